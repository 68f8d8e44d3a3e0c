"""Reassembly of flows whose rows come from a union of parts that are dealt out alike."""

from flowlens.operators import reassembly


def test_flow_of_a_union_is_one(spark):
    """Parts that are each dealt out by flow_id are joined to few partitions apart, as far as their sizes go."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        turns = spark.range(8000).select((F.col("id") % 2000).cast("string").alias("flow_id"), (F.col("id") + 1).alias("ord"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).cast("binary").alias("data"))
        placed = turns.withColumn("seq", 1 + F.coalesce(F.sum(F.octet_length("data")).over(Window.partitionBy("flow_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        syns = turns.select("flow_id").distinct().select("flow_id", F.lit(0).cast("long").alias("ord"), F.lit(None).cast("binary").alias("data"), F.lit(0).cast("long").alias("seq"), F.lit(True).alias("syn"))
        out = reassembly.reassemble(placed.withColumn("syn", F.lit(False)).unionByName(syns)).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(out) == 2000 and out["flow_id"].is_unique and set(out["segments"]) == {4} and set(out["contiguous"].map(len)) == {1024}
