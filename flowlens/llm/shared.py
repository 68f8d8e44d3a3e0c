"""The shared folder, written tables and small column helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: One or more of these bytes stand between words.
SPACE = r"\x20\x09-\x0D"
#: Stands for a missing identifier, so that it comes after every other.
LAST_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach: spark.checkpoint.dir.

    Where that is unset it is a temporary folder, if the session runs on one machine; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/flowlens-{name}-{uuid.uuid4().hex}"


#: Settings of Arrow batches -> Spark's value, and the one that holds here: texts differ in length by orders of magnitude.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(8 << 20))}


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches between JVM and Python, unless the session has a bound of its own."""
    for key, (usual, bound) in _BATCHES.items():
        if usual is None or spark.conf.get(key, usual) == usual:
            spark.conf.set(key, bound)


def release_memory() -> None:
    """Give back to the system what earlier tasks of this Python worker have freed; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Whether a query's shuffle files go when it ends; partitions of a shuffle, and whether small ones are joined.
_CLEANED, _SHUFFLED, _JOINED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"


#: Tables that are there, one list for each open scope; those of the first go when the driver's process ends.
_SCOPES: list[list[tuple[SparkSession, str]]] = [[]]


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Tables that are written within go at its end."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            remove(spark, path)


@atexit.register
def _remove_left() -> None:
    for spark, path in [x for scope in _SCOPES for x in scope]:
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            remove(spark, path)


def kept_until_exit(spark: SparkSession, path: str) -> str:
    """path, noted as a temporary one."""
    _SCOPES[-1].append((spark, path))
    return path


def written(df: DataFrame, name: str, path: str | None = None, partitions: int | None = None, joined: bool = True) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs no earlier stage.

    The table goes with the scope it is written in, or when the driver's process ends, unless dropped() comes first.
    With `partitions`, shuffles on the way have as many, before adaptive execution joins small ones (unless not `joined`).
    """
    spark = df.sparkSession
    path = path or kept_until_exit(spark, new_path(spark, name))
    settings = {_CLEANED: "true"}  # what the table is made from is not needed again
    if partitions:
        settings[_SHUFFLED] = str(partitions)
    if not joined:
        settings[_JOINED] = "false"
    # None where the session has no value of its own; a default to ask with would have to be of the setting's type
    usual = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in usual.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._flowlens_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._flowlens_path)
        for scope in _SCOPES:
            scope[:] = [x for x in scope if x[1] != table._flowlens_path]


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def partitions_for(spark: SparkSession, total_bytes: int, each: int = 16 << 20) -> int:
    """As many partitions as give `each` bytes to a task, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_bytes / each), 1)


#: How much larger texts are in memory than in compressed files, about; only the number of partitions depends on it.
_UNPACKED = 3


def planned_bytes(df: DataFrame) -> int:
    """What Spark's planner takes for the size of df's inputs, unpacked; no job runs."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if found >= 1 << 60 else found * _UNPACKED  # the planner's word for "not known"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own that df has not."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, marked: DataFrame, here, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that a table marks; of rows that stay and are there several times over, one.

    marked (id, key, gone, n): identifier (LAST_ID for none) and key of rows to leave out, or of rows that stand n times
    in docs; here: the column that gives a row's key. Of repeated rows the one with the smallest hash of its columns
    stays (maps do not count).
    """
    i, k, at = fresh(docs, "id", "key", "at")
    own = marked.select(F.col("id").alias(i), F.col("key").alias(k), "gone", "n")
    same = (id_or_last(id_col) == F.col(i)) & (here == F.col(k))
    rest = docs.join(own.select(i, k), same, "left_anti")
    repeated = own.filter("not gone and n > 1").select(i, k)
    if repeated.isEmpty():
        return rest
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = docs.join(repeated, same).withColumn(at, F.row_number().over(Window.partitionBy(i, k).orderBy(F.xxhash64(*plain))))
    return rest.unionByName(one.filter(F.col(at) == 1).select(*columns))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_or_last(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def held_out(name: str = "doc_id") -> Column:
    """True for the quarter of documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def space_normalised(text: Column) -> Column:
    """Each run of white space as one space; a lone space is left alone, so few places are rewritten."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
