"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language, packing, sentencepiece_codec, sharding, shared, simhash, substring_dedup, token_files, toxicity, vector_dedup


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(shared.table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_bytes(shared.table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.balanced_shards(shared.table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    crc = F.crc32(shared.text_or_empty().cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learned_and_identified(shared.table(spark, sf_dir, "documents"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_components(shared.table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learned_and_scored(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(shared.table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, shared.new_path(spark, "tokens"), vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.read_digests(spark, manifest)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of what they decode to."""
    model = vocabulary("piece_bpe_32k.model")
    # a table in between: in one task, encoding and decoding would each take a worker with a vocabulary and its words
    encoded = shared.written(sentencepiece_codec.encode_documents(shared.table(spark, sf_dir, "documents"), model), "ids")
    decoded = sentencepiece_codec.decode_documents(encoded, model)
    return decoded.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sharding": op3_sharding,
    "op4_language": op4_language,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_files": op9_token_files,
    "op10_sentencepiece": op10_sentencepiece,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
}
