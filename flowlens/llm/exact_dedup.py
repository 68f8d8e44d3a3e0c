"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort places equal ones side by side, and
whole texts of neighbours are compared. The order is by the first bytes, then by digest, so that splitter samples stay
small however long the texts are; equality is decided on whole texts only. A group may span partitions: each partition
reports its first and last run, and one pass over those edges (two for each partition) joins the runs that continue.

Defined cases: a null text counts as empty; a null identifier counts as larger than any other, and so does 2^63 - 1,
which stands for it; of rows repeated with one identifier and text one is kept, in exact_dedup the one with the
smallest hash of all its columns; an empty table gives an empty result; other columns travel unchanged or are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bytes of the text that lead the sort order; ties go by digest.
HEAD_BYTES = 64
#: Edge flags: the run holds the first row of its partition, the last one, or both.
FIRST, LAST = 1, 2

_RUNS = pa.schema([("id", pa.int64()), ("keep_id", pa.int64()), ("n", pa.int64()), ("kept", pa.bool_()), ("sha", pa.string()), ("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())])
_RUNS_DDL = "id long, keep_id long, n long, kept boolean, sha string, part int, edge int, text string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with the smallest identifier and size of their run; the edge runs also with their text."""
    part = TaskContext.get().partitionId()
    ids: list[np.ndarray] = []
    text = sha = None
    first = True

    def closed(last: bool) -> Iterator[pa.RecordBatch]:
        own = np.concatenate(ids)
        n, edge = len(own), FIRST * first + LAST * last
        kept = np.zeros(n, bool)
        kept[0] = True
        columns = [pa.array(own), pa.array(np.full(n, own[0])), pa.array(np.full(n, n)), pa.array(kept), pa.array([sha] * n, pa.string()), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, edge, np.int32)), pa.nulls(n, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, schema=_RUNS)
        if edge:
            yield pa.RecordBatch.from_pylist([{"id": None, "keep_id": int(own[0]), "n": n, "kept": None, "sha": None, "part": part, "edge": edge, "text": text}], schema=_RUNS)

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, shas, id_ = batch.column("text"), batch.column("sha"), batch.column("id").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(~pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)) + 1
        bounds = [0, *starts.tolist(), batch.num_rows]
        simple_ids, simple_n, simple_sha = [], [], []
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if k == 0 and text is not None and texts[0].as_py() == text:
                ids.append(id_[a:b])
                continue
            if k >= 2 and not first:  # a run that began and ended within this batch
                simple_ids.append(np.concatenate(ids))
                simple_n.append(len(simple_ids[-1]))
                simple_sha.append(sha)
            elif text is not None:
                yield from closed(False)
                first = False
            ids, sha = [id_[a:b]], shas[a].as_py()
            if k in (0, len(bounds) - 2) or first:
                text = texts[a].as_py()
        if simple_n:
            n = np.array(simple_n)
            own = np.concatenate(simple_ids)
            heads = np.concatenate([[0], np.cumsum(n)[:-1]])
            kept = np.zeros(len(own), bool)
            kept[heads] = True
            columns = [pa.array(own), pa.array(np.repeat(own[heads], n)), pa.array(np.repeat(n, n)), pa.array(kept), pa.array(simple_sha, pa.string()).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.full(len(own), part, np.int32)), pa.array(np.zeros(len(own), np.int32)), pa.nulls(len(own), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=_RUNS)
    if text is not None:
        yield from closed(True)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edge runs in order of partition, joined where the text goes on; a row for each run of a group that spans partitions."""
    members: list[tuple[int, int]] = []
    text, keep, n = None, 0, 0

    def closed() -> Iterator[pa.RecordBatch]:
        if len(members) > 1:
            rows = [{"part": p, "edge": e, "group_keep": keep, "group_n": n, "head": k == 0} for k, (p, e) in enumerate(members)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("edge", pa.int32()), ("group_keep", pa.int64()), ("group_n", pa.int64()), ("head", pa.bool_())]))

    for batch in batches:
        for row in batch.to_pylist():
            if not members or row["text"] != text:
                yield from closed()
                members, text, keep, n = [], row["text"], row["keep_id"], 0
            members.append((row["part"], row["edge"]))
            n += row["n"]
    yield from closed()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of docs: its identifier, keep_id, group_size, kept and text_sha256 of the normalised text."""
    shared.bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    partitions = partitions or shared.partitions_for(spark, shared.planned_bytes(docs), 64 << 20)
    rows = docs.select(shared.id_or_last(id_col).alias("id"), shared.space_normalised(shared.text_or_empty(text_col)).alias("text"))
    rows = rows.withColumn("head", F.substring(F.col("text").cast("binary"), 1, HEAD_BYTES)).withColumn("sha", F.sha2("text", 256))
    in_order = rows.repartitionByRange(partitions, "head", "sha", "id").sortWithinPartitions("head", "sha", "text", "id")
    runs = shared.written(in_order.select("id", "text", "sha").mapInArrow(_runs, _RUNS_DDL), "runs")
    edges = runs.filter(F.col("text").isNotNull()).select("part", "edge", "keep_id", "n", "text").repartition(1).sortWithinPartitions("part", "edge")
    # at most two rows for each partition
    spans = F.broadcast(edges.mapInArrow(_joined, "part int, edge int, group_keep long, group_n long, head boolean"))
    out = runs.filter(F.col("text").isNull()).join(spans, ["part", "edge"], "left")
    known = lambda c: F.when(F.col(c) < shared.LAST_ID, F.col(c))
    return out.select(
        known("id").alias(id_col),
        F.coalesce("group_keep", "keep_id").alias("keep_id"),
        F.coalesce("group_n", "n").alias("group_size"),
        (F.col("kept") & F.coalesce("head", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    ).withColumn("keep_id", known("keep_id"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    groups = shared.written(exact_groups(docs, id_col, text_col), "groups")
    marked = groups.groupBy(shared.id_or_last(id_col).alias("id"), F.col("text_sha256").alias("key")).agg((~F.max("kept")).alias("gone"), F.count(F.lit(1)).alias("n"))
    sha = F.sha2(shared.space_normalised(shared.text_or_empty(text_col)), 256)
    return shared.without(docs, marked.filter("gone or n > 1"), sha, id_col)
