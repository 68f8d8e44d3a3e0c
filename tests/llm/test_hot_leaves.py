"""Many near copies of one vector: they are all in the same leaves, and every leaf sees all their pairs."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.llm import vector_dedup
from tests.llm import cases


def _leaf(n, nth, leaves):
    """The rows of the nth of the leaves that n near copies share."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal(64) + 0.01 * rng.standard_normal((n, 64))
    same = {"label": "1", "dim": 64, "leaf": leaves[nth], "x": 0, "y": 0, "block": 0, "n": 1, "leaves": leaves, "earlier": leaves[:nth]}
    kinds = {"label": pa.string(), "dim": pa.int32(), "leaf": pa.int64(), "x": pa.int32(), "y": pa.int32(), "block": pa.int32(), "n": pa.int64(), "leaves": pa.list_(pa.int64()), "earlier": pa.list_(pa.int64())}
    columns = {k: pa.array([same[k]] * n, kind) for k, kind in kinds.items()} | {"node": pa.array(range(n), pa.int64()), "v": pa.array(list(v), pa.list_(pa.float64()))}
    return pa.RecordBatch.from_pydict(columns)


def test_pairs_count_in_their_first_leaf_and_soon():
    leaves = [5 + k for k in range(24)]
    first = list(vector_dedup._compared(iter([_leaf(900, 0, leaves)])))
    assert {r["w"] for b in first for r in b.to_pylist() if r["w"] is not None} == {899}
    later = _leaf(900, 23, leaves)
    start = time.process_time()
    assert sum(b.num_rows for b in vector_dedup._compared(iter([later]))) == 0
    assert time.process_time() - start < 1  # 24 * 24 comparisons of leaves for each of 404,550 pairs take longer


def test_groups_that_go_on_in_the_next_batch():
    leaves = [7, 9]
    whole = _leaf(300, 0, leaves)
    parts = [whole.slice(a, 70) for a in range(0, 300, 70)]
    found = [r for b in vector_dedup._compared(iter(parts)) for r in b.to_pylist()]
    assert sorted((r["a"], r["w"]) for r in found if r["w"] is not None) == [(k, 299) for k in range(300)]
    assert {r["b"] for r in found if r["b"] is not None} == {0}


def test_single_precision_is_moved_as_it_is(spark):
    vectors = cases.frame(spark, [(1, [1.0, 2.0], 3), (2, [1.0, 2.5], 3)], "vec_id long, embedding array<float>, label int")
    seen = []
    usual = vector_dedup._in_leaves
    try:
        vector_dedup._in_leaves = lambda walked: seen.append(walked.schema["v"].dataType.simpleString()) or usual(walked)
        got = {r["vec_id"]: r["n_links"] for r in vector_dedup.vector_components(vectors).select("vec_id", F.col("n_links")).collect()}
    finally:
        vector_dedup._in_leaves = usual
    assert seen == ["array<float>"] and got == {1: 1, 2: 1}
