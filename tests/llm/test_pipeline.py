"""The pipeline's stages one after the other against plain versions of each."""

import random

import corpus_pipeline
from flowlens.llm import queries
from tests.llm import cases
from tests.llm.test_dedup import _near_copies, _passages, _plain_removed
from tests.llm.test_near_copies import _plain_kept
from tests.llm.test_rows_and_tokens import _check_packing, _exact, _ids


def _documents():
    rows = {r[0]: r for r in _near_copies(random.Random(2)) + _passages() if r[0] is not None}
    return [(i, t, "en" if i % 2 else "de", s, n) for i, t, _, s, n in rows.values()]


def test_stages(spark, tmp_path):
    rows = _documents()
    path = f"file://{tmp_path}"
    cases.with_clashes(cases.frame(spark, rows)).write.parquet(f"{path}/documents.parquet")
    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), None
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/{k}")
        docs, columns = spark.read.parquet(f"{path}/{k}"), columns or docs.columns
        if name == "exact_dedup":
            keep = {r[0] for r in _exact(left) if r[3]}
            left = [r for r in left if r[0] in keep]
        if name == "near_dedup":
            keep = set(_plain_kept(left))
            left = [r for r in left if r[0] in keep]
        if name == "substring_dedup":
            kept = {r[0]: r[5] for r in _plain_removed(left)}
            left = [(r[0], kept[r[0]], *r[2:]) for r in left if kept[r[0]]]
        if name != "packing":
            assert docs.columns == columns
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == {r[0]: r[1] for r in left}, name
    got = docs.collect()
    _check_packing(got, 2048)
    assert {r["doc_id"] for r in got} == {r[0] for r in left}
    assert sum(r["length"] for r in got) == sum(len(_ids("byte_bpe_50k.json", r[1])) + 1 for r in left)
    assert queries.pipeline(spark, path).count() == len(got)
