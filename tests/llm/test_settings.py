"""Operators in a session that leaves Spark's settings at their defaults."""

import corpus_pipeline
import pytest

from flowlens.llm import shared, substring_dedup
from tests.llm import cases

_SETTINGS = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]


@pytest.fixture
def plain(spark):
    session = spark.newSession()
    for key in _SETTINGS:
        session.conf.unset(key)
    return session


def test_written_leaves_unset_settings_unset(plain):
    table = shared.written(plain.range(20).groupBy("id").count(), "unset", partitions=3, joined=False)
    assert table.count() == 20
    assert [plain.conf.get(key, None) for key in _SETTINGS] == [None] * 3
    assert plain.conf.get("spark.sql.shuffle.partitions") == "200"


def test_written_puts_settings_back(plain):
    plain.conf.set("spark.sql.shuffle.partitions", "7")
    shared.written(plain.range(20).groupBy("id").count(), "set", partitions=3, joined=False)
    assert [plain.conf.get(key, None) for key in _SETTINGS] == ["7", None, None]


def test_repeated_passages_without_settings(plain):
    passage = "a passage of more than fifty bytes that two documents have alike"
    docs = cases.frame(plain, [(1, "x " + passage, None, None, 0), (2, passage + " y", None, None, 0)])
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in substring_dedup.repeated_bytes(docs).collect()}
    assert got == {1: (0, 0), 2: (len(passage), 1)}


def test_fourth_stage_without_settings(plain):
    passage = "a passage of more than fifty bytes that two documents have alike"
    docs = cases.frame(plain, [(1, "x " + passage, None, None, 0), (2, passage + " y", None, None, 0)])
    name, stage = corpus_pipeline.STAGES[3]
    assert name == "substring_dedup"
    assert {r["doc_id"]: r["text"] for r in stage(plain, docs, "").collect()} == {1: "x " + passage, 2: " y"}
