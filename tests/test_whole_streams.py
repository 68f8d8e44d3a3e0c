"""Whole texts of conversations that go on beyond the caps of a first flight, and streams without a cap."""

import hashlib

from flowlens.operators import reassembly
from flowlens.plans import catalog

LONG = {1: ["ab", "cd"], 2: ["x" * 5000, "y" * 5000, "z" * 7000], 3: ["q" * 20000, "r"], 4: [f"turn {k} " for k in range(64)], 5: [f"tür {k} " for k in range(70)], 6: ["a" * 16384], 7: [None, "", "s"], 8: [None], 9: [f"{k} " * 90 for k in range(400)], None: ["n" * 17000, "o"]}


def test_nothing_is_left_out_beyond_the_caps(spark, tmp_path):
    import duckdb

    # turns of a number twice, and one without a number, have an order too
    rows = [(c, k, "user", t) for c, texts in LONG.items() for k, t in enumerate(texts)] + [(10, 1, "user", t) for t in ("b" * 9000, "a" * 9000)] + [(11, k, "user", t) for k, t in ((None, "last"), (3, "first"))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    out = catalog.QUERIES["first_flight_text"](spark, f"file://{tmp_path}").collect()
    texts = LONG | {10: ["a" * 9000, "b" * 9000], 11: ["first", "last"]}
    data = {c and str(c): "".join(t or "" for t in own).encode() for c, own in texts.items()}
    assert sorted((str(r.flow_id), r.whole_bytes, r.whole_digest) for r in out) == sorted((str(c), len(d), hashlib.md5(d).hexdigest()) for c, d in data.items())
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    same = duck.sql(catalog.ORACLE_SQL["first_flight_text"]).df()
    assert sorted(map(repr, same[["flow_id", "whole_bytes", "whole_digest"]].astype(str).itertuples(index=False, name=None))) == sorted(repr((str(r.flow_id), str(r.whole_bytes), r.whole_digest)) for r in out)


def test_gaps_overlaps_and_large_numbers(spark):
    segments = [
        ("gap", 1, 100, True, None), ("gap", 2, 106, False, b"late"), ("gap", 3, 101, False, b"abc"),
        ("over", 1, 3, False, b"cdef"), ("over", 2, 0, True, b"x"), ("over", 3, 1, False, b"abc"), ("over", 4, 1, False, b"ab"), ("over", 5, 0, False, b"before"),
        ("alone", 9, 7, False, b"no"), ("alone", 10, 9, False, b"syn"),
        ("far", 1, 2**32 - 3, True, None), ("far", 2, 2**32 + 1, False, b"beyond"), ("far", 3, 2**32 - 2, False, b"abc"),
        ("none", 1, 5, True, None),
    ]
    out = reassembly.whole_streams(spark.createDataFrame(segments, "flow_id string, ord long, seq long, syn boolean, data binary")).collect()
    want = {"gap": b"abc", "over": b"abcdef", "alone": b"nosyn", "far": b"abcbeyond", "none": b""}
    assert {r.flow_id: (r.bytes, r.digest) for r in out} == {k: (len(v), hashlib.md5(v).hexdigest()) for k, v in want.items()}
