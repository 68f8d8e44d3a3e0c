"""Exact dedup, sharding, token files and packing against plain versions."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowlens.llm import exact_dedup, packing, queries, sharding, token_files, tokens
from tests.llm import cases

LAST = 2**63 - 1


def _exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda x: LAST if x is None else x)
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return Counter(out)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_exact_groups(spark, partitions):
    rows = cases.awkward()
    got = exact_dedup.exact_groups(cases.with_clashes(cases.frame(spark, rows)), partitions=partitions)
    assert Counter(tuple(r) for r in got.collect()) == _exact(rows)


def test_exact_groups_of_one_text(spark):
    rows = [(i, "a  b", None, None, 4) for i in range(500)]
    got = exact_dedup.exact_groups(cases.frame(spark, rows), partitions=7).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(0, 500)} and sum(r["kept"] for r in got) == 1


def test_exact_dedup_keeps_columns_and_first_rows(spark):
    rows = cases.awkward()
    docs = cases.with_clashes(cases.frame(spark, rows))
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    want = Counter(k[0] for k in _exact(rows) if k[3])
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def _shards(spark, rows, shards):
    docs = cases.with_clashes(cases.frame(spark, rows))
    out = sharding.balanced_shards(docs, shards).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in out:
        assert r["size"] == len((r["text"] or "").encode()) + 8
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    return [sizes[s] for s in range(shards)]


def test_shards_have_near_equal_bytes(spark):
    rows = [(i, "word " * (1 + i * 7919 % 50), None, None, 0) for i in range(2000)]
    sizes = _shards(spark, rows, 8)
    assert max(sizes) - min(sizes) <= 2 * 258


def test_shards_split_one_large_group(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}", None, None, 0) for i in range(3000)]
    sizes = _shards(spark, rows, 6)
    assert max(sizes) - min(sizes) <= 60


def test_columns_of_any_name_travel_along(spark):
    from pyspark.sql import functions as F

    docs = cases.frame(spark, [(k, f"t {k}", None, None, 0) for k in range(40)])
    docs = docs.withColumns({c: F.col("doc_id") * 2 for c in ("hash", "id", "range", "__id", "__h", "at", "key", "sha")})
    for out in (sharding.balanced_shards(docs, 3), exact_dedup.exact_dedup(docs)):
        assert [c for c in out.columns if c not in ("size", "slot", "shard")] == docs.columns
        assert all(r["hash"] == r["id"] == r["range"] == r["__id"] == r["key"] == r["sha"] == 2 * r["doc_id"] for r in out.collect())


def test_one_of_repeated_rows_stays_whatever_the_order(spark):
    rows = [(1, "a  b", lang, "s", 0) for lang in ("x", "y", "z")] + [(1, "a b", "w", "s", 0), (2, "a b", "v", "s", 0), (None, "q", "u", "s", 0), (None, "q", "t", "s", 0)]
    kept = [sorted(((r.doc_id, r.lang) for r in exact_dedup.exact_dedup(cases.frame(spark, own)).collect()), key=str) for own in (rows, rows[::-1])]
    assert kept[0] == kept[1] and [k[0] for k in kept[0]] == [1, None]


def test_shards_of_awkward_rows(spark):
    _shards(spark, cases.awkward(), 5)
    assert sharding.balanced_shards(cases.frame(spark, []), 4).count() == 0


def _ids(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(name))
    return t.encode(text or "", add_special_tokens=False).ids


_VOCABULARIES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", _VOCABULARIES)
def test_ids_of_added_tokens(name):
    """Strings of added tokens, alone, in words, in other case, repeated, and cut short, give the library's ids."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(name))
    strings = [x.content for x in t.get_added_tokens_decoder().values()]
    texts = [form.format(s) for s in strings for form in ("{0}", "a {0} b", "a{0}b", "{0}{0}", " {0}", "{0} ", "x  {0}\n{0} y.", "é {0} Ж")]
    texts += [x.upper() for x in texts] + [s[:-1] for s in strings] + ["plain text", "", " "]
    own = tokens.encoder(queries.vocabulary(name))
    found = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert found == [t.encode(x, add_special_tokens=False).ids for x in texts]
    t.encode_special_tokens = True
    as_text = tokens.encoder(queries.vocabulary(name), added_as_text=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in as_text.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, tmp_path):
    rows = cases.awkward()
    docs = cases.with_clashes(cases.frame(spark, rows))
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}", queries.vocabulary("word_bpe_49k.json"), end_id=2, sequence=64)
    got = sorted(token_files.read_digests(spark, manifest).collect(), key=lambda r: r["start"])
    want, start = [], 0
    for r in sorted(rows, key=lambda r: (LAST if r[0] is None else r[0], r[1] or "")):
        ids = [*_ids("word_bpe_49k.json", r[1]), 2]
        want.append((r[0], start, len(ids), _crc(ids)))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    ids = {r["start"]: r["ids"] for r in token_files.read_documents(spark, manifest).collect()}
    assert all(zlib.crc32(ids[s]) == c for _, s, _, c in want)


def test_token_file_layout(spark, tmp_path):
    import pyarrow as pa

    docs = cases.frame(spark, [(1, "one two three", None, None, 0)]).coalesce(1)
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}", queries.vocabulary("word_bpe_49k.json"), end_id=2, sequence=8)
    path = manifest.first()["path"].removeprefix("file://")
    table = pa.ipc.open_file(pa.memory_map(f"{path}.arrow")).read_all()
    assert table.schema.field("ids").type.list_size == 8 and table["mask"].to_pylist() == [[1] * 4 + [0] * 4]


def _check_packing(got, capacity):
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_packing(spark):
    rows = cases.awkward()
    got = packing.pack_documents(cases.with_clashes(cases.frame(spark, rows)), queries.vocabulary("byte_bpe_50k.json"), 0, 256).collect()
    n = _check_packing(got, 256)
    want = Counter()
    for r in rows:
        ids = [*_ids("byte_bpe_50k.json", r[1]), 0]
        bounds = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        want.update((r[0], k, a, b - a, _crc(ids[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert n <= -(-sum(k[3] for k in want.elements()) // 256) + 3


def _plain_best_fit(lengths, capacity):
    """Sequences that best fit needs, pieces taken longest first, one at a time."""
    gaps, n = [], 0
    for s in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, s)
        width = gaps.pop(at) if at < len(gaps) else capacity
        n += at == len(gaps) and width == capacity
        if width > s:
            bisect.insort(gaps, width - s)
    return n


def test_brackets_match_the_narrowest_free_gap():
    rng = random.Random(4)
    for _ in range(200):
        rows = sorted(((rng.randint(1, 9), not rng.random() < 0.5) for _ in range(rng.randint(0, 40))), key=lambda r: (-r[0], not r[1]))
        free, want = [], []
        for k, (_, is_gap) in enumerate(rows):
            want.append(-1 if is_gap or not free else free.pop())
            if is_gap:
                free.append(k)
        assert packing.matched(np.array([g for _, g in rows], bool)).tolist() == want


@pytest.mark.parametrize(("kind", "rows"), [("many", packing.ROWS), ("many", 1500), ("short", packing.ROWS), ("long", packing.ROWS), ("alike", 900)])
def test_packing_is_near_best_fit(spark, monkeypatch, rows, kind):
    """Rounds, in one task and in several, need hardly more sequences than best fit of one piece after the other."""
    monkeypatch.setattr(packing, "ROWS", rows)
    rng, capacity = np.random.default_rng(3), 256
    lengths = {
        "many": np.minimum(rng.geometric(1 / 60, 5000), capacity),
        "short": np.concatenate([rng.integers(1, 6, 3000), rng.integers(130, 140, 40)]),
        "long": rng.integers(100, capacity + 1, 3000),
        "alike": np.concatenate([np.full(2000, 97), np.full(900, 62)]),
    }[kind]
    pieces = spark.createDataFrame([(k, 0, 0, int(s), 0, k) for k, s in enumerate(lengths)], packing._PIECES + ", pid long").repartition(5)
    got = packing.packed(pieces, capacity).collect()
    assert Counter((r["doc_id"], r["length"]) for r in got) == Counter(enumerate(lengths.tolist()))
    n = _check_packing(got, capacity)
    assert n <= _plain_best_fit(lengths.tolist(), capacity) * 1.02 + 3


def test_packing_of_no_rows(spark):
    assert packing.pack_documents(cases.frame(spark, []), queries.vocabulary("byte_bpe_50k.json")).count() == 0
