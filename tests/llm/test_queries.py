"""The registered queries on small tables against plain versions of their contracts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowlens.llm import queries
from tests.llm import cases
from tests.llm.test_dedup import _plain_removed, _plain_simhash, _roots
from tests.llm.test_models import LABELS, MODEL, _out, _spoken
from tests.llm.test_rows_and_tokens import LAST, _check_packing, _crc, _exact, _ids


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents, labels and embeddings, and their rows."""
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    rng = random.Random(12)
    rows = cases.awkward(seed=5, n=30)
    spoken = [(20_000 + i, t, lang, s, n) for i, t, lang, s, n in _spoken(120)]
    passage = " ".join(rng.choices(cases.WORDS, k=30))
    rows += spoken + [(30_000 + k, f"{k} {passage} {rng.random()}", "aa", None, 0) for k in range(6)]
    rows.append((30_100, "an <|endoftext|> within", None, None, 0))
    labels = [(r[0], 1, int("alpha" in (r[1] or ""))) for r in rows if r[0] is not None]
    centres = np.random.default_rng(2).standard_normal((6, 12))
    vectors = [(k, [float(x) for x in np.float32(centres[k % 6] + 0.15 * np.random.default_rng(k).standard_normal(12))], k % 2 if k % 9 else None) for k in range(150)]
    cases.frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label long").write.parquet(f"{path}/embeddings.parquet")
    return path, rows, labels, vectors


def _run(spark, tables, name):
    return queries.QUERIES[name](spark, tables[0])


def test_op1(spark, tables):
    got = _run(spark, tables, "op1_simhash").select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(tuple(r) for r in got) == _plain_simhash(tables[1])


def test_op2(spark, tables):
    got = _run(spark, tables, "op2_substring_dedup").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    plain = _plain_removed(tables[1])
    assert Counter(tuple(r) for r in got) == Counter((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in plain)


def test_op3(spark, tables):
    got = _run(spark, tables, "op3_sharding").collect()
    text = lambda r: (r[1] or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len(text(r)) + 8, zlib.crc32(text(r))) for r in tables[1])
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # one row alone is larger than a shard here; the others lie between its neighbours' borders
    assert sum(sizes.values()) == sum(len(text(r)) + 8 for r in tables[1])


def test_op4(spark, tables):
    got = _run(spark, tables, "op4_language").collect()
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((r[0], r[0] is not None and _out(r[0])) for r in tables[1])
    truth = {r[0]: r for r in tables[1]}
    for r in got:
        if not any(map(str.isalpha, truth[r.doc_id][1] or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    held = [r for r in got if r.held_out and 20_000 <= r.doc_id < 30_000]
    assert len(held) > 15 and np.mean([r.lang_pred == truth[r.doc_id][2] for r in held]) >= 0.95


def test_op5(spark, tables):
    vectors = tables[3]
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in vectors]
    links = [(i, j) for i in range(len(vectors)) for j in range(i) if vectors[i][2] is not None and vectors[i][2] == vectors[j][2] and unit[i] @ unit[j] >= 0.93]
    n, roots = Counter(x for p in links for x in p), _roots(len(vectors), links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in _run(spark, tables, "op5_vector_dedup").collect()}
    want = {k: (n[k], roots[k], roots[k] == k) for k in range(len(vectors))}
    assert len(links) > 100 and np.mean([got[k] == want[k] for k in want]) >= 0.97


def test_op6(spark, tables):
    got = _run(spark, tables, "op6_packing").collect()
    want = Counter()
    for r in tables[1]:
        ids = [*_ids("byte_bpe_50k.json", r[1]), 0]
        bounds = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.update((r[0], k, a, b - a, _crc(ids[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert _check_packing(got, 2048) <= -(-sum(k[3] for k in want.elements()) // 2048) + 1


def test_op7(spark, tables):
    got = _run(spark, tables, "op7_toxicity").collect()
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((r[0], r[0] is not None and _out(r[0])) for r in tables[1])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_op8(spark, tables):
    got = _run(spark, tables, "op8_exact_dedup").select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter(tuple(r) for r in got) == _exact(tables[1])


def test_op9(spark, tables):
    got = sorted(_run(spark, tables, "op9_token_files").collect(), key=lambda r: r.start)
    want, start = [], 0
    for r in sorted(tables[1], key=lambda r: (LAST if r[0] is None else r[0], r[1] or "")):
        ids = [*_ids("word_bpe_49k.json", r[1]), 2]
        want.append((r[0], start, len(ids), _crc(ids)))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want


def test_op10(spark, tables):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = Counter((r.doc_id, r.n_ids, r.ids_crc32, r.text_sha256) for r in _run(spark, tables, "op10_sentencepiece").collect())
    want = Counter()
    for r in tables[1]:
        ids = model.encode(r[1] or "")
        want[r[0], len(ids), _crc(ids), hashlib.sha256(model.decode(ids).encode()).hexdigest()] += 1
    assert got == want
