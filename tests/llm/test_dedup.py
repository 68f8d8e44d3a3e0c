"""SimHash, substring and vector dedup against plain versions."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from flowlens.llm import simhash, substring_dedup, vector_dedup
from flowlens.llm.components import connected_components, forest
from flowlens.llm.suffix_merge import least_of_windows
from tests.llm import cases

LAST = 2**63 - 1


def _roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def test_forest_and_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    want = _roots(600, links)
    a, b = forest(*(np.array(x) for x in zip(*links)))
    assert _roots(600, list(zip(a.tolist(), b.tolist()))) == want
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    linked = {x for p in links if p[0] != p[1] for x in p}
    assert got == {x: want[x] for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def _plain_simhash(rows):
    fps = [_plain_fingerprint(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    roots = _roots(len(rows), links)
    least = {}
    for r, root in zip(rows, roots):
        least[root] = min(least.get(root, LAST), LAST if r[0] is None else r[0])
    return Counter((r[0], f"{f:016x}", least[root]) for r, f, root in zip(rows, fps, roots))


def _near_copies(rng):
    rows = cases.awkward()
    long = " ".join(rng.choices(cases.WORDS, k=2500)).split()
    for k in range(25):
        words = list(long)
        for _ in range(k % 5):
            words[rng.randrange(len(words))] = rng.choice(cases.WORDS)
        rows.append((1000 + k, " ".join(words), None, None, 0))
    return rows


def test_simhash(spark):
    rows = _near_copies(random.Random(2))
    docs = cases.with_clashes(cases.frame(spark, rows))
    got = Counter(tuple(r) for r in simhash.near_components(docs).collect())
    assert got == _plain_simhash(rows)


def test_simhash_of_no_rows(spark):
    assert simhash.near_components(cases.frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [simhash.BLOCK, 16])
def test_grid_finds_all_near_fingerprints(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    if block < simhash.NEIGHBOURS * simhash.LIGHT:
        monkeypatch.setattr(simhash, "LIGHT", 0)
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:150]:
        for _ in range(3):
            fps.add(f ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))))
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << a) ^ (1 << b) for a in range(0, 30) for b in range(a)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    at = {f: k for k, f in enumerate(signed)}
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    want = _roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert _roots(len(fps), [(at[r["a"]], at[r["b"]]) for r in links]) == want


def _plain_removed(rows):
    first = {}
    key = lambda r: LAST if r[0] is None else r[0]
    for r in rows:
        text = (r[1] or "").encode()
        for i in range(len(text) - 49):
            w = text[i : i + 50]
            first[w] = min(first.get(w, LAST), key(r))
    out = []
    for r in rows:
        text = (r[1] or "").encode()
        gone = bytearray(len(text))
        for i in range(len(text) - 49):
            if first[text[i : i + 50]] < key(r):
                gone[i : i + 50] = b"\1" * 50
        rest = bytes(c for c, g in zip(text, gone) if not g)
        runs = [b"".join(bytes([c]) for c, _ in own) for g, own in itertools.groupby(zip(text, gone), lambda x: x[1]) if not g]
        out.append((r[0], len(text), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), rest, "".join(x.decode("utf-8", "ignore") for x in runs)))
    return out


def _passages():
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choices(cases.WORDS, k=n)) + "".join(rng.choices("qwzé漢", k=6))
    shared = [say(12) for _ in range(5)] + ["z" * 90, "ab" * 60]
    rows = cases.awkward(seed=3, n=20)
    for k in range(60):
        parts = [say(rng.randint(0, 8)) if rng.random() < 0.6 else rng.choice(shared)[rng.randint(0, 9) :] for _ in range(4)]
        rows.append((2000 + k, rng.choice(["", " ", "\n"]).join(parts), None, None, 0))
    return [r for r in rows if len(r[1] or "") < 20000]


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 3])
def test_repeated_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = _passages()
    rows += [(3000, "\u0129" + "x" * 60 + "ê", None, None, 0), (3001, "Qé" + "x" * 60 + "è", None, None, 0)]
    assert "Q" in {r[5] for r in _plain_removed(rows)}
    docs = cases.with_clashes(cases.frame(spark, rows))
    plain = _plain_removed(rows)
    got = Counter(tuple(r) for r in substring_dedup.repeated_bytes(docs).collect())
    assert got == Counter((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in plain)
    assert sum(r[2] for r in plain) > 1000
    cut = substring_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    want = Counter((r[0], r[5]) for r in plain if r[5] or not r[1])
    assert Counter((r["doc_id"], r["text"] or "") for r in cut.collect()) == want


def test_repeated_bytes_of_no_rows(spark):
    assert substring_dedup.repeated_bytes(cases.frame(spark, [])).count() == 0
    assert substring_dedup.without_repeats(cases.frame(spark, [(1, None, None, None, 0), (2, "", None, None, 0)])).count() == 2


@pytest.mark.parametrize("symbols", [b"ab", b"abc", bytes(range(256)), b"a"])
def test_merged_transforms(symbols):
    rng = random.Random(8)
    for trial in range(60):
        depth = rng.choice([3, 8, 20])
        base = bytes(rng.choices(symbols, k=30))
        strings = [bytes(rng.choices(symbols, k=rng.randint(0, 40))) for _ in range(rng.randint(2, 40))] + [base[:10], base[:25], b"x" + base]
        strings = list(dict.fromkeys(strings))
        least = np.array([rng.randint(0, 20) for _ in strings])
        low = {}
        for s, v in zip(strings, least.tolist()):
            for j in range(len(s) - depth + 1):
                low[s[j : j + depth]] = min(low.get(s[j : j + depth], 99), v)
        want = {(i, j, low[s[j : j + depth]]) for i, s in enumerate(strings) for j in range(len(s) - depth + 1) if low[s[j : j + depth]] < least[i]}
        n = rng.choice([1, 2, 4, 7])
        got = least_of_windows(strings, least, depth, np.sort(np.array([rng.randrange(n) for _ in strings])))
        assert set(zip(*(x.tolist() for x in got))) == want


def _vectors(rng):
    rows = []
    for label in (0, 1, None):
        centres = rng.standard_normal((12, 16))
        for c in centres:
            for _ in range(rng.integers(1, 40)):
                rows.append((c + rng.standard_normal(16) * rng.choice([0, 0.02, 0.1, 0.2]), label))
    rows = [([float(np.float32(x)) for x in v], label) for v, label in rows]
    rows += [(None, 0), ([], 0), ([0.0] * 16, 0), ([1.0] * 15 + [None], 0), ([1.0] * 15 + [float("nan")], 1), ([1.0] * 15 + [float("inf")], 1), ([1.0] * 8, 0), ([2.0] * 8, 0), ([1e300] * 16, 1), ([1.0] * 16, 1), ([-0.0] + [1.0] * 15, 1), ([0.0] + [1.0] * 15, 1)]
    out = [(k, v, label) for k, (v, label) in enumerate(rows)]
    return out + [out[0], out[0], (None, *out[1][1:])]


@pytest.mark.parametrize("block", [vector_dedup.BLOCK, 24])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "LEAF", 32)
    rows = _vectors(np.random.default_rng(5))
    vectors = cases.with_clashes(cases.frame(spark, rows, "vec_id long, embedding array<double>, label int")).withColumnRenamed("n", "n_links")
    got = Counter(tuple(r) for r in vector_dedup.vector_components(vectors).collect())
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        u = np.array(v) / np.abs(v).max() if ok else None
        unit.append(u / np.linalg.norm(u) if ok else None)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    n = Counter(x for p in links for x in p)
    roots = _roots(len(rows), links)
    ids = [LAST if r[0] is None else r[0] for r in rows]
    least = {}
    for i, root in zip(ids, roots):
        least[root] = min(least.get(root, LAST), i)
    want = Counter()
    for k, r in enumerate(rows):
        c = least[roots[k]]
        want[r[0], n[k], None if c == LAST else c, ids[k] == c] += 1
    found = sum(min(got[k], want[k]) for k in want) / len(rows)
    assert found >= 0.97
    assert sum(k[1] * m for k, m in got.items()) >= 0.97 * 2 * len(links)


@pytest.mark.parametrize("dim", [16, 64, 128, 384])
def test_recall_and_copies_in_any_dimension(dim):
    """Pairs just at the least similarity meet in a leaf of some tree; a vector is in few leaves."""
    rng = np.random.default_rng(dim)
    n = 20_000
    unit = rng.standard_normal((n, dim))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    away = rng.standard_normal((n // 2, dim))
    away -= (away * unit[::2]).sum(axis=1, keepdims=True) * unit[::2]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    unit[1::2] = 0.935 * unit[::2] + np.sqrt(1 - 0.935**2) * away
    levels = vector_dedup.levels_for(n)
    met, copies = np.zeros(n // 2, bool), 0
    for t in range(vector_dedup.TREES):
        rows, leaves = vector_dedup.Tree(unit, levels, t).leaves(unit, np.full(n, levels))
        copies += len(rows) / n
        first = set(zip((rows[rows % 2 == 0] // 2).tolist(), leaves[rows % 2 == 0].tolist()))
        for r, leaf in zip((rows[rows % 2 == 1] // 2).tolist(), leaves[rows % 2 == 1].tolist()):
            met[r] |= (r, leaf) in first
    assert met.mean() >= 0.97 and copies <= 40


def test_no_vectors(spark):
    empty = cases.frame(spark, [], "vec_id long, embedding array<double>, label int")
    assert vector_dedup.vector_components(empty).count() == 0
