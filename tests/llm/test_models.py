"""Language, toxicity and SentencePiece: held-out accuracy, the library and exact round trips."""

import random
import zlib

import numpy as np
import pytest

from flowlens.llm import language, queries, sentencepiece_codec, toxicity
from tests.llm import cases

SYLLABLES = {"aa": ["ka", "lo", "mi", "ten", "ar"], "bb": ["sch", "un", "ge", "ver", "ich"], "cc": ["ção", "inho", "es", "que", "lh"]}


def _speak(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def _spoken(n=240):
    rng = random.Random(1)
    return [(k, _speak(rng, lang, rng.randint(15, 80)), lang, "s", 0) for k, lang in enumerate(rng.choices(list(SYLLABLES), k=n))]


def _out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_of_held_out_documents(spark):
    rows = _spoken()
    rows += [(9001, None, "aa", None, 0), (9002, "", None, None, 0), (9003, "12 34 !?", "bb", None, 0), (9004, "🙂 ··", None, None, 0), (None, _speak(random.Random(3), "aa", 30), None, None, 0), rows[0], rows[0]]
    rng = random.Random(2)
    rows.append((9005, _speak(rng, "bb", 60) + " " + _speak(rng, "cc", 30), None, None, 0))
    got = language.learned_and_identified(cases.with_clashes(cases.frame(spark, rows))).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    found = {r["doc_id"]: r for r in got}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (9001, 9002, 9003, 9004))
    assert found[9005]["lang_pred"] == "bb" and 0.5 < found[9005]["score"] < 0.8
    assert found[None]["lang_pred"] == "aa" and not found[None]["held_out"]
    held = [r for r in rows if r[0] is not None and r[0] < 9000 and _out(r[0])]
    assert len(held) > 30 and all(found[r[0]]["held_out"] for r in held)
    assert np.mean([found[r[0]]["lang_pred"] == r[2] for r in held]) >= 0.98
    kept = language.with_language(cases.frame(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {9001, 9002, 9003, 9004}


def test_language_without_labels(spark):
    rows = [(1, "some words", None, None, 0)]
    assert [tuple(r) for r in language.learned_and_identified(cases.frame(spark, rows)).collect()] == [(1, False, "und", 0.0)]
    assert language.with_language(cases.frame(spark, rows)).count() == 1
    assert language.learned_and_identified(cases.frame(spark, [])).count() == 0


def test_many_languages_and_sets_of_four():
    """Rare languages count like others, and a document may have more than three."""
    rng = random.Random(11)
    speak = lambda k: " ".join("".join(rng.choices([f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{x}" for x in "klmnrst"], k=2)) for _ in range(40))
    n = 300
    counts = np.full((n, language.BUCKETS), language.SMOOTHING)
    for k in range(n):
        words = language.Words([speak(k).encode() for _ in range(20)])
        counts[k] += np.bincount(language._trigrams(words)[0], minlength=language.BUCKETS)
    model = language.Model([f"l{k}" for k in range(n)], np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).T, np.float32))
    names, scores = model.predict([speak(k).encode() for k in range(n)])
    assert names == [f"l{k}" for k in range(n)]
    four = [k for k in (3, 50, 120, 290)]
    text = " ".join([speak(3), *(speak(k) for k in four)]).encode()
    name, score = model.predict([text])
    assert name == ["l3"] and 0.3 < score[0] < 0.5


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_needs_pairs_of_terms(spark):
    """An insult alone is no label, nor is a group; both together are."""
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(1600):
        words = rng.choices(cases.WORDS, k=rng.randint(5, 40))
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["blockhead"] * insult + ["islanders"] * group
        rng.shuffle(words)
        rows.append((k, " ".join(words), None, None, 0))
        labels.append((k, 1, int(insult and group)))
    labels += [(0, 1, None), (None, 0, 1), (99999, 0, 1), labels[5]]
    rows += [(5001, None, None, None, 0), (5002, "", None, None, 0), rows[3], (None, "alpha", None, None, 0)]
    docs = cases.with_clashes(cases.frame(spark, rows))
    got = toxicity.learned_and_scored(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    truth = {i: t for i, _, t in labels if i is not None and i < 1600}
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1600 and _out(r["doc_id"])]
    assert all(r["held_out"] for r in held)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.98


def test_terms_that_count_in_company_only(spark):
    """Each of many group words is too rare among all documents; beside an insult it decides."""
    rng = random.Random(4)
    groups = [f"group{k}folk" for k in range(12)]
    rows, labels = [], []
    for k in range(5000):
        words = rng.choices(cases.WORDS, k=12)
        insult, group = rng.random() < 0.12, rng.random() < 0.3
        words += ["blockhead"] * insult + [rng.choice(groups)] * group
        rows.append((k, " ".join(words), None, None, 0))
        labels.append((k, 1, int(insult and group)))
    got = {r.doc_id: r.predicted for r in toxicity.learned_and_scored(cases.frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = [(k, t) for k, _, t in labels if _out(k)]
    assert np.mean([got[k] for k, t in held if t]) >= 0.8 and np.mean([got[k] for k, t in held if not t]) <= 0.03


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (3, 1, 0)], [(1, None, None)]])
def test_toxicity_without_labels_of_both_kinds(spark, labels):
    docs = cases.frame(spark, [(1, "alpha", None, None, 0), (3, None, None, None, 0)])
    got = toxicity.learned_and_scored(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 2 and len({r["score"] for r in got}) == 1
    assert toxicity.learned_and_scored(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


MODEL = queries.vocabulary("piece_bpe_32k.model")


def _library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _odd_text(rng, n, symbols):
    return "".join(rng.choice(symbols) for _ in range(n))


def test_codec_equals_the_library():
    rng, model, own = random.Random(2), _library(), sentencepiece_codec.Codec(MODEL)
    symbols = list("abcdetionsrh") * 3 + [" ", "  ", "   ", "\n", "漢", "ﬁ", "é", "́", "🙂", "the ", "ing", ".", "▁", "<0x0A>", "123", "ß", "\xa0"]
    for text in [_odd_text(rng, rng.randint(0, 60), symbols) for _ in range(1500)] + ["", " ", "  ", "\n", " a", "a ", "<s>"]:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text)
        assert own.decode(ids) == model.decode(model.encode(text))


@pytest.mark.parametrize("step", [17, 40])
def test_chunks_of_a_run_without_spaces(step):
    rng, model, own = random.Random(3), _library(), sentencepiece_codec.Codec(MODEL)
    for _ in range(60):
        text = _odd_text(rng, rng.randint(1, 400), "abcdetionsrhüß漢")
        assert own.to_ids(own.long_unit(own.units(text)[0], step)) == model.encode(text)


def test_documents_in_segments(spark):
    rows = cases.awkward()
    rng = random.Random(5)
    rows.append((777, _odd_text(rng, 900, "abcdetionsrhüß漢"), None, None, 0))
    rows.append((778, "tion" * 300 + "  " + "x y " * 100, None, None, 0))
    model = _library()
    docs = cases.with_clashes(cases.frame(spark, rows))
    encoded = sentencepiece_codec.encode_documents(docs, MODEL, segment=200)
    got = sorted(((r["doc_id"] or -1, r["ids_crc32"], r["n_ids"], r["text"]) for r in sentencepiece_codec.decode_documents(encoded, MODEL).collect()))
    want = []
    for r in rows:
        ids = model.encode(r[1] or "")
        want.append((r[0] or -1, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids), model.decode(ids)))
    assert got == sorted(want)
    assert sentencepiece_codec.encode_documents(docs.limit(0), MODEL).count() == 0
