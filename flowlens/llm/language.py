"""Language identification as a mixture of languages in each document.

Learning counts hashed byte trigrams of words per language, on a bounded sample of the labelled documents. Each word of
a document then has a likelihood under each language, and expectation-maximisation finds the document's proportions
over all of them. Sets of languages, grown by one in order of proportion, are refitted to convergence and compared by
log-likelihood less a penalty for each language; a document's set grows until two more languages in a row gain nothing.
The largest proportion in the chosen set is the prediction, and its share the score. Every labelled language is learned.

Defined cases: a null text, or one without a letter, is `und` with score 0, and so is every text if no language could be
learned; rows without a language teach nothing; repeated rows are scored each; an empty table gives an empty result.
A prediction reads the text alone. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import Words, slices

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Documents of each language that the model is fitted on, about.
PER_LANGUAGE = 1500
#: Added to each count.
SMOOTHING = 0.2
#: What a language more must gain in log-likelihood: PENALTY x ln(words).
PENALTY = 3.0
#: Expectation-maximisation ends when no share moves by CONVERGED, after STEPS steps at the latest.
CONVERGED, STEPS = 2e-3, 50
#: Numbers (trigrams x languages) that are worked on at once.
CHUNK = 1 << 21


def _trigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each byte of a word, and where each word begins among them."""
    b = words.bytes.astype(np.uint32)
    code = np.zeros(len(b), np.uint32)
    code[1:-1] = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> 16
    inside = words.bytes != 0x20
    lengths = words.ends - words.starts
    return code[inside], np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    #: log-probability of each bucket under each language
    log_p: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for a, b in slices([len(x) for x in texts], max(1, CHUNK // max(1, len(self.languages)))):
            found = self._predict(texts[a:b])
            names += found[0]
            scores.append(found[1])
        return names, np.concatenate(scores) if scores else np.zeros(0)

    def _predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        words = Words(texts)
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if len(words.starts) and self.languages:
            code, heads = _trigrams(words)
            like = np.add.reduceat(self.log_p[code], heads, axis=0)
            docs = np.flatnonzero(words.n)
            best[docs], score[docs] = _mixtures(like, words.n[docs])
        for k in np.flatnonzero(best >= 0):
            if not _has_letter(texts[k]):
                best[k], score[k] = -1, 0.0
        return [self.languages[k] if k >= 0 else UNKNOWN for k in best], score


_ASCII_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _has_letter(text: bytes) -> bool:
    return not _ASCII_LETTERS.isdisjoint(text[:64]) or not _ASCII_LETTERS.isdisjoint(text) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def _fitted(p: np.ndarray, doc: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Each document's shares by expectation-maximisation; documents leave once theirs stand still."""
    share, left = share.copy(), np.arange(len(n))
    for _ in range(STEPS):
        heads = np.concatenate([[0], np.cumsum(n)[:-1]])
        r = share[left][doc] * p
        r /= r.sum(axis=1, keepdims=True) + 1e-30
        after = np.add.reduceat(r, heads, axis=0) / n[:, None]
        moves = np.abs(after - share[left]).max(axis=1) >= CONVERGED
        share[left] = after
        if not moves.any():
            break
        if not moves.all():
            rows = moves[doc]
            p, left, n = p[rows], left[moves], n[moves]
            doc = np.repeat(np.arange(len(n)), n)
    return share


def _mixtures(like: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """like: log-likelihood of each word under each language, words in order of document; n: words of each document."""
    top = like.max(axis=1, keepdims=True)
    p = np.exp(like - top)
    heads = np.concatenate([[0], np.cumsum(n)[:-1]])
    doc = np.repeat(np.arange(len(n)), n)
    size = p.shape[1]
    share = _fitted(p, doc, n, np.full((len(n), size), 1 / size, p.dtype))
    order = np.argsort(-share, axis=1, kind="stable")
    # the single best language is the one with the highest likelihood of all words
    alone = np.add.reduceat(like - top, heads, axis=0)
    chosen, rank = alone.argmax(axis=1), np.arange(len(n))
    price = PENALTY * np.log(n + 1.0)
    value, score = alone[rank, chosen] - price, np.ones(len(n))
    # a set's likelihood is at most that of all languages together, which is at most this far from where the steps ended:
    # where that does not pay for one more language, none is tried
    mixed = (share[doc] * p).sum(axis=1) + 1e-30
    short = n * (np.add.reduceat(p / mixed[:, None], heads, axis=0).max(axis=1) / n - 1)
    most = np.add.reduceat(np.log(mixed), heads) + np.maximum(short, 0)
    left, idle = np.flatnonzero(most - 2 * price > value), np.zeros(len(n), int)
    for k in range(2, size + 1):
        if not len(left):
            break
        rows = np.isin(doc, left)
        own_n, own_p = n[left], p[rows]
        own_doc = np.repeat(np.arange(len(left)), own_n)
        allowed = np.zeros((len(left), size), p.dtype)
        np.put_along_axis(allowed, order[left, :k], 1, axis=1)
        own = share[left] * allowed
        own = _fitted(own_p, own_doc, own_n, own / (own.sum(axis=1, keepdims=True) + 1e-30))
        own_heads = np.concatenate([[0], np.cumsum(own_n)[:-1]])
        now = np.add.reduceat(np.log((own[own_doc] * own_p).sum(axis=1) + 1e-30), own_heads) - k * price[left]
        better = now > value[left]
        at = left[better]
        value[at], chosen[at], score[at] = now[better], own[better].argmax(axis=1), own[better].max(axis=1)
        idle[left] = np.where(better, 0, idle[left] + 1)
        left = left[(idle[left] < 2) & (most[left] - (k + 1) * price[left] > value[left])]
    return chosen, np.clip(score, 0.0, 1.0)


def _counted(languages: list[str]):
    place = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # by language, of those that this task meets
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for a, b in slices([len(x) for x in own], 1 << 19):
                    found = np.bincount(_trigrams(Words(own[a:b]))[0], minlength=BUCKETS)
                    total[place[lang]] = total.get(place[lang], 0) + found
        for k, n in total.items():
            bucket = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), k, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n[bucket])], names=["k", "bucket", "n"])

    return count


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model of the languages in docs, from about PER_LANGUAGE documents of each, taken by hash."""
    labelled = docs.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), shared.text_or_empty(text_col).cast("binary").alias("text"))
    counted = labelled.groupBy("lang").count().collect()  # a row for each language
    languages = sorted(r["lang"] for r in counted)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    share = {r["lang"]: PER_LANGUAGE / r["count"] for r in counted}
    limit = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(min(1.0, share[lang]) * (1 << 30)))])
    tasks = min(max(8, len(languages)), docs.sparkSession.sparkContext.defaultParallelism * 8)
    sample = labelled.filter(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) < F.element_at(limit, F.col("lang")))
    rows = sample.select("lang", "text").repartition(tasks).mapInArrow(_counted(languages), "k int, bucket int, n long")
    found = rows.groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS for each language
    counts = np.zeros((len(languages), BUCKETS))
    counts[found["k"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    counts += SMOOTHING
    log_p = np.log(counts / counts.sum(axis=1, keepdims=True)).T
    return Model(languages, np.ascontiguousarray(log_p, np.float32))


def _predictor(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column("text").to_pylist())
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(names, pa.string()), pa.array(scores.astype(np.float64))], names=[*rest, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of docs."""
    shared.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), shared.held_out(id_col).alias("held_out"), shared.text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_predictor(model), "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def learned_and_identified(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, then identify all."""
    return identify(docs, fit(docs.filter(~shared.held_out())))


def with_language(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language can be told; a model is learned from docs' own labels. Without any, all stay."""
    model = fit(docs.filter(~shared.held_out()))
    if not model.languages:
        return docs

    @F.pandas_udf("string")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(model.predict(texts.tolist())[0], dtype=object)

    return docs.filter(predicted(shared.text_or_empty(text_col).cast("binary")) != UNKNOWN)
