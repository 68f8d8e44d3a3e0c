"""Toxicity by a factorisation machine over hashed terms.

Terms are words and their beginnings, hashed. On a bounded sample of the labelled documents, the terms whose presence
depends on the label are selected by a likelihood-ratio test, among all documents and then, for what only counts in
company, among those with a term that speaks for the label. The machine learns a weight and a short vector for each,
so that pairs of terms (an insult and the mention of a group) count beyond the sum of their weights. Every document is
then scored on all its words.

Defined cases: a null or empty text has no term and gets the score of the intercept; without labels of both kinds the
score is the smoothed share of label 1; several labels of a document count as toxic if one is; rows repeated in the
documents are scored each; an empty table gives an empty result. A score reads the text alone. Other columns are never
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import WordHashes, Words, slices

BUCKET_BITS = 22
#: Labelled documents that the machine is fitted on, about.
SAMPLE = 20_000
#: Most terms of either selection, least documents with one, and least likelihood ratio (G squared).
TERMS, LEAST_DOCUMENTS, LEAST_RATIO = 4096, 3, 16.0
#: Length of a term's vector, training steps and their rate, ridge of weights and of vectors.
FACTORS, STEPS, RATE = 8, 400, 0.05
WEIGHT_RIDGE, VECTOR_RIDGE = 2e-5, 2e-4
THRESHOLD = 0.3
#: Bytes that the beginnings of words have.
BEGINNINGS = (4, 5)
CHUNK = 1 << 19


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every term, repeats included."""
    words = Words(texts)
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = WordHashes(words)
    shift = np.uint64(64 - BUCKET_BITS)
    lengths = words.ends - words.starts
    rows, buckets = [words.texts], [hashes.of(words.starts, words.ends, 1) >> shift]
    for n in BEGINNINGS:
        long = lengths > n
        rows.append(words.texts[long])
        buckets.append(hashes.of(words.starts[long], words.starts[long] + n, n) >> shift)
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


def _unique(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(rows << BUCKET_BITS | buckets)
    return key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)


@dataclass
class Machine:
    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def place(self) -> np.ndarray:
        at = np.full(1 << BUCKET_BITS, -1, np.int32)
        at[self.buckets] = np.arange(len(self.buckets))
        return at

    def scores(self, texts: list[bytes], place: np.ndarray) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for a, b in slices([len(x) for x in texts], CHUNK):
            rows, buckets = terms(texts[a:b])
            found = place[buckets] >= 0
            rows, own = _unique(rows[found], buckets[found])
            out[a:b] += _sums(self.weights, self.vectors, rows, place[own], b - a)[0]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _sums(weights: np.ndarray, vectors: np.ndarray, rows: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts its weights' sum plus all pairs' products, and its vectors' sum."""
    v = vectors[own]
    total = np.stack([np.bincount(rows, v[:, f], n) for f in range(vectors.shape[1])], axis=1) if len(rows) else np.zeros((n, vectors.shape[1]))
    squares = np.bincount(rows, (v * v).sum(axis=1), n)
    return np.bincount(rows, weights[own], n) + 0.5 * ((total * total).sum(axis=1) - squares), total


class _Groups:
    """Sums over the members of each of n groups, a column at a time, with memory that is taken once."""

    def __init__(self, group: np.ndarray, member: np.ndarray, columns: int, n: int):
        order = np.argsort(group, kind="stable")
        group, self.member = group[order], member[order].astype(np.intp)
        self.heads = np.flatnonzero(np.diff(group, prepend=-1))
        self.own = group[self.heads]
        self.taken, self.found, self.out = np.empty(len(group)), np.empty(len(self.heads)), np.zeros((columns, n))

    def sums(self, columns: np.ndarray) -> np.ndarray:
        """columns (k, members) -> (k, groups), valid until the next call."""
        if len(self.heads):
            for x, y in zip(columns, self.out):
                np.take(x, self.member, out=self.taken, mode="clip")
                y[self.own] = np.add.reduceat(self.taken, self.heads, out=self.found)
        return self.out


def train(rows: np.ndarray, own: np.ndarray, labels: np.ndarray, size: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors by full-batch Adam on the logistic loss; rows and own: (text, term) pairs.

    A step sums, over each text's terms, weights, vectors and their squares, and over each term's texts the slope of the
    loss and its products with the text's vector; nothing of the size of all pairs' vectors is made.
    """
    n = len(labels)
    rng = np.random.default_rng(0)
    bias, free = np.array([np.log((labels.sum() + 1) / (n - labels.sum() + 1))]), np.zeros((1 + FACTORS, size))
    free[1:] = rng.normal(0, 0.05, (size, FACTORS)).T
    weights, vectors = free[0], free[1:]
    ridge = np.array([WEIGHT_RIDGE] + [VECTOR_RIDGE] * FACTORS)[:, None]
    of_text, of_term = _Groups(rows, own, FACTORS + 2, n), _Groups(own, rows, FACTORS + 1, size)
    p = [bias, free]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, STEPS + 1):
        found = of_text.sums(np.concatenate([free, (vectors * vectors).sum(axis=0)[None]]))
        total = found[1:-1]
        linear = found[0] + 0.5 * ((total * total).sum(axis=0) - found[-1])
        wrong = 1 / (1 + np.exp(-np.clip(bias + linear, -30, 30))) - labels
        slope = of_term.sums(np.concatenate([wrong[None], wrong * total]))
        slope[1:] -= vectors * slope[0]
        for k, g in enumerate([np.array([wrong.mean()]), slope / n + ridge * free]):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return float(bias[0]), weights, np.ascontiguousarray(vectors.T)


def _sampled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices([len(x) for x in texts], CHUNK):
            rows, buckets = _unique(*terms(texts[a:b]))
            ends = np.cumsum(np.bincount(rows, minlength=b - a))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(buckets.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], batch.column("toxic")[a:b], lists], names=["id", "toxic", "terms"])


def _ratio(with_1, with_0, n_1, n_0):
    """G squared of a term's presence against the label, as a column."""

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, seen = n_1 + n_0, with_1 + with_0
    return 2 * (part(with_1, seen * n_1 / n) + part(with_0, seen * n_0 / n) + part(n_1 - with_1, (n - seen) * n_1 / n) + part(n_0 - with_0, (n - seen) * n_0 / n))


def _labels_of(sample: DataFrame) -> tuple[int, int]:
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    return n.get(1, 0), n.get(0, 0)


def _selected(sample: DataFrame, n_1: int, n_0: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms whose presence in these documents depends most on the label, and whether each speaks for it."""
    seen = sample.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    seen = seen.filter(F.col("a") + F.col("b") >= LEAST_DOCUMENTS).withColumn("g", _ratio(F.col("a"), F.col("b"), F.lit(n_1), F.lit(n_0))).filter(F.col("g") >= LEAST_RATIO)
    found = seen.orderBy(F.desc("g"), "term").limit(TERMS).select("term", (F.col("a") * n_0 > F.col("b") * n_1).alias("speaks")).toArrow()
    return found["term"].to_numpy(), found["speaks"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine fitted on about SAMPLE labelled documents, taken by hash."""
    shared.bound_batches(docs.sparkSession)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    total = known.count()
    taken = known.filter(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, total)) * (1 << 30)))
    taken = F.broadcast(taken.limit(2 * SAMPLE))  # no more rows than that
    rows = docs.select(F.col(id_col).cast("long").alias("id"), shared.text_or_empty(text_col).cast("binary").alias("text")).join(taken, "id")
    sample = shared.written(rows.mapInArrow(_sampled_terms, "id long, toxic int, terms array<int>"), "sample")
    n_1, n_0 = _labels_of(sample)
    nothing = Machine(np.zeros(0, np.int64), float(np.log((n_1 + 1) / (n_0 + 1))), np.zeros(0), np.zeros((0, FACTORS)))
    if not n_1 or not n_0:
        return nothing
    alone, speaks = _selected(sample, n_1, n_0)
    chosen = alone
    if speaks.any():
        company = sample.filter(F.arrays_overlap("terms", F.lit(alone[speaks].tolist())))
        with_1, with_0 = _labels_of(company)
        if with_1 and with_0:
            chosen = np.union1d(alone, _selected(company, with_1, with_0)[0])
    if not len(chosen):
        return nothing
    only = F.array_intersect("terms", F.lit(chosen.tolist()))
    used = sample.select("id", "toxic", only.alias("terms")).toArrow()  # selected terms of the sample only
    lists = used["terms"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    at = np.full(1 << BUCKET_BITS, -1, np.int32)
    at[chosen] = np.arange(len(chosen))
    bias, weights, vectors = train(np.repeat(np.arange(len(used)), sizes), at[lists.flatten().to_numpy()], used["toxic"].to_numpy().astype(float), len(chosen))
    return Machine(chosen.astype(np.int64), bias, weights, vectors)


def _scorer(machine: Machine):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = machine.place()
        for batch in batches:
            found = machine.scores(batch.column("text").to_pylist(), place)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return score


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), shared.held_out(id_col).alias("held_out"), shared.text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_scorer(machine), "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def learned_and_scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that are not held out, then score all documents."""
    return score(docs, fit(docs, labels.filter(~shared.held_out())))
