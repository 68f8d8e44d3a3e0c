"""Near-duplicate vectors of one label by a forest of random-projection trees.

Each tree splits by a random direction at the median, again and again; vectors near a split go to both sides. The
trees are fitted on a bounded sample (SAMPLE vectors), then every vector walks down all of them, as deep as the size of
its label asks. Vectors that share a label and a leaf are compared exactly in double precision; a pair counts in the
first leaf, by number, that its two vectors share, so links are counted once without being listed. Equal vectors are
one row with a weight.

A vector passes both ways within a distance of a split. Along a random direction, unit vectors spread, and two vectors
at the least similarity are apart, in proportion to one over the root of the dimension, so the distance is SPILL over
that root: recall and copies are then alike in all dimensions. Where a node has too few of the sample, the whole
level's median splits it, so depth has no bound but the size of the table. Leaves beyond BLOCK vectors are compared in
pairs of blocks, all of them, so no task holds an unbounded group.

Defined cases: a null label, or a vector that is null, zero, or has a null or non-finite component, links with nothing;
vectors of different dimension do not link; repeated identifiers are rows of their own and share the class of their
vector; a null identifier counts as larger than any other, and so does 2^63 - 1, which stands for it; an empty table
gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import connected_components, forest

COSINE = 0.93
TREES = 6
#: Vectors of a label that a leaf should hold.
LEAF = 32
#: Vectors that the trees are fitted on, and least of them that a node's own median is taken of.
SAMPLE, LEAST = 40_000, 8
#: Distance of a split within which a vector goes both ways, times the root of the dimension.
SPILL = 0.16
#: Vectors of a leaf that one task compares with each other.
BLOCK = 1024
SEED = 20


class Tree:
    """Random splits of unit vectors; nodes as in a heap, thresholds from the sample: a node's own, or its level's."""

    def __init__(self, sample: np.ndarray, levels: int, seed: int):
        rng = np.random.default_rng(seed)
        self.spill = SPILL / np.sqrt(sample.shape[1])
        self.directions = rng.standard_normal((levels, sample.shape[1]))
        self.directions /= np.linalg.norm(self.directions, axis=1, keepdims=True)
        #: of each level, sorted nodes with a threshold of their own, their thresholds, and that of the others
        self.splits: list[tuple[np.ndarray, np.ndarray, float]] = []
        rows, nodes = np.arange(len(sample)), np.ones(len(sample), np.int64)
        for level in range(levels):
            along = sample[rows] @ self.directions[level]
            order = np.lexsort((along, nodes))
            heads = np.flatnonzero(np.concatenate([[True], nodes[order][1:] != nodes[order][:-1]]))
            sizes = np.diff(np.concatenate([heads, [len(order)]]))
            own = sizes >= LEAST
            middle = along[order][heads[own] + sizes[own] // 2]
            self.splits.append((nodes[order][heads[own]], middle, float(np.median(sample @ self.directions[level]))))
            rows, nodes = self._step(rows, nodes, along, level)

    def _step(self, rows: np.ndarray, nodes: np.ndarray, along: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        known, thresholds, other = self.splits[level]
        at = np.minimum(np.searchsorted(known, nodes), max(len(known) - 1, 0))
        beyond = along - (np.where(known[at] == nodes, thresholds[at], other) if len(known) else other)
        left, right = beyond < self.spill, beyond >= -self.spill
        return np.concatenate([rows[left], rows[right]]), np.concatenate([nodes[left] * 2, nodes[right] * 2 + 1])

    def leaves(self, unit: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that a row reaches in as many levels as its depth."""
        rows, nodes = np.arange(len(unit)), np.ones(len(unit), np.int64)
        ended = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for level in range(len(self.splits) + 1):
            done = depth[rows] <= level
            ended.append((rows[done], nodes[done]))
            rows, nodes = rows[~done], nodes[~done]
            if not len(rows):
                break
            rows, nodes = self._step(rows, nodes, unit[rows] @ self.directions[level], level)
        return np.concatenate([r for r, _ in ended]), np.concatenate([n for _, n in ended])


def levels_for(n: int) -> int:
    """Levels that a label of n vectors is split in."""
    return max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))


def _unit(column: pa.Array) -> np.ndarray:
    return _scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _walker(trees: list[Tree]):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                own = batch.slice(a, 2048)
                unit = _unit(own.column("v"))
                depth = own.column("depth").to_numpy()
                rows, leaves = [], []
                for t, tree in enumerate(trees):
                    # a label of one leaf is the same leaf in every tree
                    r, n = tree.leaves(unit, depth) if t == 0 else tree.leaves(unit[depth > 0], depth[depth > 0])
                    rows.append(r if t == 0 else np.flatnonzero(depth > 0)[r])
                    leaves.append(n | t << 52)
                rows, leaves = np.concatenate(rows), np.concatenate(leaves)
                order = np.lexsort((leaves, rows))
                rows, leaves = rows[order], leaves[order]
                ends = np.cumsum(np.bincount(rows, minlength=own.num_rows))
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                names = [c for c in own.schema.names if c != "depth"]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.ListArray.from_arrays(offsets, pa.array(leaves))], names=[*names, "leaves"])

    return walk


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (label, leaf, x, y): for each class what it links with, and a forest of the links."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.concat_batches([*held, batch])
        heads = _heads(batch)
        yield from _links(batch.slice(0, heads[-2]), heads[:-1])
        held = [batch.slice(heads[-2])]  # the last group may go on
    for batch in held:
        yield from _links(batch, [0, batch.num_rows])


def _heads(batch: pa.RecordBatch) -> list[int]:
    """Where each group of rows begins, and the number of rows."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in ("label", "dim", "leaf", "x", "y"):
        k = batch.column(c).to_numpy(zero_copy_only=False)
        new[1:] |= k[1:] != k[:-1]
    return [*np.flatnonzero(new).tolist(), batch.num_rows]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each list begins and ends among them."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _shared_bits(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For lists of distinct values, words of bits: two lists have a value in common if the AND of any of their words is not 0."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    _, at, times = np.unique(values[ends[0] : ends[-1]], return_inverse=True, return_counts=True)
    common = times > 1
    number, own = np.cumsum(common) - 1, common[at]
    bit, row = number[at[own]], row[own]
    bits = np.zeros((-(-int(common.sum()) // 64), len(ends) - 1), np.uint64)
    np.bitwise_or.at(bits, (bit // 64, row), np.uint64(1) << (bit % 64).astype(np.uint64))
    return bits


def _links(batch: pa.RecordBatch, heads: list[int]) -> Iterator[pa.RecordBatch]:
    """Of groups of rows, each from one head to the next."""
    if not batch.num_rows:
        return
    ids, weights, blocks, x, y = (batch.column(c).to_numpy() for c in ("node", "n", "block", "x", "y"))
    flat, at = _lists(batch.column("v"))
    earlier, ends = _lists(batch.column("earlier"))
    n_linked = np.zeros(batch.num_rows, np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    for head, end in zip(heads, heads[1:]):
        if end - head < 2:
            continue
        unit = _scaled(flat[at[head] : at[end]].reshape(end - head, -1))
        bits = None
        for a in range(0, len(unit), 512):
            near = unit[a : a + 512] @ unit[a:].T >= COSINE
            if np.count_nonzero(near) <= len(near):
                continue  # each row with itself
            i, j = np.nonzero(near)
            ok = j > i
            i, j = i[ok] + head + a, j[ok] + head + a
            if x[head] != y[head]:
                ok = blocks[i] != blocks[j]
                i, j = i[ok], j[ok]
            if bits is None:
                bits = _shared_bits(earlier, ends[head : end + 1])
            counted = np.zeros(len(i), bool)  # in an earlier leaf
            for word in bits:
                counted |= word[i - head] & word[j - head] != 0
            i, j = i[~counted], j[~counted]
            if len(i):
                np.add.at(n_linked, i, weights[j])
                np.add.at(n_linked, j, weights[i])
                edges.append(forest(ids[i], ids[j]))
    own = np.flatnonzero(n_linked)
    if len(own):
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.nulls(len(own), pa.int64()), pa.array(n_linked[own])], names=["a", "b", "w"])
        a, b = forest(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "w"])


def _fitted(classes: DataFrame, dim: int, n: int, most: int) -> list[Tree]:
    """Trees for the n classes of one dimension, from about SAMPLE of them."""
    own = classes.filter(F.col("dim") == dim)
    share = min(1.0, SAMPLE / max(1, n))
    # by hash, so that the same vectors are taken whenever this runs
    taken = own.filter(F.pmod(F.xxhash64("label", "v", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * SAMPLE).toArrow()
    sample = _unit(taken.column("v").combine_chunks()) if len(taken) else np.zeros((1, dim))
    return [Tree(sample, levels_for(most), SEED + t) for t in range(TREES)]


def vector_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: its identifier, n_links, component_id and kept."""
    # single precision stays as it is until vectors are compared: it is half as much to move
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    usable = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(shared.id_or_last(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.when(F.coalesce(usable, F.lit(False)), v).alias("v"))
    classes = rows.filter("v is not null").groupBy("label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    # a number for each class that does not depend on identifiers, which may repeat; fixed once it is written
    classes = shared.written(classes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("v")}), "classes")
    leaves = None
    sizes = classes.groupBy("dim", "label").count()
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("count") / LEAF))).cast("int").alias("depth")
    sized = classes.join(sizes.select("dim", "label", depth), ["dim", "label"])
    # one row for each dimension of vectors
    for r in sizes.groupBy("dim").agg(F.max("count").alias("most"), F.sum("count").alias("n")).collect():
        trees = _fitted(classes, r["dim"], r["n"], r["most"])
        own = sized.filter(F.col("dim") == r["dim"]).select("label", "dim", "node", "n", "v", "depth")
        walked = own.mapInArrow(_walker(trees), f"label string, dim int, node long, n long, v {own.schema['v'].dataType.simpleString()}, leaves array<long>")
        leaves = walked if leaves is None else leaves.unionByName(walked)
    if leaves is None:
        n_of, parts = None, None
    else:
        found = shared.written(_in_leaves(leaves).mapInArrow(_compared, "a long, b long, w long"), "links")
        n_of = found.filter("w is not null").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w"))
        parts = connected_components(found.filter("b is not null").select("a", "b"))
    return _result(rows, classes, n_of, parts, id_col)


def _in_leaves(walked: DataFrame) -> DataFrame:
    """A row for each vector and leaf; for leaves beyond BLOCK, for each pair of blocks that the vector's is part of."""
    # a row's leaves are in order; those before this one tell which pairs are counted there
    spread = walked.select("label", "dim", "node", "n", "v", "leaves", F.posexplode("leaves").alias("at", "leaf")).withColumn("earlier", F.slice("leaves", 1, F.col("at"))).drop("leaves", "at")
    key = ["label", "dim", "leaf"]
    large = shared.written(walked.select("label", "dim", F.explode("leaves").alias("leaf")).groupBy(*key).count().filter(F.col("count") > BLOCK).select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("k")), "large")
    if large.isEmpty():
        spread = spread.withColumns({"block": F.lit(0), "x": F.lit(0), "y": F.lit(0)})
    else:
        spread = spread.join(large, key, "left").withColumn("k", F.coalesce("k", F.lit(1)))
        spread = spread.withColumn("block", F.pmod(F.col("node"), F.col("k")).cast("int"))
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("x"), F.greatest(F.col("block"), o).alias("y"))))
        spread = spread.withColumn("pair", pair).select("label", "dim", "node", "n", "v", "earlier", "leaf", "block", F.col("pair.x").alias("x"), F.col("pair.y").alias("y"))
    key += ["x", "y"]
    return spread.repartition(*key).sortWithinPartitions(*key)


def _result(rows: DataFrame, classes: DataFrame, n_of: DataFrame | None, parts: DataFrame | None, id_col: str) -> DataFrame:
    if n_of is None:
        of_class = classes.select("label", "v", F.lit(0).cast("long").alias("w"), F.col("least").alias("component"), "n")
    else:
        own = classes.join(n_of, "node", "left").join(parts, "node", "left").select("label", "v", "n", "least", F.coalesce("w", F.lit(0)).alias("w"), F.coalesce("component", "node").alias("root"))
        least = own.groupBy("root").agg(F.min("least").alias("component"))
        of_class = own.join(least, "root").select("label", "v", "n", "w", "component")
    known = F.when(F.col("id") < shared.LAST_ID, F.col("id"))
    component = F.coalesce("component", "id")
    out = rows.join(of_class, ["label", "v"], "left")
    return out.select(
        known.alias(id_col),
        F.coalesce(F.col("w") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.when(component < shared.LAST_ID, component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
