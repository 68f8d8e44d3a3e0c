"""SimHash near-deduplication with a grid of segment bit counts.

A fingerprint's 64 bits fall into 32 segments of two; the bit counts of the segments are a point, and the Manhattan
distance of two points is at most the Hamming distance of the fingerprints. Points within 3 have distance 0 or 1 in
their first or their second 16 coordinates, so each half is a grid: a fingerprint stands in the cell of its half and
asks at the cells that are one larger in one coordinate. Fingerprints that meet are compared exactly. Equal
fingerprints are one row there, and what meets in a cell is reported as a spanning forest, never as all its pairs.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; fewer than three words are one
shingle; repeated rows share a component; a null identifier counts as larger than any other and stays null, and so does
2^63 - 1, which stands for it; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import connected_components, forest

WORDS = 3
SEED = 42
DISTANCE = 3
_LOW_BITS = 0x55555555
#: Pairs that a task compares at once.
PAIRS = 1 << 21
#: Fingerprints of a cell that one task takes; larger cells are compared in pairs of blocks.
BLOCK = 1 << 16
#: Coordinates of a cell, and fingerprints that stand in a cell which is not counted on its own.
NEIGHBOURS, LIGHT = 16, 1 << 11


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text; only A-Z are folded and only ASCII white space parts words."""
    from xxhash import xxh64_intdigest as digest

    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts, n = np.zeros(64, np.int64), len(parts) - words + 1
    for a in range(0, n, 1 << 16):
        spans = zip(starts[a : min(n, a + (1 << 16))].tolist(), ends[a + words - 1 : a + words - 1 + (1 << 16)].tolist())
        hashes = np.array([digest(joined[x:y], SEED) for x, y in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        for b in range(0, len(bits), 255):
            counts += bits[b : b + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    shared.bound_batches(docs.sparkSession)
    rows = docs.select(shared.id_or_last(id_col).alias("id"), shared.text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "id long, fp long")


def _bit_counts(half: Column) -> Column:
    """Counts of the 16 two-bit segments of 32 bits, two bits each."""
    low = F.lit(_LOW_BITS)
    return half.bitwiseAND(low) + F.shiftrightunsigned(half, 1).bitwiseAND(low)


def _counts() -> list[Column]:
    """The bit counts of both halves of fp, c0 and c1."""
    return [_bit_counts(F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"c{k}") for k in (0, 1)]


def _cell(half: int) -> Column:
    """Where a fingerprint stands in the grid of one half."""
    return F.col(f"c{half}") + F.lit(half << 32)


def _asked(c: Column) -> list[Column]:
    """The cells that are one larger than c in one coordinate; null where it is at its largest."""
    return [F.when(F.shiftright(c, 2 * k).bitwiseAND(F.lit(3)) < 2, c + F.lit(1 << (2 * k))) for k in range(NEIGHBOURS)]


def grid_rows(fps: DataFrame) -> DataFrame:
    """(cell, fp, asks): a row where the fingerprint stands in either half's grid, and one where it asks."""
    points = fps.select("fp", *_counts())
    rows = []
    for half in (0, 1):
        asked = [x + F.lit(half << 32) for x in _asked(F.col(f"c{half}"))]
        rows += [F.struct(_cell(half).alias("cell"), F.lit(False).alias("asks"))] + [F.struct(x.alias("cell"), F.lit(True).alias("asks")) for x in asked]
    return points.select("fp", F.explode(F.array(*rows)).alias("r")).select("r.cell", "fp", "r.asks").filter("cell is not null")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, those that stand first; links of a forest among fingerprints that meet and are near."""
    held: list[np.ndarray] = []

    def links(cell: np.ndarray, fp: np.ndarray, asks: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(cell)]]))
        standing = np.add.reduceat(~asks, heads, dtype=np.int64)
        # each standing row meets those that follow it in its cell
        at = np.arange(len(cell))
        group = np.repeat(np.arange(len(heads)), sizes)
        partners = np.where(at - heads[group] < standing[group], heads[group] + sizes[group] - at - 1, 0)
        total = np.cumsum(partners)
        begin = 0
        while begin < len(cell):
            done = total[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(total, done + PAIRS, "right")))
            n = partners[begin:stop]
            if n.sum():
                left = np.repeat(np.arange(begin, stop), n)
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
                x, y = fp[left], fp[right]
                near = (np.bitwise_count(x ^ y) <= DISTANCE) & (x != y)
                if near.any():
                    a, b = forest(x[near].view(np.int64), y[near].view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            begin = stop

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("asks").to_numpy(zero_copy_only=False)]
        rows = [np.concatenate([x, y]) for x, y in zip(held, now)] if held else now
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last cell may go on
        if cut:
            yield from links(*[x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held:
        yield from links(*held)


def large_cells(fps: DataFrame) -> DataFrame:
    """(cell, k): cells in which more than BLOCK rows may stand or ask, with the number of their blocks.

    Counted from the cells where fingerprints stand. An asking fingerprint stands next to the cell it asks at, so a cell
    none of whose neighbours holds more than LIGHT has at most NEIGHBOURS * LIGHT that ask; more only come from the few
    heavy neighbours, whose counts are passed on.
    """
    standing = fps.select("fp", *_counts()).select(F.explode(F.array(*[_cell(half) for half in (0, 1)])).alias("cell")).groupBy("cell").count()
    heavy = shared.written(standing.filter(F.col("count") > LIGHT), "heavy")
    if heavy.isEmpty():
        return heavy.select("cell", F.lit(1).alias("k"))
    c, tag = F.col("cell").bitwiseAND(F.lit(0xFFFFFFFF)), F.col("cell").bitwiseAND(F.lit(1 << 32))
    asked = heavy.select(F.explode(F.array(*[x + tag for x in _asked(c)])).alias("cell"), "count").filter("cell is not null")
    rows = heavy.select("cell", "count").unionByName(asked).groupBy("cell").agg((F.sum("count") + NEIGHBOURS * LIGHT).alias("n"))
    return shared.written(rows.filter(F.col("n") > BLOCK).select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")), "large")


def _in_blocks(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Large cells become cells for each pair of their blocks."""
    if large.isEmpty():
        return rows
    block = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("x"), F.greatest(F.col("block"), o).alias("y"))))
    joined = rows.join(large, "cell", "left")
    parted = joined.filter("k is not null").withColumn("block", block).withColumn("pair", pair)
    parted = parted.select(F.xxhash64("cell", "pair.x", "pair.y").alias("cell"), "fp", "asks")
    return joined.filter("k is null").select("cell", "fp", "asks").unionByName(parted)


def near_links(fps: DataFrame) -> DataFrame:
    """fps (fp), distinct -> links (a, b) that connect all fingerprints at DISTANCE or fewer differing bits."""
    rows = _in_blocks(grid_rows(fps), large_cells(fps))
    rows = rows.repartition("cell").sortWithinPartitions("cell", "asks")
    return rows.mapInArrow(_met, "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its identifier, fingerprint (16 hex digits) and component_id."""
    own = shared.written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = shared.written(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    parts = connected_components(near_links(distinct.select("fp")))
    labelled = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(least, "label").select("fp", "component_id")
    known = lambda c: F.when(F.col(c) < shared.LAST_ID, F.col(c))
    out = own.join(of_fp, "fp")
    return out.select(known("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), known("component_id").alias("component_id"))
