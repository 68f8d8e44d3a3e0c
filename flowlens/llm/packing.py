"""Best-fit packing of token pieces into sequences of bounded length, in bulk-synchronous rounds.

Pieces wait in classes of length, each half as long as the one before; the longest class goes first. In a round the
waiting pieces of a class and the gaps of open sequences are range-sorted together, longest first, and every task sweeps
its range: a gap is laid on a stack, a piece takes the gap on top, which is its successor, the narrowest that holds it
and is still free. What a task cannot match it reports by count; from these counts (two numbers for each task) it
follows by rank which piece left over in one range takes which gap left over in an earlier one, and a join on these
ranks carries that out. Gaps shrink, and the next round begins, until no gap holds a waiting piece. Then the pieces that
are left open sequences: tasks fill them with neighbours in order of length. A gap with room for several pieces of a
class offers them in one round, as many as the pieces could use. State is rows in written tables; the driver holds
counts of tasks and classes only.

Defined cases: a null text is empty and has the closing id alone; documents longer than the capacity are cut into full
pieces, the first of which may be shorter; repeated rows are packed each; a null identifier stays null; an empty table
gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared
from .tokens import encoder

#: Texts that are encoded together.
TEXTS = 1024
#: Rows that a task sweeps.
ROWS = 1 << 19
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def _cutter(tokenizer: str, end_id: int, capacity: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.release_memory()
        encode, number = encoder(tokenizer).encode, TaskContext.get().partitionId() << 40
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                own = batch.slice(a, TEXTS)
                rows = []
                for doc_id, ids in zip(own.column("id").to_pylist(), encode(own.column("text").to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (x, y) in enumerate(zip(bounds, bounds[1:])):
                        piece = ids[x * 4 : y * 4]
                        rows.append((doc_id, k, x, y - x, zlib.crc32(piece), piece))
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                keep = 6 if with_ids else 5
                own = [pa.array(x, t) for x, t in zip(columns[:keep], types)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(number, number + len(rows)))], names=[*names[:keep], "pid"])
                number += len(rows)

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, (ids,) and pid, a number of its own."""
    shared.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), shared.text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_cutter(tokenizer, end_id, capacity, with_ids), _PIECES + ", ids binary" * with_ids + ", pid long")


def matched(gap: np.ndarray) -> np.ndarray:
    """For rows in order of size, longest first, gaps (true) before pieces of their size: the gap that each piece takes.

    Gaps and pieces are opening and closing brackets. A bracket's level is the depth inside it; a piece takes the gap
    that comes before it at its level, if one does. -1 stands for none, and for gaps.
    """
    out = np.full(len(gap), -1, np.int64)
    depth = np.cumsum(np.where(gap, 1, -1))
    level = np.where(gap, depth, depth + 1)
    order = np.argsort(level, kind="stable")
    pair = (level[order][1:] == level[order][:-1]) & gap[order][:-1] & ~gap[order][1:]
    out[order[1:][pair]] = order[:-1][pair]
    return out


#: Rows of a round's table: pieces that found a place (value: offset), pieces that wait, gaps (value: width).
PLACED, WAITS, GAP = 0, 1, 2
_STATE = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("pid", pa.int64()), ("length", pa.int64()), ("seq", pa.int64()), ("value", pa.int64()), ("rank", pa.int64()), ("free", pa.int64())])
_STATE_DDL = "kind int, part int, pid long, length long, seq long, value long, rank long, free long"


def _arrays(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    held = [[b.column(c).to_numpy() for c in names] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*held)] if held else [np.zeros(0, np.int64)] * len(names)


def _state(kind: int, part: int, n: int, **columns: np.ndarray) -> pa.RecordBatch:
    full = {"kind": np.full(n, kind, np.int32), "part": np.full(n, part, np.int32)} | columns
    return pa.RecordBatch.from_arrays([pa.array(full[f.name], f.type) if f.name in full else pa.nulls(n, f.type) for f in _STATE], schema=_STATE)


def _swept(capacity: int):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of the pieces that take a gap here; those left over, ranked from the first; and the gaps as they are then.

        A gap's free places have ranks too, counted from the last gap, in whose reach most pieces to come are.
        """
        part = TaskContext.get().partitionId()
        size, slots, key, width = _arrays(batches, "size", "slots", "key", "width")
        row = np.repeat(np.arange(len(size)), np.maximum(slots, 1))
        gap = slots[row] > 0
        took = matched(gap)
        pieces = np.flatnonzero(took >= 0)
        of_gap, length = row[took[pieces]], size[row[pieces]]
        order = np.argsort(of_gap, kind="stable")
        of_gap, length, pid = of_gap[order], length[order], key[row[pieces]][order]
        total = np.cumsum(length)
        used = np.bincount(of_gap, length, len(size)).astype(np.int64)
        before = total - length - (np.cumsum(used) - used)[of_gap]
        yield _state(PLACED, part, len(pid), pid=pid, seq=key[of_gap], value=capacity - width[of_gap] + before)
        waits = row[~gap & (took < 0)]
        yield _state(WAITS, part, len(waits), pid=key[waits], length=size[waits], rank=np.arange(len(waits)))
        free = slots - np.bincount(of_gap, minlength=len(size))
        behind = np.cumsum(free[::-1])[::-1] - free
        rest = np.flatnonzero((slots > 0) & (width > used))
        yield _state(GAP, part, len(rest), seq=key[rest], value=width[rest] - used[rest], rank=behind[rest], free=free[rest])

    return sweep


def _carried(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """From (part, pieces left, places left) in order: runs (part of pieces, first rank, part of gaps, first rank, n) that match."""
    stack, runs = [], []
    for part, waits, free in counts:
        rank = 0
        while rank < waits and stack:
            q, first, left = stack.pop()
            n = min(left, waits - rank)
            runs.append((part, rank, q, first, n))
            rank += n
            if n < left:
                stack.append((q, first + n, left - n))
        if free:
            stack.append((part, 0, free))
    return runs


def _ranked_as(runs: list[tuple[int, int, int, int, int]]):
    """Pieces left over, with the part and rank of the place they take, or null."""
    parts, ranks, q, first, n = (np.array(x, np.int64) for x in zip(*sorted(runs)))
    keys = parts << 40 | ranks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, rank = batch.column("part").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            at = np.maximum(np.searchsorted(keys, part << 40 | rank, "right") - 1, 0)
            none = (parts[at] != part) | (rank < ranks[at]) | (rank >= ranks[at] + n[at])
            yield pa.RecordBatch.from_arrays([batch.column("pid"), batch.column("length"), pa.array(q[at].astype(np.int32), mask=none), pa.array(first[at] + rank - ranks[at], mask=none)], names=["pid", "length", "q", "k"])

    return place


def _opened(capacity: int):
    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces, longest first, side by side in new sequences, numbered in this task, and the gaps that are left of these."""
        part = TaskContext.get().partitionId()
        pid, length = _arrays(batches, "pid", "length")
        total = np.concatenate([[0], np.cumsum(length)])
        heads = [0] if len(length) else []
        while heads and (after := int(np.searchsorted(total, total[heads[-1]] + capacity, "right")) - 1) < len(length):
            heads.append(after)
        heads = np.array(heads, np.int64)
        seq = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(length)))) if len(heads) else heads
        yield _state(PLACED, part, len(pid), pid=pid, seq=seq, value=total[:-1] - total[heads[seq]])
        width = capacity - np.diff(total[np.append(heads, len(length))]) if len(heads) else heads
        yield _state(GAP, part, len(heads), seq=np.arange(len(heads)), value=width)

    return open_


class Packing:
    """A packing under way: the gaps of open sequences (seq, width), and the tables that say where pieces were placed."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.gaps: DataFrame | None = None
        self.placed: list[DataFrame] = []

    def _in_order(self, rows: DataFrame, n: int, *by) -> DataFrame:
        tasks = math.ceil(n / ROWS)
        return (rows.repartitionByRange(tasks, *by) if tasks > 1 else rows.coalesce(1)).sortWithinPartitions(*by)

    def _found(self, state: DataFrame) -> None:
        self.placed.append(state.filter(F.col("kind") == PLACED).select("pid", F.col("seq").alias("sequence_id"), F.col("value").alias("offset")))
        self.gaps = state.filter((F.col("kind") == GAP) & (F.col("value") > 0)).select("seq", F.col("value").alias("width"))

    def fill(self, pieces: DataFrame, n: int, low: int, high: int) -> None:
        """Place the n pieces (pid, length) with low < length <= high: rounds of sweeps, then new sequences for the rest."""
        while n and self.gaps is not None:
            found = self.gaps.agg(F.count_if(F.col("width") > low).alias("n"), F.count_if(F.col("width") >= high).alias("several")).first()
            if not found["n"]:
                break
            # as many places as the pieces could use, if all wide gaps offered the same
            most = max(1, math.ceil(n / max(1, found["several"])))
            before, (pieces, n) = n, self._sweep(pieces, n, found["n"], low, high, most)
            if n == before:
                break
        if n:
            self._open(pieces, n)

    def _sweep(self, pieces: DataFrame, n: int, n_gaps: int, low: int, high: int, most: int) -> tuple[DataFrame, int]:
        """One round: the pieces that still wait, and their number."""
        wide = self.gaps.filter(F.col("width") > low)
        slots = F.when(F.col("width") >= high, F.least(F.floor(F.col("width") / high), F.lit(most))).otherwise(1)
        nothing = F.lit(0).cast("long")
        wide = wide.select(F.least("width", F.lit(high)).cast("long").alias("size"), slots.cast("long").alias("slots"), F.col("seq").alias("key"), "width")
        pieces = pieces.select(F.col("length").alias("size"), nothing.alias("slots"), F.col("pid").alias("key"), nothing.alias("width"))
        # of equal sizes gaps come first, the widest of them first of all
        rows = self._in_order(wide.unionByName(pieces), n + n_gaps, F.desc("size"), F.col("slots") == 0, F.desc("width"), "key")
        narrow = self.gaps.filter(F.col("width") <= low).select(F.lit(GAP).alias("kind"), F.col("seq"), F.col("width").alias("value"))
        state = shared.written(rows.mapInArrow(_swept(self.capacity), _STATE_DDL).unionByName(narrow, allowMissingColumns=True), "round")
        # a row for each task
        counts = state.filter("part is not null").groupBy("part").agg(F.count_if(F.col("kind") == WAITS).alias("waits"), F.coalesce(F.sum("free"), F.lit(0)).alias("free")).orderBy("part").collect()
        left = sum(r["waits"] for r in counts)
        waits = state.filter(F.col("kind") == WAITS)
        self._found(state)
        if runs := _carried([(r["part"], r["waits"], r["free"]) for r in counts]):
            state = shared.written(self._carry(state, waits, runs), "carried")
            waits, left = state.filter(F.col("kind") == WAITS), left - sum(r[4] for r in runs)
            self._found(state)
        return waits.select("pid", "length"), left

    def _carry(self, state: DataFrame, waits: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
        """The pieces left over by the sweeps in their places in gaps of other tasks, those that wait on, and all gaps."""
        asked = waits.select("part", "rank", "pid", "length").mapInArrow(_ranked_as(runs), "pid long, length long, q int, k long")
        gaps = state.filter(F.col("kind") == GAP)
        places = gaps.filter("free > 0").select(F.col("part").alias("q"), F.explode(F.sequence("rank", F.col("rank") + F.col("free") - 1)).alias("k"), "seq", "value")
        pairs = asked.join(places, ["q", "k"])
        before = F.sum("length").over(Window.partitionBy("seq").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
        placed = pairs.select(F.lit(PLACED).alias("kind"), "pid", "seq", (self.capacity - F.col("value") + F.coalesce(before, F.lit(0))).alias("value"))
        used = pairs.groupBy("seq").agg(F.sum("length").alias("used"))
        after = gaps.join(used, "seq", "left").select(F.lit(GAP).alias("kind"), "seq", (F.col("value") - F.coalesce("used", F.lit(0))).alias("value"))
        still = asked.filter("q is null").select(F.lit(WAITS).alias("kind"), "pid", "length")
        return placed.unionByName(after, allowMissingColumns=True).unionByName(still, allowMissingColumns=True)

    def _open(self, pieces: DataFrame, n: int) -> None:
        """New sequences for n pieces that no gap holds."""
        state = shared.written(self._in_order(pieces.select("pid", "length"), n, F.desc("length"), "pid").mapInArrow(_opened(self.capacity), _STATE_DDL), "opened")
        base = {}
        for r in state.filter(F.col("kind") == GAP).groupBy("part").count().orderBy("part").collect():  # a row for each task
            base[r["part"]], self.sequences = self.sequences, self.sequences + r["count"]
        first = F.element_at(F.create_map(*[F.lit(x).cast("long") for x in sum(base.items(), ())]), F.col("part").cast("long"))
        before = self.gaps
        self._found(state.withColumn("seq", F.col("seq") + first))
        if before is not None:
            self.gaps = self.gaps.unionByName(before)


def packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """Pieces (as token_pieces gives them) with sequence_id and offset."""
    pieces = shared.written(pieces, "pieces")
    length = F.col("length").cast("long")
    limits = [capacity >> k for k in range(capacity.bit_length() + 1)]
    of_class = F.lit(0)
    for limit in limits[1:]:
        of_class = of_class + (length <= limit).cast("int")
    waiting = {r["class"]: r["count"] for r in pieces.groupBy(of_class.alias("class")).count().collect()}  # a row for each class
    packing = Packing(capacity)
    for k in sorted(waiting):
        own = pieces.filter((length > limits[k + 1]) & (length <= limits[k])).select("pid", length.alias("length"))
        packing.fill(own, waiting[k], limits[k + 1], limits[k])
    out = [F.col(c) if c != "length" else length.alias(c) for c in pieces.columns if c != "pid"]
    if not waiting:
        return pieces.select(*out, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(functools.reduce(DataFrame.unionByName, packing.placed), "pid").select(*out, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return packed(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids), capacity)
