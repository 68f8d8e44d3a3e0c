"""Sharding by histogram sort.

Rows are ordered by (hash of the text, identifier), so equal texts are neighbours. Splitters for equal bytes are found
without sorting: each round counts the exact bytes and rows between candidate keys over all partitions, and probes the
ranges that still hold a target more finely, until every splitter meets its tolerance or stands at the nearest row.
A splitter goes between two groups of equal texts where one such place meets the tolerance; a larger group is split by
identifier. Rows then move once, straight to their range.

Defined cases: a null text has no bytes; size is the bytes plus 8; a null identifier counts as larger than any other;
rows repeated with one identifier and text have one key and stay together; an empty table gives an empty result. Other
columns travel along unchanged, but for those with the results' names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

#: Bytes counted for each row besides its text.
ROW_BYTES = 8
#: Probes within each range that is refined.
PROBES = 48
#: Allowed distance of a shard's splitter from its target, as a share of a shard; of a finer splitter, of a fine range.
#: Fine ranges only size the tasks that number the rows, so nearly all of theirs are found in the first round.
SHARD_TOLERANCE, RANGE_TOLERANCE = 0.001, 0.25
#: Most ranges, so that what the driver holds of them has a bound; beyond 64 MB x this, a range's sort spills more.
MOST_RANGES = 20_000
#: Ranges that one round refines at most, shards' borders first: no more than PROBES rows each come to the driver.
REFINED = 2_000
LOWEST = -(2**63)

Key = tuple[int, int]


@dataclass(frozen=True)
class Splitter:
    """Rows with a key from `key` on lie right of it; bytes and rows lie left of it."""

    key: Key
    bytes: int
    rows: int


def range_of(keys: list[Key]):
    """A column function (hash, id) -> number of keys that are not larger."""
    heads = np.array([k[0] for k in keys], np.int64)
    tails = np.array([k[1] for k in keys], np.int64)

    @F.pandas_udf("int")
    def found(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tied, counts = np.unique(heads, return_counts=True)
        ends = np.cumsum(counts)
        for hashes, ids in parts:
            h, i = hashes.to_numpy(np.int64), ids.to_numpy(np.int64)
            out = np.searchsorted(heads, h, "right")
            at = np.minimum(np.searchsorted(tied, h), max(len(tied) - 1, 0))
            for g in np.unique(at[tied[at] == h]) if len(tied) else ():
                own = h == tied[g]
                a, b = ends[g] - counts[g], ends[g]
                out[own] = a + np.searchsorted(tails[a:b], i[own], "right")
            yield pd.Series(out.astype(np.int32))

    return found


def _between(low: Key, high: Key) -> list[Key]:
    """Candidate keys in (low, high], at hashes as long as these differ, then at identifiers."""
    place = 0 if low[0] < high[0] else 1
    width = high[place] - low[place]
    steps = sorted({low[place] + max(1, -(-width * k // PROBES)) for k in range(1, PROBES + 1)})
    return [(x, LOWEST) if place == 0 else (low[0], x) for x in steps if x <= high[place]]


def splitters(keys: DataFrame, shards: int, fine: int) -> list[Splitter]:
    """shards * fine - 1 splitters of the table (h, id, size); every fine-th is a shard's border."""
    parts = shards * fine
    total = keys.agg(F.sum("size").alias("bytes")).first()["bytes"] or 0
    if not total:
        return [Splitter((LOWEST, LOWEST), 0, 0)] * (parts - 1)
    targets = {t: total * t / parts for t in range(1, parts)}
    allowed = {t: total / shards * SHARD_TOLERANCE if t % fine == 0 else total / parts * RANGE_TOLERANCE for t in targets}
    found: dict[int, Splitter] = {}
    probes = [(LOWEST + (2**64 * k) // (parts * 4), LOWEST) for k in range(1, parts * 4)]
    while len(found) < len(targets):
        named = keys.select(range_of(probes)("h", "id").alias("b"), "size", F.struct("h", "id").alias("k"))
        # a row for each range between two probes, however large the table is
        rows = named.groupBy("b").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("k").alias("low"), F.max("k").alias("high")).orderBy("b").collect()
        ranges, bytes_, n = [], 0, 0
        for r in rows:
            ranges.append((Splitter((r["low"]["h"], r["low"]["id"]), bytes_, n), (r["high"]["h"], r["high"]["id"]), r["bytes"]))
            bytes_, n = bytes_ + r["bytes"], n + r["rows"]
        ends = [s for s, _, _ in ranges[1:]] + [Splitter((2**63 - 1, 2**63 - 1), bytes_, n)]
        starts = np.array([s.bytes for s, _, _ in ranges])
        probes, refined = set(), 0
        for t in sorted((t for t in targets if t not in found), key=lambda t: (t % fine != 0, t)):
            at = int(np.searchsorted(starts, targets[t], "right")) - 1
            left, high, _ = ranges[at]
            near = min((left, ends[at]), key=lambda s: abs(s.bytes - targets[t]))
            if abs(near.bytes - targets[t]) <= allowed[t] or left.key == high:
                found[t] = near
            else:
                probes |= {left.key, ends[at].key, *(_between(left.key, high) if refined < REFINED else ())}
                refined += 1
        probes = sorted(probes)
    return sorted(found.values(), key=lambda s: s.key)


def balanced_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with columns size, shard (0 to shards - 1, nearly equal bytes) and slot (place in the shard, gapless from 0).

    Columns of docs with one of these three names give way to the results; read what is needed of them before.
    """
    spark = docs.sparkSession
    text, at_hash, at_id, at_range = shared.text_or_empty(text_col), *shared.fresh(docs, "hash", "id", "range")
    placed = {at_hash: F.xxhash64(text), at_id: shared.id_or_last(id_col)}
    size = F.octet_length(text).cast("long") + ROW_BYTES
    keys = shared.written(docs.select(placed[at_hash].alias("h"), placed[at_id].alias("id"), size.alias("size")), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    fine = max(1, -(-min(MOST_RANGES, shared.partitions_for(spark, total, 64 << 20)) // shards))
    at = splitters(keys, shards, fine)
    shared.dropped(keys)
    first_rows = [0] + [s.rows for s in at]
    # how many rows of the same shard lie in earlier ranges: one number for each range
    before = F.array(*[F.lit(n - first_rows[r // fine * fine]) for r, n in enumerate(first_rows)])
    rows = docs.withColumns(placed | {"size": size})
    moved = rows.withColumn(at_range, range_of([s.key for s in at])(at_hash, at_id)).repartitionById(shards * fine, F.col(at_range))
    row = F.row_number().over(Window.partitionBy(at_range).orderBy(at_hash, at_id))
    moved = moved.withColumn("slot", (F.element_at(before, F.col(at_range) + 1) + row - 1).cast("long"))
    return moved.withColumn("shard", F.floor(F.col(at_range) / fine).cast("int")).drop(at_range, at_hash, at_id)
