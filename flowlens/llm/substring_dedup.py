"""Removal of bytes that repeat a passage of an earlier document, by merged Burrows-Wheeler transforms.

A byte goes if a string of WINDOW bytes over it also starts in a document with a smaller identifier. Documents with
equal texts are one document here, that of the smallest identifier; the others repeat it as a whole.

Each window of WINDOW bytes has an anchor, the least hash of its strings of GRAM bytes, so equal windows have equal
anchors. Windows in a row with one anchor form a snippet. A window can only occur in two documents if its anchor does:
tasks send the anchors of a block of documents to the anchors' buckets and get back those seen in two documents. The
snippets of these go to the buckets, once for each block of documents that has them, however many documents share
them. There the snippets of each block, or of several where they are few, are a shard with a Burrows-Wheeler transform
of its own; merging these by interleave refinement gives the intervals of windows with a common prefix of WINDOW
bytes, and the smallest identifier in each goes back to the blocks. An anchor that more than HOT documents have would
fill one task: its windows are not sent to a bucket but meet one by one, as keys of an aggregate, so they spread over
all tasks. What a block sends is grouped by bucket, so rows never number more than the anchors sent, and grow with the
text however many blocks and buckets there are.

Defined cases: a null text is empty; matches are of bytes and may start within a character; rows with one identifier
are no earlier than each other, and rows with one identifier and text are treated alike; a null identifier counts as
larger than any other, and so does 2^63 - 1, which stands for it; an empty table gives an empty result. Other columns
are never read, or travel unchanged.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .suffix_merge import least_of_windows
from .words import slices

WINDOW = 50
GRAM = 24
#: Windows of a snippet at most.
SNIPPET = 64
#: Documents with an anchor beyond which its windows meet one by one, and windows in one row on the way there.
HOT, HOT_WINDOWS = 1 << 13, 1 << 16
#: Bytes of text for a block, and of text whose anchors, or snippets, share a bucket.
BLOCK_BYTES, ANCHOR_BYTES, SNIPPET_BYTES = 8 << 20, 4 << 20, 1 << 19
#: Bytes of snippets that are merged at once; snippets of one anchor stay together.
MERGED = 1 << 19
#: Bytes of neighbouring blocks' snippets that are one shard there.
SHARD = 1 << 14
#: Bytes of text whose anchors are worked out at once.
CHUNK = 1 << 17
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def snippets(texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: number of the first, their joined bytes, and start, windows, anchor and text of each snippet."""
    for a, b in slices([len(x) for x in texts], CHUNK):
        joined = b"".join(texts[a:b])
        if len(joined) < WINDOW:
            continue
        raw = np.frombuffer(joined, np.uint8)
        eight = np.empty(len(raw) - 7, np.uint64)
        for o in range(8):
            part = raw[o : o + (len(raw) - o) // 8 * 8].view(np.uint64)
            eight[o::8] = part
        n = len(raw) - GRAM + 1
        h = eight[:n] * _MIX[0]
        for o in range(8, GRAM, 8):
            h ^= h >> np.uint64(29)
            h += eight[o : o + n]
            h *= _MIX[1]
        h ^= h >> np.uint64(32)
        h *= _MIX[2]
        span, least = 1, h
        while span * 2 <= WINDOW - GRAM + 1:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = WINDOW - GRAM + 1 - span
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        least = least * _MIX[0]  # least hashes are small ones: mixed again, anchors fill all buckets alike
        lengths = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
        begin = np.cumsum(lengths) - lengths
        windows = lengths - WINDOW + 1
        full = windows > 0
        # a snippet starts where a text does, where the anchor changes, and after SNIPPET windows
        inside = np.zeros(len(least) + 1, np.int32)
        np.add.at(inside, begin[full], 1)
        np.add.at(inside, (begin + windows)[full], -1)
        valid = np.cumsum(inside[:-1]) > 0
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        new[begin[full]] = True
        starts = np.flatnonzero(new & valid)
        stop = np.concatenate([np.flatnonzero(new | ~valid), [len(least)]])
        sizes = stop[np.searchsorted(stop, starts, "right")] - starts
        if len(sizes) and sizes.max() > SNIPPET:
            pieces = -(-sizes // SNIPPET)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, sizes = np.repeat(starts, pieces) + nth * SNIPPET, np.repeat(sizes, pieces)
            sizes = np.minimum(sizes - nth * SNIPPET, SNIPPET)
        yield a, joined, starts, sizes, least[starts], np.searchsorted(begin, starts, "right") - 1


def _bucket_cuts(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins among sorted anchors."""
    limits = [(k << 64) // buckets for k in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(anchors, np.array(limits, np.uint64)), [len(anchors)]])


def _anchors(buckets: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each bucket, a block's distinct anchors and how many of its documents have each."""
        shared.release_memory()
        block, held, docs = None, [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            anchors = np.concatenate([x for x, _ in held])
            doc = np.concatenate([x for _, x in held])
            order = np.argsort(anchors, kind="stable")
            anchors, doc = anchors[order], doc[order]
            new = np.concatenate([[True], anchors[1:] != anchors[:-1]])
            heads = np.flatnonzero(new)
            n = np.add.reduceat(new | np.concatenate([[True], doc[1:] != doc[:-1]]), heads, dtype=np.int32)
            anchors = anchors[heads]
            cuts = _bucket_cuts(anchors, buckets)
            own = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([block] * len(own), pa.int32()), pa.array([anchors[cuts[k] : cuts[k + 1]].tobytes() for k in own], pa.binary()), pa.array([n[cuts[k] : cuts[k + 1]].tobytes() for k in own], pa.binary())], names=["bucket", "block", "anchors", "docs"])

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for b in np.unique(blocks).tolist():
                if block is not None and b != block:
                    yield from sent()
                    held, docs = [], 0
                block = b
                texts = batch.filter(pa.array(blocks == b)).column("text").to_pylist()
                for a, _, _, _, anchors, text in snippets(texts):
                    held.append((anchors, text + a + docs))
                docs += len(texts)
        yield from sent()

    return find


def _shared_anchors(hot: int):
    def find(table: pa.Table) -> pa.Table:
        """Of a bucket's anchors, for each block those that are in two documents, apart those in more than `hot`."""
        shared.release_memory()
        sent = [np.frombuffer(x, np.uint64) for x in table["anchors"].to_pylist()]
        _, at = np.unique(np.concatenate(sent), return_inverse=True)
        docs = np.bincount(at, _joined(table, "docs", np.int32))[at]
        ends = np.cumsum([0, *map(len, sent)])
        rows = []
        for k, (block, own) in enumerate(zip(table["block"].to_pylist(), sent)):
            n = docs[ends[k] : ends[k + 1]]
            if (n > 1).any():
                rows.append((block, own[n > 1].tobytes(), own[n > hot].tobytes()))
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "anchors": pa.array([r[1] for r in rows], pa.binary()), "hot": pa.array([r[2] for r in rows], pa.binary())})

    return find


class Block:
    """A block's documents in order of identifier, and its snippets with anchors of a given set, numbered as they come."""

    def __init__(self, table: pa.Table, anchors: np.ndarray):
        order = np.lexsort((table["sha"].to_numpy().astype("U64"), table["id"].to_numpy()))
        table = table.take(pa.array(order))
        self.ids, self.shas, self.texts = table["id"].to_numpy(), table["sha"].to_pylist(), table["text"].to_pylist()
        self.numbers: dict[bytes, int] = {}
        self.anchors, self.least = array("Q"), array("q")
        #: of each occurrence: text, start in it, windows, number
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for a, joined, starts, sizes, own, text in snippets(self.texts):
            at = np.minimum(np.searchsorted(anchors, own), max(len(anchors) - 1, 0))
            kept = np.flatnonzero(anchors[at] == own) if len(anchors) else np.zeros(0, int)
            if not len(kept):
                continue
            starts, sizes, own, text = starts[kept], sizes[kept], own[kept], text[kept] + a
            n = np.empty(len(kept), np.int64)
            for k, (s, e, x, d) in enumerate(zip(starts.tolist(), (starts + sizes + WINDOW - 1).tolist(), own.tolist(), text.tolist())):
                piece = joined[s:e]
                i = self.numbers.get(piece)
                if i is None:
                    i = self.numbers[piece] = len(self.anchors)
                    self.anchors.append(x)
                    self.least.append(self.ids[d])
                n[k] = i
            begin = np.cumsum([0, *map(len, self.texts[a : text[-1]])])
            self.found.append((text, starts - begin[text - a], sizes, n))


def _known_block(docs: pa.Table, answers: pa.Table) -> tuple[Block | None, np.ndarray]:
    """The block with its shared anchors, and for each snippet whether its anchor is hot."""
    shared.release_memory()
    anchors = np.sort(_joined(answers, "anchors", np.uint64))
    block = Block(docs, anchors) if len(docs) and len(anchors) else None
    if block is None or not block.anchors:
        return None, np.zeros(0, bool)
    return block, np.isin(np.array(block.anchors, np.uint64), _joined(answers, "hot", np.uint64))


def _sent_snippets(buckets: int):
    def send(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        """For each bucket, a block's snippets: bytes, lengths, anchors, smallest identifiers, numbers.

        Without a bucket, the distinct windows of snippets with hot anchors: joined bytes and smallest identifiers.
        """
        names = ["bucket", "block", "bytes", "lengths", "anchors", "least", "numbers"]
        block, hot = _known_block(docs, answers)
        rows = []
        if block:
            own, least = np.array(block.anchors, np.uint64), np.array(block.least, np.int64)
            order = np.flatnonzero(~hot)
            order = order[np.argsort(own[order], kind="stable")]
            strings = list(block.numbers)
            cuts = _bucket_cuts(own[order], buckets)
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                at = order[cuts[k] : cuts[k + 1]]
                parts = [strings[i] for i in at.tolist()]
                rows.append((k, key[0].as_py(), b"".join(parts), np.fromiter(map(len, parts), np.int32, len(parts)).tobytes(), own[at].tobytes(), least[at].tobytes(), at.astype(np.int32).tobytes()))
            windows = _least_here(block, np.flatnonzero(hot).tolist())
            listed = list(windows)
            for k in range(0, len(listed), HOT_WINDOWS):
                part = listed[k : k + HOT_WINDOWS]
                rows.append((None, key[0].as_py(), b"".join(part), b"", b"", np.array([windows[w] for w in part], np.int64).tobytes(), b""))
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.table([pa.array(x, pa.int32() if k < 2 else pa.binary()) for k, x in enumerate(columns)], names=names)

    return send


def _windows(string: bytes) -> list[bytes]:
    return [string[j : j + WINDOW] for j in range(len(string) - WINDOW + 1)]


def _least_here(block: Block, numbers: list[int]) -> dict[bytes, int]:
    """The windows of some of a block's snippets, each with the smallest identifier in the block."""
    strings, out = list(block.numbers), {}
    for i in numbers:
        for w in _windows(strings[i]):
            out[w] = min(out.get(w, shared.LAST_ID), block.least[i])
    return out


def _each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, least, window) for each window of the rows without a bucket."""
    for batch in batches:
        for block, raw, least in zip(*(batch.column(c).to_pylist() for c in ("block", "bytes", "least"))):
            n = len(raw) // WINDOW
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(np.frombuffer(least, np.int64)), pa.array([raw[k * WINDOW : (k + 1) * WINDOW] for k in range(n)], pa.binary())], names=["block", "least", "window"])


def _packed_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: its windows that are elsewhere with a smaller identifier, and these."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for b in np.unique(blocks).tolist():
            own = batch.filter(pa.array(blocks == b))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([b"".join(own.column("window").to_pylist())], pa.binary()), pa.array([own.column("low").to_numpy().tobytes()], pa.binary())], names=["block", "h_windows", "h_least"])


_TOLD = ["block", "anchors", "numbers", "least", "w_number", "w_offset", "w_least"]
_TOLD_DDL = "block int, anchors binary, numbers binary, least binary, w_number binary, w_offset binary, w_least binary"
#: What blocks are told besides of hot anchors: these, and of their windows.
_HOT_TOLD = ["hot", "h_windows", "h_least"]


def _joined_shards(blocks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of shards for strings in order of block: the block's, or one for several blocks of less than SHARD bytes."""
    heads = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
    before = np.cumsum(sizes) - sizes
    return np.repeat(before[heads] // SHARD, np.diff(np.append(heads, len(blocks))))


def _merged(table: pa.Table) -> pa.Table:
    """For each block what it has to know of its snippets in a bucket: the smallest identifier, and of single windows."""
    shared.release_memory()
    numbers: dict[bytes, int] = {}
    sent, least, anchors, shards = [], [], [], []
    for block, raw, lengths, own, low in zip(*(table[c].to_pylist() for c in ("block", "bytes", "lengths", "anchors", "least"))):
        ends = np.cumsum(np.frombuffer(lengths, np.int32)).tolist()
        at = np.empty(len(ends), np.int64)
        for k, (a, b, x, d) in enumerate(zip([0, *ends], ends, np.frombuffer(own, np.uint64).tolist(), np.frombuffer(low, np.int64).tolist())):
            piece = raw[a:b]
            i = numbers.get(piece)
            if i is None:
                i = numbers[piece] = len(least)
                least.append(d)
                anchors.append(x)
                shards.append(block)
            elif d < least[i]:
                least[i] = d
            at[k] = i
        sent.append(at)
    least, anchors, shards, strings = np.array(least, np.int64), np.array(anchors, np.uint64), np.array(shards, np.int64), list(numbers)
    # an anchor with one snippet needs no merging: its windows have no other place
    order = np.argsort(anchors, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], anchors[order][1:] != anchors[order][:-1]])) if len(order) else order
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    held, size = [], 0
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)]):
        if b - a > 1:
            held += order[a:b].tolist()
            size += sum(len(strings[i]) for i in order[a:b].tolist())
        if held and (size >= MERGED or b == len(order)):
            own = np.array(held)
            own = own[np.argsort(shards[own], kind="stable")]
            pieces = [strings[i] for i in own.tolist()]
            string, offset, low = least_of_windows(pieces, least[own], WINDOW, _joined_shards(shards[own], np.fromiter(map(len, pieces), np.int64, len(pieces))))
            found.append((own[string], offset, low))
            held, size = [], 0
    string, offset, low = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(string, kind="stable")
    string, offset, low = string[order], offset[order], low[order]
    rows = []
    for block, own, number, at in zip(*(table[c].to_pylist() for c in ("block", "anchors", "numbers")), sent):
        a, b = np.searchsorted(string, at), np.searchsorted(string, at, "right")
        n = b - a
        pick = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        local = np.frombuffer(number, np.int32)
        rows.append((block, own, number, least[at].tobytes(), np.repeat(local, n).tobytes(), offset[pick].astype(np.int32).tobytes(), low[pick].tobytes()))
    columns = list(zip(*rows)) or [[]] * len(_TOLD)
    return pa.table([pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(columns)], names=_TOLD)


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table[column].to_pylist() if x is not None] or [np.zeros(0, kind)])


def _rest(text: bytes, covered: np.ndarray, whole_characters: bool) -> bytes:
    """What is not covered; with whole_characters, each run of it without what a cut left of a character."""
    if not whole_characters:
        return np.frombuffer(text, np.uint8)[~covered].tobytes()
    edges = np.flatnonzero(np.diff(covered, prepend=True, append=True)).tolist()
    return b"".join(text[a:b].decode("utf-8", "ignore").encode() for a, b in zip(edges[::2], edges[1::2]))


def _removed(with_bytes: bool):
    def remove(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Each document's length, removed bytes, spans, and the digest of the rest, or its bytes where something is removed."""
        names = ["sha", "least", "n_bytes", "n_removed", "n_spans", "kept"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary() if with_bytes else pa.string()]
        if not len(docs):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        shared.release_memory()
        hot = np.unique(_joined(answers, "hot", np.uint64))
        block = Block(docs, np.union1d(_joined(answers, "anchors", np.uint64), hot))
        least = np.array(block.least, np.int64)
        numbers = _joined(answers, "numbers", np.int32)
        least[numbers] = _joined(answers, "least", np.int64)
        w_number, w_offset, w_least = (_joined(answers, c, k) for c, k in (("w_number", np.int32), ("w_offset", np.int32), ("w_least", np.int64)))
        if len(hot):
            own = np.flatnonzero(np.isin(np.array(block.anchors, np.uint64), hot)).tolist()
            low, raw = _least_here(block, own), b"".join(x for x in answers["h_windows"].to_pylist() if x)
            low.update(zip((raw[k : k + WINDOW] for k in range(0, len(raw), WINDOW)), _joined(answers, "h_least", np.int64).tolist()))
            strings = list(block.numbers)
            found = [(i, j, low[w]) for i in own for j, w in enumerate(_windows(strings[i])) if low[w] < block.least[i]]
            if found:
                extra = list(zip(*found))
                w_number, w_offset, w_least = (np.concatenate([x, np.array(y, x.dtype)]) for x, y in zip((w_number, w_offset, w_least), extra))
        order = np.argsort(w_number, kind="stable")
        w_number, w_offset, w_least = w_number[order], w_offset[order], w_least[order]
        marks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for text, start, size, number in block.found:
            own = block.ids[text]
            whole = least[number] < own
            spans = [(text[whole], start[whole], start[whole] + size[whole] + WINDOW - 1)]
            a, b = np.searchsorted(w_number, number), np.searchsorted(w_number, number, "right")
            n = np.where(whole, 0, b - a)
            pick = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            smaller = w_least[pick] < np.repeat(own, n)
            at = np.repeat(start, n)[smaller] + w_offset[pick][smaller]
            spans.append((np.repeat(text, n)[smaller], at, at + WINDOW))
            for t, x, y in spans:
                by = np.argsort(t, kind="stable")
                t, x, y = t[by], x[by], y[by]
                cuts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else []
                for p, q in zip(cuts, [*cuts[1:], len(t)]):
                    marks.setdefault(int(t[p]), []).append((x[p:q], y[p:q]))
        rows = []
        for k, (sha, own, text) in enumerate(zip(block.shas, block.ids.tolist(), block.texts)):
            gone, spans, rest = 0, 0, text
            if k in marks:
                cover = np.zeros(len(text) + 1, np.int32)
                for x, y in marks[k]:
                    np.add.at(cover, x, 1)
                    np.add.at(cover, y, -1)
                covered = np.cumsum(cover[:-1]) > 0
                gone = int(covered.sum())
                spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                rest = _rest(text, covered, with_bytes) if gone else text
            rows.append((sha, own, len(text), gone, spans, (rest if gone else None) if with_bytes else hashlib.sha256(rest).hexdigest()))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return remove


def _passages(docs: DataFrame, id_col: str, text_col: str, with_bytes: bool) -> DataFrame:
    """(sha, least, n_bytes, n_removed, n_spans, kept) for each distinct text; least: the smallest identifier with it."""
    shared.bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(shared.id_or_last(id_col).alias("id"), shared.text_or_empty(text_col).cast("binary").alias("text"))
    distinct = rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min(F.struct("id", "text")).alias("r"))
    blocks = shared.partitions_for(spark, shared.planned_bytes(docs), BLOCK_BYTES)
    # a task's documents are a block
    base = shared.written(distinct.select("sha", "r.id", "r.text", F.spark_partition_id().alias("block")), "texts", partitions=blocks, joined=False)
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = base.select("block", "text").mapInArrow(_anchors(shared.partitions_for(spark, total, ANCHOR_BYTES)), "bucket int, block int, anchors binary, docs binary")
    common = shared.written(sent.groupBy("bucket").applyInArrow(_shared_anchors(HOT), "block int, anchors binary, hot binary"), "anchors", partitions=blocks)
    volume = common.agg(F.sum(F.octet_length("anchors"))).first()[0] or 0
    # an anchor stands for about 14 bytes of text
    buckets = shared.partitions_for(spark, volume * 14 // 8, SNIPPET_BYTES)
    both = base.groupBy("block").cogroup(common.groupBy("block"))
    pieces = both.applyInArrow(_sent_snippets(buckets), "bucket int, block int, bytes binary, lengths binary, anchors binary, least binary, numbers binary")
    pieces = shared.written(pieces, "pieces", partitions=blocks, joined=False)
    merged = pieces.filter("bucket is not null").groupBy("bucket").applyInArrow(_merged, _TOLD_DDL)
    told = shared.written(merged, "intervals", partitions=max(blocks, buckets), joined=False)
    tables = [base, common, pieces, told]
    hot = common.filter(F.octet_length("hot") > 0)
    if hot.isEmpty():
        told = told.withColumns({c: F.lit(None).cast("binary") for c in _HOT_TOLD})
    else:
        windows = pieces.filter("bucket is null").select("block", "bytes", "least").mapInArrow(_each_window, "block int, least long, window binary")
        low = windows.groupBy("window").agg(F.min("least").alias("low"))
        later = windows.join(low, "window").filter("low < least").select("block", "window", "low")
        tables.append(shared.written(later.mapInArrow(_packed_windows, "block int, h_windows binary, h_least binary"), "hot", partitions=blocks))
        told = told.unionByName(tables[-1], allowMissingColumns=True).unionByName(hot.select("block", "hot"), allowMissingColumns=True)
    kept = "kept binary" if with_bytes else "kept string"
    out = base.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_removed(with_bytes), f"sha string, least long, n_bytes long, n_removed long, n_spans long, {kept}")
    out = shared.written(out, "passages", partitions=blocks, joined=False)
    shared.dropped(*tables)
    return out


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its identifier, n_bytes, n_removed, n_spans, kept_sha256."""
    found = _passages(docs, id_col, text_col, False)
    text = shared.text_or_empty(text_col).cast("binary")
    rows = docs.select(shared.id_or_last(id_col).alias("id"), F.sha2(text, 256).alias("sha"))
    joined = rows.join(found, "sha")
    # another copy of a text repeats it as a whole, if it is long enough to
    copy = (F.col("id") > F.col("least")) & (F.col("n_bytes") >= WINDOW)
    return joined.select(
        F.when(F.col("id") < shared.LAST_ID, F.col("id")).alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.col("kept")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """docs with repeated bytes gone from the text; documents of which nothing is left go.

    What a cut leaves of a character is dropped on either side of it, so no character is made of two. n_chars is counted
    anew where it is a column.
    """
    i, sha, least, n, rest = shared.fresh(docs, "id", "sha", "least", "n", "rest")
    found = _passages(docs, id_col, text_col, True)
    found = found.select(F.col("sha").alias(sha), F.col("least").alias(least), F.col("n_bytes").alias(n), F.col("kept").cast("string").alias(rest))
    rows = docs.withColumns({sha: F.sha2(shared.text_or_empty(text_col).cast("binary"), 256), i: shared.id_or_last(id_col)}).join(found, sha)
    changed = F.col(rest).isNotNull()
    rows = rows.filter((F.col(i) <= F.col(least)) | (F.col(n) < WINDOW)).filter(~changed | (F.col(rest) != ""))
    out = {text_col: F.when(changed, F.col(rest)).otherwise(F.col(text_col))}
    if n_chars_col in docs.columns:
        out[n_chars_col] = F.when(changed, F.length(rest)).otherwise(F.col(n_chars_col)).cast(docs.schema[n_chars_col].dataType)
    return rows.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])
