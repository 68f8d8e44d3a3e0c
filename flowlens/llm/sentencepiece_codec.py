"""SentencePiece encoding and decoding by a max-plus scan.

The public model is of the byte-pair kind. Its segmentation is the only one in which every two neighbouring pieces are
what the merges make of those two pieces alone; so a segmentation is a path of pieces where a step weighs 0 if the two
pieces may follow each other and minus infinity if not, and the encoding is the path of greatest weight. The state
between two chunks of a text is the piece that reaches their border: its end beyond the border and its identity. A
chunk yields the matrix of greatest weights from each state on its left to each on its right, matrices are combined in
pairs (the max-plus product is associative) until the states at all borders are known, and each chunk then traces its
own path back from them. Texts beyond SEGMENT characters are spread over tasks this way; so are single runs without a
space. Elsewhere a piece never crosses from another character to a space, nor between two characters that are neighbours
in no piece, which leaves one state there, and a worker remembers the paths of such short units.

Defined cases: a null or empty text has no ids and decodes to an empty text; characters outside the vocabulary become
their UTF-8 bytes; repeated rows are encoded each; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import contextlib
import gc
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SPACE_MARK = "▁"
#: Characters of a text, or of a run without a space, that are scanned as one chunk.
SEGMENT = 32_768
#: Units longer than this are scanned in pieces of it.
UNIT = 1024
#: Units and pairs that a worker remembers; beyond that it starts anew.
MOST_UNITS, MOST_PAIRS = 800_000, 400_000
_UNIT = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

@contextlib.contextmanager
def _uncollected() -> Iterator[None]:
    """No search for reference cycles: a batch's words are many objects, and none is in a cycle."""
    usual = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if usual:
            gc.enable()


_CODECS: dict[str, Codec] = {}

#: Where the last piece ends, and the piece.
State = tuple[int, str]


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


class Codec:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.ids, self.score, self.bytes = {}, {}, {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(_BYTE.fullmatch(piece)[1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.score[piece] = i, model.get_score(i)
        self.longest = max(map(len, self.ids))
        #: Ids of units: of those that begin with a mark, by the rest; of others, by all of it.
        self.words: dict[str, bytes] = {}
        self.unit_ids: dict[str, bytes] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        #: Neighbouring characters within pieces: between any other two nothing merges, and a text's sides are independent.
        self.joins = {x[k : k + 2] for x in self.ids for k in range(len(x) - 1)}
        #: For each beginning of a piece, the pieces that it ends with, longest first, and at last its last character.
        self.ends: dict[str, tuple[str, ...]] = {}
        for piece in self.ids:
            for n in range(1, len(piece) + 1):
                if (begin := piece[:n]) not in self.ends:
                    self.ends[begin] = (*(x for k in range(n - 1) if (x := begin[k:]) in self.ids), begin[-1])
        self.raw = {x: i.to_bytes(4, "little") for x, i in self.ids.items()}
        self.texts = [x.encode() for x in self.pieces]
        for b, i in self.bytes.items():
            self.texts[i] = bytes([b])

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging, best score first, leftmost of equals."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        queue: list[tuple[float, int, str, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (s := self.score.get(parts[a] + parts[b])) is not None:
                heapq.heappush(queue, (-s, a, parts[a], parts[b]))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while queue:
            _, a, x, y = heapq.heappop(queue)
            b = right[a]
            if parts[a] != x or b >= len(parts) or parts[b] != y:
                continue
            parts[a], parts[b] = x + y, None
            right[a] = right[b]
            if right[b] < len(parts):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [x for x in parts if x is not None]

    def follows(self, x: str, y: str) -> bool:
        """Whether the weight of a step from piece x to piece y is 0, not minus infinity."""
        known = self.pairs.setdefault(x, {})
        found = known.get(y)
        if found is None:
            if self.n_pairs >= MOST_PAIRS:
                self.pairs.clear()
                self.n_pairs, known = 0, self.pairs.setdefault(x, {})
            self.n_pairs += 1
            found = known[y] = x + y not in self.ids and self.merged(x + y) == [x, y]
        return found

    def scan(self, text: str, begin: int, end: int, entry: State | None) -> dict[int, State]:
        """From an entry state, each place from begin on that a path reaches: the piece that ends there, and where it starts.

        Pieces start before `end`; paths from one state are unique, so a place has one entry at most.
        """
        start = begin if entry is None else entry[0]
        at: list[State | None] = [(-1, "" if entry is None else entry[1])]
        self._go_on(text, start, min(len(text), end + self.longest - 1), end, at, [""])
        return {start + k: state for k, state in enumerate(at) if state is not None}

    def _go_on(self, text: str, start: int, stop: int, end: int, at: list[State | None], begun: list[str]) -> None:
        """Go on with a scan from `start` up to `stop`. at: the states at start and the places after it, as far as known;
        begun: at each of these, the longest beginning of a piece that the text since start ends with.
        """
        ends, pairs, follows = self.ends, self.pairs, self.follows
        suffix = begun[-1]
        for place in range(start + len(at), stop + 1):
            suffix += text[place - 1]
            while (pieces := ends.get(suffix)) is None:
                suffix = suffix[1:]
                if not suffix:  # a character in which no piece begins
                    pieces = (text[place - 1],)
                    break
            found = None
            for piece in pieces:
                before = place - len(piece)
                state = at[before - start]
                if state is None or before >= end:
                    continue
                last = state[1]
                if not last or (ok := pairs[last].get(piece) if last in pairs else None) or (ok is None and follows(last, piece)):
                    found = (before, piece)
                    break
            at.append(found)
            begun.append(suffix)

    def trace(self, at: dict[int, State], stop: int) -> list[str]:
        """Pieces of the path that ends at stop."""
        out = []
        while (state := at[stop])[0] >= 0:
            out.append(state[1])
            stop = state[0]
        return out[::-1]

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for x in pieces:
            i = self.ids.get(x)
            out += (self.bytes[b] for b in x.encode()) if i is None else (i,)
        return out

    def entries(self, text: str, border: int) -> list[State]:
        """States that may be at a border: pieces that start before it and end at it or beyond, and single characters."""
        out = []
        for start in range(max(0, border - self.longest), border):
            for stop in range(border, min(len(text), start + self.longest) + 1):
                if stop - start == 1 or text[start:stop] in self.ids:
                    out.append((stop, text[start:stop]))
        return out

    def matrix(self, text: str, begin: int, end: int, entries: list[State | None], exits: list[State]) -> np.ndarray:
        """Greatest weight from each entry state to each exit state of the chunk [begin, end)."""
        out = np.full((len(entries), len(exits)), -np.inf)
        for i, entry in enumerate(entries):
            if entry is not None and entry[0] >= end:  # a piece across the whole chunk
                out[i, [k for k, x in enumerate(exits) if x == entry]] = 0
                continue
            at = self.scan(text, begin, end, entry)
            for k, (stop, piece) in enumerate(exits):
                if at.get(stop, (-1, None))[1] == piece and at[stop][0] < end and at[stop][0] >= 0:
                    out[i, k] = 0
        return out

    def long_unit(self, text: str, step: int = UNIT) -> list[str]:
        """Pieces of a text by chunks: matrices, their products, and a trace of each chunk from its own states."""
        borders = [*range(0, len(text), step), len(text)]
        states: list[list[State | None]] = [[None], *([s for s in self.entries(text, b)] for b in borders[1:-1])]
        states.append([(len(text), text[a:]) for a in range(max(0, len(text) - self.longest), len(text)) if len(text) - a == 1 or text[a:] in self.ids])
        matrices = [self.matrix(text, a, b, states[k], states[k + 1]) for k, (a, b) in enumerate(zip(borders, borders[1:]))]
        chosen = border_states(matrices)
        out: list[str] = []
        for k, (a, b) in enumerate(zip(borders, borders[1:])):
            entry, leave = states[k][chosen[k]], states[k + 1][chosen[k + 1]]
            if entry is None or entry[0] < b:
                out += self.trace(self.scan(text, a, b, entry), leave[0])
        return out

    def units(self, text: str) -> list[str]:
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
        return _UNIT.findall(marked)

    def encode_units(self, units: list[str]) -> bytes:
        get = self._ids_of(set(units)).__getitem__
        return b"".join(map(get, units))

    def _ids_of(self, units: set[str]) -> dict[str, bytes]:
        """The ids of each unit, remembered or found now."""
        joins, words, others = self.joins, self.words, self.unit_ids
        out: dict[str, bytes] = {}
        cut: dict[str, list[str]] = {}
        whole: set[str] = set()
        for unit in units:
            ids = words.get(unit[1:]) if unit[0] == SPACE_MARK else others.get(unit)
            if ids is not None:
                out[unit] = ids
            elif cuts := [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in joins]:
                cut[unit] = [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)])]
            else:
                whole.add(unit)
        for part in {x for parts in cut.values() for x in parts} - out.keys():
            ids = words.get(part[1:]) if part[0] == SPACE_MARK else others.get(part)
            if ids is not None:
                out[part] = ids
            else:
                whole.add(part)
        found = self._short([x for x in whole if len(x) <= UNIT])
        out |= found
        out |= {x: np.array(self.to_ids(self.long_unit(x)), "<u4").tobytes() for x in whole if len(x) > UNIT}
        for unit, parts in cut.items():
            out[unit] = b"".join([out[x] for x in parts])
            if len(unit) <= UNIT:
                found[unit] = out[unit]
        for own in (words, others):
            if len(own) + len(found) > MOST_UNITS:
                own.clear()
        for unit, ids in found.items():
            if unit[0] == SPACE_MARK:
                words[unit[1:]] = ids
            else:
                others[unit] = ids
        return out

    def _short(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units of UNIT characters at most. What reaches a place depends on the text up to there alone, so in
        sorted order each scan goes on from the place up to which the unit before it is the same.
        """
        out, raw, before = {}, self.raw, ""
        at: list[State | None] = [(-1, "")]
        begun = [""]
        for unit in sorted(units):
            same, most = 0, min(len(unit), len(before))
            while same < most and unit[same] == before[same]:
                same += 1
            del at[same + 1 :], begun[same + 1 :]
            self._go_on(unit, 0, len(unit), len(unit), at, begun)
            ids, stop = [], len(unit)
            while stop:
                stop, piece = at[stop]
                i = raw.get(piece)
                ids.append(b"".join(self.bytes[b].to_bytes(4, "little") for b in piece.encode()) if i is None else i)
            out[unit], before = b"".join(ids[::-1]), unit
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        return self.encode_units(self.units(text)) if text else b""

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; where single spaces part its words, these are looked up as they are."""
        with _uncollected():
            return self._encode_all(texts)

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        plain = [bool(x) and "  " not in x and SPACE_MARK not in x and x[0] != " " != x[-1] for x in texts]
        seen: set[str] = set()
        for x, simple in zip(texts, plain):  # a text's words are held one text at a time
            if simple:
                seen.update(x.split(" "))
        missing = seen - self.words.keys()
        if len(self.words) + len(missing) > MOST_UNITS:
            self.words.clear()
            missing = seen
        found = self._ids_of({SPACE_MARK + x for x in missing})
        self.words.update((x, found[SPACE_MARK + x]) for x in missing)
        get = self.words.__getitem__
        out = [b"".join(map(get, x.split(" "))) if simple else b"" for x, simple in zip(texts, plain)]
        return [ids if simple else self.encode(x) for x, simple, ids in zip(texts, plain, out)]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace").replace(SPACE_MARK, " ")
        return text[1:] if text.startswith(" ") else text


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1, initial=-np.inf)


def border_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each border on a path of greatest weight, by products of halves.

    The first matrix has one row; the product of all fixes the last state, and the two halves fix the one between them.
    """

    def product(a: int, b: int) -> np.ndarray:
        if (a, b) not in made:
            m = (a + b) // 2
            made[a, b] = matrices[a] if b - a == 1 else max_plus(product(a, m), product(m, b))
        return made[a, b]

    made: dict[tuple[int, int], np.ndarray] = {}
    n = len(matrices)
    chosen = {0: 0, n: int(product(0, n)[0].argmax())}
    spans = [(0, n)]
    while spans:
        a, b = spans.pop()
        if b - a == 1:
            continue
        m = (a + b) // 2
        chosen[m] = int((product(a, m)[chosen[a]] + product(m, b)[:, chosen[b]]).argmax())
        spans += [(a, m), (m, b)]
    return [chosen[k] for k in range(n + 1)]


def _encoder(model: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            ids = own.encode_all(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary())], names=["id", "ids"])

    return encode


def _cut(model: str, segment: int):
    """Segments of long texts: the text around, where the segment begins and ends in it, and whether a border has one state."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = codec(model).longest
        fresh = re.compile(f"(?<=[^{SPACE_MARK}]){SPACE_MARK}")
        for batch in batches:
            for row, id_, text in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "text"))):
                marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
                borders = [(0, True)]
                while len(marked) - borders[-1][0] > segment:
                    at = borders[-1][0] + segment
                    found = fresh.search(marked, at, min(len(marked), at + UNIT))
                    borders.append((found.start(), True) if found else (at, False))
                borders.append((len(marked), True))
                rows = []
                for k, ((a, one_left), (b, one_right)) in enumerate(zip(borders, borders[1:])):
                    left, right = (a if one_left else max(0, a - margin)), (b if one_right else min(len(marked), b + margin))
                    rows.append({"row": row, "id": id_, "k": k, "last": len(borders) - 2, "text": marked[left:right], "begin": a - left, "end": b - left, "one_left": one_left, "one_right": one_right})
                yield pa.RecordBatch.from_pylist(rows, schema=_SEGMENTS)

    return cut


_SEGMENTS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("k", pa.int32()), ("last", pa.int32()), ("text", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("one_left", pa.bool_()), ("one_right", pa.bool_())])
_SEGMENTS_DDL = "row long, id long, k int, last int, text string, begin int, end int, one_left boolean, one_right boolean"


def _states(own: Codec, r: dict) -> tuple[list[State | None], list[State]]:
    """States on either side of a segment; both segments at a border list them alike."""
    text, begin, end = r["text"], r["begin"], r["end"]
    entries = [None] if r["one_left"] else own.entries(text, begin)
    if not r["one_right"]:
        return entries, own.entries(text, end)
    return entries, [(len(text), text[a:]) for a in range(max(0, len(text) - own.longest), len(text)) if len(text) - a == 1 or text[a:] in own.ids]


def _matrices(model: str):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for r in batch.to_pylist():
                entries, exits = _states(own, r)
                m = own.matrix(r["text"], r["begin"], r["end"], entries, exits)
                if r["one_right"]:  # whichever piece ends the segment, what follows is free of it
                    m = m.max(axis=1, keepdims=True, initial=-np.inf)
                if r["one_left"] and r["k"]:
                    m = m[:1]
                yield pa.RecordBatch.from_pylist([{"row": r["row"], "k": r["k"], "n": len(m), "weights": m.tobytes()}], schema=pa.schema([("row", pa.int64()), ("k", pa.int32()), ("n", pa.int32()), ("weights", pa.binary())]))

    return compute


def _chosen(key: tuple, table: pa.Table) -> pa.Table:
    """The state at either side of each segment of a text."""
    rows = sorted(table.to_pylist(), key=lambda r: r["k"])
    states = border_states([np.frombuffer(r["weights"]).reshape(r["n"], -1) for r in rows])
    return pa.table({"row": [r["row"] for r in rows], "k": pa.array([r["k"] for r in rows], pa.int32()), "entry": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32())})


def _traced(model: str):
    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["entry"] is None:  # one state on either side
                    ids = own.encode_units(_UNIT.findall(r["text"]))
                else:
                    entries, exits = _states(own, r)
                    entry = entries[r["entry"]]
                    at = own.scan(r["text"], r["begin"], r["end"], entry)
                    stop = len(r["text"]) if r["one_right"] else exits[r["leave"]][0]
                    pieces = own.trace(at, stop) if entry is None or entry[0] < r["end"] else []
                    ids = np.array(own.to_ids(pieces), "<u4").tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("k"), pa.array(out, pa.binary())], names=["row", "id", "k", "ids"])

    return trace


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of row and k; the ids of each text."""
    row = id_ = None
    held: list[bytes] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["row"] != row:
                yield pa.RecordBatch.from_arrays([pa.array([id_], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["id", "ids"])
                held = []
            row, id_ = r["row"], r["id"]
            held.append(r["ids"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([id_], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["id", "ids"])


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(id, ids) for each row of docs: the ids as little-endian unsigned 32-bit integers."""
    shared.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), shared.text_or_empty(text_col).alias("text"))
    short = rows.filter(F.length("text") <= segment).mapInArrow(_encoder(model), "id long, ids binary")
    # numbers are fixed once the segments are written
    long = rows.filter(F.length("text") > segment).withColumn("row", F.monotonically_increasing_id())
    parts = shared.written(long.mapInArrow(_cut(model, segment), _SEGMENTS_DDL).repartition("row", "k"), "segments")
    bound = parts.filter(~(F.col("one_left") & F.col("one_right"))).select("row").distinct()
    weights = parts.join(bound, "row", "left_semi").mapInArrow(_matrices(model), "row long, k int, n int, weights binary")
    chosen = weights.groupBy("row").applyInArrow(_chosen, "row long, k int, entry int, leave int")
    traced = parts.join(chosen, ["row", "k"], "left").select(*_SEGMENTS.names, "entry", "leave").mapInArrow(_traced(model), "row long, id long, k int, ids binary")
    whole = traced.repartition("row").sortWithinPartitions("row", "k").mapInArrow(_assembled, "id long, ids binary")
    return short.unionByName(whole).withColumnRenamed("id", id_col)


def _decoder(model: str, id_col: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), n, crc, pa.array([own.decode(x) for x in ids], pa.string())], names=[id_col, "n_ids", "ids_crc32", "text"])

    return decode


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_ids, ids_crc32, text) for each row of ids."""
    return encoded.select(id_col, "ids").mapInArrow(_decoder(model, id_col), f"{id_col} long, n_ids long, ids_crc32 long, text string")
