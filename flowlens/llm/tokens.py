"""Token ids by the tokenizers library, each distinct word of a worker encoded once.

Both public vocabularies treat words apart: the byte-level one never joins a space with what stands before it, the
other drops white space. So a text's ids are the ids of its parts, cut where a space precedes other characters. The
parts' ids are kept in a bounded store of the Python worker, and parts not yet in it are encoded many at a time. Texts
are cut, and their parts told apart, as Arrow columns; Python sees each distinct part of a batch once.

A text that holds the string of an added token (such as an end mark) is given to the library whole, which makes that
string one id. With `added_as_text` such strings are ordinary text.

Defined cases: an empty text has no ids; a text of any length, without spaces too, has the library's ids.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import slices

#: Parts that a worker remembers: two generations, of which the older goes when the younger is full.
MOST_PARTS = 700_000
#: Parts that are encoded as one string.
_JOINED = 500
#: Bytes of text that are cut at once.
_CHUNK = 1 << 22
#: Marks that often end a part.
_MARKS = (",", ".")
_ODD_SPACE = re.compile(r" (?=\s)| \Z")
_CUT = re.compile(r" (?=\S)")

_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, added_as_text: bool = False) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if (path, added_as_text) not in _ENCODERS:
        _ENCODERS[path, added_as_text] = WordEncoder(path, added_as_text)
    return _ENCODERS[path, added_as_text]


def _plain(text: str) -> bool:
    """Whether all characters are of Latin-1, where each has one lower form and none combines."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    def __init__(self, path: str, added_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Parts are ordinary text: folding can make an added token's string of one that is none.
        self.tokenizer.encode_special_tokens = True
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: The library finds a normalised token after folding, so its string is sought in folded text here.
        self.added = [] if added_as_text else [(x.content, x.normalized) for x in added]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        #: Word ends are marked in the vocabulary that drops spaces; in the other, a name has a letter for each byte.
        self.marks_ends = any(x.endswith("</w>") for x in names)
        self.ends = np.array([x.endswith("</w>") for x in names])
        self.lengths = np.array([len(x) for x in names])
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Where spaces belong to the part behind them: ids of parts that begin a text.
        self.first: dict[str, bytes] = {}
        self.tails = {x: self._alone(x) for x in _MARKS}

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _holds_added(self, text: str) -> bool:
        return any(x in (self.tokenizer.normalizer.normalize_str(text) if folded and self.tokenizer.normalizer else text) for x, folded in self.added)

    def _by_library(self, text: str) -> bytes:
        """The ids of a text with added tokens."""
        self.tokenizer.encode_special_tokens = False
        try:
            return self._alone(text)
        finally:
            self.tokenizer.encode_special_tokens = True

    def _learn(self, parts: list[str]) -> None:
        if self.parts and len(self.parts) + len(parts) > MOST_PARTS // 2:
            self.older, self.parts = self.parts, {}
        # after a Latin-1 letter, a mark begins a new word in either vocabulary, so its ids follow those of the part without it
        marked = [x for x in parts if x[-1:] in _MARKS and x[-2:-1].isalpha() and x[-2] < "\u0100"]
        whole = set(parts).difference(marked)
        whole.update(x[:-1] for x in marked)
        whole = [x for x in whole if x not in self.parts]
        if self.marks_ends:
            self._learn_marked(whole)
        else:
            self._learn_spaced(whole)
        known, tails = self.parts, self.tails
        self.parts.update((x, known[x[:-1]] + tails[x[-1]]) for x in marked)

    def _learn_spaced(self, parts: list[str]) -> None:
        groups = [parts[i : i + _JOINED] for i in range(0, len(parts), _JOINED)]
        encoded = self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, encoded):
            ids = np.array(found.ids, np.uint32)
            at = np.concatenate([[0], np.cumsum(self.lengths[ids])])
            wanted = np.concatenate([[0], np.cumsum([len(x.encode()) + 1 for x in group])])
            cuts = np.searchsorted(at, wanted)
            if at[-1] == wanted[-1] and (at[cuts] == wanted).all():
                raw, cuts = ids.tobytes(), (cuts * 4).tolist()
                self.parts.update(zip(group, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                self.parts.update((x, self._alone(" " + x)) for x in group)

    def _learn_marked(self, parts: list[str]) -> None:
        simple, counts, odd = [], [], []
        for x in parts:
            n = len(_MARKED_WORDS.findall(x)) if x.isascii() else 0
            (simple if n else odd).append(x)
            if n:
                counts.append(n)
        groups = [simple[i : i + _JOINED] for i in range(0, len(simple), _JOINED)]
        encoded = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for i, group, found in zip(range(0, len(simple), _JOINED), groups, encoded):
            own, ids = counts[i : i + _JOINED], np.array(found.ids, np.uint32)
            ends = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            last = np.cumsum(own)
            if len(ends) == last[-1] + 1 and ends[-1] == len(ids):
                raw, cuts = ids.tobytes(), [0, *(ends[last] * 4).tolist()]
                self.parts.update(zip(group, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                odd += group
        if odd:
            found = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
            self.parts.update((x, np.array(e.ids, np.uint32).tobytes()) for x, e in zip(odd, found))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        whole = {k: self._by_library(x) for k, x in enumerate(texts) if self._holds_added(x)}
        if whole:
            rest = iter(self._by_parts([x for k, x in enumerate(texts) if k not in whole]))
            return [whole[k] if k in whole else next(rest) for k in range(len(texts))]
        return self._by_parts(texts)

    def _by_parts(self, texts: list[str]) -> list[bytes]:
        if self.marks_ends:  # that vocabulary folds case itself; where folding is plain, do it before parts are told apart
            texts = [x.lower() if _plain(x) else x for x in texts]
        out: list[bytes] = []
        for a, b in slices([len(x) for x in texts], _CHUNK):
            out += self._chunk(texts[a:b])
        return out

    def _chunk(self, texts: list[str]) -> list[bytes]:
        odd = {k: _CUT.split(x) for k, x in enumerate(texts) if _ODD_SPACE.search(x)}
        if odd:
            cut = iter(pc.split_pattern(pa.array([x for k, x in enumerate(texts) if k not in odd], pa.large_string()), " ").to_pylist())
            lists = pa.array([odd[k] if k in odd else next(cut) for k in range(len(texts))], pa.large_list(pa.large_string()))
        else:
            lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = np.asarray(lists.offsets)
        ends = ends - ends[0]
        coded = lists.flatten().dictionary_encode()
        at, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        heads = ends[:-1]
        found = self._known(names if self.marks_ends else [names[k] for k in np.unique(np.delete(at, heads)).tolist()])
        if self.marks_ends:
            table = [found[x] for x in names]
        else:
            table = [found.get(x, b"") for x in names]
            begins = [names[k] for k in at[heads].tolist()]
            begin = {x: len(names) + k for k, x in enumerate(dict.fromkeys(begins))}
            table += [self._first(x) for x in begin]
            at = at.copy()
            at[heads] = [begin[x] for x in begins]
        sizes = np.fromiter(map(len, table), np.int32, len(table)) // 4
        ids, places = np.frombuffer(b"".join(table), "<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
        n = sizes[at]
        total = np.concatenate([[0], np.cumsum(n)])
        from_ = np.repeat(places[at] - total[:-1].astype(np.int32), n)
        from_ += np.arange(total[-1], dtype=np.int32)
        raw = ids[from_].tobytes()
        bounds = (total[ends] * 4).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _known(self, parts: list[str]) -> dict[str, bytes]:
        """Parts with their ids."""
        get = self.parts.get
        found = {x: get(x) for x in parts}
        if missing := [x for x, ids in found.items() if ids is None]:
            seen = {x: self.older[x] for x in missing if x in self.older}
            self.parts.update(seen)
            found.update(seen)
            if missing := [x for x in missing if x not in seen]:
                self._learn(missing)
                found.update((x, self.parts[x]) for x in missing)
        return found

    def _first(self, part: str) -> bytes:
        if not part:
            return b""
        if part not in self.first:
            if len(self.first) >= MOST_PARTS // 5:
                self.first.clear()
            self.first[part] = self._alone(part)
        return self.first[part]


#: In ASCII, the words that the marked vocabulary's splitter finds.
_MARKED_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.IGNORECASE)
