"""Token ids of whole texts with a word-level cache in front of a public BPE tokenizer.

The vocabulary file splits a text into words, single digits and runs of other signs, and every such
part has its own ids whatever stands beside it. So the parts are cut out here with array operations,
distinct parts are looked up in a bounded cache, and only parts not met before go through the
tokenizer. Texts with signs beyond Latin Extended-B (or the dotted capital I, whose lower case is two
signs) are given to the tokenizer whole: the ids are the same either way.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from siteratio.llm.words import mix

#: Code points of texts cut at once.
CHUNK = 1 << 18
#: Distinct parts kept by a Python worker; beyond it the cache starts anew.
CACHED = 600_000

_LIMIT = 0x250
_SPACES = (*range(9, 14), 0x20, 0x85, 0xA0)
_CLASS = np.full(_LIMIT, 3, dtype=np.uint8)
for _c in range(_LIMIT):
    _kind = unicodedata.category(chr(_c))[0]
    if _kind in "LN":
        _CLASS[_c] = 1 if _kind == "L" else 2
_CLASS[list(_SPACES)] = 0
_LOW = np.array([ord(chr(c).lower()[0]) for c in range(_LIMIT)], dtype=np.uint32)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_UNBASE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_CODE = mix(np.arange(1, _LIMIT + 1, dtype=np.uint64))


def _plain(text: str) -> bool:
    """Whether the array operations below cut this text as the tokenizer does."""
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return max(text) < chr(_LIMIT) and "\u0130" not in text


def _pieces(text: str) -> list[str]:
    """A long text cut at spaces into pieces of less than CHUNK signs; none if a run without a space is too long."""
    out, at = [], 0
    while len(text) - at >= CHUNK:
        space = text.rfind(" ", at, at + CHUNK - 1)
        if space < 0:
            return []
        out.append(text[at:space])
        at = space + 1
    return [*out, text[at:]]


def _put(table: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``table`` with ``values`` from ``at`` on, twice as long if they have no room."""
    if at + len(values) > len(table):
        table = np.concatenate([table, np.zeros(max(len(table), len(values)), table.dtype)])
    table[at : at + len(values)] = values
    return table


class WordTokenizer:
    """Ids of texts by the word-level vocabulary file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        steps = np.full(CHUNK + 2, _BASE, dtype=np.uint64)
        steps[0] = 1
        self.up = np.multiply.accumulate(steps)
        steps[1:] = _UNBASE
        self.down = np.multiply.accumulate(steps)
        self.clear()

    def clear(self) -> None:
        #: sorted keys of the parts and their places
        self.keys = np.zeros(0, np.uint64)
        self.order = np.zeros(0, np.int64)
        #: parts and ids in the tables below, which have room to spare
        self.parts = self.ids = 0
        self.starts = np.zeros(2 * CACHED, np.int64)
        self.sizes = np.zeros(2 * CACHED, np.int64)
        self.flat = np.zeros(4 * CACHED, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each text."""
        out: list[np.ndarray] = []
        group: list[str] = []
        size = 0
        for text in texts:
            plain = _plain(text)
            if plain and size + len(text) < CHUNK:
                group.append(text)
                size += len(text) + 1
                continue
            out += self._cut(group)
            group, size = [], 0
            if plain and len(text) < CHUNK:
                group, size = [text], len(text) + 1
            elif plain and "<|" not in text and (pieces := _pieces(text)):
                out.append(np.concatenate([ids for piece in pieces for ids in self._cut([piece])]))
            else:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32))
        return out + self._cut(group)

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        joined = " ".join(texts) + " "
        if "<|" in joined:  # a special token's name in a text keeps its own id
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
        low = _LOW[np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)]
        kind = _CLASS[low]
        n = len(low)
        first = np.ones(n, dtype=bool)
        first[1:] = kind[1:] != kind[:-1]
        first |= kind == 2
        for i in np.flatnonzero(first & (low == 39)):
            tail = low[i + 1 : i + 3].tobytes().decode("utf-32-le")
            wide = 2 if tail[:1] in ("s", "t", "m", "d") and tail else 3 if tail in ("re", "ve", "ll") else 0
            if wide:
                first[i + 1 : i + wide] = False
                first[i + wide] = True
        marks = np.flatnonzero(first)
        ends = np.append(marks[1:], n)
        part = kind[marks] != 0
        marks, ends = marks[part], ends[part]
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_CODE[low] * self.up[:n], out=sums[1:])
        keys = mix((sums[ends] - sums[marks]) * self.down[marks] + (ends - marks).astype(np.uint64))
        distinct, at, which = np.unique(keys, return_index=True, return_inverse=True)
        place = self._places(distinct, low.tobytes().decode("utf-32-le"), marks[at], ends[at])[which]
        sizes = self.sizes[place]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.starts[place] - total[:-1], sizes) + np.arange(total[-1])]
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return np.split(ids, total[np.searchsorted(marks, bounds[1:-1])])

    def _places(self, keys: np.ndarray, low: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the cache has the ids of each distinct part; ``keys`` are sorted."""
        if len(self.keys) > CACHED:
            self.clear()
        near = np.searchsorted(self.keys, keys)
        known = near < len(self.keys)
        known[known] = self.keys[near[known]] == keys[known]
        place = np.empty(len(keys), dtype=np.int64)
        place[known] = self.order[near[known]]
        new = np.flatnonzero(~known)
        if len(new):
            parts = [low[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            # parts beside each other, a blank between them: the last id of each ends a word
            lines = [" ".join(parts[i : i + 2000]) for i in range(0, len(parts), 2000)]
            found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, dtype=np.uint32) for x in found])
            stops = np.flatnonzero(self.ends[ids]) + 1
            sizes = np.diff(stops, prepend=0)
            place[new] = self.parts + np.arange(len(new))
            self.starts = _put(self.starts, self.parts, stops - sizes + self.ids)
            self.sizes = _put(self.sizes, self.parts, sizes)
            self.flat = _put(self.flat, self.ids, ids)
            self.parts += len(new)
            self.ids += len(ids)
            self.keys = np.insert(self.keys, near[new], keys[new])
            self.order = np.insert(self.order, near[new], place[new])
        return place


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
