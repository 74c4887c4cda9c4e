"""Words and word shingles of whole texts, hashed straight from Arrow's text buffers.

Bytes A-Z count as a-z; a word is a run of anything but the space and the bytes 9 to 13, so in
UTF-8 every letter beyond ASCII belongs to a word. A word's hash is a polynomial of its bytes modulo
2**64, taken from running sums, and mixed; a text is handled in segments of bounded size that end at
a word's end, so memory follows the segment and not the text (only a single word may exceed it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once.
SEGMENT = 1 << 18
#: Words of a shingle.
SHINGLE = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)[_LOWER]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def text_buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, raw = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.zeros(0, np.uint8) if raw is None else np.frombuffer(raw, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SEGMENT bytes that end after a space (or at the end)."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + SEGMENT, n)
        while end < n:
            spaces = np.flatnonzero(~_WORD[data[end : end + SEGMENT]])
            if len(spaces):
                end += int(spaces[0]) + 1
                break
            end = min(end + SEGMENT, n)
        yield at, end
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in bytes of all words; a word never crosses from one text to the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _WORD[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    before[firsts] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    after[lasts] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_hashes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, in order; number of words of each text)."""
    data, offsets = text_buffer(texts)
    hashes, begins = [], []
    for lo, hi in _segments(data):
        part = data[lo:hi]
        inner = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, hi, "right")] - lo
        starts, ends = word_spans(part, np.concatenate([[0], inner, [hi - lo]]))
        up, down = _powers(hi - lo)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * up[: hi - lo], out=sums[1:])
        value = (sums[ends] - sums[starts]) * down[starts]
        hashes.append(mix(value + (ends - starts).astype(np.uint64) * _BASE))
        begins.append(starts + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    begins = np.concatenate(begins)
    return np.concatenate(hashes), np.diff(np.searchsorted(begins, offsets, "left"))


def shingle_sets(texts: pa.Array | pa.ChunkedArray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles.

    A text with fewer than ``size`` words has its whole sequence as its one shingle; one without
    words has none.
    """
    words, counts = word_hashes(texts)
    at = 0
    for n in counts:
        own = words[at : at + n]
        at += n
        if n == 0:
            yield np.zeros(0, np.uint64)
            continue
        wide = min(size, int(n))
        value = np.full(n - wide + 1, wide, dtype=np.uint64)
        for k in range(wide):
            value = value * _BASE + own[k : n - wide + 1 + k]
        yield np.unique(mix(value))
