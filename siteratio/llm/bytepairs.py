"""Token counts of whole texts by merging byte pairs with a heap and a linked list.

The pieces of a vocabulary file have scores. A text starts as its code points; again and again the two
neighbours whose union is the piece of best score (the leftmost among equals) become one symbol, until
no two neighbours form a piece. A heap holds the pairs that may merge, two arrays of positions are the
linked list of symbols. The number of tokens is the number of initial symbols less that of merges: a
code point outside the vocabulary stands for the symbols of its UTF-8 bytes, which never merge. No
identifier is made.

Texts are cut first where no piece reaches across: before a blank after another sign, if no piece holds
one inside, and in long words between signs that no piece has side by side. The parts merge alone, so
counts of short ones are kept in a bounded table, and a text is read in windows, whatever its length.

Defined cases: a null text has 0 bytes and 0 tokens, as the empty text has; rows that repeat give one
row each, a null doc_id stays null; an empty table gives an empty one; further columns are ignored; a
long text without a place to cut is merged in one go, at about 200 bytes a code point. Vocabularies with
user-defined pieces, which a text would be searched for first, are not supported.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a text read at once; a window ends at the next place where a word may end.
WINDOW = 1 << 18
#: Words up to this length are kept with their counts, in two generations of at most so many.
KEPT_LENGTH, KEPT_WORDS = 32, 300_000
BLANK = "▁"


class MergeCounter:
    """Counts the tokens of texts by the vocabulary file at ``path``."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = p = SentencePieceProcessor(model_file=path)
        scores = {
            p.id_to_piece(i): p.get_score(i)
            for i in range(p.get_piece_size())
            if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))
        }
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: order[s] for piece, s in scores.items() if len(piece) > 1}
        self.single = {piece for piece in scores if len(piece) == 1}
        self.beside = {a + b for piece in self.rank for a, b in zip(piece, piece[1:], strict=False)}
        inner = any(BLANK in piece.lstrip(BLANK) for piece in self.rank)
        self.words = None if inner else re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.word_end = re.compile(f"[^{BLANK}](?={BLANK})")
        self.kept: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def initial(self, part: str) -> int:
        """Symbols before any merge."""
        single = self.single
        return sum(1 if c in single else len(c.encode("utf-8", "surrogatepass")) for c in part)

    def merges(self, part: str) -> int:
        """How often two neighbours of ``part`` become one."""
        n = len(part)
        get, push, pop = self.rank.get, heapq.heappush, heapq.heappop
        # a symbol is the position it starts at: where it ends, and where the one before it starts
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(part[i : i + 2])) is not None]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, left, middle, right = pop(heap)
            if end[left] != middle or end[middle] != right:
                continue  # one of the two has merged since
            done += 1
            end[left], end[middle] = right, -1
            if right < n:
                before[right] = left
                r = get(part[left : end[right]])
                if r is not None:
                    push(heap, (r, left, right, end[right]))
            start = before[left]
            if start >= 0:
                r = get(part[start:right])
                if r is not None:
                    push(heap, (r, start, left, right))
        return done

    def _count_word(self, word: str) -> int:
        if len(word) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_WORDS:
                self.older, self.kept = self.kept, {}
            n = self.older.get(word)
            self.kept[word] = n = self.initial(word) - self.merges(word) if n is None else n
            return n
        beside, start, n = self.beside, 0, 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in beside:
                if k - start > 1:
                    n -= self.merges(word[start:k])
                start = k
        return n + self.initial(word) - self.merges(word[start:])

    def windows(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > WINDOW and self.words is not None:
            cut = self.word_end.search(text, start + WINDOW)
            if not cut:
                break
            yield text[start : cut.end()]
            start = cut.end()
        yield text[start:] if start else text

    def count(self, text: str | None) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        get, n = self.kept.get, 0
        for window in self.windows(self.processor.normalize(text)):
            for word in self.words.findall(window) if self.words else [window]:
                k = get(word)
                n += self._count_word(word) if k is None else k
        return n


_loaded: dict[str, MergeCounter] = {}


def merge_counter(path: str) -> MergeCounter:
    """The counter of a vocabulary file, loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = MergeCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes (UTF-8) and n_tokens of every text by the vocabulary file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(vocabulary)
        for batch in batches:
            tokens = np.fromiter((counter.count(t.as_py()) for t in batch.column(2)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens)], out.names)

    rows = docs.select(
        F.col(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("_text")
    )
    out = rows.drop("_text").withColumn("n_tokens", F.lit(0).cast("long")).schema
    return rows.mapInArrow(count, out)


def over_limit(limit: int, tokens: str = "n_tokens") -> Column:
    """Whether a text has more than ``limit`` tokens."""
    return F.col(tokens) > limit
