"""Spelling variants: words one edit apart, found with k-d trees over letter counts.

A word is a point whose coordinates count its letters. One replaced letter moves the point by one up in
one coordinate and one down in another, one inserted letter by one up: the L1 distance is at most two,
whatever the place of the edit. So the words near a given one lie in a small box around it, among the
points of its own length and of the next.

* **Counting.** Runs of letters are counted inside tasks, text by text, and only sums per word are
  shuffled. Texts are read in windows, so a very long one takes no more memory.
* **Cells.** For each length, a k-d tree over a bounded sample of words (``SAMPLE``) cuts the space of letter
  counts into cells. The sample only chooses the cuts: every word is a point of exactly one cell and asks
  every cell whose box its own box meets, those of its length and of the next. Points and questions of a
  cell with too many of either are dealt out in blocks, each block of points meeting each block of questions.
* **Range search.** In a block, a k-d tree with tight boxes is built over the points and all questions go
  down together; a subtree is left where its box is further than one up and one down. In a leaf, two
  words stay only if their first or their second halves are the same letters, as one edit leaves one half alone,
  and what stays is compared letter by letter.
* **Forms.** A block gives per word the number of near words it met and the best of them, never the pairs; a grouped
  sum joins the blocks. Chains of forms are followed by doubling; n at least doubles along a chain, so it ends.

Defined cases: a null text has no words; a null doc_id counts as the empty text in ``<doc_id>:<run>``; rows that
repeat count again; ties between forms go to the smallest word in code-point order; an empty table gives no words;
further columns are ignored. A run may be as long as a text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteratio.llm.store import stored

#: Words that choose the cuts between cells.
SAMPLE = 100_000
#: Points a cell should hold, and most questions of a block.
CELL, ASKED = 20_000, 100_000
#: Most points of a leaf, unless they are all alike.
LEAF = 48
#: Bytes of a text read at once; distinct words summed up in a task before they are handed on.
WINDOW, HELD = 1 << 20, 200_000
#: Questions that go down a tree together.
TOGETHER = 16_384

_RUN = re.compile(rb"[a-z]*(?:\xc3[\x80-\xbf][a-z]*)+|[a-z]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")

# ---------------------------------------------------------------- words


def runs(text: str) -> Iterator[list[bytes]]:
    """The maximal runs of letters of a text, A-Z lower-cased, as UTF-8, window by window."""
    data = text.encode("utf-8", "surrogatepass").lower()  # of bytes, only A-Z change
    start = 0
    while start < len(data):
        cut = _GAP.search(data, start + WINDOW)
        stop = cut.end() if cut else len(data)
        yield _RUN.findall(data, start, stop)
        start = stop


def thinned(run: bytes, prefix: int, every: int) -> bytes:
    """The run, or without one letter if ``every`` divides its checksum (that of the text before it is ``prefix``)."""
    h = zlib.crc32(run, prefix)
    if h % every:
        return run
    letters = run.decode()
    k = h % len(letters)
    return (letters[:k] + letters[k + 1 :]).encode()


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, every: int = 97) -> DataFrame:
    """word, n and length of all words of the texts that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def hand_on() -> pa.RecordBatch:
            pairs = [(w.decode(), n) for w, n in held.items()]
            pairs = [p for p in pairs if len(p[0]) >= min_length]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key, text = key.as_py(), text.as_py()
                if not text:
                    continue
                prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
                for window in runs(text):
                    for run, n in Counter(window).items():
                        if len(run) >= min_length:
                            word = thinned(run, prefix, every)
                            held[word] = held.get(word, 0) + n
                    if len(held) > HELD:
                        yield hand_on()
        yield hand_on()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    words = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return words.withColumn("length", F.length("word"))


# ---------------------------------------------------------------- letter counts

#: a to z and U+00C0 to U+00FF.
LETTERS = 26 + 64
_DIMENSION = np.zeros(256, dtype=np.int64)
_DIMENSION[97:123] = np.arange(26)
_DIMENSION[192:] = np.arange(26, LETTERS)


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of letter counts a word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    kind = np.int16 if lengths.max(initial=0) < 1 << 14 else np.int64
    codes = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    at = np.repeat(np.arange(len(words)) * LETTERS, lengths) + _DIMENSION[codes]
    return np.bincount(at, minlength=len(words) * LETTERS).astype(kind).reshape(-1, LETTERS)


@dataclass
class Tree:
    """A k-d tree: boxes over the coordinates ``dims``, cuts, and the points of each leaf."""

    dims: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cuts: list[tuple[int, int, int, int] | None]  # dimension, largest value of the left child, children
    points: list[np.ndarray | None]
    fixed: np.ndarray | None  # the one value of all points in the other coordinates; None: no bound there

    def locate(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf each vector belongs to."""
        out = np.zeros(len(vectors), dtype=np.int64)
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            cut = self.cuts[node]
            if cut is None:
                out[rows] = node
                continue
            left = vectors[rows, cut[0]] <= cut[1]
            stack += [(cut[2], rows[left]), (cut[3], rows[~left])]
        return out

    def reach(self, vectors: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves and the vectors that get into their box by at most ``up`` and ``down`` in sum."""
        v = vectors[:, self.dims]
        rise = fall = np.zeros(len(v), dtype=np.int64)
        if self.fixed is not None:
            rest = np.delete(vectors, self.dims, axis=1)
            rise = np.maximum(self.fixed - rest, 0).sum(1)
            fall = np.maximum(rest - self.fixed, 0).sum(1)
        stack = [(0, np.flatnonzero((rise <= up) & (fall <= down)))]
        while stack:
            node, rows = stack.pop()
            x = v[rows]
            ups = np.maximum(self.low[node] - x, 0).sum(1) + rise[rows]
            downs = np.maximum(x - self.high[node], 0).sum(1) + fall[rows]
            rows = rows[(ups <= up) & (downs <= down)]
            if not len(rows):
                continue
            cut = self.cuts[node]
            if cut is None:
                yield node, rows
            else:
                stack += [(cut[2], rows), (cut[3], rows)]


def _best_cut(x: np.ndarray) -> tuple[int, int] | None:
    """The coordinate and value that cut the points most evenly; None if they are all alike."""
    middle = np.partition(x, len(x) // 2, axis=0)[len(x) // 2]
    most, best = 0, None
    for value, left in ((middle, (x <= middle).sum(0)), (middle - 1, (x < middle).sum(0))):
        even = np.minimum(left, len(x) - left)
        d = int(even.argmax())
        if even[d] > most:
            most, best = even[d], (d, int(value[d]))
    return best


def build(x: np.ndarray, capacity: int, tight: bool) -> Tree:
    """A tree over the rows of ``x``; ``tight`` boxes hold just these points, others the whole side of each cut."""
    some = (
        np.flatnonzero(x.min(0, initial=1 << 14) != x.max(0, initial=-1)) if tight else np.arange(x.shape[1])
    )
    if tight and not len(x):
        raise ValueError("a tight tree needs points")
    cuts: list = []
    points: list = []
    lows: list = []
    highs: list = []
    top = np.iinfo(x.dtype).max

    def add(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
        node = len(cuts)
        cuts.append(None)
        points.append(rows)
        lows.append(x[rows][:, some].min(0) if tight else low)
        highs.append(x[rows][:, some].max(0) if tight else high)
        return node

    wide = np.zeros(len(some), x.dtype), np.full(len(some), top, x.dtype)
    stack = [add(np.arange(len(x)), *wide)]
    while stack:
        node = stack.pop()
        rows = points[node]
        cut = _best_cut(x[rows][:, some]) if len(rows) > capacity and len(some) else None
        if cut is None:
            continue
        d, value = cut
        left = x[rows, some[d]] <= value
        below, above = highs[node].copy(), lows[node].copy()
        below[d], above[d] = value, value + 1
        children = add(rows[left], lows[node], below), add(rows[~left], above, highs[node])
        cuts[node], points[node] = (int(some[d]), value, *children), None
        stack += children
    low, high = np.array(lows), np.array(highs)
    if tight:
        return Tree(some, low, high, cuts, points, np.delete(x[0], some))
    used = np.unique([c[0] for c in cuts if c]).astype(np.int64)
    return Tree(used, low[:, used], high[:, used], cuts, [None] * len(points), None)


# ---------------------------------------------------------------- near words


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter is replaced, or put into the shorter ``a`` (as long or one less long than ``b``)."""
    n = len(a)
    k = 0
    while k < n and a[k] == b[k]:
        k += 1
    if len(b) == n:
        return k < n and a[k + 1 :] == b[k + 1 :]
    return a[k:] == b[k + 1 :]


def _halves(words: list[str], first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``first`` and the last ``last`` letters."""
    of = lambda part: np.fromiter((hash(part(w)) for w in words), np.int64, len(words))
    return of(lambda w: w[:first]), of(lambda w: w[len(w) - last :])


def near_pairs(points: list[str], asked: list[str]) -> Iterator[tuple[int, int]]:
    """Places (in ``asked``, in ``points``) of words one edit apart.

    All points are of one length; all asked words are of that length or all of one less.
    """
    if not points or not asked:
        return
    short = len(asked[0])
    shorter = short < len(points[0])
    half = short // 2
    tree = build(letter_counts(points), LEAF, tight=True)
    p_first, p_last = _halves(points, half, short - half)
    for start in range(0, len(asked), TOGETHER):
        some = asked[start : start + TOGETHER]
        a_first, a_last = _halves(some, half, short - half)
        for leaf, rows in tree.reach(letter_counts(some), 1, 0 if shorter else 1):
            here = tree.points[leaf]
            for k in range(0, len(here), 1024):
                block = here[k : k + 1024]
                step = max(1, (1 << 20) // len(block))
                for m in range(0, len(rows), step):
                    r = rows[m : m + step]
                    same = a_first[r][:, None] == p_first[block]
                    same |= a_last[r][:, None] == p_last[block]
                    for i, j in zip(*np.nonzero(same), strict=True):
                        a, p = int(r[i]), int(block[j])
                        if one_edit(some[a], points[p]):
                            yield start + a, p


def _cell_trees(words: DataFrame, total: int) -> dict[int, Tree]:
    """A tree of cells for each length, cut by a bounded sample."""
    step = max(1, -(-total // SAMPLE))
    sample = words.select("word", "length").where(F.pmod(F.xxhash64("word"), F.lit(step)) == 0).limit(2 * SAMPLE)
    by_length: dict[int, list[str]] = {}
    for r in sample.collect():
        by_length.setdefault(r.length, []).append(r.word)
    capacity = max(1, CELL // step)
    return {n: build(letter_counts(w), capacity, tight=False) for n, w in by_length.items()}


def _routes(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """word, n, asks, length and cell: as a point, the cell it is in; as a question, all cells it has to see."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                part = batch.take(pa.array(rows))
                vectors = letter_counts(part.column(0).to_pylist())
                own, longer = trees.get(length), trees.get(length + 1)
                whole = np.arange(len(rows))
                found = [(False, length, 0, whole)] if own is None else []
                if own is not None:
                    leaves = own.locate(vectors)
                    found += [(False, length, k, np.flatnonzero(leaves == k)) for k in np.unique(leaves).tolist()]
                for n, tree, down in ((length, own, 1), (length + 1, longer, 0)):
                    reached = [(0, whole)] if tree is None else tree.reach(vectors, 1, down)
                    found += [(True, n, k, r) for k, r in reached]
                for asks, n, cell, r in found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(r)),
                            part.column(1).take(pa.array(r)),
                            pa.array(np.full(len(r), asks)),
                            pa.array(np.full(len(r), n, np.int32)),
                            pa.array(np.full(len(r), cell, np.int32)),
                        ],
                        ["word", "n", "asks", "length", "cell"],
                    )

    return words.select("word", "n", "length").mapInArrow(
        route, "word string, n long, asks boolean, length int, cell int"
    )


def _met(group: pa.Table) -> pa.Table:
    """Of one block: per word the number of near words met here and the best of them."""
    words, counts = group.column("word").to_pylist(), group.column("n").to_pylist()
    asks, length = group.column("asks").to_pylist(), group.column("length")[0].as_py()
    points = [k for k, a in enumerate(asks) if not a]
    met: dict[str, list] = {}

    def meet(word: str, n: int, other: str) -> None:
        seen = met.get(word)
        if seen is None:
            met[word] = [1, -n, other]
        else:
            seen[0] += 1
            if (-n, other) < (seen[1], seen[2]):
                seen[1:] = -n, other

    for shorter in (False, True):
        asked = [k for k, a in enumerate(asks) if a and len(words[k]) == length - shorter]
        for a, p in near_pairs([words[k] for k in points], [words[k] for k in asked]):
            i, j = asked[a], points[p]
            meet(words[i], counts[j], words[j])
            if shorter:
                meet(words[j], counts[i], words[i])
    columns = zip(*((w, *m) for w, m in met.items()), strict=True) if met else ([], [], [], [])
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.Table.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["word", "met", "minus_n", "other"]
    )


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form and form_n of every word that has a near one; ``words`` has word, n and length."""
    trees = _cell_trees(words, words.count())
    routes = stored(_routes(words, trees), "routes")
    sizes = routes.groupBy("length", "cell").agg(
        F.count_if(~F.col("asks")).alias("points"), F.count_if(F.col("asks")).alias("questions")
    )
    large = sizes.where(f"points > {CELL * 2} OR questions > {ASKED * 2}").selectExpr(
        "length", "cell", f"points div {CELL} + 1 AS p", f"questions div {ASKED} + 1 AS q"
    )
    # a point goes to one block of points and meets all blocks of questions; a question the other way round
    blocks = (
        routes.join(large, ["length", "cell"], "left")
        .selectExpr("word", "n", "asks", "length", "cell", "coalesce(p, 1L) AS p", "coalesce(q, 1L) AS q")
        .selectExpr("*", "pmod(xxhash64(word), if(asks, q, p)) AS mine")
        .selectExpr("*", "explode(sequence(0L, if(asks, p, q) - 1)) AS theirs")
        .selectExpr(
            "word", "n", "asks", "length", "cell",
            "if(asks, theirs, mine) AS points_block", "if(asks, mine, theirs) AS questions_block",
        )
    )
    met = blocks.groupBy("length", "cell", "points_block", "questions_block").applyInArrow(
        _met, "word string, met long, minus_n long, other string"
    )
    best = met.groupBy("word").agg(F.sum("met").alias("n_near"), F.min(F.struct("minus_n", "other")).alias("best"))
    return best.selectExpr("word", "n_near", "best.other AS form", "-best.minus_n AS form_n")


def follow(forms: DataFrame) -> DataFrame:
    """word and root: the last form of the chain that starts with each word of ``forms`` (word, form not null)."""
    chains = stored(forms.selectExpr("word", "form AS root"), "chains")
    while True:
        ahead = chains.selectExpr("word AS root", "root AS further")
        moved = stored(
            chains.join(ahead, "root", "left").selectExpr("word", "coalesce(further, root) AS root", "further"), "chains"
        )
        if moved.where("further IS NOT NULL").isEmpty():
            return chains
        chains = moved.drop("further")


def spelling_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, every: int = 97, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of the documents.

    A word's form is its most frequent near word if that is at least ``times`` as frequent.
    """
    words = stored(word_counts(docs, min_length, min_count, every), "words")
    near = stored(near_words(words), "near")
    rows = words.join(near, "word", "left").selectExpr(
        "word",
        "n",
        "coalesce(n_near, 0L) AS n_near",
        f"if(form_n >= {times} * n, form, NULL) AS form",
        f"if(form_n >= {times} * n, form_n, NULL) AS form_n",
    )
    rows = stored(rows, "forms")
    roots = follow(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").selectExpr(
        "word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n"
    )
