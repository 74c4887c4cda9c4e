"""Katz backoff language model over words.

The model has two orders. All pairs of words seen in the training texts, also those seen once, have
discounted probabilities d(c) c(hw) / c(h), with Katz's Good-Turing discounts for the counts from 1 to 5:
what these take from all pairs is n_1, the estimate for the pairs never seen. Larger counts, and those for which the
formula is no discount, are discounted by 1 / 2. What the pairs leave of a history's mass goes to all
other words in proportion to their single-word probability (c(w) + 1) / (N + V + 1), which keeps one
share for words never seen. The weight of that, alpha(h), is exactly what makes the probabilities after h
sum to one. No pair is left out, at any size.

Tables are keyed by codes of words: small numbers for the most frequent ones (at most NUMBERED, whatever the
corpus), so that rows of pairs take few bytes in shuffles, and 64-bit hashes for the others. A text's probability is a sum over its tokens,

    log P_1(w) + log alpha(w)      for each word, as what is predicted and as the next history,
    + gain(h, w)                   for each pair in the table: the log of its probability over alpha(h) P_1(w),

so scoring is two lookups per token. The gain of a pair follows from its count and from the rows of its two words, so only
counts of pairs are stored. Numbered words and the frequent pairs of them (at most FREQUENT, whatever the corpus) are looked
up in broadcast arrays; gains of pairs with a rare word are found by shuffle joins. All tokens without a frequent pair then
meet the other pairs of their bucket (a hash of the pair), and rare words their rows in the same way, as pairs behind no word. That is done
in SLICES parts, one after the other and each over its own buckets, so that its files are never on disk all at once.

Pairs and tokens are shuffled and stored as blocks: a row has many of one bucket, as packed arrays, so Spark moves few rows and the
work on single pairs is done on arrays inside tasks. A bucket has at most about TALLIED tokens over SLICES, whatever the corpus.

Defined cases: a null or empty text is the end token alone; repeated rows have equal scores; without
training texts every token has probability 1 / (V + 1) with V = 0; rows with a null doc_id train; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteratio.llm.store import stored, temporary
from siteratio.llm.words import mix, word_hashes

#: Most pairs that are broadcast.
FREQUENT = 1_000_000
#: Most words that get a small number for a code; their rows are broadcast.
NUMBERED = 500_000
#: Parts in which tokens meet the pairs that are not broadcast.
SLICES = 2
#: Tokens whose pairs a task adds up at once.
TALLIED = 1 << 21
#: Rows of a batch that goes back to Spark.
BATCH = 1 << 16
#: Pairs of a block in the table.
PIECE = 1 << 19
#: Least count of a pair in the table, whatever the corpus: all pairs are in it.
CUTOFF = 1
#: Counts from the cutoff on that get Good-Turing discounts.
DISCOUNTED = 5
#: Codes of the end token and of the history at a text's start, and the least number of a word; they can't be hashes
#: of words but by chance. NONE stands before a rare word that is looked up alone.
NONE = 0
END = 1
START = 2
FIRST = 3
#: Columns of blocks: arrays of histories and words (of numbers where both are numbered), and two more as the kind says.
BLOCK = ["bucket", "kind", "h", "w", "x", "y"]
BLOCKS = "bucket int, kind int, h binary, w binary, x binary, y binary"
#: Kinds of blocks. Counts of pairs (x) of numbered words and of others, gains and bases (x, y) of pairs with a rare word, tokens with the
#: texts (x) of runs of them and their lengths (y), for numbered words and others. Tables come before the tokens that meet them.
PAIRS, RARE, GAINS, TOKENS, OTHERS, TEXTS = range(6)
#: What is added up for a text.
SUMS = ["row", "tokens", "known", "base", "gain"]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text modulo 7 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", "text").alias("row"),
        held_out(F.col("doc_id")).alias("held"),
        "text",
    )


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(history, word, position in the batch of the text) of every token of a batch of texts."""
    words, counts = word_hashes(part.column("text"))
    words = words.view(np.int64)
    ends = np.cumsum(counts + 1) - 1
    word = np.full(len(words) + len(counts), END, dtype=np.int64)
    inner = np.ones(len(word), dtype=bool)
    inner[ends] = False
    word[inner] = words
    history = np.empty_like(word)
    history[1:] = word[:-1]
    history[ends - counts] = START
    return history, word, np.repeat(np.arange(len(counts)), counts + 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c: how often each token occurs in the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                _, word, _ = _tokens(batch.slice(at, 1000))
                distinct, n = np.unique(word, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n)], names=["word", "c"])

    training = _source(docs).where(~F.col("held")).select("text")
    return training.mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Places:
    """Places of values in a sorted array of distinct 64-bit hashes, found from their leading bits."""

    def __init__(self, hashes: np.ndarray):
        bits = len(hashes).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(hashes >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
        self.hashes = np.append(hashes, np.uint64(0xFFFFFFFFFFFFFFFF))

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a value is in the array, its place if so)."""
        at = self.first[(values >> self.shift).astype(np.int64)]
        behind = np.flatnonzero(self.hashes[at] < values)
        while len(behind):  # few share their leading bits
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < values[behind]]
        return (self.hashes[at] == values) & (at < len(self.hashes) - 1), at


class Numbers:
    """Codes of words: numbers for the words given, from FIRST on in their order, hashes for the others."""

    def __init__(self, words: np.ndarray):
        words = words.view(np.uint64)
        order = np.argsort(words)
        self.places, self.codes = Places(words[order]), np.append(order.astype(np.int64) + FIRST, 0)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        found, at = self.places(words.view(np.uint64))
        return np.where(found, self.codes[at], words)


def numbered(counts: DataFrame, most: int) -> tuple[Broadcast, int, DataFrame]:
    """Numbers of the words that occur most (no more than ``most``), the first number not used, and ``counts`` by codes."""
    often = counts.where((F.col("c") >= Model.frequent(counts, most)) & (F.col("word") != END)).toArrow().sort_by(
        [("c", "descending"), ("word", "ascending")]
    )
    numbers = counts.sparkSession.sparkContext.broadcast(Numbers(often["word"].to_numpy()))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = numbers.value(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(codes), batch.column(1)], names=["word", "c"])

    return numbers, FIRST + len(often), counts.select("word", "c").mapInArrow(code, "word long, c long")


def _codes(part: pa.RecordBatch, numbers: Broadcast) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(history, word, position in the batch of the text) of every token of a batch of texts, words by their codes."""
    history, word, text = _tokens(part)
    word = numbers.value(word)
    return np.where(history == START, START, np.roll(word, 1)), word, text


def _within(codes: np.ndarray, top: int) -> np.ndarray:
    """Which codes are numbers below ``top``."""
    return (codes > NONE) & (codes < top)


def _common(top: int, *names: str) -> Column:
    """Whether all the columns have codes that are numbers below ``top``."""
    out = F.lit(True)
    for name in names:
        out &= F.col(name).between(NONE + 1, top - 1)
    return out


class Rows:
    """What is known of the numbered words, by their codes: c (how often they occur), alpha and ``before`` (as histories)."""

    def __init__(self, table: pa.Table, top: int, starts: int, start: float):
        self.c, self.alpha = np.zeros(top, np.int64), np.zeros(top)
        self.c[table["word"].to_numpy()] = table["c"].to_numpy()
        self.alpha[table["word"].to_numpy()] = table["alpha"].to_numpy()
        self.before, self.weight = self.c.copy(), self.alpha.copy()
        self.before[START], self.weight[START] = starts, start


def discounts(of_count: dict[int, int], least: int) -> dict[int, float]:
    """Katz's discount factors of the counts from ``least``; where they are no discount, 1 - 1 / (2 c).

    ``of_count`` has how many pairs were seen how often. The factors are (c* / c - m) / (1 - m), with Turing's
    c* = (c + 1) n_(c + 1) / n_c and the share m of the pairs seen least that the larger counts would have to give.
    """
    top = least + DISCOUNTED
    rest = top * of_count.get(top, 0) / (least * of_count[least]) if of_count.get(least) else 1.0
    out = {}
    for c in range(least, top):
        turing = (c + 1) * of_count.get(c + 1, 0) / (c * of_count[c]) if of_count.get(c) else 0.0
        katz = (turing - rest) / (1 - rest) if rest < 1 else 0.0
        out[c] = katz if 0.0 < katz < 1.0 else 1 - 0.5 / c
    return out


def _tally(h: np.ndarray, w: np.ndarray, c: np.ndarray | None, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ones of pairs (h, w) and the sums of their counts c (None: one each); numbered words' pairs sort as one integer."""
    common = _within(h, top) & _within(w, top)
    key = h[common] * top + w[common]
    if c is None:
        key, often = np.unique(key, return_counts=True)
        c = np.ones(len(h), np.int64)
    else:
        order = np.argsort(key)
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        key, often = key[order][first], np.add.reduceat(c[common][order], first)
    h, w, c = h[~common], w[~common], c[~common]
    order = np.lexsort((w, h))
    h, w = h[order], w[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)
    rare = np.add.reduceat(c[order], first)
    return np.concatenate([key // top, h[first]]), np.concatenate([key % top, w[first]]), np.concatenate([often, rare])


def _batches(names: list[str], columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + BATCH]) for x in columns], names=names)


def _buckets(h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """One of n buckets for each pair (h, w), by a hash of it."""
    key = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0x94D049BB133111EB)
    return (((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order that brings equal keys together and keeps theirs; the keys, and where in that order they are."""
    small = keys.astype(np.uint16) if len(keys) and keys.max() < 1 << 16 else keys  # sorted by digits
    order = np.argsort(small, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    ends = np.append(first[1:], len(keys))[: len(first)]
    return order, [(int(keys[lo]), slice(lo, hi)) for lo, hi in zip(first, ends, strict=True)]


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest takes."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if k is np.int64 or x.max(initial=0) <= np.iinfo(k).max)
    return x.astype(kind).tobytes()


def _unpacked(x: pa.Scalar, n: int) -> np.ndarray:
    """The n numbers of ``_packed``."""
    raw = x.as_py()
    width = len(raw) // n if n else 8
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[width]).astype(np.int64)


def _codes_packed(h: np.ndarray, w: np.ndarray, common: bool) -> tuple[bytes, bytes]:
    """Pairs of codes; numbers take 4 bytes, and histories are differences to the one before."""
    kind = np.uint32 if common else np.int64
    return np.diff(h, prepend=0).astype(kind).tobytes(), w.astype(kind).tobytes()


def _codes_unpacked(h: pa.Scalar, w: pa.Scalar, common: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``_codes_packed``."""
    kind = np.uint32 if common else np.int64
    h = np.cumsum(np.frombuffer(h.as_py(), kind), dtype=kind)  # differences wrap around, and so do their sums
    return h.astype(np.int64), np.frombuffer(w.as_py(), kind).astype(np.int64)


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Blocks as a batch, from tuples as in BLOCK."""
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=BLOCK)


def _pair_blocks(h: np.ndarray, w: np.ndarray, c: np.ndarray, top: int, bucket: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``most`` counted pairs, by their buckets."""
    rare = ~(_within(h, top) & _within(w, top))
    order, groups = _groups(2 * bucket + rare)
    h, w, c = h[order], w[order], c[order]
    rows, size = [], 0
    for key, place in groups:
        for lo in range(place.start, place.stop, most):
            at = slice(lo, min(lo + most, place.stop))
            kind = RARE if key % 2 else PAIRS
            rows.append((key // 2, kind, *_codes_packed(h[at], w[at], kind == PAIRS), _packed(c[at]), b""))
            size += at.stop - at.start
            if size >= most:
                yield _block_rows(rows)
                rows, size = [], 0
    if rows:
        yield _block_rows(rows)


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(h, w, c, kind) of blocks of counted pairs."""
    for batch in batches:
        kinds, hs, ws, cs = (batch.column(k) for k in ("kind", "h", "w", "x"))
        for i in range(batch.num_rows):
            kind = kinds[i].as_py()
            h, w = _codes_unpacked(hs[i], ws[i], kind == PAIRS)
            yield h, w, _unpacked(cs[i], len(h)), kind


def bucket_tasks(docs: DataFrame, tokens: int) -> int:
    """Tasks among which pairs of ``tokens`` tokens are dealt; each has SLICES buckets."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // TALLIED))


def pair_counts(docs: DataFrame, numbers: Broadcast, top: int, tokens: int, blocks: bool = False) -> DataFrame:
    """h, w, c of all pairs in the training texts, of which there are ``tokens``; each pair once. On request as blocks.

    Tasks add up the pairs of their texts, and after the shuffle those of their share, by sorting arrays:
    most of the pairs of a task differ, so hash tables of rows would cost more than they save.
    """
    tasks, slices, names, at_once, piece = bucket_tasks(docs, tokens), SLICES, ["h", "w", "c"], TALLIED, PIECE

    def tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, w, c = _tally(*map(np.concatenate, zip(*parts, strict=True)), None, top)
        yield from _pair_blocks(h, w, c, top, _buckets(h, w, tasks * slices) // slices, piece)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                parts.append(_codes(batch.slice(at, 500), numbers)[:2])
                size += len(parts[-1][0])
                if size >= at_once:
                    yield from tally(parts)
                    parts, size = [], 0
        if parts:
            yield from tally(parts)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, full = [], 0, at_once
        for h, w, c, _ in _pairs_of(batches):
            parts.append((h, w, c))
            size += len(h)
            if size >= full:
                parts = [_tally(*map(np.concatenate, zip(*parts, strict=True)), top)]
                size = len(parts[0][0])
                full = max(at_once, 2 * size)
        if parts:
            h, w, c = _tally(*map(np.concatenate, zip(*parts, strict=True)), top)
            yield from _pair_blocks(h, w, c, top, _buckets(h, w, tasks * slices), piece) if blocks else _batches(names, (h, w, c))

    training = _source(docs).where(~F.col("held")).select("text")
    dealt = training.mapInArrow(spread, BLOCKS).repartitionById(tasks, "bucket")
    return dealt.mapInArrow(add_up, BLOCKS if blocks else "h long, w long, c long")


def unpacked(blocks: DataFrame) -> DataFrame:
    """h, w, c of blocks of counted pairs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, w, c, _ in _pairs_of(batches):
            yield from _batches(["h", "w", "c"], (h, w, c))

    return blocks.mapInArrow(rows, "h long, w long, c long")


def unpacked_gains(blocks: DataFrame) -> DataFrame:
    """h, w, gain, base of blocks of gains."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, w, gain, base in zip(*(batch.column(k) for k in BLOCK[2:]), strict=True):
                sums = (np.frombuffer(x.as_py()) for x in (gain, base))
                yield from _batches(["h", "w", "gain", "base"], (*_codes_unpacked(h, w, False), *sums))

    return blocks.mapInArrow(rows, "h long, w long, gain double, base double")


class Table:
    """Gains and bases of pairs, found by their codes."""

    def __init__(self, h: np.ndarray, w: np.ndarray, gain: np.ndarray, base: np.ndarray | None = None, top: int | None = None):
        self.top = top  # numbers below it are a key as they are, other codes by their places
        if top is None:
            self.h, self.w = np.unique(h), np.unique(w)
            key = np.searchsorted(self.h, h) * len(self.w) + np.searchsorted(self.w, w)
        else:
            key = h * top + w
        order = np.argsort(key)
        self.key, self.gain = np.append(key[order], -1), np.append(gain[order], 0.0)
        self.base = None if base is None else np.append(base[order], 0.0)

    def __call__(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(gains, bases) of pairs, 0 for those not in the table."""
        if self.top is None:
            at_h, at_w = np.searchsorted(self.h, h), np.searchsorted(self.w, w)
            known = np.append(self.h, 0)[at_h] == h
            known &= (at_h < len(self.h)) & (np.append(self.w, 0)[at_w] == w) & (at_w < len(self.w))
            key = np.where(known, at_h * len(self.w) + at_w, -2)
        else:
            key = h * self.top + w
        at = np.searchsorted(self.key[:-1], key)
        at[self.key[at] != key] = len(self.key) - 1
        return self.gain[at], None if self.base is None else self.base[at]


class Model:
    """Tables of a trained model: words (word, c, alpha) and pairs (h, w, c), logs to base 10."""

    def __init__(self, docs: DataFrame, most: int = FREQUENT):
        spark = docs.sparkSession
        self.most, self.least = most, CUTOFF
        with temporary(spark):
            hashed = stored(word_counts(docs), "words")
            self.numbers, self.top, counts = numbered(hashed, min(most, NUMBERED))
            counts = stored(counts, "codes")
            n, v, starts = counts.agg(
                F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0))
            ).first()
            self.tokens, self.distinct = int(n), int(v)
            self.total = self.tokens + self.distinct + 1
            self.tasks = bucket_tasks(docs, self.tokens)
            self.blocks = stored(pair_counts(docs, self.numbers, self.top, self.tokens, blocks=True), "pairs", keep=True)
            self.pairs = unpacked(self.blocks)
            sizes = stored(self._sizes(), "sizes")
            alone = self.least + DISCOUNTED
            of_count = {r["c"]: r["n"] for r in sizes.where(F.col("c") <= alone).collect()}
            self.factors = discounts(of_count, self.least)
            self.often_from = self.frequent(sizes, most, "n")
            start = spark.range(1).select(F.lit(START).cast("long").alias("h"), F.lit(int(starts)).cast("long").alias("of_h"))
            history = counts.select(F.col("word").alias("h"), F.col("c").alias("of_h")).unionByName(start)
            alpha = F.log10((1 - F.col("two") / F.col("of_h")) / (1 - F.col("one") / F.lit(float(self.total))))
            alphas = stored(self._masses(counts).join(history, "h").select("h", alpha.alias("alpha")), "alpha")
            first = alphas.where(F.col("h") == START).first()
            self.start = float(first["alpha"]) if first else 0.0
            words = counts.join(alphas.withColumnRenamed("h", "word"), "word", "left")
            words = words.select("word", "c", F.coalesce("alpha", F.lit(0.0)).alias("alpha"))
            self.words = stored(words, "vocabulary", keep=True)
            known = self.words.where(_common(self.top, "word")).toArrow()
            self.rows = spark.sparkContext.broadcast(Rows(known, self.top, int(starts), self.start))
            self.gains = stored(self._gain_blocks(self._rare_gains(history, alphas)), "gains", keep=True)
            self.rare = unpacked_gains(self.gains)

    def _discounted(self) -> Column:
        """d(c) c of a pair's count c."""
        out = F.col("c") - 0.5
        for c, d in self.factors.items():
            out = F.when(F.col("c") == c, F.lit(d * c)).otherwise(out)
        return out

    def _discount(self) -> Callable[[np.ndarray], np.ndarray]:
        """d(c) c of arrays of counts."""
        kept = np.array([self.factors.get(c, 0) * c for c in range(self.least + DISCOUNTED)])
        return lambda c: np.where(c < len(kept), kept[np.minimum(c, len(kept) - 1)], c - 0.5)

    def _sizes(self) -> DataFrame:
        """c, n: how many pairs are seen how often."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, c, _ in _pairs_of(batches):
                distinct, n = np.unique(c, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n)], names=["c", "n"])

        return self.blocks.mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))

    def _masses(self, counts: DataFrame) -> DataFrame:
        """h; two: sum of d(c) c over its pairs; one: sum of c(w) + 1 over them."""
        top, discount, known = self.top, self._discount(), counts.where(_common(self.top, "word")).toArrow()
        of_word = np.zeros(top)
        of_word[known["word"].to_numpy()] = known["c"].to_numpy()
        of_word = counts.sparkSession.sparkContext.broadcast(of_word)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for h, w, c, kind in _pairs_of(batches):
                if kind == RARE:
                    common = _within(w, top)
                    h, w, c = h[common], w[common], c[common]
                first = np.flatnonzero(np.diff(h, prepend=h[:1] - 1))  # pairs of a block ascend by h
                if len(first):
                    sums = np.add.reduceat(discount(c), first), np.add.reduceat(of_word.value[w] + 1, first)
                    yield from _batches(["h", "two", "one"], (h[first], *sums))

        common = self.blocks.mapInArrow(add_up, "h long, two double, one double")
        tail = counts.where(~_common(self.top, "word")).select(F.col("word").alias("w"), (F.col("c") + 1).cast("double").alias("one"))
        rare = unpacked(self.blocks.where(F.col("kind") == RARE)).where(~_common(self.top, "w")).join(tail, "w")
        both = common.unionByName(rare.select("h", self._discounted().alias("two"), "one"))
        return both.groupBy("h").agg(F.sum("two").alias("two"), F.sum("one").alias("one"))

    def _rare_gains(self, history: DataFrame, alphas: DataFrame) -> DataFrame:
        """h, w, gain, base of all pairs with a rare word, and of the rare words alone (behind NONE)."""
        of_h = history.join(alphas, "h")
        of_w = self.words.select(F.col("word").alias("w"), F.col("c").alias("of_w"))
        two, one = F.log10(self._discounted() / F.col("of_h")), F.log10((F.col("of_w") + 1) / F.lit(float(self.total)))
        rare = unpacked(self.blocks.where(F.col("kind") == RARE)).join(of_w, "w").join(of_h, "h")
        rare = rare.select("h", "w", (two - F.col("alpha") - one).alias("gain"), F.lit(0.0).alias("base"))
        alone = self.words.where(~_common(self.top, "word")).select(
            F.lit(NONE).cast("long").alias("h"), F.col("word").alias("w"), F.col("alpha").alias("gain"), F.log10(F.col("c") + 1).alias("base")
        )
        return rare.unionByName(alone)

    def _gains(self) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Gains of arrays of pairs of numbered words and of their counts."""
        rows, total, discount = self.rows, float(self.total), self._discount()

        def gains(h: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
            of = rows.value
            return np.log10(discount(c) / of.before[h]) - of.weight[h] - np.log10((of.c[w] + 1) / total)

        return gains

    def _frequent_gains(self) -> DataFrame:
        """key (h * top + w), gain of the frequent pairs of numbered words."""
        gains, top, least = self._gains(), self.top, self.often_from

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for h, w, c, _ in _pairs_of(batches):
                often = c >= least
                h, w, c = h[often], w[often], c[often]
                yield from _batches(["key", "gain"], (h * top + w, gains(h, w, c)))

        return self.blocks.where(F.col("kind") == PAIRS).mapInArrow(find, "key long, gain double")

    def _gain_blocks(self, rare: DataFrame) -> DataFrame:
        """The rows of ``_rare_gains`` as blocks."""
        n, at_once = self.tasks * SLICES, PIECE

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            h, w, gain, base = (np.concatenate([x.column(k).to_numpy() for x in parts]) for k in ("h", "w", "gain", "base"))
            order, groups = _groups(_buckets(h, w, n))
            h, w, gain, base = h[order], w[order], gain[order], base[order]
            return _block_rows([(k, GAINS, *_codes_packed(h[at], w[at], False), gain[at].tobytes(), base[at].tobytes()) for k, at in groups])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, size = [], 0
            for batch in batches:
                parts.append(batch)
                size += batch.num_rows
                if size >= at_once:
                    yield block(parts)
                    parts, size = [], 0
            if size:
                yield block(parts)

        return rare.mapInArrow(pack, BLOCKS)

    @staticmethod
    def frequent(table: DataFrame, room: int, stands_for: str = "1") -> int:
        """The least count c, a power of two, that no more than ``room`` rows of ``table`` reach, or of those that its rows stand for."""
        power = F.floor(F.log2(F.col("c"))).cast("int")
        sizes = {r["p"]: r["n"] for r in table.groupBy(power.alias("p")).agg(F.sum(F.expr(stands_for)).alias("n")).collect()}  # 64 rows at most
        least = 63
        while least > 0 and room >= sizes.get(least - 1, 0):
            least -= 1
            room -= sizes.get(least, 0)
        return 1 << least

    def _token_blocks(self, docs: DataFrame, often: Broadcast, turn: int) -> DataFrame:
        """Blocks of the tokens of a slice that no broadcast pair has, and of its rare words behind NONE.

        In the first turn also of what the broadcast tables tell of every text; other words count as unseen there.
        """
        numbers, rows, top, total = self.numbers, self.rows, self.top, float(self.total)
        slices, n, at_once = SLICES, self.tasks * SLICES, TALLIED

        def texts(names: np.ndarray, word: np.ndarray, gain: np.ndarray, text: np.ndarray) -> tuple:
            of, code = rows.value, np.where(_within(word, top), word, NONE)
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            counts = [np.add.reduceat(x, starts) for x in (np.ones(len(word), np.int64), (of.c[code] > 0).astype(np.int64))]
            sums = [np.add.reduceat(x, starts).tobytes() for x in (np.log10((of.c[code] + 1) / total), of.alpha[code] + gain)]
            bucket = int(_buckets(names[:1], names[:1], n)[0]) // slices * slices + turn
            return bucket, TEXTS, names.tobytes(), np.concatenate(counts).tobytes(), *sums

        def block(parts: list[tuple]) -> Iterator[tuple]:
            names, h, w, name, bucket = map(np.concatenate, zip(*parts, strict=True))
            rare = ~(_within(h, top) & _within(w, top))
            order, groups = _groups(2 * bucket + rare)
            h, w, name = h[order], w[order], name[order]
            for key, at in groups:
                first = np.flatnonzero(np.diff(name[at], prepend=-1))
                runs = np.diff(first, append=at.stop - at.start)
                kind = OTHERS if key % 2 else TOKENS
                yield key // 2, kind, *_codes_packed(h[at], w[at], kind == TOKENS), names[name[at][first]].tobytes(), _packed(runs)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, whole, size, before = [], [], 0, 0
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    names = part.column("row").to_numpy()
                    history, word, text = _codes(part, numbers)
                    bucket = _buckets(history, word, n)
                    own = np.mod(bucket, slices) == turn
                    if turn:
                        own[own] = ~often.value(history[own], word[own])[0]
                    else:
                        found, gain = often.value(history, word)
                        own &= ~found
                        whole.append(texts(names, word, np.where(found, gain, 0.0), text))
                    alone = np.flatnonzero(~_within(word, top))
                    behind = np.full(len(alone), NONE, np.int64)
                    bucket_alone = _buckets(behind, word[alone], n)
                    mine = np.mod(bucket_alone, slices) == turn
                    alone = alone[mine]
                    parts.append((
                        names,
                        np.concatenate([history[own], behind[mine]]), np.concatenate([word[own], word[alone]]),
                        np.concatenate([text[own], text[alone]]) + before, np.concatenate([bucket[own], bucket_alone[mine]]),
                    ))
                    before += len(names)
                    size += len(parts[-1][1])
                    if size >= at_once:
                        yield _block_rows([*whole, *block(parts)])
                        parts, whole, size, before = [], [], 0, 0
            if parts and (rows_left := [*whole, *block(parts)]):
                yield _block_rows(rows_left)

        return _source(docs).select("row", "text").mapInArrow(spread, BLOCKS)

    def _sums(self, blocks: DataFrame) -> DataFrame:
        """row, tokens, known, base, gain: what the texts' tokens find in the pairs of their buckets, added up by texts."""
        gains, top, least, tasks, slices, at_once = self._gains(), self.top, self.often_from, self.tasks, SLICES, PIECE
        kinds = (np.int64, np.int64, np.int64, np.float64, np.float64)

        def deal(parts: list[tuple]) -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            part = ((columns[0].view(np.uint64) >> np.uint64(32)) * np.uint64(tasks)) >> np.uint64(32)
            order, groups = _groups(part.astype(np.int64))
            arrays = [pa.array([key for key, _ in groups], pa.int32())]
            for x in columns:
                x = x[order]
                arrays.append(pa.array([x[at].tobytes() for _, at in groups], pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, names=["part", *SUMS])

        def tables(found: dict[int, list[tuple]]) -> dict[int, Table]:
            none = np.zeros(0, np.int64)
            h, w, c = (np.concatenate(x) for x in zip(*found[PAIRS] or [(none, none, none)], strict=True))
            seldom = c < least
            h, w, c = h[seldom], w[seldom], c[seldom]
            rare = [np.concatenate(x) for x in zip(*found[GAINS] or [(none, none, none * 0.0, none * 0.0)], strict=True)]
            return {TOKENS: Table(h, w, gains(h, w, c), top=top), OTHERS: Table(*rare)}

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, table, parts, size = {PAIRS: [], GAINS: []}, None, [], 0
            for batch in batches:
                kind_of, hs, ws, xs, ys = (batch.column(k) for k in BLOCK[1:])
                for i in range(batch.num_rows):
                    kind = kind_of[i].as_py()
                    if kind == TEXTS:
                        names, counts = (np.frombuffer(x[i].as_py(), np.int64) for x in (hs, ws))
                        parts.append((names, *counts.reshape(2, -1), *(np.frombuffer(x[i].as_py()) for x in (xs, ys))))
                    else:
                        h, w = _codes_unpacked(hs[i], ws[i], kind in (PAIRS, TOKENS))
                        if kind == PAIRS:
                            found[kind].append((h, w, _unpacked(xs[i], len(h))))
                            continue
                        if kind == GAINS:
                            found[kind].append((h, w, np.frombuffer(xs[i].as_py()), np.frombuffer(ys[i].as_py())))
                            continue
                        if table is None:
                            table, found = tables(found), None
                        gain, base = table[kind](h, w)
                        names = np.frombuffer(xs[i].as_py(), np.int64)
                        runs = _unpacked(ys[i], len(names))
                        first = np.cumsum(runs) - runs
                        none = np.zeros(len(names), np.int64)
                        if base is None:
                            known, base = none, none * 0.0
                        else:
                            known, base = np.add.reduceat((base > 0).astype(np.int64), first), np.add.reduceat(base, first)
                        parts.append((names, none, known, base, np.add.reduceat(gain, first)))
                    size += len(parts[-1][0])
                    if size >= at_once:
                        yield deal(parts)
                        parts, size = [], 0
            if parts:
                yield deal(parts)

        def together(parts: list[tuple]) -> tuple:
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            order = np.argsort(columns[0])
            name = columns[0][order]
            first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            return name[first], *(np.add.reduceat(x[order], first) for x in columns[1:])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, size, full = [], 0, at_once
            for batch in batches:
                for i in range(batch.num_rows):
                    parts.append(tuple(np.frombuffer(batch.column(k)[i].as_py(), kind) for k, kind in zip(SUMS, kinds, strict=True)))
                    size += len(parts[-1][0])
                    if size >= full:
                        parts = [together(parts)]
                        size = len(parts[0][0])
                        full = max(at_once, 2 * size)
            if parts:
                yield from _batches(SUMS, together(parts))

        met = blocks.repartitionById(tasks, F.expr(f"cast(bucket div {slices} as int)")).sortWithinPartitions("kind")
        met = met.mapInArrow(meet, "part int, " + ", ".join(f"{k} binary" for k in SUMS))
        return met.repartitionById(tasks, "part").mapInArrow(add_up, "row long, tokens long, known long, base double, gain double")

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
        often = docs.sparkSession.sparkContext.broadcast(Often(self._frequent_gains().toArrow(), self.top))
        sums = None
        for turn in range(SLICES):
            own = F.expr(f"bucket % {SLICES} = {turn}")
            tables = self.blocks.where((F.col("kind") == PAIRS) & own).unionByName(self.gains.where(own))
            met = stored(self._sums(tables.unionByName(self._token_blocks(docs, often, turn))), "slice")
            sums = met if sums is None else sums.unionByName(met)
        sums = sums.groupBy("row").agg(*[F.sum(c).alias(c) for c in SUMS[1:]])
        texts = _source(docs).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held"), F.count("*").alias("texts"))
        # sums over the copies of a row, each of which has the same share of them
        base = F.col("base") / F.col("texts")
        return (
            texts.join(sums, "row")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("texts"))))
            .select(
                "doc_id",
                F.col("held").alias("held_out"),
                (F.col("tokens") / F.col("texts")).cast("long").alias("n_tokens"),
                (F.col("known") / F.col("texts")).cast("long").alias("n_known"),
                F.lit(self.tokens).cast("long").alias("train_tokens"),
                base.alias("base_score"),
                (base + F.col("gain") / F.col("texts") + F.lit(self.start)).alias("score"),
            )
        )


class Often:
    """Gains of frequent pairs of numbered words, by h * top + w."""

    def __init__(self, table: pa.Table, top: int):
        hashes = mix(table["key"].to_numpy())
        order = np.argsort(hashes)
        self.places, self.gains, self.top = Places(hashes[order]), np.append(table["gain"].to_numpy()[order], 0.0), top

    def __call__(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a pair is one of them, its gain if so)."""
        both = _within(h, self.top) & _within(w, self.top)
        found, at = self.places(mix(np.where(both, h, 0) * self.top + np.where(both, w, 0)))
        return found & both, self.gains[at]
