"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text gives a short vector of transformed statistics. Per class, the mean and the covariance come
from sums over all labelled training documents (added up in tasks, so only two small matrices reach
the driver); the covariance is shrunk towards the diagonal of the pooled one and factored once. A
score is the logistic of the difference of the two Mahalanobis log-densities plus the log of the
class shares. All labelled documents are used, none sampled.

Inputs of a score are statistics of the text alone. Defined cases: a null or empty text has all
statistics 0 and gets a score like any other; rows with a null label or a label other than 0 and 1 do
not train, and a document with both labels trains both; with labels of one class only, every score is
that class, with none at all 0.5; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteratio.llm.store import stored
from siteratio.llm.words import SEGMENT, mix, text_buffer, word_hashes

#: Weight of the pooled diagonal in a class covariance, and the least variance of a statistic.
SHRINKAGE = 0.05
LEAST_VARIANCE = 1e-4
#: A document counts as good from this score on.
THRESHOLD = 0.3

STATISTICS = (
    "words", "word_length", "distinct_words", "repeated_neighbours", "repeated_pairs", "top_word",
    "capitals", "digits", "marks", "stops", "symbols", "marks_per_word", "word_length_spread",
    "lines", "period", "long_words",
)

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_DIGITS = (_CODES >= 48) & (_CODES <= 57)
_LETTERS = _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_BLANK = np.isin(_CODES, (9, 10, 11, 12, 13, 32))
_STOP = np.isin(_CODES, (33, 44, 46, 58, 59, 63))
_SYMBOL = ~(_LETTERS | _DIGITS | _BLANK | np.isin(_CODES, (39, 44, 45, 46)))
_LINE = _CODES == 10


def _counts(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> np.ndarray:
    """How many bytes of each text are in a class of bytes."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    for lo in range(0, len(data), SEGMENT):
        sums = np.concatenate([[0], np.cumsum(member[data[lo : lo + SEGMENT]])])
        cut = np.clip(offsets - lo, 0, len(sums) - 1)
        out += np.diff(sums[cut])
    return out


def _share(part, whole):
    return np.sqrt(part / np.maximum(whole, 1))


def statistics(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row of STATISTICS per text."""
    data, offsets = text_buffer(texts)
    n_bytes = np.diff(offsets)
    words, counts = word_hashes(texts)
    blank, upper, digit, letter, stop, symbol, line = (
        _counts(data, offsets, m) for m in (_BLANK, _UPPER, _DIGITS, _LETTERS, _STOP, _SYMBOL, _LINE)
    )
    inner = np.zeros((len(counts), 6))
    at = 0
    for i, n in enumerate(counts):
        own = words[at : at + n]
        at += n
        if n < 2:
            continue
        distinct, times = np.unique(own, return_counts=True)
        pairs = mix(own[:-1] * np.uint64(3) + own[1:])
        order = np.sort(pairs)
        inner[i, 0] = len(distinct)
        inner[i, 1] = (own[1:] == own[:-1]).sum()
        inner[i, 2] = (order[1:] == order[:-1]).sum()
        inner[i, 3] = times.max()
        inner[i, 4] = (times[times > 1]).sum()
    graphic = n_bytes - blank
    one = np.maximum(counts, 1)
    length = graphic / one
    columns = [
        np.log1p(counts),
        np.log1p(length),
        np.log1p(inner[:, 0]) - np.log1p(counts),
        _share(inner[:, 1], counts),
        _share(inner[:, 2], counts),
        _share(inner[:, 3], counts),
        _share(upper, letter),
        _share(digit, graphic),
        _share(graphic - letter - digit, graphic),
        _share(stop, graphic),
        _share(symbol, graphic),
        np.log1p((graphic - letter - digit) / one),
        _share(inner[:, 4], counts),
        _share(line, counts),
        np.log1p(counts / np.maximum(stop, 1)) * (counts > 0),
        _share(letter, n_bytes),
    ]
    return np.stack(columns, axis=1) * (counts > 0)[:, None]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the vector of statistics of the text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = statistics(part.column(1))
                values = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())
                )
                yield pa.RecordBatch.from_arrays([part.column(0), values], names=["doc_id", "x"])
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(compute, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors, log-determinants and shares."""

    share: list[float]
    mean: list[np.ndarray] = field(default_factory=list)
    whiten: list[np.ndarray] = field(default_factory=list)
    log_det: list[float] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not all(self.share):
            return np.full(len(x), 0.5 if not any(self.share) else float(self.share[1] > 0))
        log_density = [
            np.log(self.share[c]) - 0.5 * (((x - self.mean[c]) @ self.whiten[c].T) ** 2).sum(axis=1) - self.log_det[c]
            for c in (0, 1)
        ]
        return 1.0 / (1.0 + np.exp(-np.clip(log_density[1] - log_density[0], -500, 500)))


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit on ``labelled`` (label 0 or 1, x)."""
    d = len(STATISTICS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            x = np.column_stack([np.ones(len(x)), x])
            for c in (0, 1):
                own = x[label == c]
                sums[c] = sums.get(c, 0) + own.T @ own
        for c, s in sums.items():
            s = np.broadcast_to(s, (d + 1, d + 1)).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * s.size), pa.array(np.arange(s.size)), pa.array(s)], names=["label", "cell", "value"]
            )

    cells = labelled.select(F.col("label").cast("long"), "x").mapInArrow(add, "label long, cell long, value double")
    total = np.zeros((2, (d + 1) ** 2))
    for r in cells.groupBy("label", "cell").agg(F.sum("value").alias("value")).collect():  # 2 (d + 1)**2 rows
        total[r["label"], r["cell"]] = r["value"]
    total = total.reshape(2, d + 1, d + 1)
    n = total[:, 0, 0]
    if not n.all():
        return Discriminant([float(x) / max(n.sum(), 1) for x in n])
    mean = [total[c, 0, 1:] / n[c] for c in (0, 1)]
    scatter = [total[c, 1:, 1:] - n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = np.diag(np.maximum(np.diag(scatter[0] + scatter[1]) / n.sum(), LEAST_VARIANCE))
    model = Discriminant([float(x) / n.sum() for x in n], mean)
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - shrinkage) * scatter[c] / n[c] + shrinkage * pooled)
        model.whiten.append(np.linalg.inv(factor))
        model.log_det.append(float(np.log(np.diag(factor)).sum()))
    return model


def scored(statistics_: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of each row of ``with_statistics``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    return statistics_.mapInArrow(score, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text modulo 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(statistics_: DataFrame, labels: DataFrame) -> Discriminant:
    """The model fitted on the labelled rows that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long"), F.col("quality").alias("label")
    )
    return fit(known.distinct().join(statistics_, "doc_id"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, as they are."""
    # stored, so that no stage has two steps in Python: each would take a worker more for every core
    model = trained(stored(with_statistics(docs), "statistics"), labels)

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = [batch.slice(at, 1000) for at in range(0, len(batch), 1000)]
            yield pa.array(np.concatenate([model.scores(statistics(p)) for p in parts] or [np.zeros(0)]))
        pa.default_memory_pool().release_unused()

    return docs.where(F.arrow_udf(score, T.DoubleType())(F.col("text")) >= threshold)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    found = stored(with_statistics(docs), "statistics")
    model = trained(found, labels)
    return scored(found, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
