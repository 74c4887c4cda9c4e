"""Best-fit packing of documents into sequences of a fixed number of tokens.

The plan is made over the histogram of piece lengths, which has at most one row per length and so
stays small whatever the input: lengths are taken from the longest down, and all pieces of a length
fill the fullest sequences that still have room, by counts. What comes out is a list of runs: so many
pieces of a length go, k to each, into neighbouring sequences at some offset. Pieces then get their
rank within their length and take the slot with that rank by an equi-join.

Ranks come from small groups (a hash of the document within a length, as many groups as the
histogram asks for), so a length that a third of all pieces share is ranked by many tasks; slots are
written out from the runs in chunks of bounded size. The ids themselves stay out of this: places are
found for the pieces' numbers, and only the join of places and pieces shuffles ids, once.

Defined cases: a null or empty text is the one id 0; repeated rows are packed as often as they occur;
documents with a null doc_id are packed too; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteratio.llm.store import stored

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces of one length that are ranked together, on average.
RANKED = 2_000
#: Slots that one row of the plan stands for at most.
CHUNK = 10_000

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary"
#: Number of a row among all pieces: the task that cut it, and its place there.
NUMBER = "task int, nth long"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Tokens of every text, the id 0 behind them, cut into pieces of at most ``capacity``: PIECES and NUMBER.

    ``ids`` are unsigned little-endian 32-bit integers; without ``with_ids`` it is null. The numbers are
    distinct within one computation of the table, so it has to be stored before they are used.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from siteratio.llm.tokens import word_tokenizer

        tokenizer = word_tokenizer(vocabulary)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        task, cut_before = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            at = 0
            while at < batch.num_rows:  # about 256 KB, or one longer text, at a time
                end, size = at, 0
                while end < batch.num_rows and (end == at or size + sizes[end] < 1 << 18):
                    size += sizes[end]
                    end += 1
                part = batch.slice(at, end - at)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = []
                for name, ids in zip(part.column(0).to_pylist(), tokenizer.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(0)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        raw = ids[start : start + capacity].tobytes()
                        rows.append((name, k, start, len(raw) // 4, zlib.crc32(raw), raw if with_ids else None))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)),
                     pa.array(np.full(len(rows), task, dtype=np.int32)), pa.array(cut_before + np.arange(len(rows)))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "nth"],
                )
                cut_before += len(rows)
                at = end
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, f"{PIECES}, {NUMBER}")


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, first rank, pieces, pieces per sequence, first sequence, offset): the piece of rank
    r in the run goes to sequence first + (r - first rank) // k, behind (r - first rank) % k others of
    the run.
    """
    #: free room -> groups [first sequence, sequences] of equally filled ones
    room: dict[int, list[list[int]]] = {}
    runs = []
    opened = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                per = capacity // length
                n = -(-left // per)
                group = [opened, n]
                opened += n
                free = capacity
            else:
                group = room[free].pop()
                if not room[free]:
                    del room[free]
            per = free // length
            full = min(group[1], left // per)
            took = 0
            if full:
                runs.append((length, rank, full * per, per, group[0], capacity - free))
                took = full * per
                room.setdefault(free - per * length, []).append([group[0], full])
            if full < group[1]:
                rest = min(per, left - took)
                at = group[0] + full
                if rest:  # fewer than per: the last sequence of this length
                    runs.append((length, rank + took, rest, per, at, capacity - free))
                    room.setdefault(free - rest * length, []).append([at, 1])
                    took += rest
                    at += 1
                if at < group[0] + group[1]:
                    room.setdefault(free, []).append([at, group[0] + group[1] - at])
            left -= took
            rank += took
        room.pop(0, None)
    return runs


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Add ``rank``: 0, 1, ... within each length, in no particular but a repeatable order."""
    spark = pieces.sparkSession
    groups = [(length, -(-n // RANKED)) for length, n in histogram.items()]
    sized = F.broadcast(spark.createDataFrame(groups, "length int, groups long"))
    grouped = pieces.join(sized, "length").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("groups"))
    )
    before = (
        grouped.groupBy("length", "part")
        .count()
        .withColumn("before", F.expr("sum(count) over (partition by length order by part) - count"))
        .drop("count")
    )
    within = F.expr("row_number() over (partition by length, part order by doc_id, piece, ids_crc32) - 1")
    return (
        grouped.withColumn("within", within)
        .join(before, ["length", "part"])
        .withColumn("rank", F.col("within") + F.col("before"))
        .drop("within", "before", "groups", "part")
    )


def slots(spark, runs: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """One row per planned slot: length, rank, sequence_id, offset."""
    columns = "length int, first long, pieces long, per long, sequence long, begin long"
    plan = spark.createDataFrame(runs, columns)
    chunks = plan.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (pieces - 1) div {CHUNK})"))).repartition(
        "length", "chunk", "sequence"
    )
    each = chunks.withColumn(
        "k", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(pieces, (chunk + 1) * {CHUNK}) - 1)"))
    )
    return each.selectExpr(
        "length",
        "first + k as rank",
        "sequence + k div per as sequence_id",
        "begin + (k % per) * length as offset",
    )


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places: PIECES, sequence_id and offset."""
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, vocabulary, capacity, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = plan_runs(histogram, capacity)
    # the slots come from a small plan but are as many as the pieces: never broadcast them
    light = ranked(pieces.drop("ids"), histogram).hint("merge").join(slots(spark, runs), ["length", "rank"]).drop("rank")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    if not with_ids:
        return light.withColumn("ids", F.lit(None).cast("binary")).select(columns)
    places = light.select("task", "nth", "sequence_id", "offset")
    return pieces.hint("merge").join(places, ["task", "nth"]).select(columns)
