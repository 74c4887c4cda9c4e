"""Mixing sources to target weights.

Every source is a stream of words, cut into blocks of a fixed length (the last may be shorter). An
output shard has a fixed number of slots; how many of them each source gets is drawn from a
multinomial distribution, seeded by the shard. A source numbers its slots through all shards; slot k
takes the block at place k of a pseudorandom permutation of the source's blocks, a new permutation
whenever all blocks are used up. Blocks and slots then meet in an equi-join on (source, block), so a
source that holds a third of all words is spread over as many tasks as it has blocks.

Draws over all shards stray from the targets by about the square root of the number of slots. The few
slots that a source was dealt beyond its target are passed on to the sources that got too few, so
the totals meet the targets to within a block and no block is used more than twice.

The number of sources is that of the weights, so tables of one row per source are kept on the driver.

Defined cases: a null or empty text has size 0 and nothing is taken from it; a null source is a
source of its own, the last one; repeated rows are mixed row by row; an empty table gives no rows;
further columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteratio.llm.store import stored, temporary
from siteratio.llm.words import mix as scatter

#: Words of a block; blocks of a shard.
BLOCK = 64
SLOTS = 1024
#: Slots that a task writes out, on average.
SLOTS_A_TASK = 1 << 17
#: Weights of the sources in order, repeating; share of all words to take; most uses of a block.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
SEED = 20_240_601
#: Documents of a source whose place in the stream is found together, on average.
GROUP = 2_000

WORD = r"[^\\x20\\x09-\\x0D]+"


def capped_targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is shared anew."""
    target = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s]
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in full:
            target[i] = float(most * sizes[i])
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return target


@dataclass
class Mixture:
    """What is to be taken, one entry per source in the order of the sources."""

    names: list[str | None]
    sizes: list[int]
    rows: list[int]
    targets: list[float]

    @property
    def blocks(self) -> np.ndarray:
        return -(-np.array(self.sizes, dtype=np.int64) // BLOCK)

    @property
    def slots(self) -> np.ndarray:
        """Slots of each source: its target in blocks of its mean size, at most MOST times its blocks."""
        size = np.maximum(np.array(self.sizes, dtype=np.float64), 1)
        wanted = np.rint(np.array(self.targets) * self.blocks / size).astype(np.int64)
        return np.minimum(wanted, MOST * self.blocks)


def plan_mixture(sized: DataFrame) -> Mixture:
    """Sizes, rows and targets of the sources of ``sized`` (source, size)."""
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"] or 0) for r in found]
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))]
    targets = capped_targets(sizes, weights, SHARE * sum(sizes))
    return Mixture([r["source"] for r in found], sizes, [r["rows"] for r in found], targets)


def streams(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, Mixture]:
    """Each document's place in its source's stream of words, and the mixture.

    Columns: doc_id, source_no, size, begin (words of the source before it) and those in ``carry``.
    """
    spark = docs.sparkSession
    sized = stored(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.expr(f"regexp_count(text, '{WORD}')"), F.lit(0)).cast("long").alias("size"),
            F.xxhash64("doc_id", "text").alias("key"),
            *[F.col(c).alias(f"carried_{c}") for c in carry],
        ),
        "sizes",
    )
    plan = plan_mixture(sized)
    order = [(n, i, -(-rows // GROUP)) for i, (n, rows) in enumerate(zip(plan.names, plan.rows, strict=True))]
    sources = F.broadcast(spark.createDataFrame(order, "source_name string, source_no int, groups long"))
    grouped = sized.join(sources, F.col("source").eqNullSafe(F.col("source_name"))).withColumn(
        "part", F.pmod("key", F.col("groups"))
    )
    before = (
        grouped.groupBy("source_no", "part")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.expr("sum(words) over (partition by source_no order by part) - words"))
        .drop("words")
    )
    within = F.expr(
        "sum(size) over (partition by source_no, part order by key, doc_id, size "
        "rows between unbounded preceding and current row) - size"
    )
    placed = grouped.withColumn("within", within).join(before, ["source_no", "part"])
    return (
        placed.select(
            "doc_id",
            "source_no",
            "size",
            (F.col("within") + F.col("before")).alias("begin"),
            *[F.col(f"carried_{c}").alias(c) for c in carry],
        ),
        plan,
    )


def block_pieces(placed: DataFrame) -> DataFrame:
    """source_no, block, doc_id, begin (the document's), at (words of it before the piece), length."""
    last = f"(begin + size - 1) div {BLOCK}"
    each = placed.where("size > 0").select(
        "source_no",
        "doc_id",
        "begin",
        "size",
        F.explode(F.expr(f"sequence(begin div {BLOCK}, {last})")).alias("block"),
    )
    return each.selectExpr(
        "source_no",
        "block",
        "doc_id",
        "begin",
        f"greatest(block * {BLOCK} - begin, 0L) as at",
        f"least((block + 1) * {BLOCK}, begin + size) - greatest(block * {BLOCK}, begin) as length",
    )


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index in the permutation of range(size) that ``key`` names.

    A four-round Feistel network over the next even number of bits; values beyond the size walk on.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (scatter(right + scatter(k + np.uint64(turn + 1))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def draw_counts(spark, plan: Mixture, seed: int = SEED) -> DataFrame:
    """shard, source_no, slots: a multinomial draw for each shard."""
    slots = plan.slots
    total = int(slots.sum())
    chance = slots / max(total, 1)
    shards = -(-total // SLOTS)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                n = min(SLOTS, total - int(shard) * SLOTS)
                dealt = np.random.default_rng([seed, int(shard)]).multinomial(n, chance)
                some = np.flatnonzero(dealt)
                yield pd.DataFrame({"shard": shard, "source_no": some, "slots": dealt[some]})

    tasks = max(1, min(shards // 64 + 1, 2000))
    return spark.range(0, shards, 1, tasks).mapInPandas(draw, "shard long, source_no int, slots long")


def deal_slots(spark, plan: Mixture, seed: int = SEED) -> DataFrame:
    """shard, source_no, epoch, block: one row for each slot of each shard."""
    dealt = stored(draw_counts(spark, plan, seed), "draws")
    drawn = np.zeros(len(plan.names), dtype=np.int64)
    for r in dealt.groupBy("source_no").agg(F.sum("slots").alias("n")).collect():
        drawn[r["source_no"]] = r["n"]
    wanted, blocks = plan.slots, plan.blocks
    over = np.maximum(drawn - wanted, 0)
    over_before = np.cumsum(over) - over
    short_until = np.cumsum(np.maximum(wanted - drawn, 0))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                n = part["slots"].to_numpy()
                source = np.repeat(part["source_no"].to_numpy(dtype=np.int64), n)
                shard = np.repeat(part["shard"].to_numpy(), n)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                k = np.repeat(part["first"].to_numpy(), n) + inner
                spare = np.flatnonzero(k >= wanted[source])  # passed on to a source that got too few
                x = over_before[source[spare]] + k[spare] - wanted[source[spare]]
                to = np.searchsorted(short_until, x, side="right")
                k[spare] = wanted[to] - (short_until[to] - x)
                source[spare] = to
                epoch = k // blocks[source]
                key = scatter((source * 1000 + epoch + seed * 1_000_003).astype(np.uint64))
                block = permuted(k % blocks[source], blocks[source], key)
                yield pd.DataFrame({"shard": shard, "source_no": source, "epoch": epoch, "block": block})

    first = F.expr("sum(slots) over (partition by source_no order by shard) - slots")
    # the window brings a source's draws together, one row per shard; their slots are written out all over the cluster
    parts = max(1, min(int(wanted.sum()) // SLOTS_A_TASK + 1, 2000))
    placed = dealt.withColumn("first", first).repartition(parts, "source_no", "shard")
    return placed.mapInPandas(expand, "shard long, source_no int, epoch long, block long")


def mix(docs: DataFrame, carry: tuple[str, ...] = (), seed: int = SEED) -> tuple[DataFrame, DataFrame, Mixture]:
    """(placed documents, taken pieces, mixture).

    A taken piece is a stretch of one document in one slot: shard, source_no, epoch, block, doc_id,
    begin, at, length. (source_no, begin) names the row of the placed documents it is from.
    """
    with temporary(docs.sparkSession):  # the sizes hold the carried texts once more
        placed, plan = streams(docs, carry)
        placed = stored(placed, "placed", keep=True)
    slots = deal_slots(docs.sparkSession, plan, seed)
    # slots come from a small table of draws but are as many as the blocks: never broadcast them
    return placed, block_pieces(placed).hint("merge").join(slots, ["source_no", "block"]), plan


def mixed_texts(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as documents: each row is what one pass over a source takes of one document in a piece.

    A document taken whole keeps its text as it is; of one taken in part every unbroken stretch of
    words is a row, its words joined by single spaces.
    """
    placed, taken, _ = mix(docs, ("text", "lang", "source"), seed)
    turns = "partition by source_no, begin, epoch order by block"
    stretches = (
        taken.withColumn("island", F.expr(f"block - row_number() over ({turns})"))
        .groupBy("source_no", "begin", "epoch", "island")
        .agg(F.min("at").alias("at"), F.sum("length").alias("length"))
        .groupBy("source_no", "begin")
        .agg(F.sort_array(F.collect_list(F.struct("at", "length"))).alias("stretches"))
    )
    # the words of a document are found once, whatever the number of its stretches, and not where it is taken whole
    words = f"if(exists(stretches, s -> s.length < size), regexp_extract_all(text, '{WORD}', 0), cast(array() as array<string>))"
    cut = "array_join(slice(w, cast(s.at + 1 as int), cast(s.length as int)), ' ')"
    texts = f"transform(array({words}), w -> transform(stretches, s -> if(s.length = size, text, {cut})))[0]"
    return (
        placed.where("size > 0")
        .join(stretches, ["source_no", "begin"])
        .withColumn("text", F.explode(F.expr(texts)))
        .select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    )


def taken_words(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    placed, pieces, plan = mix(docs, (), seed)
    rows = [(i, s, t) for i, (s, t) in enumerate(zip(plan.sizes, plan.targets, strict=True))]
    sources = F.broadcast(docs.sparkSession.createDataFrame(rows, "source_no int, source_size long, target double"))
    taken = pieces.groupBy("source_no", "begin").agg(F.sum("length").alias("words"))
    # rows without words share their place with the next document; they meet no piece
    keyed = placed.withColumn("own", F.when(F.col("size") > 0, F.col("begin")))
    joined = keyed.join(taken.withColumnRenamed("begin", "own"), ["source_no", "own"], "left")
    return joined.join(sources, "source_no").select(
        "doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken")
    )
