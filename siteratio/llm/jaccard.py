"""Exact Jaccard self-join of word-shingle sets by PartEnum signatures.

Two sets of sizes a and b with Jaccard similarity of at least 3/4 differ in at most (a + b) / 7
elements. Sets are banded by size (powers of two; a set near the upper end of its band also stands in
the next one), and a band splits the domain of shingles into n1 partitions of three parts each. As
differences are spread over partitions, many partitions of similar sets differ in one element at
most, and then two of the three parts are equal: the signatures of a set are, for each partition and
each pair of its parts, a hash of what the set has there. Similar sets share a signature for certain.

n1 is larger than needed for one shared signature, and this slack is used against signatures that
very many sets share (nothing in that part, or a passage that is everywhere): a set drops them while
fewer of its partitions have them than any partner is sure to share. Sets for which they are too many
keep them, and two such sets still meet there, so no link is lost.

Before that, sets without a partner are set aside. First by a sample: shingles are thinned out by
hash, a set counts how many of its thinned shingles no other set has, and is set aside if so many
would be found for a set with a partner with a chance below e**-35. Then exactly: a set more than a
quarter of whose shingles no other remaining set has can't have a partner.

Within a group of sets that share a signature, sets are first compared with one of them, that which
meets most others: a text and its edited copies are linked through the text. What is linked already is not
compared again, nor are sets with too many shingles that no set of another component has. Of what remains,
pairs of small groups are joined by their signatures. Large groups that have sets in common are a family; its sets are
compared by blocks, parity sketches against parity sketches, and only pairs that these allow are written. In a family of very many
near copies that are not linked among each other the work inside the blocks still grows with its square. Every link
is checked on the sets themselves (64-bit hashes of shingles).

Defined cases: equal sets are always linked; a null or empty text, or one without words, has no
shingles, is linked with nothing and is its own component; rows that share a doc_id are separate
texts, and their component is its smallest doc_id; a null doc_id gets the smallest doc_id of its
component, or null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteratio.llm.components import components
from siteratio.llm.store import stored, temporary
from siteratio.llm.words import mix, shingle_sets

#: Sets that share a signature from which on it counts as common.
COMMON = 16
#: Partitions beyond those that guarantee a shared signature, as a share of them.
SLACK = 0.3
#: Sets of fewer shingles are never set aside by the sample.
SAMPLED_FROM = 128
#: -log of the chance to set a set with a partner aside.
CERTAINTY = 35.0
#: Rows of candidate pairs that are broadcast (16 bytes each); beyond it they are shuffled.
BROADCAST_PAIRS = 1_000_000
#: Bytes of sketches that are broadcast.
BROADCAST_SKETCHES = 1 << 25
#: Sets, and 64-bit words of their sketches, that a block of a family has on average at most.
BLOCK_SETS = 1_000
BLOCK_WORDS = 1 << 19
#: Sizes of a class are within this factor: more than 4 / 3, so that partners are never two classes apart.
CLASS = 1.34
#: Column that names a row by its id and text, while it is one.
ROW_KEY = "_id_and_text"
#: Rounds of comparisons with one set of each group.
STAR_ROUNDS = 2


def _bits(n: float) -> int:
    """A set of n shingles looks at those whose hash ends in so many zero bits."""
    return min(4, max(1, int(np.log2(n / SAMPLED_FROM)) + 1))


def _sample(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sampled hashes that a set shows to others, which of them it looks at itself)."""
    n = len(hashes)
    if n * 4 < SAMPLED_FROM * 3:
        return hashes[:0], np.zeros(0, bool)
    shown = _bits(max(n * 0.75, SAMPLED_FROM))
    some = hashes[(hashes & np.uint64((1 << shown) - 1)) == 0]
    if n < SAMPLED_FROM:
        return some, np.zeros(len(some), bool)
    return some, (some & np.uint64((1 << _bits(n)) - 1)) == 0


def _long(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))


def _set_key(s: np.ndarray) -> int:
    """The name of a set: a hash of its size and of its shingles."""
    total = mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)) * np.uint64(0x9E3779B97F4A7C15)
    return int(_long(mix(total))[0])


def _sketch(s: np.ndarray) -> np.ndarray:
    """Parities: bit i tells whether an odd number of shingles falls to i.

    Two sets differ in at least as many shingles as their sketches of one length differ in bits. The
    length is a power of two, and a sketch folded in half (by exclusive or) is that of half the length.
    """
    bits = 64 << max(0, (len(s) - 1).bit_length() - 5)
    odd = np.bincount((mix(s ^ np.uint64(0xC0FFEE)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _profiles(docs: DataFrame) -> DataFrame:
    """Of each text: n (size of its set), key (of the set), looked (at so many sampled shingles)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [(len(s), _set_key(s), int(_sample(s)[1].sum())) for s in shingle_sets(part.column(2))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))],
                    names=["doc_id", ROW_KEY, "n", "key", "looked"],
                )
        pa.default_memory_pool().release_unused()

    columns = f"doc_id long, {ROW_KEY} long, n long, key long, looked long"
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias(ROW_KEY), "text").mapInArrow(
        compute, columns
    )


def _sampled(docs: DataFrame) -> DataFrame:
    """shingle, key, counts: the sampled shingles of every text; ``counts`` where its set looks at them."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                shown, own, keys = [], [], []
                for s in shingle_sets(batch.slice(at, 500).column(0)):
                    some, looked_at = _sample(s)
                    shown.append(_long(some))
                    own.append(looked_at)
                    keys.append(np.full(len(some), _set_key(s), dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (shown, keys, own)], names=["shingle", "key", "counts"]
                )
        pa.default_memory_pool().release_unused()

    return docs.select("text").mapInArrow(compute, "shingle long, key long, counts boolean")


def _alone(rows: DataFrame) -> DataFrame:
    """key and alone: how many shingles of ``rows`` (shingle, key, counts) no other set has."""
    owners = rows.groupBy("shingle").agg(
        F.min("key").alias("key"), F.max("key").alias("other"), F.max("counts").alias("counts")
    )
    return owners.where("key = other and counts").groupBy("key").agg(F.count("*").alias("alone"))


def _candidates(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per set that may have a partner: key, n and the row to read it from."""
    sets = (
        profiles.where("n > 0")
        .groupBy("key")
        .agg(
            F.min(ROW_KEY).alias(ROW_KEY),
            F.max("n").alias("n"),
            F.max("looked").alias("looked"),
        )
    )
    share = "(alone / looked)"
    surprise = (
        f"looked * ({share} * ln({share} / 0.25) + "
        f"case when alone < looked then (1 - {share}) * ln((1 - {share}) / 0.75) else 0 end)"
    )
    set_aside = F.expr(f"coalesce(alone > 0.25 * looked and {surprise} >= {CERTAINTY}, false)")
    return sets.join(_alone(_sampled(docs)), "key", "left").where(~set_aside).select("key", "n", ROW_KEY)


def _shingles(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """key, n, the set and its sketch of each candidate, read again from its text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                expected = part.column(0).to_pylist()
                kept = [(k, s) for k, s in zip(expected, shingle_sets(part.column(1)), strict=True) if _set_key(s) == k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in kept], pa.int64()), pa.array([len(s) for _, s in kept], pa.int64()),
                     _lists([_long(s) for _, s in kept]), _lists([_sketch(s) for _, s in kept])],
                    names=["key", "n", "shingles", "sketch"],
                )
        pa.default_memory_pool().release_unused()

    keyed = docs.select(F.xxhash64("doc_id", "text").alias(ROW_KEY), "text")
    wanted = candidates.select("key", ROW_KEY)
    if wanted.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        wanted = F.broadcast(wanted)
    return keyed.join(wanted, ROW_KEY).select("key", "text").mapInArrow(compute, "key long, n long, shingles array<long>, sketch array<long>")


def partitions(band: int) -> int:
    """Partitions of the band of sets with 2**band to 2**(band + 1) - 1 shingles."""
    differ = 2 * ((2 << band) - 1) // 7  # most elements in which similar sets of the band differ
    return int(np.ceil((1 + SLACK) * (differ // 2))) + 1


def sure_matches(n: int, band: int) -> int:
    """Partitions that a set of n shingles shares (but for one element) with any partner in the band."""
    partner = min(4 * n // 3, (2 << band) - 1)
    return partitions(band) - ((n + partner) // 7) // 2


def signatures(hashes: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, partition) of a set in a band: three signatures for each partition."""
    n1 = partitions(band)
    place = mix(hashes + np.uint64(0xA5A5 + band))
    part, third = (place >> np.uint64(8)) % np.uint64(n1), (place & np.uint64(255)) % np.uint64(3)
    sums = np.zeros(n1 * 3, dtype=np.uint64)
    np.add.at(sums, (part * np.uint64(3) + third).astype(np.int64), mix(hashes ^ np.uint64(0x5DEECE66D)))
    sums = sums.reshape(n1, 3)
    where = np.arange(n1, dtype=np.uint64)[:, None] * np.uint64(3) + np.arange(3, dtype=np.uint64)[None, :]
    pair = mix(np.roll(sums, 1, axis=1)) + mix(np.roll(sums, 2, axis=1)) * np.uint64(0x9E3779B97F4A7C15)
    out = mix(pair + mix(where + np.uint64(band << 40)))
    return out.ravel(), np.repeat(np.arange(n1), 3)


def _signed(sets: DataFrame) -> DataFrame:
    """signature, key, n, band, part: all signatures of all sets."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = batch.column(2)
            for i, (key, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                s = shingles[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                own = n.bit_length() - 1
                for band in (own, own + 1):
                    if 4 * n // 3 < 1 << band:  # no partner reaches into the next band
                        continue
                    out, part = signatures(s, band)
                    same = lambda v, t, m=len(out): pa.array(np.full(m, v), t)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_long(out)), same(key, pa.int64()), same(n, pa.int32()), same(band, pa.int32()),
                         pa.array(part, pa.int32())],
                        names=["signature", "key", "n", "band", "part"],
                    )
        pa.default_memory_pool().release_unused()

    columns = "signature long, key long, n int, band int, part int"
    return sets.select("key", "n", "shingles").mapInArrow(compute, columns)


#: SQL for the number of partitions of a band.
_PARTITIONS = f"element_at(array({', '.join(str(partitions(b)) for b in range(31))}), band + 1)"
#: SQL for ``sure_matches``.
_SURE = f"{_PARTITIONS} - ((n + least(4 * n div 3, shiftleft(2, band) - 1)) div 7) div 2"


def _few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has no more than BROADCAST_PAIRS rows (a few longs each)."""
    return F.broadcast(df) if df.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else df


def _groups(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets that share a signature, common signatures dropped where they may be; weak partitions of the sets.

    The first has signature, key, n, band, met and ``hub``, the key and n of one of the sets; the
    second key, band and ``weak``: in how many partitions the set has common signatures. ``met`` counts
    the sets that a set shares common signatures with, once for each of them: of a text and its many
    edited copies, which are often like that text but not like each other, the text itself has most.
    """
    signed = _signed(sets)
    lowest = F.min(F.struct("key", "n")).alias("hub")
    shared = signed.groupBy("signature").agg(F.count("*").alias("members"), lowest, F.max("key").alias("high"))
    multi = stored(signed.join(shared.where("hub.key < high"), "signature").drop("high"), "shared")
    common = F.col("members") > COMMON
    weak = (
        multi.where(common)
        .groupBy("key", "n", "band")
        .agg(F.count_distinct("part").alias("weak"), F.sum("members").alias("met"))
    )
    weak = stored(weak.withColumn("crowded", F.expr(f"weak >= {_SURE}")).drop("n"), "weak")
    columns = ["signature", "key", "n", "band"]
    # of a common signature the crowded sets stay: their hub is found anew
    crowded = weak.where("crowded").select("key", "band", "met")
    kept = multi.where(common).join(_few(crowded), ["key", "band"]).select(*columns, "met")
    again = kept.groupBy("signature").agg(_most_met("n"))
    hot = kept.join(again, "signature").select(*columns, "met", "hub")
    cold = multi.where(~common).select(*columns, F.lit(0).cast("long").alias("met"), "hub")
    return cold.unionByName(hot), weak.select("key", "band", "weak")


def _most_met(*columns: str) -> Column:
    """The set of a group that met most (of equal ones that with the least key): key and ``columns``."""
    return F.max_by(F.struct("key", *columns), F.struct("met", -F.col("key"))).alias("hub")


def _possible(met: DataFrame, weak: DataFrame) -> DataFrame:
    """Of pairs that share signatures (a, b, an, bn, band) those that share enough: a, b, shared.

    A linked pair shares a signature in all but half of the partitions in which its sets can differ,
    and of these it has lost at most those that are weak for both.
    """
    counted = (
        met.where("band = floor(log2(greatest(an, bn)))")
        .groupBy("a", "b", "an", "bn", "band")
        .agg(F.count("*").alias("shared"))
    )
    weak = _few(weak)
    for side in "ab":
        own = weak.selectExpr(f"key as {side}", "band", f"weak as weak_{side}")
        counted = counted.join(own, [side, "band"], "left")
    lost = "least(coalesce(weak_a, 0), coalesce(weak_b, 0))"
    return counted.where(f"shared >= {_PARTITIONS} - ((an + bn) div 7) div 2 - {lost}").select("a", "b", "shared")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that are linked, checked on their sets.

    Sketches, a bit or two per shingle, first rule out pairs that surely differ in too many shingles.
    """
    pairs = stored(pairs.select("a", "b"), "pairs")
    short = sets.select("key", "n", "sketch")
    if short.agg(F.coalesce(F.sum(8 * F.size("sketch")), F.lit(0))).first()[0] <= BROADCAST_SKETCHES:
        short = F.broadcast(short)
    for side in "ab":
        own = short.selectExpr(f"key as {side}", f"n as {side}n", f"sketch as {side}s")
        pairs = pairs.join(own, side)
    words = "least(size(as_), size(bs))"
    pairs = pairs.withColumnRenamed("as", "as_")
    # a sketch longer than the other is folded to its length; sizes of partners differ by one doubling at most
    half = lambda c: (
        f"if(size({c}) > {words}, zip_with(slice({c}, 1, {words}), slice({c}, {words} + 1, {words}), (x, y) -> x ^ y), {c})"
    )
    differ = f"aggregate(zip_with({half('as_')}, {half('bs')}, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)"
    pairs = _few(stored(pairs.where(f"{differ} <= (an + bn) div 7").select("a", "b"), "alike"))
    left = sets.join(pairs, sets["key"] == F.col("a")).select("a", "b", F.col("shingles").alias("left"))
    right = sets.join(pairs, sets["key"] == F.col("b")).select("a", "b", F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - both
    return stored(left.join(right, ["a", "b"]).where(100 * both >= 75 * union).select("a", "b").distinct(), "links")


def _near(low: str, high: str) -> str:
    """Sizes that leave room for the similarity."""
    return f"100 * least({low}, {high}) >= 75 * greatest({low}, {high})"


def _open(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` with the label of each set's component so far; groups with one label are left out."""
    found = components(links).selectExpr("id as key", "component")
    labelled = groups.join(_few(found), "key", "left").withColumn("label", F.coalesce("component", "key"))
    mixed = labelled.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = mixed.where("low < high").select("signature")
    return stored(labelled.join(mixed, "signature").select("signature", "key", "n", "band", "met", "label"), "open")


def _foreign(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """``open_`` with ``own``: how many shingles of a set no open set of another component has.

    Two sets of different components differ in the own shingles of both at least, and similar ones in
    (a + b) / 7 shingles at most. So sets with more own shingles than a partner of any size allows are left out.
    """
    labels = stored(open_.select("key", "label").distinct(), "labels")
    rows = stored(sets.join(_few(labels), "key").select(F.explode("shingles").alias("shingle"), "key", "label"), "elements")
    spread = rows.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    shared = rows.join(spread.where("low < high").select("shingle"), "shingle", "left_semi")
    others = stored(shared.groupBy("key").agg(F.count("*").alias("others")), "others")
    return (
        open_.join(_few(others), "key")
        .withColumn("own", F.expr("n - others"))
        .where("100 * others >= 75 * n")
        .drop("others", "met")
    )


def link_sets(sets: DataFrame) -> DataFrame:
    """Links (a, b) between keys of ``sets`` (key, n, shingles) that connect all linked sets."""
    groups, weak = _groups(sets)
    links = tested = open_ = None
    for _ in range(STAR_ROUNDS):
        # in each group, one set is the hub; each set is compared with the hub it shares most with
        if links is None:
            met = groups.where("key <> hub.key")
        else:
            fresh = open_.join(_few(tested.select(F.col("b").alias("key")).distinct()), "key", "left_anti")
            hubs = fresh.groupBy("signature").agg(_most_met("n", "label"))
            met = open_.join(hubs, "signature").where("label <> hub.label")
        met = met.selectExpr("key as a", "hub.key as b", "n as an", "hub.n as bn", "band")
        met = _possible(met.where(_near("an", "bn")), weak)
        if tested is not None:
            for there, back in ("ab", "ba"):
                done = tested.selectExpr(f"{there} as a", f"{back} as b")
                met = met.join(done, ["a", "b"], "left_anti")
        pairs = stored(met.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b")), "star")
        found = _linked(pairs, sets)
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        columns = ["signature", "key", "n", "band", "met"]
        open_ = _open((groups if open_ is None else open_).select(columns), links)
    open_ = _foreign(open_, sets)
    hubs = open_.groupBy("signature").agg(F.count("*").alias("members"), F.min("key").alias("hub"))
    open_ = stored(open_.join(hubs, "signature"), "foreign")
    large = F.col("members") > COMMON
    one, two = open_.where(~large).alias("one"), open_.where(~large).alias("two")
    rest = one.join(two, "signature").where(
        "one.key < two.key and one.label <> two.label and one.own + two.own <= (one.n + two.n) div 7 and "
        + _near("one.n", "two.n")
    )
    rest = rest.selectExpr("one.key as a", "two.key as b", "one.n as an", "two.n as bn", "one.band as band")
    # two sets of a large group are of one family; of two others all that they share is in small groups
    rest = _possible(rest, weak).select("a", "b").unionByName(_alike(open_.where(large), sets)).distinct()
    same = tested.selectExpr("least(a, b) as a", "greatest(a, b) as b")
    return links.unionByName(_linked(rest.join(same, ["a", "b"], "left_anti"), sets))


def _alike(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of one family and of different components whose sketches allow a link.

    A family is what ``groups`` connect. It is cut into classes of size, so that partners are in one class or
    in neighbouring ones, and these into blocks of bounded size; every two such blocks are compared by one task, which
    gives out no pair but those that pass.
    """
    edges = groups.where("key <> hub").selectExpr("key as a", "hub as b").distinct()
    family = _few(components(edges).selectExpr("id as key", "component as family"))
    who = groups.select("key", "label", "own").distinct().join(family, "key")
    who = sets.join(_few(who), "key").withColumn("size", F.expr(f"cast(floor(ln(n) / ln({CLASS}D)) as int)"))
    who = stored(who.select("family", "size", "key", "n", "label", "own", "sketch"), "family")
    blocks = who.groupBy("family", "size").agg(
        F.expr(f"greatest(count(*) div {BLOCK_SETS}, sum(size(sketch)) div {BLOCK_WORDS}) + 1").alias("blocks")
    )
    blocks = stored(blocks, "blocks")
    placed = who
    for name, step in (("blocks", 0), ("above", 1), ("below", -1)):
        near = blocks.select("family", (F.col("size") - step).alias("size"), F.col("blocks").alias(name))
        placed = placed.join(_few(near), ["family", "size"], "left")
    placed = placed.withColumn("block", F.expr("pmod(xxhash64(key), blocks)"))
    numbers = "transform(sequence(0L, {} - 1), i -> named_struct('ls', {}, 'lb', {}, 'rs', {}, 'rb', {}))"
    beside = numbers.format("blocks", "size", "least(i, block)", "size", "greatest(i, block)")
    above = numbers.format("above", "size", "block", "size + 1", "i")
    below = numbers.format("below", "size - 1", "i", "size", "block")
    none = "cast(array() as array<struct<ls:int,lb:bigint,rs:int,rb:bigint>>)"
    cells = f"concat({beside}, coalesce({above}, {none}), coalesce({below}, {none}))"
    placed = placed.withColumn("cell", F.explode(F.expr(cells))).select("*", "cell.*").drop("cell", "blocks", "above", "below")
    return placed.groupBy("family", "ls", "lb", "rs", "rb").applyInArrow(_compare, "a long, b long")


def _compare(cell: pa.Table) -> pa.Table:
    """Pairs of a cell's left and right block that differ in few enough bits of their sketches."""
    cell = cell.combine_chunks()
    numbers = {c: cell[c].to_numpy() for c in ("size", "block", "ls", "lb", "rs", "rb", "key", "n", "label", "own")}
    lists = cell["sketch"].combine_chunks()
    words = np.diff(lists.offsets.to_numpy())
    flat, starts = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()[:-1]
    left = (numbers["size"] == numbers["ls"]) & (numbers["block"] == numbers["lb"])
    right = (numbers["size"] == numbers["rs"]) & (numbers["block"] == numbers["rb"])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for w in np.unique(words[left]):
        for v in np.unique(words[right]):
            one, two = np.flatnonzero(left & (words == w)), np.flatnonzero(right & (words == v))
            short = min(w, v)
            a, b = (_folded(flat[starts[x][:, None] + np.arange(m)], short) for x, m in ((one, w), (two, v)))
            for i, bits in zip(one, a, strict=True):
                both = numbers["n"][i] + numbers["n"][two]
                fit = (numbers["label"][two] != numbers["label"][i]) & (numbers["own"][two] + numbers["own"][i] <= both // 7)
                fit &= 100 * np.minimum(numbers["n"][two], numbers["n"][i]) >= 75 * np.maximum(numbers["n"][two], numbers["n"][i])
                at = np.flatnonzero(fit)
                at = at[np.bitwise_count(b[at] ^ bits).sum(axis=1, dtype=np.int64) <= both[at] // 7]
                there = numbers["key"][two[at]]
                here = np.full(len(at), numbers["key"][i])
                out.append((np.minimum(here, there), np.maximum(here, there)))
    columns = [np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]) for k in (0, 1)]
    return pa.table({"a": pa.array(columns[0]), "b": pa.array(columns[1])})


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (one a row) as if they had been made with so many words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n and the component (null without shingles) of every row of ``docs``.

    Only this table stays, the many others on the way to it are deleted.
    """
    with temporary(docs.sparkSession):
        return stored(_labelled(docs), "classes", keep=True)


def _labelled(docs: DataFrame) -> DataFrame:
    profiles = stored(_profiles(docs), "profiles")
    sets = stored(_shingles(docs, stored(_candidates(docs, profiles), "candidates")), "sets")
    alone = _alone(sets.select(F.explode("shingles").alias("shingle"), "key", F.lit(True).alias("counts")))
    partnered = sets.select("key", "n").join(alone, "key", "left").where("100 * (n - coalesce(alone, 0)) >= 75 * n")
    partnered = _few(stored(partnered.select("key"), "partnered"))
    found = components(link_sets(sets.join(partnered, "key", "left_semi")))
    rows = profiles.select("doc_id", ROW_KEY, "n", F.expr("if(n > 0, key, null)").alias("key"))
    return rows.join(found.withColumnRenamed("id", "key"), "key", "left").select(
        "doc_id", ROW_KEY, "n", F.coalesce("component", "key").alias("component")
    )


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    rows = _classes(docs)
    named = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("lowest"))
    return rows.join(named, "component", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id, of rows that share it any one.

    Texts without words join nothing and stay, but of rows alike in doc_id and text one stays.
    """
    rows = _classes(docs)
    first = F.min_by(ROW_KEY, F.struct(F.col("doc_id").isNull(), "doc_id", ROW_KEY)).alias(ROW_KEY)
    kept = rows.where("n > 0").groupBy("component").agg(first).select(ROW_KEY)
    kept = kept.unionByName(rows.where("n = 0").select(ROW_KEY).distinct())
    keyed = docs.withColumn(ROW_KEY, F.xxhash64("doc_id", "text"))
    return keyed.join(kept, ROW_KEY, "left_semi").dropDuplicates([ROW_KEY]).drop(ROW_KEY)
