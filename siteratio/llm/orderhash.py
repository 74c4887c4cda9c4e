"""Order MinHash fingerprints.

A text's k-mers are runs of three words, each numbered by how often it has occurred before, so a
repeated k-mer counts as often as it occurs. The numbered k-mers are hashed; the hash picks a bin and a
rank in it, and every bin keeps the two of smallest rank, in the order in which they stand in the
text. The hash of such a pair is one part of the fingerprint: a part survives an edit only if the same
two k-mers stay smallest in their bin and stay in order, so the share of equal parts falls with the
edit distance, also for moves that leave the set of k-mers as it was.

Everything is DataFrame expressions: one sort of the k-mers by value for the numbers, one by bin and
rank for the choice, both within a row. Neighbours come from ranges of doc_id that one window each
walks through, joined at their seams, so no task sees all documents.

Defined cases: a null text is empty; an empty text, or one of fewer than three words, has the k-mer of
all its words; bins without k-mers are empty parts and count for the likeness only where the other
text has some; two texts without any part are alike; rows that share a doc_id follow each other by
their text's hash; rows with a null doc_id come last, after the smallest; the next document after the
last is the first (a single document is its own next); an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of a k-mer, parts of a fingerprint, k-mers of a part.
KMER = 3
PARTS = 64
PICKED = 2
#: Documents of a range, on average, and most ranges.
RANGE_ROWS = 2_000
RANGES = 1_000

WORD_BREAK = r"[\\x20\\x09-\\x0D]+"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def fingerprint(text: str) -> Column:
    """The fingerprint of a text column, an array of PARTS longs (null where a bin is empty)."""
    words = f"filter(split({text}, '{WORD_BREAK}'), w -> w <> '')"
    kmers = (
        f"transform(sequence(0, greatest(size(w) - {KMER}, 0)), "
        "i -> struct(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) as h, i as at))"
    )
    # runs of equal k-mers in the sorted array: where they begin, then the number within the run
    starts = "filter(sequence(0, size(s) - 1), i -> i = 0 or s[i].h <> s[i - 1].h)"
    numbered = (
        "flatten(transform(b, (lo, j) -> transform(sequence(lo, coalesce(get(b, j + 1), size(s)) - 1), "
        "i -> struct(xxhash64(s[i].h, i - lo) as h, s[i].at as at))))"
    )
    # by bin (the low bits) and then by the rest of the hash
    ranked = f"sort_array(transform(n, x -> struct(pmod(x.h, {PARTS}) as bin, x.h as h, x.at as at)))"
    heads = "filter(sequence(0, size(r) - 1), i -> i = 0 or r[i].bin <> r[i - 1].bin)"
    pick = (
        "map_from_arrays(transform(g, i -> r[i].bin), transform(g, i -> "
        "if(get(r, i + 1) is null or get(r, i + 1).bin <> r[i].bin, xxhash64(r[i].h), "
        "if(r[i].at < r[i + 1].at, xxhash64(r[i].h, r[i + 1].h), xxhash64(r[i + 1].h, r[i].h)))))"
    )
    filled = f"transform(sequence(0, {PARTS - 1}), p -> try_element_at(m, p))"
    sql = _let(pick, "m", filled)
    sql = _let(heads, "g", sql)
    sql = _let(ranked, "r", sql)
    sql = _let(numbered, "n", sql)
    sql = _let(starts, "b", sql)
    sql = _let(f"sort_array({kmers})", "s", sql)
    return F.expr(_let(words, "w", sql))


def printed(parts: Column) -> Column:
    """A fingerprint as text: hexadecimal parts, joined by dots."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.hex(p), F.lit(""))), ".")


def likeness(one: str, two: str) -> Column:
    """Share of equal parts among those that either fingerprint has."""
    either = F.expr(f"size(filter(zip_with({one}, {two}, (a, b) -> a is not null or b is not null), x -> x))")
    same = F.expr(f"size(filter(zip_with({one}, {two}, (a, b) -> coalesce(a = b, false)), x -> x))")
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def _cuts(docs: DataFrame) -> list[int]:
    """Bounds of ranges of doc_id. Approximate, and not the same when taken again: take them once."""
    zones = min(RANGES, math.ceil(docs.count() / RANGE_ROWS))
    if zones <= 1:
        return []
    shares = [k / zones for k in range(1, zones)]
    return sorted(set(docs.select(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []))


def _zoned(docs: DataFrame, cuts: list[int]) -> DataFrame:
    """``docs`` with ``zone``, numbered from 0 by falling doc_id."""
    inside = F.lit(len(cuts))
    if cuts:
        bounds = F.array(*map(F.lit, cuts))
        inside = F.when(F.col("doc_id").isNull(), inside).otherwise(
            F.lit(len(cuts)) - F.size(F.filter(bounds, lambda c: c < F.col("doc_id")))
        )
    return docs.withColumn("zone", inside)


def with_next(docs: DataFrame) -> DataFrame:
    """Add next_text and next_parts to ``docs`` (doc_id, text, parts), by falling doc_id."""
    spark = docs.sparkSession
    cuts = _cuts(docs)
    zoned = _zoned(docs, cuts)
    walk = Window.partitionBy("zone").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    walked = zoned.withColumn("following", F.lead(F.struct("text", "parts")).over(walk))
    # what follows the last row of a zone is the first row of the next zone that has any
    texts = _zoned(docs.select("doc_id", "text"), cuts)
    first = F.struct(F.col("doc_id").isNotNull(), "doc_id", F.bitwise_not(F.xxhash64("text")).alias("late"))
    heads = texts.groupBy("zone").agg(F.max_by("text", first).alias("text")).withColumn("parts", fingerprint("text"))
    zones = sorted(r["zone"] for r in texts.select("zone").distinct().collect())  # RANGES + 1 at most
    if not zones:
        return docs.withColumn("next_text", F.col("text")).withColumn("next_parts", F.col("parts"))
    after = ", ".join(f"({z}, {zones[(k + 1) % len(zones)]})" for k, z in enumerate(zones))
    seams = (
        spark.sql(f"select * from values {after} as t(seam, zone)")
        .join(heads, "zone")
        .select("seam", F.struct("text", "parts").alias("head"))
    )
    joined = walked.join(seams, (F.col("zone") == F.col("seam")) & F.col("following").isNull(), "left")
    after_ = F.coalesce("following", "head")
    return joined.select(
        *docs.columns, after_["text"].alias("next_text"), after_["parts"].alias("next_parts")
    )


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited_text and the fingerprints of the text, the edited and the next text.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = plain.withColumn("parts", fingerprint("text"))
    half = "char_length(text) div 2"
    text = f"concat(left(text, cast(char_length(text) - {half} as int)), left(next_text, cast({half} as int)))"
    return (
        with_next(plain)
        .withColumn("edited_text", F.expr(text))
        .withColumn("edited_parts", fingerprint("edited_text"))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next of every row."""
    return edited(docs).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        printed(F.col("parts")).alias("fingerprint"),
        printed(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness("parts", "edited_parts").alias("near_edited"),
        likeness("parts", "next_parts").alias("near_next"),
    )
