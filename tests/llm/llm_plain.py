"""Plain Python readings of the contracts, for small inputs."""

import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use inside.
CLASHES = ("size", "key", "row", "n", "length", "block", "class", "zone", "spans", "row_key", "label", "u", "part")


def documents(spark, rows):
    """A documents table from (doc_id, text[, source]) with further columns of clashing names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *["x"] * len(CLASHES)) for r in rows]
    kinds = [T.LongType(), *[T.StringType()] * 3, T.LongType(), *[T.StringType()] * len(CLASHES)]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    return spark.createDataFrame(full, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])).repartition(3)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def prose(seed, n):
    """n invented words, repeatable."""
    import random

    rng = random.Random(seed)
    return " ".join(
        "".join(rng.choice(["an", "er", "th", "on", "é", "st", "Re"]) for _ in range(rng.randint(1, 4))) for _ in range(n)
    )


#: Nulls, blanks, short, repeated and very long texts.
ODD = [
    (1, None, None),
    (2, "", "a"),
    (3, " \n\t ", "a"),
    (4, "one", "b"),
    (5, "two words", "b"),
    (6, prose(1, 60), "a"),
    (6, prose(1, 60), "a"),
    (7, prose(1, 60), "b"),
    (None, prose(2, 30), "b"),
    (None, None, None),
    (8, prose(3, 30_000), "a"),
    (9, "x" * 50_000 + " 中文 \U0001f600 İstanbul", None),
]


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


def jaccard_links(sets):
    """Pairs with 100 * intersection >= 75 * union, through an index of shingles."""
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    out = []
    for i, s in sets.items():
        met = Counter(j for x in s for j in index[x] if j > i)
        out += [(i, j) for j, k in met.items() if 100 * k >= 75 * (len(s) + len(sets[j]) - k)]
    return out
