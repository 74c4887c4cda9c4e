"""License scans by ordered signature rules.

A rule is a regular expression over words with a keyword, a tier (0 before 2), a confidence and a
label. Texts without any keyword are passed over by one search; in the others every word gets its
number attached, only the rules all of whose fixed words occur are tried, and their matches carry their
word positions with them. Detections are then resolved in one pass by start: one that lies inside another
of the same or a better tier (of equal stretches, inside the earlier rule's) is suppressed, partial
overlaps stay. All of it is DataFrame expressions on one row at a time.

Patterns are written as words with single spaces. ``word?`` may be missing, ``*3`` stands for up to
three arbitrary words, anything else in a word is a regular expression over that word.

Defined cases: a null or empty text has no words, no labels and score 0; first_word and last_word are
null without a base place; repeated rows have equal results; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose places are always reported, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# label: its identifier as words; its full name; the keyword of the name, a word of all its matches
NAMES = {
    "apache-1.1": ("apache 1 1", "apache software license version? 1 1", "license"),
    "apache-2.0": ("apache 2 0", "apache license version? 2 0?", "license"),
    "mit": ("mit", "mit license", "license"),
    "x11": ("x11", "x11 license", "license"),
    "isc": ("isc", "isc license", "license"),
    "zlib": ("zlib", "zlib license", "license"),
    "ncsa": ("ncsa", "university of illinois *1 ncsa open source license", "license"),
    "bsd-2-clause": ("bsd 2 clause", "(?:simplified|freebsd) bsd license", "license"),
    "bsd-3-clause": ("bsd 3 clause", "(?:new|modified|revised) bsd license", "license"),
    "bsd-4-clause": ("bsd 4 clause", "(?:original|old) bsd license", "license"),
    "0bsd": ("0bsd", "zero clause bsd license", "license"),
    "gpl-1.0": ("gpl 1 0", "gnu general public license *3 version? (?:1|v1) 0?", "license"),
    "gpl-2.0": ("gpl 2 0", "gnu general public license *3 version? (?:2|v2) 0?", "license"),
    "gpl-3.0": ("gpl 3 0", "gnu general public license *3 version? (?:3|v3) 0?", "license"),
    "lgpl-2.0": ("lgpl 2 0", "gnu library general public license *3 version? (?:2|v2) 0?", "license"),
    "lgpl-2.1": ("lgpl 2 1", "gnu lesser general public license *3 version? (?:2|v2) 1", "license"),
    "lgpl-3.0": ("lgpl 3 0", "gnu lesser general public license *3 version? (?:3|v3) 0?", "license"),
    "agpl-3.0": ("agpl 3 0", "gnu affero general public license *3 version? (?:3|v3) 0?", "license"),
    "gfdl-1.2": ("gfdl 1 2", "gnu free documentation license *3 version? 1 2", "license"),
    "gfdl-1.3": ("gfdl 1 3", "gnu free documentation license *3 version? 1 3", "license"),
    "mpl-1.1": ("mpl 1 1", "mozilla public license *1 version? (?:1|v1) 1", "license"),
    "mpl-2.0": ("mpl 2 0", "mozilla public license *1 version? (?:2|v2) 0?", "license"),
    "epl-1.0": ("epl 1 0", "eclipse public license *1 version? (?:1|v1) 0?", "license"),
    "epl-2.0": ("epl 2 0", "eclipse public license *1 version? (?:2|v2) 0?", "license"),
    "cddl-1.0": ("cddl 1 0", "common development and distribution license", "license"),
    "cpl-1.0": ("cpl 1 0", "common public license", "license"),
    "eupl-1.1": ("eupl 1 1", "european union public licen[cs]e *1 1 1", "european"),
    "eupl-1.2": ("eupl 1 2", "european union public licen[cs]e *1 1 2", "european"),
    "cc0-1.0": ("cc0 1 0", "creative commons zero", "commons"),
    "cc-by-3.0": ("cc by 3 0", "creative commons attribution 3 0 *2 license", "license"),
    "cc-by-4.0": ("cc by 4 0", "creative commons attribution 4 0 *2 license", "license"),
    "cc-by-sa": ("cc by sa", "creative commons attribution share ?alike *4 license", "license"),
    "cc-by-nd": ("cc by nd", "creative commons attribution no ?derivatives *4 license", "license"),
    "cc-by-nc": ("cc by nc", "creative commons attribution non ?commercial *4 license", "license"),
    "cc-by-nc-sa": ("cc by nc sa", "creative commons attribution non ?commercial share ?alike *4 license", "license"),
    "cc-by-nc-nd": ("cc by nc nd", "creative commons attribution non ?commercial no ?derivatives *4 license", "license"),
    "unlicense": ("unlicense", "the unlicense", "unlicense"),
    "wtfpl": ("wtfpl", "do what the fuck you want to public license", "license"),
    "artistic-1.0": ("artistic 1 0", "artistic license 1 0", "license"),
    "artistic-2.0": ("artistic 2 0", "artistic license 2 0", "license"),
    "bsl-1.0": ("bsl 1 0", "boost software license", "license"),
    "ofl-1.1": ("ofl 1 1", "sil open font license", "license"),
    "odbl-1.0": ("odbl 1 0", "open database license", "license"),
    "odc-by-1.0": ("odc by 1 0", "open data commons attribution license", "license"),
    "pddl-1.0": ("pddl 1 0", "public domain dedication and license", "license"),
    "postgresql": ("postgresql", "postgresql licen[cs]e", "postgresql"),
    "psf-2.0": ("psf 2 0", "python software foundation license", "license"),
    "php-3.01": ("php 3 01", "php license *1 3 01", "license"),
    "ruby": ("ruby", "ruby license", "license"),
    "vim": ("vim", "vim license", "license"),
    "openssl": ("openssl", "openssl license", "license"),
    "w3c": ("w3c", "w3c software *3 license", "license"),
    "ms-pl": ("ms pl", "microsoft public license", "license"),
    "ms-rl": ("ms rl", "microsoft reciprocal license", "license"),
    "osl-3.0": ("osl 3 0", "open software license *1 3 0", "license"),
    "afl-3.0": ("afl 3 0", "academic free license *1 3 0", "license"),
    "upl-1.0": ("upl 1 0", "universal permissive license", "license"),
    "lppl-1.3c": ("lppl 1 3c", "latex project public license", "license"),
    "cecill-2.1": ("cecill 2 1", "cecill free software license", "license"),
    "apsl-2.0": ("apsl 2 0", "apple public source license", "license"),
    "sleepycat": ("sleepycat", "sleepycat license", "license"),
    "qpl-1.0": ("qpl 1 0", "q public license", "license"),
    "blueoak-1.0.0": ("blueoak 1 0 0", "blue oak model license", "license"),
}

# Notices by their own words: pattern, label, tier, confidence, keyword.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0, 0.95, "permission"),
    ("permission to use copy modify and or? distribute this software", "isc", 0, 0.9, "permission"),
    ("redistribution and use in source and binary forms", "bsd", 0, 0.9, "redistribution"),
    ("neither the name of *8 may be used to endorse *20 redistribution", "bsd-3-clause", 1, 0.8, "redistribution"),
    ("all rights reserved", "all-rights-reserved", 2, 0.5, "reserved"),
    ("copyright c? (?:19|20)[0-9][0-9]", "copyright-notice", 2, 0.3, "copyright"),
    ("(?:released|placed|dedicated) *3 (?:into|in|to) the public domain", "public-domain", 1, 0.9, "domain"),
    ("this work is in the public domain", "public-domain", 1, 0.9, "domain"),
    ("gnu lesser general public license", "lgpl", 2, 0.75, "license"),
    ("gnu affero general public license", "agpl", 2, 0.75, "license"),
    ("gnu free documentation license", "gfdl", 2, 0.75, "license"),
    ("(?:gpl|gplv2|gplv3) license", "gpl", 2, 0.7, "license"),
    ("bsd license", "bsd", 2, 0.7, "license"),
    ("creative commons *6 license", "creative-commons", 2, 0.7, "license"),
    ("(?:proprietary|commercial) license", "proprietary", 2, 0.6, "license"),
    ("end user license agreement", "proprietary", 1, 0.8, "license"),
    ("royalty free license", "royalty-free", 2, 0.5, "license"),
)

# Words one of which every match of a rule has.
KEYWORDS = tuple(
    dict.fromkeys(
        ["license", "cc", "spdx", "opensource"]
        + [notice[4] for notice in NOTICES]
        + [word for ident, _, keyword in NAMES.values() for word in (ident.split()[0], keyword)]
    )
)

_GRANT = "(?:licensed|released|distributed|published|available|provided|covered|used)"

# Bytes that separate words; A-Z belong to words before lower-casing. Written out one by one, as
# regular expressions look single signs up in a table and try ranges one after the other.
_BETWEEN = "".join(rf"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
_GAP = f"[{_BETWEEN}]+"
_WORD = f"[^{_BETWEEN}]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Rule(NamedTuple):
    rank: int
    label: str
    tier: int
    confidence: float
    keyword: str
    pattern: str
    base: bool
    words: tuple[str, ...]


def word_pattern(pattern: str) -> str:
    """The regular expression over numbered words (\\x01 word \\x02 number) for a pattern of words."""
    out = []
    for word in pattern.split(" "):
        if word.startswith("*"):
            out.append(f"(?:\x01[^\x01]+){{0,{word[1:]}}}?")
        elif word.startswith("?"):  # may also be written together with the word before
            out.append(f"(?:\x02[0-9]+\x01)?(?:{word[1:]})\x02[0-9]+")
        else:
            optional = word.endswith("?")
            one = f"\x01(?:{word.removesuffix('?')})\x02[0-9]+"
            out.append(f"(?:{one})?" if optional else one)
    joined = "".join(out)
    return joined.replace("\x02[0-9]+(?:\x02[0-9]+\x01)?", "(?:\x02[0-9]+\x01)?") + "(?=\x01)"


def fixed_words(pattern: str) -> list[str]:
    """The whole words that every match of a pattern of words has."""
    words = pattern.split(" ")
    joined = [word.startswith("?") for word in (*words[1:], "")]  # those may be one word with the next
    return [w for w, j in zip(words, joined, strict=True) if re.fullmatch("[0-9a-z]+", w) and not j]


def rules() -> list[Rule]:
    """All rules in order: base phrases, notices, then seven forms for every license.

    A rule's keyword and fixed words are whole words of each of its matches, so trying it only where all
    of them occur loses none.
    """
    rows: list[tuple] = [(p, label, 2, 0.8, "cc" if p.startswith("cc") else "license", True) for p, label in BASE]
    rows += [(*notice, False) for notice in NOTICES]
    for label, (ident, name, keyword) in NAMES.items():
        own = ident.split()[0]
        rows += [
            (f"spdx license identifier {ident} (?:only|or)? later?", label, 0, 0.99, "spdx", False),
            (f"opensource org licenses? {ident}", label, 0, 0.9, "opensource", False),
            (f"{_GRANT} *3 under *4 {name}", label, 1, 0.95, keyword, False),
            (f"{_GRANT} *3 under *2 {ident}", label, 1, 0.9, own, False),
            (name, label, 2, 0.8, keyword, False),
            (f"{ident} licen[cs]e", label, 2, 0.75, own, False),
            (f"licen[cs]e {ident}", label, 2, 0.7, own, False),
        ]
    return [
        Rule(k, *row[1:5], word_pattern(row[0]), row[5], tuple(dict.fromkeys([row[4], *fixed_words(row[0])])))
        for k, row in enumerate(rows)
    ]


def _gate() -> str:
    """The search for any keyword, by first letters."""
    tails: dict[str, list[str]] = {}
    for word in KEYWORDS:
        tails.setdefault(word[0], []).append(word[1:])
    return "(?i)(?<![0-9a-z])(?:" + "|".join(f"{c}(?:{'|'.join(t)})" for c, t in tails.items()) + ")(?![0-9a-z])"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections."""
    kind = (
        "array<struct<rank:int,label:string,tier:int,confidence:double,pattern:string,base:boolean,words:array<string>>>"
    )
    table = F.from_json(F.lit(json.dumps([r._asdict() for r in rules()])), kind)
    all_fixed = F.array(*[F.lit(w) for w in dict.fromkeys(w for r in rules() for w in r.words)])
    lower = f"translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}')"
    words = f"filter(split({lower}, '{_GAP}'), w -> w <> '')"
    numbered = "concat(array_join(transform(words, (w, i) -> concat(char(1), w, char(2), i)), ''), char(1))"
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = plain.select(
        "doc_id",
        F.expr(f"cast(regexp_count(text, '{_WORD}') as long)").alias("n_words"),
        F.when(F.col("text").rlike(_gate()), F.expr(words)).alias("words"),
    )
    marked = split.select(
        "doc_id",
        "n_words",
        F.expr(numbered).alias("marked"),
        F.array_intersect("words", all_fixed).alias("occur"),
    )
    found = marked.select(
        "doc_id",
        "n_words",
        F.when(
            F.col("marked").isNotNull(),
            F.flatten(
                F.transform(
                    F.filter(table, lambda r: F.forall(r["words"], lambda w: F.array_contains(F.col("occur"), w))),
                    lambda r: F.transform(
                        F.regexp_extract_all(F.col("marked"), r["pattern"], F.lit(0)),
                        lambda m: F.struct(
                            F.regexp_extract(m, "\x02([0-9]+)", 1).cast("int").alias("start"),
                            (-F.regexp_extract(m, "([0-9]+)$", 1).cast("int")).alias("last"),
                            r["tier"].alias("tier"),
                            r["rank"].alias("rank"),
                            r["label"].alias("label"),
                            r["confidence"].alias("confidence"),
                            r["base"].alias("base"),
                        ),
                    ),
                )
            ),
        ).alias("found"),
    )
    inside = (
        "(d.tier >= 0 and a.e0 >= -d.last) or (d.tier >= 1 and a.e1 >= -d.last) or (d.tier >= 2 and a.e2 >= -d.last)"
    )
    reach = ", ".join(f"if(d.tier = {t}, greatest(a.e{t}, -d.last), a.e{t}) as e{t}" for t in range(3))
    resolved = (
        "aggregate(sort_array(found), struct(-1 as e0, -1 as e1, -1 as e2, "
        "cast(array() as array<string>) as labels, 1d as miss), "
        f"(a, d) -> if({inside}, a, struct({reach}, array_union(a.labels, array(d.label)) as labels, "
        "a.miss * (1d - d.confidence) as miss)))"
    )
    base = found.withColumn("base", F.expr("filter(found, d -> d.base)")).withColumn("kept", F.expr(resolved))
    none = "cast(array() as array<string>)"
    return base.select(
        "doc_id",
        "n_words",
        F.expr("cast(coalesce(size(base), 0) as long)").alias("n_base"),
        F.expr("cast(array_min(transform(base, d -> d.start)) as long)").alias("first_word"),
        F.expr("cast(array_max(transform(base, d -> d.start)) as long)").alias("last_word"),
        F.expr(f"coalesce(sort_array(array_distinct(transform(base, d -> d.label))), {none})").alias("base_labels"),
        F.expr(
            f"coalesce(sort_array(array_union(kept.labels, transform(base, d -> d.label))), {none})"
        ).alias("labels"),
        F.expr("coalesce(1d - kept.miss, 0d)").alias("score"),
        F.expr("transform(found, d -> struct(d.label, d.start, -d.last as last_word, d.tier, d.rank))").alias(
            "detections"
        ),
    )
