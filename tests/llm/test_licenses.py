import re

from llm_plain import ODD, SCHEMA, documents, lower, prose

from siteratio.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License)",
    "SPDX-License-Identifier: Apache-2.0",
    "the MIT license! MIT_License; mit\nlicense and emit license, MIT Licenses",
    "GNU General Public License version 3, GNU  GENERAL-PUBLIC license",
    "Licensed under CC BY-NC 4.0. All rights reserved.",
    "ccby cc. by écc by cc byé CC\x00BY",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "Redistribution and use in source and binary forms; new BSD license",
    "no grant here " + prose(4, 50),
    "mit license " * 300,
    "Kind of licenſe: mit licenſe",
    "apache " + "license " * 3 + prose(9, 4000) + " gnu general public license",
]


def base_places(text):
    words = WORD.findall(lower(text))
    places = []
    for phrase, label in licenses.BASE:
        one = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(one)] == one]
    return words, places


def brute(text):
    """All rules over numbered words, and suppression by comparing all pairs of detections."""
    words = WORD.findall(lower(text))
    marked = "".join(f"\x01{w}\x02{i}" for i, w in enumerate(words)) + "\x01"
    found = []
    for rule in licenses.rules():
        if f"\x01{rule.keyword}\x02" in marked:
            for m in re.finditer(rule.pattern, marked):
                ends = re.findall("\x02([0-9]+)", m.group())
                found.append((int(ends[0]), int(ends[-1]), rule))

    def suppressed(d):
        order = lambda x: (x[0], -x[1], x[2].tier, x[2].rank)
        return any(
            e[0] <= d[0] and e[1] >= d[1] and e[2].tier <= d[2].tier and order(e) < order(d) for e in found
        )

    kept = [d for d in found if not suppressed(d)]
    miss = 1.0
    for d in kept:
        miss *= 1 - d[2].confidence
    base = {d[2].label for d in found if d[2].base}
    return sorted({d[2].label for d in kept} | base), 1 - miss


def test_hundreds_of_rules_in_order():
    rules = licenses.rules()
    assert len(rules) > 300 and [r.rank for r in rules] == list(range(len(rules)))
    assert all(r.keyword in licenses.KEYWORDS and 0 < r.confidence < 1 and r.tier in (0, 1, 2) for r in rules)
    assert [r.label for r in rules if r.base] == [label for _, label in licenses.BASE]


def test_as_by_brute_force(spark):
    rows = list(enumerate(TEXTS))
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, rows)).collect()}
    for i, text in rows:
        words, places = base_places(text)
        row = got[i]
        assert row["n_words"] == len(words), text
        assert row["n_base"] == len(places), text
        starts = [k for k, _ in places]
        assert row["first_word"] == (min(starts) if starts else None)
        assert row["last_word"] == (max(starts) if starts else None)
        assert row["base_labels"] == sorted({label for _, label in places})
        labels, score = brute(text)
        assert row["labels"] == labels, text
        assert abs(row["score"] - score) < 1e-12 and 0 <= row["score"] <= 1


def test_named_licenses(spark):
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(documents(spark, list(enumerate(TEXTS)))).collect()}
    assert "apache-2.0" in got[0] and "apache-2.0" in got[1] and "gpl-3.0" in got[3]
    assert "cc-by-nc" in got[4] and "all-rights-reserved" in got[4]
    assert got[6] == ["mit"] and "bsd-3-clause" in got[7] and got[8] == []


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(documents(spark, [(1, "mit license")])).select("labels")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(spark):
    got = licenses.scan(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert all(r["labels"] == [] and r["base_labels"] == [] and r["score"] == 0 and r["n_base"] == 0 for r in got)
    assert {r["doc_id"]: r["n_words"] for r in got}[9] == len(WORD.findall(lower(ODD[-1][1])))
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


GRANTED = [
    "Released under Apache 2.0", "distributed under the MPL 2.0", "available under BSD 3-Clause", "MIT Licence",
    "Licence: ISC", "European Union Public License v 1 2", "European Union Public Licence 1 1", "Creative Commons Zero",
    "PostgreSQL License", "PostgreSQL Licence", "https://opensource.org/MIT", "covered under Zlib", "no words of it",
]


def test_keywords_lose_no_match(spark, monkeypatch):
    patterns = []
    monkeypatch.setattr(licenses, "word_pattern", lambda p, real=licenses.word_pattern: patterns.append(p) or real(p))
    rules = licenses.rules()
    monkeypatch.undo()

    def written_out(pattern, pick, optional):
        out = []
        for word in pattern.split(" "):
            if word.startswith("*") or (word.endswith("?") and not word.startswith("?") and not optional):
                continue
            word = word.replace("[0-9][0-9]", "99").replace("licen[cs]e", "(?:license|licence)").strip("?")
            choices = word.split("(?:")[-1].replace(")", "|", 1).removesuffix("|").split("|")
            out.append(choices[pick % len(choices)].replace("1999", "19") if "(?:" in word else word)
        return " ".join(out)

    texts = GRANTED + [written_out(p, pick, more) for p in patterns for pick in (0, 1) for more in (False, True)]
    rows = list(enumerate(dict.fromkeys(texts)))
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, rows)).collect()}
    seen = set()
    for i, text in rows:
        marked = "".join(f"\x01{w}\x02{k}" for k, w in enumerate(WORD.findall(lower(text)))) + "\x01"
        want = {r.rank for r in rules if re.search(r.pattern, marked)}
        seen |= want
        assert {d["rank"] for d in got[i]["detections"] or []} == want, text
    assert len(seen) > 0.98 * len(rules)
    for i in range(len(GRANTED) - 1):
        assert got[i]["labels"] and got[i]["score"] > 0, GRANTED[i]


def test_rules_tried_only_where_all_their_fixed_words_occur(spark):
    rules = licenses.rules()
    assert licenses.fixed_words("gnu license *3 version? (?:2|v2) 0?") == ["gnu", "license"]
    assert licenses.fixed_words("attribution share ?alike *4 license") == ["attribution", "license"]
    by_keyword = [r for r in rules if r.keyword == "license"]
    tried = [r for r in by_keyword if set(r.words) <= set("a license to the work under this agreement".split())]
    assert len(by_keyword) > 100 and len(tried) < 10
    text = "".join(f"a{chr(c)}" for c in range(128)) + " commons\x7fAttribution\x00ShareAlike"
    got = licenses.scan(documents(spark, [(1, text), (2, "creative commons attribution share-alike license")])).collect()
    assert {r["doc_id"]: r["n_words"] for r in got} == {1: len(WORD.findall(lower(text))), 2: 6}
    assert {r["doc_id"]: {d["label"] for d in r["detections"] or []} for r in got} == {1: set(), 2: {"creative-commons", "cc-by-sa"}}
