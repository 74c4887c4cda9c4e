"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, ``://`` and
the cue words before identifiers. Local parsers expand every anchor to its boundaries and validate
what they found. Dotted addresses and card numbers have digits as their anchors. Every parser is
linear in the text, also for very long runs of digits or letters, where a backtracking search for
the same patterns would be quadratic.

Base kinds (fixed patterns, leftmost and non-overlapping per kind, failing matches dropped without a
retry): email, ip, card, phone. The method adds iban, account, ssn, secret and url (only addresses
that carry a user name or password). Spans count code points; the end is exclusive.

Defined cases: a null or empty text has no spans; equal rows have equal spans; spans of different
kinds may overlap, and redaction then replaces their union by the name of the first one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "account", "ssn", "secret", "url")
SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)

# Cue words, fixed values: what they introduce.
CUES = {
    "iban": "iban",
    "account": "account",
    "acct": "account",
    "ssn": "ssn",
    "social security": "ssn",
    "password": "secret",
    "passwd": "secret",
    "token": "secret",
    "secret": "secret",
    "api_key": "secret",
    "apikey": "secret",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_WORD_CHAR = re.compile(r"[A-Za-z0-9_]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
_AFTER_CUE = re.compile(r"(?:[ ]?(?:number|no\.?|nr\.?|#))?[ ]*[:=#]?[ ]*")
_ASSIGNED = re.compile(r"[ ]*[:=][ ]*[\"']?")
_SECRET = re.compile(r"[A-Za-z0-9+/_.~-]{8,}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])")
_AUTHORITY = re.compile(r"[^\s/?#@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?")

_automaton = None


def automaton():
    """The anchors, built once in each Python worker; cues in lower, upper and title case."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for anchor in ("@", "+", "://"):
            a.add_word(anchor, (anchor, len(anchor)))
        for cue, kind in CUES.items():
            for form in (cue, cue.upper(), cue.title(), cue.capitalize()):
                a.add_word(form, (kind, len(form)))
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str, ats: list[int]) -> Iterator[tuple[str, int, int]]:
    done = 0
    for at in ats:
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()


def dotted(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, parts = m.start(), m.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield "ip", at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()


def phones(text: str, pluses: list[int]) -> Iterator[tuple[str, int, int]]:
    for at in pluses:
        m = _PHONE.match(text, at)
        if not m:
            continue
        kept = m.group().rstrip(" ().-")
        if 10 <= sum(c.isdigit() for c in kept) <= 15:
            yield "phone", at, at + len(kept)


def identified(text: str, cues: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Identifiers behind cue words, and addresses with user names at ``://``."""
    for kind, start, end in cues:
        if kind == "://":
            left = start
            while left > 0 and text[left - 1] in _SCHEME:
                left -= 1
            m = _AUTHORITY.match(text, end)
            if left < start and m:
                yield "url", left, m.end()
            continue
        if start and _WORD_CHAR.match(text[start - 1]):
            continue
        gap = (_ASSIGNED if kind == "secret" else _AFTER_CUE).match(text, end)
        if not gap:
            continue
        at = gap.end()
        if kind == "iban" and (m := _IBAN.match(text, at)):
            found = m.group()
            # the greedy match may run into the next word: give back blanks until it validates
            while found and not iban_valid(found):
                found = found.rpartition(" ")[0]
            if found:
                yield "iban", at, at + len(found)
        elif kind == "account" and (m := _ACCOUNT.match(text, at)):
            yield "account", at, m.end()
        elif kind == "ssn" and (m := _SSN.match(text, at)):
            yield "ssn", at, m.end()
        elif kind == "secret" and (m := _SECRET.match(text, at)):
            value = m.group().rstrip(".")
            if len(value) >= 8 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                yield "secret", at, at + len(value)


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then by kind as listed."""
    if not text:
        return []
    anchors: dict[str, list] = {"@": [], "+": [], "cue": []}
    for last, (kind, width) in automaton().iter(text):
        if kind in ("@", "+"):
            anchors[kind].append(last)
        else:
            anchors["cue"].append((kind, last + 1 - width, last + 1))
    spans: list[tuple[str, int, int]] = []
    if anchors["@"]:
        spans += emails(text, anchors["@"])
    if anchors["+"]:
        spans += phones(text, anchors["+"])
    if anchors["cue"]:
        spans += dict.fromkeys(identified(text, anchors["cue"]))
    if _DIGIT.search(text):
        spans += dotted(text)
        spans += cards(text)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if spans else spans


def blank(text: str | None, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span (or union of overlapping spans) replaced by <KIND>."""
    out, done = [], 0
    text = text or ""
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


@F.pandas_udf(SPANS)
def spans_of(texts: pd.Series) -> pd.Series:
    named = ("kind", "start", "end")
    return pd.Series([[dict(zip(named, s, strict=True)) for s in find(t)] for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def redacted(texts: pd.Series) -> pd.Series:
    return pd.Series([blank(t, find(t)) for t in texts], dtype=object)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array of the spans of each text in ``out``."""
    return docs.withColumn(out, spans_of(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans of each text replaced; a null text becomes empty."""
    return docs.withColumn(text, redacted(F.col(text)))
