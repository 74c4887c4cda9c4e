"""Small helpers for expressions written as SQL text.

Plans with many expressions are written as text: the JVM parses them in one call,
where building the same tree column by column costs a Python-to-JVM call per node.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ident(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def idents(names: Iterable[str]) -> list[str]:
    return [ident(n) for n in names]


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> str:
    """A double literal."""
    return f"{float(value)!r}D"


def over(keys: Sequence[str], rest: str = "") -> str:
    by = f"PARTITION BY {', '.join(idents(keys))}" if keys else ""
    return f"OVER ({by} {rest})"


def present(expression: str) -> str:
    """The value as a double, NaN turned into NULL."""
    return f"nanvl(cast({expression} AS double), cast(NULL AS double))"


def exprs(*parts: str) -> list[Column]:
    return [F.expr(p) for p in parts]
