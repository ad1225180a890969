"""Small helpers for writing Spark SQL expressions as text.

Generated expressions (one per label, mask word or candidate) are written as text and parsed once by
``F.expr``: a Column built call by call costs a round trip to the JVM per operator.
"""

from __future__ import annotations

import math
from collections.abc import Iterable


def num(value: float) -> str:
    """A DOUBLE literal."""
    value = float(value)
    if math.isinf(value):
        return "double('infinity')" if value > 0 else "double('-infinity')"
    if math.isnan(value):
        return "double('nan')"
    return f"({value!r}D)" if value < 0 else f"{value!r}D"


def long(value: int) -> str:
    return f"{value}L"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def case(branches: Iterable[tuple[str, str]], otherwise: str | None = None) -> str:
    body = " ".join(f"WHEN {c} THEN {v}" for c, v in branches)
    if not body:
        return otherwise or "NULL"
    return f"(CASE {body}" + (f" ELSE {otherwise}" if otherwise is not None else "") + " END)"


def all_of(tests: Iterable[str]) -> str:
    return "(" + " AND ".join(tests) + ")"


def any_of(tests: Iterable[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


def plus(terms: Iterable[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def array(items: Iterable[str]) -> str:
    return "array(" + ", ".join(items) + ")"
