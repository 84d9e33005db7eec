"""Small pieces of Spark SQL text.

Expression helpers in this package return SQL text, used through `selectExpr` and `F.expr`. A plan
with thousands of operators built one Column call at a time costs seconds of driver time; the same
plan from text costs one parse per expression.
"""

from __future__ import annotations

import re


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, (list, tuple)):
        return f"CAST(array({', '.join(text(v) for v in value)}) AS array<string>)"
    return text(value)


def is_in(expression: str, values: list) -> str:
    if not values:
        return "false"
    return f"({expression} IN ({', '.join(literal(v) for v in values)}))"


def any_of(tests: list[str]) -> str:
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"{text(k)}, {v}" for k, v in fields.items()) + ")"


def when(condition: str, value: str, otherwise: str | None = None) -> str:
    tail = "" if otherwise is None else f" ELSE {otherwise}"
    return f"CASE WHEN {condition} THEN {value}{tail} END"


def compact(entries: list[str]) -> str:
    """Array of the entries that are not null."""
    return f"array_compact(array({', '.join(entries)}))"


def fill(template: str, **values: str) -> str:
    """`{name}` places of a fixed text replaced by expressions."""
    pieces = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            pieces.append(f"CAST({values[part]} AS STRING)")
        elif part:
            pieces.append(text(part))
    return f"concat({', '.join(pieces)})"
