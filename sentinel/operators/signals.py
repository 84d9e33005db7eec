"""The shape every detector returns, and how a detector emits it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from sentinel.functions import fixed_values as fv
from sentinel.functions import sql

SIGNAL_COLUMNS = ["target", "w_end", "kind", "severity", "entity", "cur", "base", "threshold",
                  "extra", "detail"]


def signal(kind: str, *, cur: str, base: str = "NULL", threshold: str = "NULL",
           entity: str = "NULL", extra: str = "NULL", detail: str | None = None,
           **values: str) -> str:
    """One signal as a struct; the text comes from the kind's format unless given."""
    if detail is None:
        detail = sql.fill(fv.DETAIL[kind], cur=cur, base=base, entity=entity, **values)
    return sql.struct(
        kind=sql.text(kind), severity=sql.text(fv.SEVERITY[kind]),
        entity=f"CAST({entity} AS STRING)", cur=f"CAST({cur} AS BIGINT)",
        base=f"CAST({base} AS BIGINT)", threshold=f"CAST({threshold} AS DOUBLE)",
        extra=f"CAST({extra} AS array<string>)", detail=detail,
    )


def emit(rows: DataFrame, *candidates: tuple[str, str]) -> DataFrame:
    """All signals whose condition holds, from one pass over the rows."""
    found = sql.compact([sql.when(condition, s) for condition, s in candidates])
    return rows.selectExpr("target", "w_end", f"inline({found})")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.union(b), parts)
