"""Windows and baselines without self-joins.

A bucket belongs to exactly one window of a target, and, shifted by the baseline offset, to the
baseline of exactly one window. So each fact row is emitted once per side and one grouping gives
current and baseline next to each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.config import Span, Target
from sentinel.functions import sql
from sentinel.functions.index_names import index_matches


def window_end(second: str, anchor: int, window: int) -> str:
    """End of the half-open window holding this second."""
    return f"({second} - pmod({second} - {anchor}L, {window}L) + {window}L)"


def assign(
    facts: DataFrame,
    targets: list[Target],
    span: Span,
    *,
    offset: Callable[[Target], int] | None = None,
    lead: Callable[[Target], int] | None = None,
    indices: Callable[[Target], list] = lambda t: t.indices,
    keep: Callable[[Target], str] | None = None,
    extra: Callable[[Target], dict[str, str]] = lambda t: {},
) -> DataFrame:
    """Add target, w_end and (with `offset`) is_base to each fact row, once per matching side.

    `lead` also keeps windows whose end, moved on by that much, is evaluated.
    """
    hits = []
    for t in targets:
        matches = index_matches(indices(t))
        if keep is not None:
            matches += f" AND {keep(t)}"
        for shift, is_base in [(0, False)] + ([(offset(t), True)] if offset else []):
            end = window_end(f"(bucket + {shift}L)" if shift else "bucket", span.anchor, t.window)
            wanted = span.covers(end, t.window)
            if lead is not None:
                wanted = f"({wanted} OR {span.covers(f'({end} + {lead(t)}L)', t.window)})"
            fields = {"target": sql.text(t.name), "w_end": end, **extra(t)}
            if offset:
                fields["is_base"] = sql.literal(is_base)
            hits.append(sql.when(f"{matches} AND {wanted}", sql.struct(**fields)))
    return facts.selectExpr("*", f"inline({sql.compact(hits)})")


def sides(value: str, name: str, condition: str | None = None) -> list:
    """Sums of a measure for the current window and, as base_<name>, its baseline."""
    both = f" AND {condition}" if condition else ""
    return [
        F.expr(f"coalesce(sum(CASE WHEN NOT is_base{both} THEN {value} END), 0L) AS {name}"),
        F.expr(f"coalesce(sum(CASE WHEN is_base{both} THEN {value} END), 0L) AS base_{name}"),
    ]


def spine(spark: SparkSession, targets: list[Target], span: Span) -> DataFrame:
    """Every evaluated (target, w_end), also the empty ones."""
    rows = [
        sql.struct(target=sql.text(t.name), ends=f"sequence({span.first_end(t.window)}L,"
                   f" {span.last_end(t.window)}L, {t.window}L)")
        for t in targets if span.last_end(t.window) >= span.first_end(t.window)
    ]
    return (
        spark.range(1, numPartitions=1).selectExpr(f"inline(array({', '.join(rows)}))")
        .selectExpr("target", "explode(ends) AS w_end")
    )


def top_k(rows: DataFrame, partition: list[str], order: list[str], k: int | None,
          rank: str = "rank") -> DataFrame:
    """First k rows per group; Spark trims each partition before it shuffles the groups."""
    ranked = rows.selectExpr("*", f"row_number() OVER (PARTITION BY {', '.join(partition)}"
                                  f" ORDER BY {', '.join(order)}) AS {rank}")
    return ranked if k is None else ranked.where(f"{rank} <= {k}")


def per_target(targets: list[Target], value: Callable[[Target], str], default: str = "NULL") -> str:
    """An expression that depends on the row's target."""
    values = [(t, value(t)) for t in targets]
    if not values:
        return default
    cases = " ".join(f"WHEN {sql.text(t.name)} THEN {v}" for t, v in values)
    return f"CASE target {cases} ELSE {default} END"
