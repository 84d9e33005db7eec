"""Field coverage of a log source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows, non-null values and distinct values of each field.

    Values are counted per (field, value) first, so exact distinct counts need no per-field pass
    and a dominant value collapses before the shuffle.
    """
    cells = ", ".join(f"named_struct('field', '{name}', 'value', CAST({name} AS STRING))"
                      for name in fields)
    counted = (rows.selectExpr(f"inline(array({cells}))").groupBy("field", "value")
               .agg(F.expr("count(*) AS n")))
    return counted.groupBy("field").agg(
        F.expr("sum(n) AS n_rows"),
        F.expr("coalesce(sum(CASE WHEN value IS NOT NULL THEN n END), 0L) AS n_filled"),
        F.expr("count(value) AS n_distinct"))
