"""Text jobs over whole tables: redaction, secret census, fingerprint rollup, phrase counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.functions import sql, text


def scrub_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The same table with the chosen columns redacted; a narrow job."""
    return rows.withColumns({c: F.expr(text.scrub(c)) for c in columns})


def pii_census(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """How many rows hold each kind of secret, counted on the raw text in one pass."""
    flags = text.secret_flags(column)
    return rows.select(column, *(by or [])).groupBy(*(by or [])).agg(
        F.expr("count(*) AS n_rows"),
        *[F.expr(f"count_if({flag}) AS {name}") for name, flag in flags.items()])


def scrubbed_messages(rows: DataFrame, column: str = "message") -> DataFrame:
    """Counts per redacted text. Equal raw texts are combined first, so each is redacted once."""
    raw = rows.where(f"{column} IS NOT NULL").groupBy(column).agg(F.expr("count(*) AS n"))
    return (raw.selectExpr(f"{text.scrub(column)} AS message", "n")
            .groupBy("message").agg(F.expr("sum(n) AS n")))


def fingerprint_rollup(rows: DataFrame, column: str = "message", time: str = "ts") -> DataFrame:
    """Occurrences, first and last time and an example per fingerprint.

    Equal raw texts are combined first, so each is fingerprinted once.
    """
    raw = rows.where(f"{column} IS NOT NULL").groupBy(column).agg(
        F.expr("count(*) AS n"), F.expr(f"min({time}) AS first_at"),
        F.expr(f"max({time}) AS last_at"))
    return (
        raw.selectExpr(f"{text.fingerprint(column)} AS fp", f"{column} AS example", "n",
                       "first_at", "last_at")
        .groupBy("fp")
        .agg(F.expr("sum(n) AS n"), F.expr("min(first_at) AS first_at"),
             F.expr("max(last_at) AS last_at"), F.expr("min(example) AS example"))
    )


def phrase_counts(rows: DataFrame, column: str, phrases: list[str]) -> DataFrame:
    """Rows holding each phrase as consecutive whole words; every text is tokenised once."""
    tests = ", ".join(
        f"CASE WHEN {text.has_phrase('words', [p])} THEN {sql.text(p)} END" for p in phrases)
    return (
        rows.selectExpr(f"{text.words(column)} AS words")
        .selectExpr(f"explode(array_compact(array({tests}))) AS phrase")
        .groupBy("phrase").agg(F.expr("count(*) AS n"))
    )
