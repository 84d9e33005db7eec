"""One pass over raw logs: counts per time bucket and index, independent of any target.

Raw rows are only ever aggregated here. Every sum is combined on the map side, so a single index,
level or client that holds most of the rows costs one partial row per task. Targets, windows and
baselines are assigned afterwards, on the much smaller facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.config import Span, Target, bucket_seconds, scan_bounds
from sentinel.functions import fixed_values as fv
from sentinel.functions import sql, text
from sentinel.functions.index_names import index_may_match
from sentinel.sources.logs import between

HOST_PHRASES = {
    "ssh_fail": fv.SSH_FAIL_PHRASES,
    "oom": fv.OOM_PHRASES,
    "disk": fv.DISK_PHRASES,
    "unit_fail": fv.UNIT_FAIL_PHRASES,
}
LINE_KEYS = ["bucket", "index_name", "level", "host", "message_template"]
SECOND = "unix_seconds(CAST(ts AS TIMESTAMP))"


def as_timestamp(epoch: str) -> str:
    return f"CAST(timestamp_seconds({epoch}) AS TIMESTAMP_NTZ)"


def reported_levels(targets: list[Target]) -> list[str]:
    return sorted({level for t in targets for level in [*t.error_levels, *t.warn_levels]})


def prepare(logs: DataFrame, targets: list[Target], span: Span, periods: tuple[int, ...] = ()) -> DataFrame:
    """Rows any target could need, with their bucket; `n` is 1 so facts can be re-summed.

    `periods` are lengths besides the targets' own that buckets must divide, such as a digest's.
    """
    low, high = scan_bounds(targets, span, periods)
    patterns = [p for t in targets for p in [*t.indices, *t.linux_indices]]
    patterns += [index for t in targets for _, index, _ in t.heartbeats]
    step = bucket_seconds(targets, periods)
    return (
        between(logs, low, high)
        .where(index_may_match(patterns))
        .selectExpr("*", f"{SECOND} - pmod({SECOND} - {span.anchor}L, {step}L) AS bucket",
                    "1L AS n")
    )


def _phrase_sums(rows: DataFrame) -> tuple[DataFrame, list]:
    if "ssh_fail" in rows.columns:
        hits = {name: name for name in HOST_PHRASES}
    else:
        source = "host_message" if "host_message" in rows.columns else "message"
        rows = rows.selectExpr("*", f"{text.words(source)} AS words")
        hits = {name: sql.when(text.has_phrase("words", phrases), "n")
                for name, phrases in HOST_PHRASES.items()}
    return rows, [F.expr(f"coalesce(sum({hit}), 0L) AS {name}") for name, hit in hits.items()]


def redacted_alike(targets: list[Target]) -> bool:
    """May templates be redacted before anything is summed? Every target wants it and none ranks raw ones."""
    return all(t.scrub_pii and t.template_limit is None for t in targets)


def line_facts(rows: DataFrame, targets: list[Target], redacted: bool = False) -> DataFrame:
    """The finest grain the level, message and host facts can all be summed from.

    With `redacted` templates lose addresses, tokens and the like before the shuffle, so facts grow with the
    kinds of lines and not with the clients that lines name.
    """
    reported = sql.is_in("level", reported_levels(targets))
    shown = text.scrub("message_template") if redacted else "message_template"
    rows = rows.withColumn("message_template", F.expr(sql.when(reported, shown)))
    rows, sums = _phrase_sums(rows)
    return rows.groupBy(*LINE_KEYS).agg(F.expr("sum(n) AS n"), *sums)


def count_facts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket", "index_name", "level").agg(F.expr("sum(n) AS n"))


def message_rows(rows: DataFrame, targets: list[Target], redacted: bool = False) -> DataFrame:
    """Templates of error and warning rows, not summed yet; with `redacted`, redacted here."""
    shown = text.scrub("message_template") if redacted else "message_template"
    return (
        rows.where(f"{sql.is_in('level', reported_levels(targets))} AND message_template IS NOT NULL")
        .selectExpr("bucket", "index_name", "level", f"{shown} AS message", "n")
    )


def message_facts(rows: DataFrame, targets: list[Target], redacted: bool = False) -> DataFrame:
    return (message_rows(rows, targets, redacted).groupBy("bucket", "index_name", "level", "message")
            .agg(F.expr("sum(n) AS n")))


def host_facts(rows: DataFrame) -> DataFrame:
    rows, sums = _phrase_sums(rows.where("host IS NOT NULL"))
    return rows.groupBy("bucket", "index_name", "host").agg(F.expr("sum(n) AS total"), *sums)


def access_rows(rows: DataFrame) -> DataFrame:
    """Requests with what is counted about them, not summed yet."""
    codes = ", ".join(map(str, fv.AUTH_STATUS_CODES))
    return rows.where("status_code IS NOT NULL").selectExpr(
        "bucket", "index_name", "source_ip", "url_path", "n AS total",
        "CASE WHEN status_code >= 400 AND status_code < 500 THEN n ELSE 0L END AS c4xx",
        f"CASE WHEN status_code IN ({codes}) THEN n ELSE 0L END AS auth_fail",
        "CASE WHEN status_code >= 400 THEN n ELSE 0L END AS failed")


def access_facts(rows: DataFrame) -> DataFrame:
    """Requests per client and path. Distinct paths stay countable after any further sum."""
    return access_rows(rows).groupBy("bucket", "index_name", "source_ip", "url_path").agg(
        *[F.expr(f"sum({name}) AS {name}") for name in ("total", "c4xx", "auth_fail", "failed")])
