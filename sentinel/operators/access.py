"""Clients probing an API: scanner paths, path enumeration, rejected logins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.config import Span, Target, with_limits
from sentinel.functions import fixed_values as fv
from sentinel.functions import sql, text
from sentinel.operators import signals
from sentinel.operators.windows import assign, per_target, top_k


def watched(targets: list[Target]) -> list[Target]:
    return [t for t in targets if t.security_check]


def request_windows(access: DataFrame, targets: list[Target], span: Span) -> DataFrame:
    """Requests per window, client and path. A busy client spreads over its paths."""
    def by_path(t: Target) -> dict[str, str]:
        prefix = t.security_auth_path_prefix
        scoped = text.starts_with_ignoring_case("url_path", prefix) if prefix else "true"
        return {
            "scoped_fail": sql.when(f"auth_fail > 0 AND {scoped}", "auth_fail", "0L"),
            "suspicious": sql.when(
                f"failed > 0 AND {text.contains_any('url_path', t.path_tokens)}", "failed", "0L"),
        }

    rows = assign(access, watched(targets), span, extra=by_path)
    sums = ["total", "c4xx", "auth_fail", "scoped_fail", "suspicious"]
    return rows.groupBy("target", "w_end", "source_ip", "url_path").agg(
        *[F.expr(f"sum({name}) AS {name}") for name in sums])


def access_by_ip(requests: DataFrame) -> DataFrame:
    """Per client, all of them: requests, 4xx, rejected logins (all and in scope), distinct paths."""
    sums = ["total", "c4xx", "auth_fail", "scoped_fail"]
    return (
        requests.where("source_ip IS NOT NULL").groupBy("target", "w_end", "source_ip")
        .agg(*[F.expr(f"sum({name}) AS {name}") for name in sums],
             # one row per path here, so counting rows counts distinct paths
             F.expr("count(url_path) AS distinct_paths"))
    )


def busiest_clients(clients: DataFrame, targets: list[Target]) -> DataFrame:
    """The clients to list: the busiest of a window where a target sets `security_top_ips`, else all."""
    limited = {t.name: t.security_top_ips for t in watched(targets) if t.security_top_ips is not None}
    if not limited:
        return clients
    capped = sql.is_in("target", list(limited))
    ranked = top_k(clients.where(capped), ["target", "w_end"], ["total DESC", "source_ip ASC"], max(limited.values()))
    own = per_target([t for t in watched(targets) if t.name in limited], lambda t: f"rank <= {t.security_top_ips}", "false")
    return ranked.where(own).drop("rank").union(clients.where(f"NOT {capped}"))


def client_signals(clients: DataFrame, targets: list[Target],
                   kinds: tuple[str, ...] = ("api_scan", "auth_bruteforce")) -> DataFrame:
    scope = sql.when("auth_prefix = ''", "''", sql.fill(fv.AUTH_SCOPE, prefix="auth_prefix"))
    found = {
        "api_scan": (
            "c4xx >= scan_min_4xx AND distinct_paths >= scan_min_paths",
            signals.signal("api_scan", cur="c4xx", threshold="scan_min_4xx", entity="source_ip",
                           paths="distinct_paths", extra="array(CAST(distinct_paths AS STRING))",
                           hours="hours"),
        ),
        "auth_bruteforce": (
            "scoped_fail >= auth_threshold",
            signals.signal("auth_bruteforce", cur="scoped_fail", threshold="auth_threshold",
                           entity="source_ip", scope=scope, hours="hours"),
        ),
    }
    return signals.emit(with_limits(clients, targets), *[found[kind] for kind in kinds])


def suspicious_requests(requests: DataFrame) -> DataFrame:
    """Failed requests on scanner paths: how many, the top paths and the top clients."""
    # the total and both breakdowns from one grouping
    parts = ("array(named_struct('by', 'all', 'key', CAST(NULL AS STRING)),"
             " named_struct('by', 'path', 'key', url_path),"
             " named_struct('by', 'ip', 'key', source_ip))")
    grouped = (
        requests.where("suspicious > 0")
        .selectExpr("target", "w_end", "suspicious", f"inline({parts})")
        .groupBy("target", "w_end", "by", "key").agg(F.expr("sum(suspicious) AS n"))
        .where("by = 'all' OR key IS NOT NULL")
    )
    ranked = top_k(grouped, ["target", "w_end", "by"], ["n DESC", "key ASC"], fv.TOP_SUSPICIOUS)

    def listed(by: str, name: str):
        return F.expr(f"transform(array_sort(collect_list(CASE WHEN by = '{by}' THEN"
                      f" struct(rank, key, n) END)), e -> struct(e.key, e.n)) AS {name}")

    return ranked.groupBy("target", "w_end").agg(
        F.expr("max(CASE WHEN by = 'all' THEN n END) AS suspicious"),
        listed("path", "paths"), listed("ip", "ips"))


def suspicious_signals(suspicious: DataFrame, targets: list[Target]) -> DataFrame:
    def shown(column: str, separator: str, nothing: str) -> str:
        keys = f"transform(slice({column}, 1, {fv.SHOWN_SUSPICIOUS}), e -> e.key)"
        return sql.when(f"size({column}) = 0", sql.text(nothing),
                        f"array_join({keys}, {sql.text(separator)})")

    return signals.emit(with_limits(suspicious, targets), (
        "suspicious >= min_suspicious",
        signals.signal("suspicious_requests", cur="suspicious", threshold="min_suspicious",
                       hours="hours", paths=shown("paths", "; ", fv.NO_PATHS),
                       ips=shown("ips", ", ", fv.NO_IPS)),
    ))
