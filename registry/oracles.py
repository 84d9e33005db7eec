"""What each registered query must return, as SQL for another engine.

Written from the rules, not from the library: windows are joined to raw rows by time, baselines are
joined the same way one offset earlier, and there are no buckets.
"""

from __future__ import annotations

import re

from registry import settings as cfg
from sentinel.config import Target
from sentinel.functions import fixed_values as fv
from sentinel.operators.facts import HOST_PHRASES
from sentinel.sources.event_logs import EVENT_LOGS_SQL, EVENT_ROWS_SQL

LOGS = f"logs AS ({EVENT_LOGS_SQL.replace('{events}', 'events')})"
ALL_LOGS = f"logs AS ({EVENT_ROWS_SQL.replace('{events}', 'events')})"
COLUMNS = "target, w_end, kind, severity, entity, cur, base, threshold, extra, detail"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def ts(second: int) -> str:
    return f"CAST(to_timestamp({second}) AT TIME ZONE 'UTC' AS TIMESTAMP)"


def seconds(n: int) -> str:
    return f"INTERVAL {n} SECOND"


def listed(values) -> str:
    return "(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def fill(template: str, **values: str) -> str:
    parts = [f"CAST({values[p]} AS VARCHAR)" if i % 2 else q(p)
             for i, p in enumerate(re.split(r"\{(\w+)\}", template)) if i % 2 or p]
    return "(" + " || ".join(parts) + ")"


def stream(name: str) -> str:
    return rf"regexp_replace({name}, '^\.ds-(.+)-\d{{4}}\.\d{{2}}\.\d{{2}}-\d{{6}}$', '\1')"


def family(name: str) -> str:
    return rf"regexp_replace({stream(name)}, '^(.+?)-\d{{4}}\.\d{{2}}(?:\.\d{{2}})?$', '\1')"


def matches(patterns, name: str = "index_name") -> str:
    return "(" + " OR ".join(
        "TRUE" if p == "*" else f"{stream(name)} LIKE {q(p.replace('*', '%'))}" for p in patterns
    ) + ")"


# The engine has no lookarounds: the neighbours are captured. Twice, as addresses may share the one between them.
IPV6 = fv.IPV6.replace(r"(?<![0-9A-Za-z:.])(", r"(^|[^0-9A-Za-z:.])(?:").replace(r"(?![0-9A-Za-z.])", r"($|[^0-9A-Za-z.])")


def scrub(value: str) -> str:
    for pattern, token in [
        (r"\beyJ[A-Za-z0-9._\-]{10,}\b", "<jwt>"),
        (r"(?i)\bbearer\s+[A-Za-z0-9._\-]+", "bearer <token>"),
        (r"(://[^/\s:@]+:)[^@/\s]+(@)", r"\1<pw>\2"),
        (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "<email>"),
        (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"),
        (IPV6, r"\1<ip>\2"), (IPV6, r"\1<ip>\2"),
        (r"\b[A-Za-z0-9_\-]{32,}\b", "<token>"),
    ]:
        value = f"regexp_replace({value}, {q(pattern)}, {q(token)}, 'g')"
    return value


def fingerprint(value: str) -> str:
    hexa = "[0-9a-fA-F]"
    for pattern, token in [
        (rf"\b{hexa}{{8}}-{hexa}{{4}}-{hexa}{{4}}-{hexa}{{4}}-{hexa}{{12}}\b", "<id>"),
        (rf"\b0x{hexa}+\b|\b{hexa}{{8,}}\b", "<hex>"),
        (r"""'[^']*'|"[^"]*\"""", "<str>"),
        (r"\d+", "<n>"),
        (r"\s+", " "),
    ]:
        value = f"regexp_replace({value}, {q(pattern)}, {q(token)}, 'g')"
    return f"trim({value})"


def masked(value: str) -> str:
    """Twice, because neighbouring numbers share the character between them."""
    for _ in range(2):
        value = rf"regexp_replace({value}, '(^|[^\w.:-])\d+($|[^\w.:-])', '\1<n>\2', 'g')"
    return value


def phrase(words: str, phrases) -> str:
    return "(" + " OR ".join(
        f"contains({words}, {q(' ' + ' '.join(re.sub(r'[^a-z0-9_]+', ' ', p.lower()).split()) + ' ')})"
        for p in phrases) + ")"


WORDS = r"(' ' || regexp_replace(lower(message), '[^\p{L}\p{N}_]+', ' ', 'g') || ' ')"


# ---- one target ------------------------------------------------------------------------------

def spine(t: Target, name: str) -> str:
    return (f"spine_{name} AS (SELECT {q(t.name)} AS target, r AS w_end FROM range("
            f"{ts(cfg.SPAN.first_end(t.window))}, {ts(cfg.SPAN.last_end(t.window) + 1)},"
            f" {seconds(t.window)}) g(r))")


def windows(t: Target) -> list[str]:
    n = t.name
    counts = f"""
        count(l.ts) AS total,
        count(*) FILTER (l.level IN {listed(t.error_levels)}) AS err,
        count(*) FILTER (l.level IN {listed(t.warn_levels)}) AS warn,
        count(*) FILTER (l.level IN {listed(t.fatal_levels)}) AS fatal"""

    def side(name: str, shift: int) -> str:
        return f"""{name}_{n} AS (SELECT s.w_end, {counts} FROM spine_{n} s LEFT JOIN rows_{n} l
          ON l.ts >= s.w_end - {seconds(shift + t.window)} AND l.ts < s.w_end - {seconds(shift)}
          GROUP BY s.w_end)"""

    return [
        f"rows_{n} AS (SELECT * FROM logs WHERE {matches(t.indices)})",
        spine(t, n),
        side("cur", 0), side("base", t.baseline_offset),
        f"""win_{n} AS (SELECT {q(n)} AS target, c.*, b.total AS base_total, b.err AS base_err,
          b.warn AS base_warn, b.fatal AS base_fatal FROM cur_{n} c JOIN base_{n} b USING (w_end))""",
    ]


def templates(t: Target) -> list[str]:
    n = t.name
    levels = listed([*t.error_levels, *t.warn_levels])
    shown = scrub("message") if t.scrub_pii else "message"
    ignored = " OR ".join(f"contains(lower(message), {q(p.lower())})" for p in t.warn_spike_ignore)

    def side(shift: int, is_base: bool) -> str:
        return f"""SELECT s.w_end, {is_base} AS is_base, l.message, count(*) AS n
          FROM spine_{n} s JOIN rows_{n} l ON l.level IN {levels}
          AND l.ts >= s.w_end - {seconds(shift + t.window)} AND l.ts < s.w_end - {seconds(shift)}
          GROUP BY ALL"""

    return [
        f"raw_{n} AS ({side(0, False)} UNION ALL {side(t.baseline_offset, True)})",
        f"""top_{n} AS (SELECT *, row_number() OVER (PARTITION BY w_end, is_base
          ORDER BY n DESC, message) AS rank FROM raw_{n} {f"QUALIFY rank <= {t.template_limit}" if t.template_limit else ""})""",
        f"""clean_{n} AS (SELECT w_end, is_base, {shown} AS message, CAST(sum(n) AS BIGINT) AS n,
          min(rank) AS rank FROM top_{n} GROUP BY ALL)""",
        f"tpl_{n} AS (SELECT *, ({ignored or 'FALSE'}) AS ignored FROM clean_{n})",
        f"""ign_{n} AS (SELECT w_end,
          coalesce(sum(n) FILTER (ignored AND NOT is_base), 0)::BIGINT AS ignored,
          coalesce(sum(n) FILTER (ignored AND is_base), 0)::BIGINT AS base_ignored,
          count(*) FILTER (NOT is_base) AS n_templates FROM tpl_{n} GROUP BY w_end)""",
        f"""fp_{n} AS (SELECT w_end, {fingerprint('message')} AS fp,
          bool_or(NOT is_base AND NOT ignored) AS in_current,
          bool_or(is_base AND NOT ignored) AS in_baseline, bool_or(NOT is_base) AS seen
          FROM tpl_{n} GROUP BY ALL)""",
    ]


def signal(t: Target, kind: str, source: str, condition: str, *, cur: str, base: str = "NULL",
           threshold: str = "NULL", entity: str = "NULL", extra: str = "NULL",
           detail: str | None = None, **values) -> str:
    detail = detail or fill(fv.DETAIL[kind], cur=cur, base=base, entity=entity, **values)
    return f"""SELECT {q(t.name)} AS target, w_end, {q(kind)} AS kind,
      {q(fv.SEVERITY[kind])} AS severity, CAST({entity} AS VARCHAR) AS entity,
      CAST({cur} AS BIGINT) AS cur, CAST({base} AS BIGINT) AS base,
      CAST({threshold} AS DOUBLE) AS threshold, CAST({extra} AS VARCHAR) AS extra,
      {detail} AS detail FROM {source} WHERE {condition}"""


def hours(t: Target) -> str:
    return q(f"{t.window_hours:g}")


def gate_parts(t: Target, kinds=("error_spike", "warn_spike", "fatal", "ingestion_stopped")):
    n = t.name
    ctes = windows(t) + templates(t)
    loud = f"""(SELECT w.*, coalesce(i.ignored, 0) AS ignored,
      greatest(0, warn - coalesce(i.ignored, 0)) AS loud,
      greatest(0, base_warn - coalesce(i.base_ignored, 0)) AS base_loud
      FROM win_{n} w LEFT JOIN ign_{n} i USING (w_end))"""
    warn_text = (fill(fv.DETAIL["warn_spike"], cur="loud", base="base_loud",
                      factor=q(str(t.warn_spike_factor)))
                 + " || CASE WHEN ignored > 0 THEN "
                 + fill(fv.DETAIL["warn_spike_ignored"], ignored="ignored") + " ELSE '' END")
    parts = {
        "error_spike": signal(
            t, "error_spike", f"win_{n}",
            f"err >= {t.min_errors} AND err >= base_err * CAST({t.error_spike_factor} AS DOUBLE)",
            cur="err", base="base_err", threshold=str(t.error_spike_factor),
            factor=q(str(t.error_spike_factor))),
        "warn_spike": signal(
            t, "warn_spike", loud,
            f"loud >= {t.min_warnings} AND loud >= base_loud * CAST({t.warn_spike_factor} AS DOUBLE)",
            cur="loud", base="base_loud", threshold=str(t.warn_spike_factor), extra="ignored",
            detail=warn_text),
        "fatal": signal(t, "fatal", f"win_{n}", "fatal > 0", cur="fatal"),
        "ingestion_stopped": signal(
            t, "ingestion_stopped", f"win_{n}", f"base_total >= {t.min_errors} AND total = 0",
            cur="total", base="base_total", threshold=str(t.min_errors)),
    }
    return ctes, [parts[k] for k in kinds]


def new_error_parts(t: Target, live: bool = False):
    n = t.name
    known = ""
    if live:
        known = f"""AND NOT EXISTS (SELECT 1 FROM fp_{n} e WHERE e.fp = f.fp AND e.seen
          AND e.w_end < f.w_end AND e.w_end >= f.w_end - {seconds(fv.SEEN_RETENTION)})"""
    source = f"""(SELECT w_end, count(*) AS new, list(fp ORDER BY fp)[1:5] AS shown FROM fp_{n} f
      WHERE in_current AND NOT in_baseline {known} GROUP BY w_end)"""
    return [], [signal(t, "new_errors", source, "TRUE", cur="new",
                       extra="array_to_string(shown, ';')",
                       shown="array_to_string(shown, '; ')")]


def silent_parts(t: Target):
    n, s = t.name, t.silence_window
    ctes = [f"""fam_{n} AS (SELECT s.w_end, {family('l.index_name')} AS family,
        count(*) FILTER (l.ts >= s.w_end - {seconds(s)}) AS cur,
        count(*) FILTER (l.ts < s.w_end - {seconds(s)}) AS base
        FROM spine_{n} s JOIN rows_{n} l ON l.ts >= s.w_end - {seconds(2 * s)} AND l.ts < s.w_end
        GROUP BY ALL)"""]
    source = f"(SELECT *, sum(cur) OVER (PARTITION BY w_end) AS alive FROM fam_{n})"
    return ctes, [signal(t, "index_silent", source,
                         f"alive > 0 AND cur = 0 AND base >= {t.min_errors}", cur="cur",
                         base="base", threshold=str(t.min_errors), entity="family",
                         hours=q(f"{t.index_silent_window_hours:g}"))]


def heartbeat_parts(t: Target):
    n = t.name
    parts = []
    for service, index, text in t.heartbeats:
        source = f"""(SELECT s.w_end, count(l.ts) AS hits FROM spine_{n} s LEFT JOIN
          (SELECT ts FROM logs WHERE {matches([index])} AND {phrase(WORDS, [text])}) l
          ON l.ts >= s.w_end - {seconds(t.staleness)} AND l.ts < s.w_end GROUP BY s.w_end)"""
        parts.append(signal(t, "heartbeat_missing", source, "hits = 0", cur="hits",
                            entity=q(service), minutes=q(f"{t.heartbeat_max_staleness_minutes:g}")))
    return [], parts


def access_ctes(t: Target) -> list[str]:
    n = t.name
    tokens = " OR ".join(f"contains(lower(path), {q(p.lower())})" for p in t.path_tokens)
    return [
        f"""req_{n} AS (SELECT s.w_end, l.* FROM spine_{n} s JOIN rows_{n} l
          ON l.ts >= s.w_end - {seconds(t.window)} AND l.ts < s.w_end WHERE l.status IS NOT NULL)""",
        f"""ip_{n} AS (SELECT w_end, source_ip, count(*) AS total,
          count(*) FILTER (status >= 400 AND status < 500) AS c4xx,
          count(*) FILTER (status IN (401, 403)) AS auth_fail,
          count(*) FILTER (status IN (401, 403) AND starts_with(lower(path),
            {q(t.security_auth_path_prefix.lower())})) AS scoped_fail,
          count(DISTINCT path) AS distinct_paths
          FROM req_{n} WHERE source_ip IS NOT NULL GROUP BY w_end, source_ip)""",
        f"bad_{n} AS (SELECT * FROM req_{n} WHERE status >= 400 AND ({tokens}))",
        f"""badlist_{n} AS (SELECT w_end, what, list(key ORDER BY n DESC, key)[1:5] AS keys FROM (
          SELECT w_end, 'path' AS what, path AS key, count(*) AS n FROM bad_{n} GROUP BY ALL
          UNION ALL SELECT w_end, 'ip', source_ip, count(*) FROM bad_{n} GROUP BY ALL)
          WHERE key IS NOT NULL GROUP BY ALL)""",
    ]


def suspicious_part(t: Target) -> str:
    n = t.name
    source = f"""(SELECT w_end, count(*) AS cnt,
      (SELECT array_to_string(keys, '; ') FROM badlist_{n} x WHERE x.w_end = b.w_end
        AND what = 'path') AS paths,
      (SELECT array_to_string(keys, ', ') FROM badlist_{n} x WHERE x.w_end = b.w_end
        AND what = 'ip') AS ips FROM bad_{n} b GROUP BY w_end)"""
    return signal(t, "suspicious_requests", source, f"cnt >= {t.security_min_suspicious}",
                  cur="cnt", threshold=str(t.security_min_suspicious), hours=hours(t),
                  paths="coalesce(paths, '—')", ips="coalesce(ips, 'unbekannt')")


def client_parts(t: Target) -> dict[str, str]:
    scope = q(f" auf {t.security_auth_path_prefix}*")
    return {
        "api_scan": signal(
            t, "api_scan", f"ip_{t.name}", f"c4xx >= {t.security_scan_min_4xx}"
            f" AND distinct_paths >= {t.security_scan_min_paths}", cur="c4xx",
            threshold=str(t.security_scan_min_4xx), entity="source_ip", extra="distinct_paths",
            paths="distinct_paths", hours=hours(t)),
        "auth_bruteforce": signal(
            t, "auth_bruteforce", f"ip_{t.name}",
            f"scoped_fail >= {t.security_auth_fail_threshold}", cur="scoped_fail",
            threshold=str(t.security_auth_fail_threshold), entity="source_ip", scope=scope,
            hours=hours(t)),
    }


def host_ctes(t: Target) -> list[str]:
    n = t.name
    hits = ", ".join(f"count(*) FILTER (NOT prior AND {phrase('words', p)}) AS {name}"
                     for name, p in HOST_PHRASES.items())
    return [f"""host_{n} AS (SELECT w_end, host, count(*) FILTER (NOT prior) AS total,
        count(*) FILTER (prior) AS base_total, {hits} FROM (
          SELECT s.w_end, l.host, l.ts < s.w_end - {seconds(t.window)} AS prior, {WORDS} AS words
          FROM spine_{n} s JOIN logs l ON l.ts >= s.w_end - {seconds(2 * t.window)}
          AND l.ts < s.w_end WHERE {matches(t.linux_indices)} AND host IS NOT NULL)
        GROUP BY ALL)"""]


def host_parts(t: Target) -> dict[str, str]:
    limits = {"linux_ssh_bruteforce": ("ssh_fail", t.linux_ssh_fail_threshold),
              "linux_oom": ("oom", t.linux_oom_threshold),
              "linux_disk_errors": ("disk", t.linux_disk_error_threshold),
              "linux_unit_failures": ("unit_fail", t.linux_unit_fail_threshold)}
    parts = {kind: signal(t, kind, f"host_{t.name}", f"{m} >= {limit}", cur=m,
                          threshold=str(limit), entity="host", hours=hours(t))
             for kind, (m, limit) in limits.items()}
    parts["linux_host_silent"] = signal(
        t, "linux_host_silent", f"host_{t.name}",
        f"base_total >= {t.linux_host_silent_min_baseline} AND total = 0", cur="total",
        base="base_total", threshold=str(t.linux_host_silent_min_baseline), entity="host",
        hours=hours(t))
    return parts


def all_parts(targets, heartbeats: bool):
    ctes, parts = [LOGS], []
    for t in targets:
        c, p = gate_parts(t)
        ctes, parts = ctes + c, parts + p
        if t.alert_on_new_signatures:
            parts += new_error_parts(t)[1]
        c, p = silent_parts(t)
        ctes, parts = ctes + c, parts + p
        if heartbeats:
            parts += heartbeat_parts(t)[1]
        if t.security_check:
            ctes += access_ctes(t)
            parts += [suspicious_part(t), *client_parts(t).values()]
        if t.linux_check and t.linux_indices:
            ctes += host_ctes(t)
            parts += host_parts(t).values()
    return ctes, parts


def statement(ctes, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def materialized(ctes, parts) -> list[str]:
    return [*ctes, f"sig AS MATERIALIZED ({union(parts)})"]


MAIN, CALM = cfg.MAIN[0], cfg.CALM[0]
RANK = "CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
KIND_ORDER = listed(fv.SEVERITY).replace("(", "[").replace(")", "]")
INCIDENTS = f"""inc AS MATERIALIZED (SELECT target, w_end,
  substr(sha256(array_to_string(list(part ORDER BY part), '|')), 1, 16) AS signature,
  arg_max(severity, {RANK}) AS rule_severity, bool_or(forced) AS forced,
  array_to_string(list(kind || ':' || severity || ':' || shown ORDER BY pos, shown), '|') AS signals,
  list(DISTINCT kind) AS kinds,
  array_to_string(list(kind ORDER BY pos, shown), ',') AS kind_list
  FROM (SELECT *, kind || ':' || {masked('detail')} AS part, {scrub('detail')} AS shown,
    kind IN {listed(fv.FORCED_KINDS)} AS forced,
    list_position({KIND_ORDER}, kind) AS pos FROM sig) GROUP BY target, w_end)"""


def cooled(delivered: str) -> list[str]:
    """The greedy walk along each signature's windows."""
    pause = seconds(CALM.cooldown)
    return [
        f"""seq AS (SELECT *, {delivered} AS delivered, row_number() OVER (
          PARTITION BY target, signature ORDER BY w_end) AS rn FROM inc)""",
        f"""walk AS (SELECT target, signature, w_end, rn, delivered, TRUE AS alerted,
            CASE WHEN delivered THEN w_end END AS last FROM seq WHERE rn = 1
          UNION ALL
          SELECT s.target, s.signature, s.w_end, s.rn, s.delivered,
            coalesce(s.w_end - w.last >= {pause}, TRUE),
            CASE WHEN coalesce(s.w_end - w.last >= {pause}, TRUE) AND s.delivered THEN s.w_end
                 ELSE w.last END
          FROM walk w JOIN seq s ON s.target = w.target AND s.signature = w.signature
            AND s.rn = w.rn + 1)""",
    ]


def calm(select: str, *more: str, delivered: str = "TRUE") -> str:
    ctes = [*materialized(*all_parts(cfg.CALM, False)), INCIDENTS, *cooled(delivered),
            """alerts AS MATERIALIZED (SELECT i.*, CASE WHEN i.forced THEN 'high'
               ELSE i.rule_severity END AS severity
               FROM inc i JOIN walk w USING (target, signature, w_end) WHERE w.alerted)"""]
    return statement([*ctes, *more], select, recursive=True)


def multi(select: str) -> str:
    return statement([*materialized(*all_parts(cfg.MULTI, False)), INCIDENTS], select)


def main_windows(select: str, *more) -> str:
    return statement([LOGS, *windows(MAIN), *templates(MAIN), *more], select)


ORACLES: dict[str, str] = {}

# ---- sources ---------------------------------------------------------------------------------
ORACLES["scan_window"] = statement([LOGS], f"""
SELECT event_id, ts, index_name, level, message FROM logs
WHERE ts >= TIMESTAMP '2024-01-09 18:00:00' AND ts < TIMESTAMP '2024-01-11 06:30:00'
  AND (service = 'web' OR index_name = 'api-logs-2024.01')""")
ORACLES["error_samples"] = statement([LOGS, *windows(MAIN)], f"""
SELECT 'main' AS target, w_end, rank, ts, event_id, substr(message, 1, 300) AS sample FROM (
  SELECT s.w_end, l.*, row_number() OVER (PARTITION BY s.w_end ORDER BY ts DESC, event_id DESC) AS rank
  FROM spine_main s JOIN rows_main l ON l.ts >= s.w_end - {seconds(MAIN.window)} AND l.ts < s.w_end
  WHERE level IN ('Error', 'Fatal'))
WHERE rank <= 5 AND message <> ''""")
ORACLES["field_coverage"] = statement([ALL_LOGS], union([
    f"""SELECT '{name}' AS field, count(*) AS n_rows, count({source}) AS n_filled,
        count(DISTINCT {source}) AS n_distinct FROM logs"""
    for name, source in [
        ("level", "level"), ("index_name", "index_name"), ("host", "host"), ("service", "service"),
        ("status_code", "status"), ("source_ip", "source_ip"),
        ("logger", "CAST(NULL AS VARCHAR)"), ("message_template", "message")]]))

# ---- text ------------------------------------------------------------------------------------
ORACLES["fingerprint_rollup"] = statement([ALL_LOGS], f"""
SELECT {fingerprint('message')} AS fp, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at,
  min(message) AS example FROM logs GROUP BY 1""")
ORACLES["scrub_table"] = f"""
SELECT doc_id, lang, source, {scrub('text')} AS text FROM documents"""
ORACLES["scrub_pages"] = f"""
SELECT page_id, {scrub('url')} AS url, {scrub('html')} AS html FROM pages"""
_CENSUS = """count(*) AS n_rows,
  count(*) FILTER (regexp_matches(text, '\\beyJ[A-Za-z0-9._\\-]{10,}\\b')) AS jwt,
  count(*) FILTER (regexp_matches(text, '(?i)\\bbearer\\s+[A-Za-z0-9._\\-]+')) AS bearer,
  count(*) FILTER (regexp_matches(text, '://[^/\\s:@]+:[^@/\\s]+@')) AS url_password,
  count(*) FILTER (regexp_matches(text, '\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]+\\b')) AS email,
  count(*) FILTER (regexp_matches(text, '\\b\\d{1,3}(?:\\.\\d{1,3}){3}\\b')) AS ipv4,
  count(*) FILTER (regexp_matches(text, '\\b[A-Za-z0-9_\\-]{32,}\\b')) AS long_token"""
_CENSUS += f""",
  count(*) FILTER (regexp_matches(text, {q(IPV6)})) AS ipv6"""
ORACLES["pii_census"] = f"SELECT source, {_CENSUS} FROM documents GROUP BY source"
ORACLES["pii_census_conversations"] = f"SELECT role, {_CENSUS} FROM conversations GROUP BY role"
ORACLES["scrubbed_messages"] = statement([ALL_LOGS], f"""
SELECT {scrub('message')} AS message, count(*) AS n FROM logs GROUP BY 1""")
ORACLES["phrase_counts"] = statement([ALL_LOGS], "SELECT * FROM (" + union([
    f"""SELECT {q(p)} AS phrase, count(*) AS n FROM logs
        WHERE {phrase(WORDS, [p])}"""
    for group in HOST_PHRASES.values() for p in group]) + ") WHERE n > 0")

# ---- counts ----------------------------------------------------------------------------------
ORACLES["window_totals"] = main_windows(
    "SELECT target, w_end, total, err, warn, fatal FROM win_main")
ORACLES["level_counts"] = main_windows(f"""
SELECT s.target, s.w_end, l.level, count(*) AS n FROM spine_main s JOIN rows_main l
ON l.ts >= s.w_end - {seconds(MAIN.window)} AND l.ts < s.w_end GROUP BY ALL""")
ORACLES["level_compare"] = statement(
    [LOGS, *[c for t in cfg.MULTI for c in windows(t)]],
    union([f"""SELECT coalesce(c.target, b.target) AS target, coalesce(c.w_end, b.w_end) AS w_end,
      coalesce(c.level, b.level) AS level, coalesce(c.n, 0) AS cur, coalesce(b.n, 0) AS base FROM
      (SELECT s.target, s.w_end, l.level, count(*) AS n FROM spine_{t.name} s JOIN rows_{t.name} l
        ON l.ts >= s.w_end - {seconds(t.window)} AND l.ts < s.w_end GROUP BY ALL) c
      FULL JOIN
      (SELECT s.target, s.w_end, l.level, count(*) AS n FROM spine_{t.name} s JOIN rows_{t.name} l
        ON l.ts >= s.w_end - {seconds(t.window + t.baseline_offset)}
        AND l.ts < s.w_end - {seconds(t.baseline_offset)} GROUP BY ALL) b
      ON c.w_end = b.w_end AND c.level = b.level""" for t in cfg.MULTI]))
ORACLES["index_family_counts"] = main_windows(f"""
SELECT s.target, s.w_end, {family('l.index_name')} AS family, count(*) AS n
FROM spine_main s JOIN rows_main l ON l.ts >= s.w_end - {seconds(MAIN.window)} AND l.ts < s.w_end
GROUP BY ALL""")
ORACLES["top_messages"] = main_windows(
    "SELECT 'main' AS target, w_end, message, n, rank FROM top_main WHERE NOT is_base AND rank <= 15")
ORACLES["access_by_ip"] = main_windows("""SELECT 'main' AS target, w_end, source_ip, total, c4xx,
  auth_fail, scoped_fail, distinct_paths FROM ip_main""", *access_ctes(MAIN))
ORACLES["host_counts"] = main_windows("""SELECT 'main' AS target, w_end, host, total, base_total,
  ssh_fail, oom, disk, unit_fail FROM host_main""", *host_ctes(MAIN))
ORACLES["baseline_compare"] = statement(
    [LOGS, *[c for t in cfg.MODES for c in windows(t)]],
    union([f"""SELECT target AS mode, w_end, total, base_total, err, base_err
               FROM win_{t.name}""" for t in cfg.MODES]))

# ---- detectors -------------------------------------------------------------------------------
for _kind in ("error_spike", "warn_spike", "fatal", "ingestion_stopped"):
    _ctes, _parts = gate_parts(MAIN, (_kind,))
    ORACLES[_kind] = statement([LOGS, *_ctes], union(_parts))
ORACLES["ignore_degraded"] = statement([LOGS, *windows(cfg.LISTED[0]), *templates(cfg.LISTED[0])], """
SELECT * FROM (SELECT w.target, w.w_end, w.warn, coalesce(i.n_templates, 0) AS n_templates,
  CASE WHEN coalesce(i.n_templates, 0) = 0 THEN 'no templates'
       WHEN i.n_templates >= 15 THEN 'template list full' END AS reason
  FROM win_main w LEFT JOIN ign_main i USING (w_end) WHERE w.warn > 0)
WHERE reason IS NOT NULL""")
ORACLES["new_errors"] = main_windows(union(new_error_parts(MAIN)[1]))
ORACLES["new_errors_live"] = main_windows(union(new_error_parts(MAIN, live=True)[1]))
ORACLES["live_cycle"] = ORACLES["new_errors_live"]
ORACLES["index_silent"] = main_windows(union(silent_parts(MAIN)[1]), *silent_parts(MAIN)[0])
ORACLES["heartbeat_missing"] = main_windows(union(heartbeat_parts(MAIN)[1]))
ORACLES["suspicious_requests"] = main_windows(suspicious_part(MAIN), *access_ctes(MAIN))
for _kind, _part in client_parts(MAIN).items():
    ORACLES[_kind] = main_windows(_part, *access_ctes(MAIN))
for _kind, _part in host_parts(MAIN).items():
    ORACLES["host_" + {"linux_ssh_bruteforce": "ssh_bruteforce", "linux_oom": "oom",
                       "linux_disk_errors": "disk_errors",
                       "linux_unit_failures": "unit_failures",
                       "linux_host_silent": "silent"}[_kind]] = main_windows(_part,
                                                                             *host_ctes(MAIN))
_ctes, _parts = all_parts(cfg.MAIN, True)
ORACLES["all_signals"] = statement(_ctes, union(_parts))
_ctes, _parts = all_parts(cfg.MULTI, False)
ORACLES["replay_signals"] = statement(_ctes, union(_parts))
_gates = [gate_parts(t) for t in cfg.MULTI]
ORACLES["multi_target_gate"] = statement([LOGS, *[c for ctes, _ in _gates for c in ctes]],
                                         union([p for _, parts in _gates for p in parts]))

# the same rules for each target; one of them reads other columns as level and text
EDGE_LOGS = """edge_logs AS (SELECT * REPLACE (CASE WHEN status >= 500 OR status IN (401, 403) THEN 'Error'
  WHEN status >= 400 THEN 'Warning' END AS level, coalesce(path, message) AS message) FROM logs)"""
_named = [(t, gate_parts(t, ("error_spike", "warn_spike", "fatal")), new_error_parts(t)) for t in cfg.NAMED]
ORACLES["fields_per_target"] = statement(
    [LOGS, EDGE_LOGS, *dict.fromkeys(
        c.replace("FROM logs WHERE", "FROM edge_logs WHERE") if t.name == "edge" else c
        for t, gates, news in _named for c in [*gates[0], *news[0]])],
    union([p for _, gates, news in _named for p in [*gates[1], *news[1]]]))

# ---- incidents -------------------------------------------------------------------------------
ORACLES["overall_severity"] = multi(f"""
SELECT target, w_end, arg_max(severity, {RANK}) AS severity, count(*) AS n_signals
FROM sig GROUP BY target, w_end""")
ORACLES["signature_of_signals"] = multi("SELECT target, w_end, signature FROM inc")
ORACLES["rule_verdict"] = multi(f"""
SELECT target, w_end, forced, TRUE AS anomalous,
  CASE WHEN forced THEN 'high' ELSE rule_severity END AS severity,
  {q(fv.RULE_SUMMARY)} AS summary, {q(fv.RULE_CAUSE)} AS suspected_cause,
  {q(fv.RULE_ACTION)} AS recommended_action, FALSE AS external_verdict FROM inc""")
ORACLES["cooldown_dedupe"] = calm(
    "SELECT target, w_end, signature, delivered, alerted FROM walk",
    delivered="extract(hour FROM w_end) <> 12")
ORACLES["live_cooldown"] = ORACLES["cooldown_dedupe"]
ORACLES["daily_quota"] = calm(f"""
SELECT target, w_end, CAST(w_end AS DATE) AS day, nth, nth <= {cfg.QUOTA} AS within_budget,
  greatest(0, {cfg.QUOTA} - nth) AS remaining FROM (
  SELECT *, row_number() OVER (PARTITION BY CAST(w_end AS DATE) ORDER BY w_end, target) AS nth
  FROM alerts)""")
ORACLES["budgeted_verdicts"] = calm(f"""
SELECT target, w_end, signature, CASE WHEN forced THEN 'high' WHEN nth <= {cfg.QUOTA} THEN 'low' ELSE rule_severity END AS severity,
  CASE WHEN nth <= {cfg.QUOTA} THEN 'seen' ELSE {q(fv.RULE_SUMMARY)} END AS summary, nth <= {cfg.QUOTA} AS external_verdict FROM (
  SELECT *, row_number() OVER (PARTITION BY CAST(w_end AS DATE) ORDER BY w_end, target) AS nth FROM alerts)""")
ORACLES["verdict_asof"] = calm(f"""
SELECT i.target, i.w_end, i.signature, v.w_end AS verdict_ts,
  CASE WHEN v.w_end IS NULL THEN NULL WHEN extract(hour FROM v.w_end) = 0 THEN 'low'
       ELSE 'high' END AS ext_severity
FROM inc i LEFT JOIN inc v ON v.target = i.target AND v.signature = i.signature
  AND v.w_end <= i.w_end AND i.w_end - v.w_end < {seconds(43200)}
  AND extract(hour FROM v.w_end) % 12 = 0
QUALIFY row_number() OVER (PARTITION BY i.target, i.w_end ORDER BY v.w_end DESC NULLS LAST) = 1""")


def _level_text(shift: int) -> str:
    return f"""(SELECT string_agg(level || '=' || n, ',' ORDER BY level) FROM (
      SELECT level, count(*) AS n FROM rows_calm l WHERE l.ts < a.w_end - {seconds(shift)}
      AND l.ts >= a.w_end - {seconds(shift + CALM.window)} GROUP BY level))"""


ORACLES["alert_documents"] = calm(f"""
SELECT a.w_end AS ts, a.target, a.severity, {q(fv.RULE_SUMMARY)} AS summary, a.forced,
  a.signature, CAST(6 AS DOUBLE) AS window_hours,
  {q(','.join(CALM.indices))} AS monitored_indices, a.signals, w.total,
  coalesce({_level_text(0)}, '') AS levels,
  coalesce((SELECT string_agg(message || '=' || n, '|' ORDER BY n DESC, message) FROM (
    SELECT * FROM tpl_calm x WHERE x.w_end = a.w_end AND NOT is_base ORDER BY n DESC, message LIMIT 10)), '')
    AS top_error_messages,
  w.base_total, coalesce({_level_text(CALM.baseline_offset)}, '') AS base_levels,
  'alerts-' || strftime(a.w_end, '%Y.%m') AS alert_index, strftime(a.w_end, '%Y.%m') AS month
FROM alerts a JOIN win_calm w USING (w_end)""")
ORACLES["run_counters"] = calm("""
SELECT 'cycles_total' AS counter, '' AS label, count(*) AS value FROM spine_calm
UNION ALL SELECT CASE WHEN alerted THEN 'alerts_total' ELSE 'suppressed_total' END, '', count(*)
FROM walk GROUP BY 1
UNION ALL SELECT 'signals_total', kind, count(*) FROM sig GROUP BY kind""")

# ---- history ---------------------------------------------------------------------------------
ORACLES["first_seen"] = main_windows(f"""
SELECT 'main' AS target, w_end, fp FROM fp_main f WHERE seen AND NOT EXISTS (
  SELECT 1 FROM fp_main e WHERE e.seen AND e.fp = f.fp AND e.w_end < f.w_end
  AND e.w_end >= f.w_end - {seconds(fv.SEEN_RETENTION)})""")
ORACLES["retain_history"] = calm("""
SELECT 'alerts' AS history, target, w_end, signature FROM alerts WHERE w_end >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY
UNION ALL SELECT 'verdicts', target, w_end, signature FROM inc
WHERE extract(hour FROM w_end) % 12 = 0 AND w_end >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY
UNION ALL SELECT 'fingerprints', 'calm', max(w_end), fp FROM fp_calm WHERE seen GROUP BY fp
HAVING max(w_end) >= TIMESTAMP '2024-01-31' - INTERVAL 180 DAY""")
ORACLES["alert_append"] = calm("""
SELECT w_end AS ts, target, severity, signature, CAST(len(string_split(kind_list, ',')) AS INTEGER) AS n_signals,
  strftime(w_end, '%Y.%m') AS month FROM alerts""")
ORACLES["digest"] = calm(f"""
SELECT d.target, d.day AS w_end, d.total, d.err, d.warn, d.alerts,
  CASE WHEN d.alerts = 0 THEN {q(fv.DIGEST_QUIET)} ELSE replace({q(fv.DIGEST_ALERTS)}, '{{n}}', d.alerts::VARCHAR) END AS headline,
  m.top_errors FROM (
  SELECT 'calm' AS target, g.day, count(l.ts) AS total,
    count(*) FILTER (level IN ('Error', 'Fatal')) AS err,
    count(*) FILTER (level = 'Warning') AS warn,
    (SELECT count(*) FROM alerts a WHERE a.w_end >= g.day - INTERVAL 1 DAY AND a.w_end < g.day)
      AS alerts
  FROM (SELECT r AS day FROM range(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-31 00:00:01',
    INTERVAL 1 DAY) t(r)) g LEFT JOIN rows_calm l ON l.ts >= g.day - INTERVAL 1 DAY
    AND l.ts < g.day GROUP BY g.day) d
LEFT JOIN (SELECT day, string_agg({scrub('message')} || '=' || n, '|' ORDER BY n DESC, message)
    AS top_errors FROM (
  SELECT * FROM (SELECT date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS day, message,
    count(*) AS n FROM rows_calm WHERE level IN ('Error', 'Fatal', 'Warning') GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, message) <= 5) GROUP BY day) m
USING (day)""")
ORACLES["digest_due"] = calm("""
SELECT w_end, (SELECT count(*) FROM alerts a WHERE a.w_end >= d.w_end - INTERVAL 2 DAY AND a.w_end < d.w_end) AS alerts
FROM (SELECT min(r) AS w_end, date_diff('day', min(min(r)) OVER (), min(r)) AS nr
  FROM range(TIMESTAMP '2024-01-01 06:00:00', TIMESTAMP '2024-01-31 00:00:01', INTERVAL 6 HOUR) t(r)
  WHERE hour(r) >= 7 GROUP BY r::DATE) d WHERE nr % 2 = 0""")
ORACLES["history_report"] = calm("""
SELECT date_trunc('day', w_end)::TIMESTAMP AS day, severity, count(*) AS alerts FROM alerts
WHERE w_end >= TIMESTAMP '2024-01-08 06:00:00' AND w_end < TIMESTAMP '2024-01-21 12:00:00' GROUP BY ALL""")
ORACLES["run_counters_assessed"] = calm("""
SELECT 'cycles_total' AS counter, '' AS label, count(*) AS value FROM spine_calm
UNION ALL SELECT 'alerts_total', '', count(*) FROM alerts WHERE forced OR hour(w_end) <> 0
UNION ALL SELECT 'suppressed_total', '', count(*) FROM walk WHERE NOT alerted
UNION ALL SELECT 'signals_total', kind, count(*) FROM sig GROUP BY kind""")
ORACLES["quiet_days"] = calm("""
SELECT day AS w_end FROM (SELECT r AS day FROM range(TIMESTAMP '2024-01-02',
  TIMESTAMP '2024-01-31 00:00:01', INTERVAL 1 DAY) t(r)) d WHERE NOT EXISTS (
  SELECT 1 FROM alerts a WHERE a.w_end >= d.day - INTERVAL 24 HOUR AND a.w_end <= d.day)""")
ORACLES["alerts_over_time"] = calm("""
SELECT date_trunc('day', w_end)::TIMESTAMP AS day, severity, count(*) AS alerts FROM alerts
GROUP BY ALL""")
ORACLES["alerts_by_severity"] = calm("""
SELECT severity, count(*) AS alerts FROM alerts GROUP BY severity
ORDER BY alerts DESC, severity LIMIT 5""")
ORACLES["top_signal_kinds"] = calm("""
SELECT kind, count(*) AS alerts FROM (SELECT unnest(kinds) AS kind FROM alerts) GROUP BY kind
ORDER BY alerts DESC, kind LIMIT 10""")
ORACLES["recent_alerts"] = calm(f"""
SELECT w_end AS ts, target, severity, {q(fv.RULE_SUMMARY)} AS summary, kind_list AS kinds,
  TRUE AS delivered, FALSE AS external_verdict FROM alerts ORDER BY w_end DESC LIMIT 25""")

# ---- normalisation ---------------------------------------------------------------------------
# The fields of each raw document, then the ingest rules over them.
_RAW = r"""
raw AS (SELECT event_id, ts, event_type AS kind, user_id AS uid,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
parts AS (SELECT *,
    CASE kind WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Warning' END AS lvl,
    CASE kind WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 401 ELSE 404 END
              WHEN 'view' THEN 200 END AS status,
    CASE WHEN k % 20 = 0 THEN '/healthz' ELSE '/item/' || k END AS pth,
    CASE k % 10 WHEN 0 THEN 'Microsoft.Hosting.Lifetime'
                WHEN 1 THEN 'Microsoft.EntityFrameworkCore.Database'
                WHEN 2 THEN 'Microsoft.EntityFrameworkCore.Migrations' END AS lgr,
    CASE WHEN kind = 'view' AND k % 10 = 0 THEN 'Heartbeat: api'
         WHEN kind = 'error' AND k % 10 = 3 THEN 'Unauthorized call' ELSE 'ok ' || kind END AS message,
    event_id % 11 <> 0 AS has_labels, event_id % 6 = 0 OR event_id % 2 = 1 AS has_fields,
    event_id % 13 = 0 AS has_metadata FROM raw),
doc AS (SELECT *,
    CASE WHEN event_id % 3 = 0 THEN lvl END AS old_level,
    CASE WHEN event_id % 3 = 1 OR event_id % 27 = 0 THEN lvl END AS new_level,
    CASE WHEN has_labels AND event_id % 4 = 0 THEN 'u' || uid END AS l_username,
    CASE WHEN has_labels AND event_id % 8 = 0 THEN 'n' || uid END AS l_user_name,
    CASE WHEN has_labels AND event_id % 5 = 0 THEN CAST(uid AS VARCHAR) END AS l_user_id,
    CASE WHEN has_labels AND event_id % 3 = 0 THEN 'shop' END AS l_app,
    CASE WHEN has_labels AND event_id % 3 = 1 THEN 'prod' END AS l_env,
    CASE WHEN has_labels AND event_id % 7 = 0 THEN ['import', 'k' || k % 3] ELSE [] END AS l_tags,
    CASE WHEN has_metadata THEN ['crawl', 'daily'] ELSE [] END AS m_tags,
    CASE WHEN has_fields AND event_id % 16 = 0 THEN 'f' || uid END AS f_user_name,
    CASE WHEN has_fields AND event_id % 10 = 0 THEN 'i' || uid END AS f_user_id,
    CASE WHEN has_fields AND event_id % 2 = 0 THEN lgr END AS logger,
    CASE WHEN has_fields AND event_id % 2 = 0 THEN 'vm' || uid % 6 END AS host,
    CASE WHEN has_fields AND event_id % 6 IN (3, 5) THEN 'batch' END AS f_app,
    CASE WHEN event_id % 4 = 1 THEN pth WHEN event_id % 4 = 0 THEN pth END AS url_path,
    CASE WHEN event_id % 4 = 1 THEN 'GET' END AS http_method,
    CASE WHEN event_id % 4 IN (0, 1) THEN status END AS status_code,
    event_id % 4 = 0 AND status IS NOT NULL AS status_is_number,
    CASE WHEN event_id % 9 = 0 THEN 'own' END AS own_user,
    CASE WHEN event_id % 5 = 1 THEN ['daily'] END AS own_tags FROM parts),
judged AS (SELECT *, NOT (old_level IS NOT NULL AND new_level IS NOT NULL) AS done FROM doc),
folded AS (SELECT *, CASE WHEN own_tags IS NULL AND (has_labels OR has_metadata) THEN []
    ELSE own_tags END AS start FROM judged),
tagged AS (SELECT *,
    CASE WHEN start IS NOT NULL THEN list_concat(start, list_filter(list_concat(l_tags,
      list_filter(m_tags, lambda m: NOT list_contains(l_tags, m))),
      lambda x: NOT list_contains(start, x))) END AS f_tags,
    list_filter([
      CASE WHEN contains(message, 'Heartbeat:') THEN 'heartbeat' END,
      CASE WHEN url_path LIKE '%/healthz' THEN 'healthcheck' END,
      CASE WHEN status_code IS NOT NULL THEN 'request' END,
      CASE WHEN status_is_number AND status_code = 401 OR contains(message, 'Unauthorized')
           THEN 'auth' END,
      CASE WHEN logger LIKE '%Lifetime' OR logger LIKE '%Migrations' THEN 'startup' END,
      CASE WHEN logger LIKE '%Database' THEN 'db' END], lambda x: x IS NOT NULL) AS auto FROM folded),
norm AS (SELECT event_id, ts, message,
    CASE WHEN done THEN coalesce(new_level, old_level, 'Information') ELSE new_level END AS level,
    CASE WHEN done THEN coalesce(l_app, f_app, 'unknown') END AS service,
    CASE WHEN done THEN l_env END AS environment,
    CASE WHEN done THEN coalesce(f_user_name, l_user_name, l_username, own_user)
         ELSE own_user END AS user_name,
    CASE WHEN done THEN coalesce(f_user_id, l_user_id) END AS user_id,
    CASE WHEN done THEN logger END AS logger, CASE WHEN done THEN host END AS host,
    CASE WHEN done OR event_id % 4 = 0 THEN url_path END AS url_path,
    CASE WHEN done THEN http_method END AS http_method,
    CASE WHEN done OR event_id % 4 = 0 THEN status_code END AS status_code,
    status_is_number, done,
    CASE WHEN NOT done THEN own_tags WHEN len(auto) = 0 THEN f_tags
         ELSE list_concat(coalesce(f_tags, []), auto) END AS tags,
    l_app, l_env, l_username, l_user_name, l_user_id, has_labels, kind,
    CASE WHEN has_labels AND event_id % 7 = 0 THEN ' import, k' || k % 3 || ' ,,import' || chr(9)
      END AS raw_tags FROM tagged)"""


def normalized(select: str) -> str:
    return f"WITH {_RAW}\n{select}"


ORACLES["normalize_logs"] = normalized("""
SELECT event_id, ts, level, message, service, environment, user_name, user_id, logger, host,
  url_path, http_method, status_code, status_is_number, array_to_string(tags, ',') AS tags,
  array_to_string(list_sort(list_filter([
    'Application=' || l_app, 'Environment=' || l_env,
    CASE WHEN has_labels THEN 'kind=' || kind END,
    CASE WHEN NOT done THEN 'LogTags=' || raw_tags END,
    CASE WHEN NOT done THEN 'UserId=' || l_user_id END,
    CASE WHEN NOT done THEN 'UserName=' || l_user_name END,
    CASE WHEN NOT done THEN 'Username=' || l_username END,
    CASE WHEN done THEN 'schema_version=1' ELSE 'schema_error=field [log.level] already exists' END
  ], lambda x: x IS NOT NULL)), ',') AS labels FROM norm""")
ORACLES["backfill_logs"] = normalized("SELECT event_id, ts, level, service, user_name FROM norm")
ORACLES["normalize_errors"] = normalized("""
SELECT 'field [log.level] already exists' AS schema_error, count(*) AS n FROM norm WHERE NOT done""")
ORACLES["normalize_conflicts"] = """
SELECT CASE WHEN clash > 0 THEN 'field [' || ['log.level', 'log.logger', 'host.name', 'url.path',
    'http.request.method', 'http.response.status_code'][clash] || '] already exists' END AS schema_error,
  count(*) AS n, count(*) FILTER (WHERE clash <> 1) AS users, count(*) FILTER (WHERE clash <> 1) AS levels,
  count(*) FILTER (WHERE clash NOT IN (1, 2)) AS loggers, count(*) FILTER (WHERE clash NOT IN (1, 2, 3)) AS hosts,
  count(*) FILTER (WHERE clash NOT IN (1, 2, 3, 4)) AS url_paths, count(*) FILTER (WHERE clash NOT IN (1, 2, 3, 4, 5)) AS http_methods,
  count(*) FILTER (WHERE clash = 0) AS statuses, count(*) FILTER (WHERE clash IN (1, 2, 3)) AS kept_machines,
  CAST(sum(event_id % 3) AS BIGINT) AS cores
FROM (SELECT event_id, CAST(event_id % 7 AS INTEGER) AS clash FROM events) GROUP BY clash"""
ORACLES["normalize_rest"] = normalized("""
SELECT event_id, f_app AS application, CASE WHEN NOT done THEN old_level END AS old_level,
  CASE WHEN NOT done THEN host END AS machine, CASE WHEN NOT done THEN f_user_name END AS user,
  CASE WHEN NOT done AND has_metadata THEN 'crawl, daily' END AS metadata_tags,
  CASE WHEN NOT done THEN 'field [log.level] already exists' END AS schema_error FROM tagged""").replace(" AS user,", ' AS "user",')
_AUTO = listed(["heartbeat", "healthcheck", "request", "auth", "startup", "db"])
for _name, _test in (("fold_tags", "NOT IN"), ("derive_tags", "IN")):
    ORACLES[_name] = normalized(f"""
SELECT tag, count(*) AS n, min(event_id) AS first_event FROM (
  SELECT event_id, unnest(tags) AS tag FROM norm) WHERE tag {_test} {_AUTO} GROUP BY tag""")
ORACLES["logs_without_noise"] = normalized("""
SELECT event_id, ts, level, message FROM norm WHERE NOT coalesce(
  list_contains(tags, 'heartbeat') OR list_contains(tags, 'healthcheck'), FALSE)""")
ORACLES["fingerprint_documents"] = f"""
SELECT {fingerprint('text')} AS fp, count(*) AS n, min(doc_id) AS first_doc,
  max(doc_id) AS last_doc FROM documents WHERE text IS NOT NULL GROUP BY 1"""

# ---- streams: equal to the batch result, whole and in whatever order rows come -------------------
ORACLES["stream_normalize"] = normalized("""
SELECT event_id, ts, level, service, user_name, array_to_string(tags, ',') AS tags FROM norm""")
ORACLES["stream_bucket_counts"] = statement([LOGS], """
SELECT bucket, index_name, level, count(*) AS n FROM (SELECT *,
  time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS bucket FROM logs) GROUP BY ALL""")
ORACLES["stream_cooldown"] = ORACLES["cooldown_dedupe"]
ORACLES["stream_first_seen"] = ORACLES["first_seen"]
ORACLES["stream_index_silent"] = ORACLES["index_silent"]
ORACLES["stream_alerts"] = ORACLES["alert_documents"]
_SINCE = "TIMESTAMP '2024-01-01'"
_GHOST = cfg.GHOST[0]
ORACLES["stream_heartbeats"] = statement([LOGS], "SELECT 'main' AS target, service,"
    " date_trunc('second', ts)::TIMESTAMP AS last_seen,"
    f" coalesce(date_trunc('second', ts)::TIMESTAMP, {_SINCE}) + {seconds(_GHOST.staleness)} AS missing_since FROM (" + union([
    f"""SELECT {q(service)} AS service, ts, lead(ts) OVER (ORDER BY ts NULLS FIRST) AS next FROM (
        SELECT ts FROM logs WHERE {matches([index])} AND {phrase(WORDS, [text])} UNION ALL SELECT NULL)"""
    for service, index, text in _GHOST.heartbeats])
    + f""") WHERE coalesce(next, (SELECT greatest(TIMESTAMP '2024-01-31', max(ts) - INTERVAL 10 MINUTE) FROM logs) + INTERVAL 1 SECOND)
      - coalesce(ts, {_SINCE}) > {seconds(_GHOST.staleness)}""")
