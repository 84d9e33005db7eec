"""Index names: pattern matching and rollover families. All return Spark SQL text."""

from __future__ import annotations

from sentinel.functions import fixed_values as fv
from sentinel.functions import sql


def stream_name(index_name: str = "index_name") -> str:
    """Backing indices of a data stream carry the stream's name inside theirs."""
    return f"regexp_replace({index_name}, {sql.text(fv.DATA_STREAM_BACKING)}, '$1')"


def index_family(index_name: str = "index_name") -> str:
    """Data stream name, or the name without its month or day suffix."""
    return f"regexp_replace({stream_name(index_name)}, {sql.text(fv.DATED_INDEX)}, '$1')"


def _patterns(entries: list[str]) -> list[str]:
    return [p.strip() for entry in entries for p in entry.split(",") if p.strip()]


def _like(pattern: str, index_name: str) -> str:
    if pattern == "*":
        return "true"
    name = index_name if pattern.startswith(".") else stream_name(index_name)
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"{name} LIKE {sql.text(escaped.replace('*', '%'))}"


def index_matches(patterns: list[str], index_name: str = "index_name") -> str:
    """Comma joined `*` patterns; a leading `-` excludes. Hidden names need a leading dot."""
    flat = _patterns(patterns)
    wanted = [_like(p, index_name) for p in flat if not p.startswith("-")]
    unwanted = [_like(p[1:], index_name) for p in flat if p.startswith("-")]
    test = sql.any_of(wanted)
    return f"({test} AND NOT {sql.any_of(unwanted)})" if unwanted else test


def index_may_match(patterns: list[str], index_name: str = "index_name") -> str:
    """Cheap superset of `index_matches` for raw rows: prefix tests only, no regular expression."""
    prefixes = {p.split("*")[0] for p in _patterns(patterns) if not p.startswith("-")}
    if "" in prefixes:
        return "true"
    return sql.any_of([f"startswith({index_name}, {sql.text(start)})"
                       for p in sorted(prefixes) for start in (p, ".ds-" + p)])
