"""Reading logs into the canonical schema."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sentinel.functions import sql
from sentinel.functions.index_names import index_matches

_TEXT = T.StringType()
LOG_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("index_name", _TEXT),
    T.StructField("level", _TEXT),
    T.StructField("message", _TEXT),
    T.StructField("message_template", _TEXT),
    T.StructField("service", _TEXT),
    T.StructField("environment", _TEXT),
    T.StructField("user_name", _TEXT),
    T.StructField("user_id", _TEXT),
    T.StructField("logger", _TEXT),
    T.StructField("host", _TEXT),
    T.StructField("url_path", _TEXT),
    T.StructField("http_method", _TEXT),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("status_is_number", T.BooleanType()),
    T.StructField("source_ip", _TEXT),
    T.StructField("trace_id", _TEXT),
    T.StructField("span_id", _TEXT),
    T.StructField("tags", T.ArrayType(_TEXT)),
    T.StructField("labels", T.MapType(_TEXT, _TEXT)),
])
#: With the field that only some sources tell from `message`.
CONFORMED = [*LOG_SCHEMA.fields, T.StructField("host_message", _TEXT)]


#: How search stores call the exact form of a text field; here it is the field itself.
EXACT_FORM = ".keyword"


def field_of(schema: T.StructType, name: str) -> str | None:
    """SQL of a field by its dotted name, or None: a column of that very name, else a path into structs and maps."""
    found = _path(schema, name)
    if found is None and name.endswith(EXACT_FORM):
        found = _path(schema, name.removesuffix(EXACT_FORM))
    return found


def _path(kind: T.DataType, name: str) -> str | None:
    if isinstance(kind, T.MapType):
        return f"[{sql.text(name)}]" if isinstance(kind.keyType, T.StringType) else None
    if not isinstance(kind, T.StructType):
        return None
    quoted = {f.name: "`" + f.name.replace("`", "``") + "`" for f in kind.fields}
    if name in quoted:
        return quoted[name]
    for f in kind.fields:
        if name.startswith(f.name + "."):
            rest = _path(f.dataType, name[len(f.name) + 1:])
            if rest is not None:
                return quoted[f.name] + (rest if rest.startswith("[") else "." + rest)
    return None


def conform(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Canonical columns from a source's own names, which may be paths into structs and maps.

    A field the source lacks becomes null, decided from its schema before anything runs: without
    templates only levels are compared, without levels only totals. A source without the clock is refused.
    `host_message`, if named, is the text that host checks read; else they read `message`.
    """
    names = names or {}
    unknown = set(names) - {f.name for f in CONFORMED}
    if unknown:
        raise ValueError(f"no canonical fields: {sorted(unknown)}")
    columns = []
    for f in CONFORMED:
        if f not in LOG_SCHEMA.fields and f.name not in names:
            continue
        source = field_of(df.schema, names.get(f.name, f.name))
        kind = f.dataType.simpleString()
        if f.name == "ts":
            if source is None:
                raise ValueError(f"logs have no field {names.get('ts', 'ts')} for their clock")
            columns.append(f"{source} AS ts")
        else:
            columns.append(f"CAST({source or 'NULL'} AS {kind}) AS {f.name}")
    return df.selectExpr(*columns)


def read_logs(spark: SparkSession, path: str, fmt: str = "parquet",
              names: dict[str, str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Logs at rest. JSON needs a schema up front; it is never inferred from the data."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt in ("json", "csv"):
        raise ValueError(f"reading {fmt} needs a schema")
    return conform(reader.load(path), names)


def time_literal(logs: DataFrame, second: int) -> str:
    """A literal of the log clock's own type, so that the bound reaches the file scan."""
    text = datetime.fromtimestamp(second, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(logs.schema["ts"].dataType, T.TimestampNTZType):
        return f"TIMESTAMP_NTZ'{text}'"
    return f"TIMESTAMP_LTZ'{text}+00:00'"


def between(logs: DataFrame, low: int, high: int) -> DataFrame:
    """Half-open time range."""
    return logs.where(f"ts >= {time_literal(logs, low)} AND ts < {time_literal(logs, high)}")


def scan(logs: DataFrame, indices: list[str], low: int, high: int) -> DataFrame:
    """Rows of the matching indices in [low, high). No match means no rows, not an error."""
    return between(logs, low, high).where(index_matches(indices))
