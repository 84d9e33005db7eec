"""Ingest normalisation of raw JSON documents into the canonical log columns.

The steps run in a fixed order. When a rename finds its target already there the document is kept,
the remaining steps are skipped for it and the reason is stored. A document is parsed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sentinel.functions import fixed_values as fv
from sentinel.functions import sql

USER_STAGE = 2
LAST_STAGE = 8
USER_LABELS = ["Username", "UserName", "UserId"]
TAG_LABEL = "LogTags"
NO_TAGS = "CAST(array() AS array<string>)"
# everything up to and including the space
CONTROL_CHARS = "'" + "".join(f"\\u{c:04x}" for c in range(0x21)) + "'"


# A document as it is parsed, once. Fields whose type or JSON null matters stay variants.
SCHEMA = {
    "f_ts": "`@timestamp` string", "f_level": "level variant", "f_message": "message string",
    "f_tags": "tags variant", "f_labels": "labels variant", "f_metadata": "metadata variant",
    "f_log": "log struct<level: variant, logger: variant>",
    "f_service": "service struct<name: string, environment: string>",
    "f_user": "user struct<name: string, id: string>",
    "f_host": "host struct<name: variant>", "f_url": "url struct<path: variant>",
    "f_http": "http struct<request: struct<method: variant>, response: struct<status_code: variant>>",
    "f_trace": "trace struct<id: string>", "f_span": "span struct<id: string>",
    "f_fields": "fields struct<Application: string, UserName: string, UserId: string, SourceContext: variant,"
                " MachineName: variant, RequestPath: variant, RequestMethod: variant, StatusCode: variant>",
}
# stage, old field, canonical field
RENAMES = [
    (1, "level", "log.level"),
    (3, "fields.SourceContext", "log.logger"),
    (4, "fields.MachineName", "host.name"),
    (5, "fields.RequestPath", "url.path"),
    (6, "fields.RequestMethod", "http.request.method"),
    (7, "fields.StatusCode", "http.response.status_code"),
]
# what columns or labels hold of a document: whole keys, and keys within objects
WHOLE = ["@timestamp", "message", "tags"]
WITHIN = {
    "log": ["level", "logger"], "service": ["name", "environment"], "user": ["name", "id"],
    "host": ["name"], "url": ["path"], "trace": ["id"], "span": ["id"],
}
WITHIN_HTTP = {"request": ["method"], "response": ["status_code"]}
#: the keys of a document made of the columns
KNOWN = [*WHOLE, *WITHIN, "http", "labels"]
#: A key with a dot in it may be one of the fields, written flat; this looks at its end, and at dots only.
FLAT_KEY = r'\.[A-Za-z_]++"\s*+:'
ROOTS = [*WITHIN, "http", "labels", "fields", "metadata"]


def member(path: str, kind: str = "variant") -> str:
    """A field by its dotted name: nested objects first, then one literal key."""
    root, _, inner = path.partition(".")
    if not inner:
        return f"f_{root}"
    flat = f"try_variant_get(flat, '$[\"{path}\"]', '{kind}')"
    nested = (f"try_variant_get(f_{root}, '$.{inner}', '{kind}')" if root in ("labels", "metadata")
              else f"f_{path}")
    if root == "labels":  # a path that finds nothing costs more than a key that a map doesn't hold
        text = f"try_element_at(label_texts, '{inner}')"
        nested = text if kind == "string" else sql.when(f"{text} IS NOT NULL", nested)
    return f"coalesce({nested}, {flat})"


def as_text(column: str) -> str:
    return f"try_variant_get({column}, '$', 'string')"


def is_number(column: str) -> str:
    return f"coalesce(schema_of_variant({column}) RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)', false)"


def tag_list(sources: list[str]) -> str:
    """Tags of comma separated texts: trimmed, without empty ones."""
    parts = ", ".join(f"split(coalesce({s}, ''), ',')" for s in sources)
    tags = f"filter(transform(flatten(array({parts})), p -> btrim(p, {CONTROL_CHARS})), p -> p <> '')"
    return sql.when(f"coalesce({', '.join(sources)}) IS NULL", NO_TAGS, tags)


def derived_tags(message: str, path: str, status: str, status_is_number: str, logger: str) -> str:
    """Tags that follow from a document's structure, in catalogue order."""
    def contains(value: str, marker: str) -> str:
        return f"contains({value}, {sql.text(marker)})"

    codes = ", ".join(map(str, fv.AUTH_STATUS_CODES))
    rules = {
        "heartbeat": [contains(message, m) for m in fv.HEARTBEAT_MARKERS],
        "healthcheck": [f"endswith({path}, {sql.text(e)})" for e in fv.HEALTH_PATH_ENDINGS],
        "request": [f"{status} IS NOT NULL"],
        "auth": [f"({status_is_number} AND try_cast({status} AS DOUBLE) IN ({codes}))",
                 *[contains(message, m) for m in fv.AUTH_MARKERS]],
        "startup": [f"{logger} = {sql.text(fv.STARTUP_LOGGER)}",
                    contains(logger, fv.MIGRATIONS_LOGGER)],
        "db": [f"(startswith({logger}, {sql.text(fv.DB_LOGGER_PREFIX)})"
               f" AND NOT {contains(logger, fv.DB_LOGGER_EXCLUDED)})"],
    }
    tags = ", ".join(sql.when(sql.any_of(tests), sql.text(tag)) for tag, tests in rules.items())
    return f"array_except(array({tags}), CAST(array(NULL) AS array<string>))"


def added(tags: str, new: str) -> str:
    """The list with the new tags that are missing; what was in it stays, duplicates included."""
    return f"concat({tags}, array_except({new}, {tags}))"


def _object(value: str) -> str:
    """The members of a variant that is an object."""
    return f"try_variant_get({value}, '$', 'map<string,variant>')"


def _let(value: str, name: str, body: str) -> str:
    """The body, with the value worked out once under this name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _without(value: str, consumed: str, key: str, depth: int = 0) -> str:
    """A variant without the members of which `consumed` holds; null if nothing is left. What is no object stays."""
    whole, left = f"m{depth}", f"l{depth}"
    kept = f"map_filter({whole}, ({key}, x{depth}) -> NOT {consumed})"
    filled = _let(kept, left, sql.when(f"size({left}) > 0", f"to_variant_object({left})"))
    return _let(_object(value), whole, sql.when(f"{whole} IS NULL", value, filled))


def rest_of(document: str, fail_stage: str) -> str:
    """JSON text of what no column and no label of a normalised document holds; null if nothing is left.

    A step that did not run has consumed nothing: the old fields of a failed document are in here.
    """
    flat = [f"{root}.{key}" for root, keys in WITHIN.items() for key in keys]
    flat += [f"http.{root}.{key}" for root, keys in WITHIN_HTTP.items() for key in keys]
    overrides = [(USER_STAGE, f) for f in ("fields.UserName", "fields.UserId")]
    overrides += [(USER_STAGE, f"labels.{label}") for label in USER_LABELS]
    tags = [(LAST_STAGE, f"{root}.{TAG_LABEL}") for root in ("labels", "metadata")]
    old = [(stage, name) for stage, name, _ in RENAMES]
    steps = [*old, *overrides, *tags]
    stages = " ".join(f"WHEN {sql.text(name)} THEN {stage}" for stage, name in steps)

    def consumed(name: str) -> str:
        """Lambdas are not compiled, so their tests are few: both lists are hashed, the stages looked at for a hit."""
        late = f"{sql.is_in(name, [n for _, n in steps])} AND {fail_stage} > CASE {name} {stages} END"
        return f"({sql.is_in(name, WHOLE + flat)} OR ({late}))"

    deep = " ".join(f"WHEN {sql.text(root)} THEN {_without('w', sql.is_in('j', keys), 'j', 1)}"
                    for root, keys in WITHIN_HTTP.items())
    http = f"map_filter(transform_values(m, (h, w) -> CASE h {deep} ELSE w END), (h, w) -> w IS NOT NULL)"
    http = _let(http, "l", sql.when("size(l) > 0", "to_variant_object(l)"))
    trimmed = (
        f"CASE WHEN NOT {sql.is_in('k', ROOTS)} THEN v"
        f" WHEN k = 'labels' THEN CASE WHEN {_object('v')} IS NULL THEN v END"
        f" WHEN k = 'http' THEN {_let(_object('v'), 'm', sql.when('m IS NULL', 'v', http))}"
        f" ELSE {_without('v', consumed('concat(k, \'.\', i)'), 'i')} END")
    top = f"map_filter({_object(f'try_parse_json({document})')}, (k, v) -> NOT {consumed('k')})"
    left = f"map_filter(transform_values({top}, (k, v) -> {trimmed}), (k, v) -> v IS NOT NULL)"
    return f"nullif(to_json({left}), '{{}}')"


def normalize(raw: DataFrame, document: str = "document") -> DataFrame:
    """Raw JSON text column to canonical columns; `schema_error` says where a document failed, `rest` is the
    JSON text of all that no column and no label holds.

    The document is parsed once into typed fields. Each step is its own projection, because later ones use
    its columns several times; columns that nobody reads are not computed.
    """
    def clash(old: str, new: str) -> str:
        """Both keys are there, even if one holds a JSON null."""
        return f"({member(old)} IS NOT NULL AND {member(new)} IS NOT NULL)"

    stages = " ".join(f"WHEN {clash(old, new)} THEN {n}" for n, old, new in RENAMES)

    def ran(stage: int) -> str:
        return f"fail_stage > {stage}"

    def renamed(new: str) -> str:
        stage, old = next((s, o) for s, o, n in RENAMES if n == new)
        return f"coalesce({as_text(member(new))}, {sql.when(ran(stage), as_text(member(old)))})"

    def filled(current: str, *fallbacks: str) -> str:
        return f"coalesce({current}, {', '.join(sql.when('done', f) for f in fallbacks)})"

    def overridden(current: str, *sources: str) -> str:
        """The last override that is set wins."""
        latest = ", ".join(sql.when(ran(USER_STAGE), member(s, "string")) for s in reversed(sources))
        return f"coalesce({latest}, {member(current, 'string')})"

    def text_only(column: str) -> str:
        return sql.when(f"schema_of_variant({column}) = 'STRING'", as_text(column))

    def is_object(column: str) -> str:
        return f"({column} IS NOT NULL AND NOT is_variant_null({column}))"

    carried = list(raw.columns)
    parsed = ", ".join(SCHEMA.values())
    canonical = {
        "level": filled(renamed("log.level"), sql.text(fv.DEFAULT_LEVEL)),
        "message": "f_message",
        "message_template": f"coalesce({member('labels.MessageTemplate', 'string')}, f_message)",
        "service": filled(member("service.name", "string"), member("labels.Application", "string"),
                          member("fields.Application", "string"), sql.text(fv.DEFAULT_SERVICE)),
        "environment": filled(member("service.environment", "string"), member("labels.Environment", "string")),
        "user_name": overridden("user.name", "labels.Username", "labels.UserName", "fields.UserName"),
        "user_id": overridden("user.id", "labels.UserId", "fields.UserId"),
        "logger": renamed("log.logger"), "host": renamed("host.name"), "url_path": renamed("url.path"),
        "http_method": renamed("http.request.method"), "status_text": renamed("http.response.status_code"),
        "status_is_number":
            f"CASE WHEN {member('http.response.status_code')} IS NOT NULL"
            f" THEN {is_number(member('http.response.status_code'))}"
            f" ELSE {ran(7)} AND {is_number(member('fields.StatusCode'))} END",
        "source_ip": member("labels.IpAddress", "string"),
        "trace_id": member("trace.id", "string"), "span_id": member("span.id", "string"),
    }
    removed = (f"(({ran(USER_STAGE)} AND {sql.is_in('k', USER_LABELS)})"
               f" OR (done AND k = {sql.text(TAG_LABEL)}))")
    stamp_key = sql.when("done", "'schema_version'", "'schema_error'")
    stamp = sql.when("done", sql.text(fv.SCHEMA_VERSION), "schema_error")
    errors = " ".join(f"WHEN {n} THEN {sql.text(fv.RENAME_CONFLICT.replace('{field}', new))}" for n, _, new in RENAMES)
    label_tags, metadata_tags = member(f"labels.{TAG_LABEL}"), member(f"metadata.{TAG_LABEL}")
    labels = "coalesce(label_texts, CAST(map() AS map<string,string>))"
    kept = f"map_filter({labels}, (k, v) -> v IS NOT NULL AND NOT {removed} AND k <> {stamp_key})"
    # The parse and the tags are generators of one row: a filter on a normalised column stays above the parse,
    # one on tags above them too. Pushed down, it would repeat all that the column is made of.
    return (
        raw.selectExpr(*carried, f"inline(array(from_json({document}, {sql.text(parsed)}))) AS ({', '.join(SCHEMA)})")
        .selectExpr("*", sql.when(f"{document} RLIKE {sql.text(FLAT_KEY)}", f"try_parse_json({document})") + " AS flat",
                    "try_variant_get(f_labels, '$', 'map<string,string>') AS label_texts")
        .selectExpr("*", f"CASE {stages} ELSE {LAST_STAGE + 1} END AS fail_stage")
        .selectExpr("*", f"{ran(LAST_STAGE)} AS done", f"CASE fail_stage {errors} END AS schema_error")
        .selectExpr(
            "*", *[f"{value} AS c_{name}" for name, value in canonical.items()],
            "coalesce(try_variant_get(f_tags, '$', 'array<string>'),"
            f" {sql.when(f'{as_text("f_tags")} IS NOT NULL', f'array({as_text("f_tags")})')}) AS own_tags",
            f"{tag_list([text_only(label_tags), text_only(metadata_tags)])} AS new_tags",
            f"{is_object('f_labels')} OR {is_object('f_metadata')} AS has_sources")
        .selectExpr(
            "*", sql.when("own_tags IS NULL AND has_sources", NO_TAGS, "own_tags") + " AS start_tags",
            f"{derived_tags('c_message', 'c_url_path', 'c_status_text', 'c_status_is_number', 'c_logger')} AS derived")
        .selectExpr("*", f"{added('start_tags', 'new_tags')} AS folded")
        .selectExpr(
            "*", "explode(array(CASE WHEN NOT done THEN own_tags WHEN size(derived) = 0 THEN folded"
            f" ELSE {added(f'coalesce(folded, {NO_TAGS})', 'derived')} END)) AS c_tags")
        .selectExpr(
            *carried, "try_cast(f_ts AS TIMESTAMP_NTZ) AS ts",
            *[f"c_{c} AS {c}" if c != "status_text" else "try_cast(c_status_text AS INT) AS status_code" for c in canonical],
            "c_tags AS tags",
            f"map_concat({kept}, map({stamp_key}, {stamp})) AS labels", "schema_error",
            f"{rest_of(document, 'fail_stage')} AS rest")
    )


def to_document(rows: DataFrame) -> DataFrame:
    """Canonical columns and the rest back to a JSON document, for running the normalisation over history."""
    def filled(**columns: str) -> str:
        """An object, unless all its members are null."""
        return sql.when(" OR ".join(f"{c} IS NOT NULL" for c in columns.values()), sql.struct(**columns))

    number = "CAST(status_code AS STRING)"
    status = sql.when("status_is_number", f"parse_json({number})",
                      f"parse_json(concat('\"', {number}, '\"'))")
    http = sql.struct(request=filled(method="http_method"),
                      response=sql.when("status_code IS NOT NULL", sql.struct(status_code=status)))
    known = (
        "to_json(named_struct("
        "'@timestamp', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"),"
        f" 'host', {filled(name='host')},"
        f" 'http', {sql.when('http_method IS NOT NULL OR status_code IS NOT NULL', http)},"
        f" 'labels', labels, 'log', {filled(level='level', logger='logger')}, 'message', message,"
        f" 'service', {filled(environment='environment', name='service')}, 'span', {filled(id='span_id')},"
        f" 'tags', tags, 'trace', {filled(id='trace_id')}, 'url', {filled(path='url_path')},"
        f" 'user', {filled(id='user_id', name='user_name')}))")

    def both(a: str, b: str, joined: str) -> str:
        """Members of two objects; a value that is no object stays as the rest has it."""
        return (f"CASE WHEN {b} IS NULL THEN {a} WHEN {a} IS NULL OR {_object(a)} IS NULL OR {_object(b)} IS NULL THEN {b}"
                f" ELSE to_variant_object({joined}) END")

    deepest = both("c", "d", f"map_zip_with({_object('c')}, {_object('d')}, (i, e, f) -> coalesce(f, e))")
    deeper = both("a", "b", f"map_zip_with({_object('a')}, {_object('b')}, (j, c, d) -> {deepest})")
    others = f"coalesce({_object('parse_json(rest)')}, CAST(map() AS map<string,variant>))"
    merged = f"to_json(map_zip_with({_object('parse_json(known)')}, {others}, (k, a, b) -> {deeper}))"
    # Mostly the rest is an object with other keys. Then the two texts are joined, and nothing is parsed.
    apart = f"startswith(rest, '{{\"') AND NOT arrays_overlap(json_object_keys(rest), {sql.literal(KNOWN)})"
    joined = "concat(left(known, length(known) - 1), ',', substr(rest, 2))"
    return (rows.selectExpr("rest", f"{known} AS known")
            .selectExpr(f"CASE WHEN rest IS NULL THEN known WHEN {apart} THEN {joined} ELSE {merged} END AS document"))


def without_noise(rows: DataFrame) -> DataFrame:
    """Rows that are neither heartbeats nor health probes; untagged rows stay."""
    return rows.where(f"NOT coalesce(arrays_overlap(tags, {sql.literal(fv.NOISE_TAGS)}), false)")


def backfill(raw: DataFrame, path: str, document: str = "document") -> None:
    """Normalise history and replace the days it covers, leaving other days as they are.

    Running it again over the same days gives the same table.
    """
    rows = normalize(raw, document).selectExpr("*", "CAST(ts AS DATE) AS dt")
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dt").parquet(path))
