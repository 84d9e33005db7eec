"""Logs derived from an `events` table.

The statement is plain SQL that other engines accept unchanged; `{events}` is the table.
Outages of the whole system, one service and one host, and a burst of errors are planted in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.sources.logs import conform

EVENT_ROWS_SQL = """
WITH b AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         replace(substr(CAST(ts AS STRING), 1, 10), '-', '.') AS ymd
  FROM {events}
), m AS (
  SELECT *,
    CASE WHEN event_type = 'error' AND k = 99 THEN 'Fatal'
         WHEN event_type = 'error' THEN 'Error'
         WHEN event_type = 'click' AND ts >= TIMESTAMP '2024-01-20 06:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00' THEN 'Error'
         WHEN event_type = 'signup' THEN 'Warning'
         ELSE 'Information' END AS level,
    CASE user_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'crawler' WHEN 2 THEN 'web' ELSE 'bot' END AS service,
    CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 404 WHEN 1 THEN 401 WHEN 2 THEN 403 ELSE 500 END
         WHEN event_type IN ('view', 'click') THEN 200 ELSE NULL END AS status
  FROM b
)
SELECT event_id, ts,
  CASE service WHEN 'api' THEN 'api-logs-' || substr(ymd, 1, 7)
       WHEN 'crawler' THEN 'crawler-logs-' || ymd
       WHEN 'web' THEN '.ds-web-logs-generic-default-' || ymd || '-000001'
       ELSE 'bot-logs' END AS index_name,
  service, level, status,
  '10.0.0.' || CAST(user_id % 8 AS STRING) AS source_ip,
  'vm' || CAST(user_id % 6 AS STRING) AS host,
  CASE WHEN status IS NULL THEN NULL
       WHEN status IN (401, 403) THEN '/api/auth/login' || CAST(k % 7 AS STRING)
       WHEN status = 404 AND k % 8 = 0 THEN '/wp-login.php'
       WHEN status = 404 THEN '/item/' || CAST(k AS STRING)
       WHEN k % 20 = 0 THEN '/healthz' ELSE '/api/item/' || CAST(k AS STRING) END AS path,
  CASE WHEN event_type = 'error' THEN
         CASE k % 5 WHEN 0 THEN 'Failed password for u' || CAST(k AS STRING) || ' from 10.0.0.' || CAST(user_id % 8 AS STRING)
                    WHEN 1 THEN 'Out of memory: Killed process ' || CAST(k AS STRING)
                    WHEN 2 THEN 'EXT4-fs error (device sda' || CAST(k % 3 AS STRING) || ')'
                    WHEN 3 THEN 'unit' || CAST(k AS STRING) || '.service: Failed with result exit-code'
                    ELSE 'timeout after ' || CAST(k AS STRING) || 's calling ' || service END
       WHEN event_type = 'signup' THEN
         CASE k % 3 WHEN 0 THEN 'curl exited with code ' || CAST(k AS STRING)
                    ELSE 'slow signup for u' || CAST(user_id AS STRING) || '@example.com' END
       WHEN event_type = 'view' AND k % 10 = 0 THEN 'Heartbeat: ' || service
       ELSE 'ok ' || event_type END AS message
FROM m
"""
EVENT_LOGS_SQL = EVENT_ROWS_SQL + """
WHERE NOT (ts >= TIMESTAMP '2024-01-25 12:00:00' AND ts < TIMESTAMP '2024-01-25 18:00:00')
  AND NOT (service = 'crawler' AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-13 00:00:00')
  AND NOT (user_id % 6 = 3 AND ts >= TIMESTAMP '2024-01-16 00:00:00' AND ts < TIMESTAMP '2024-01-17 12:00:00')
"""


def event_logs(events: DataFrame, outages: bool = True) -> DataFrame:
    """Canonical logs; the rendered text doubles as the template. Without `outages` every event is a row."""
    # TIMESTAMP literals in the statement take the session's default timestamp type, so compare
    # them with the events' zone-less clock explicitly.
    statement = (EVENT_LOGS_SQL if outages else EVENT_ROWS_SQL).replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    logs = events.sparkSession.sql(statement, events=events)
    return conform(logs, {
        "status_code": "status", "url_path": "path", "message_template": "message",
    })


def raw_documents(events: DataFrame) -> DataFrame:
    """JSON log documents as applications emit them: old and new field names, mixed shapes.

    Which names a document uses depends on its event id, so every rule of the normalisation,
    including the rename conflict, has documents it applies to.
    """
    events = events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    eid, uid, k = F.col("event_id"), F.col("user_id"), F.col("k")
    kind = F.col("event_type")

    def pick(mod: int, *wanted: int):
        return (eid % mod).isin(*wanted)

    level = F.when(kind == "error", "Error").when(kind == "signup", "Warning")
    status = F.when(kind == "error", F.when(k % 2 == 0, 401).otherwise(404)).when(kind == "view", 200)
    number = F.when(pick(2, 0), status)
    words = F.when(pick(2, 1), status.cast("string"))
    path = F.when(k % 20 == 0, F.lit("/healthz")).otherwise(F.concat(F.lit("/item/"), k))
    logger = (
        F.when(k % 10 == 0, F.lit("Microsoft.Hosting.Lifetime"))
        .when(k % 10 == 1, F.lit("Microsoft.EntityFrameworkCore.Database"))
        .when(k % 10 == 2, F.lit("Microsoft.EntityFrameworkCore.Migrations"))
    )
    message = (
        F.when((kind == "view") & (k % 10 == 0), F.lit("Heartbeat: api"))
        .when((kind == "error") & (k % 10 == 3), F.lit("Unauthorized call"))
        .otherwise(F.concat(F.lit("ok "), kind))
    )
    tag_text = F.concat(F.lit(" import, k"), k % 3, F.lit(" ,,import\t"))
    labels = F.struct(
        F.when(pick(4, 0), F.concat(F.lit("u"), uid)).alias("Username"),
        F.when(pick(8, 0), F.concat(F.lit("n"), uid)).alias("UserName"),
        F.when(pick(5, 0), uid.cast("string")).alias("UserId"),
        F.when(pick(3, 0), F.lit("shop")).alias("Application"),
        F.when(pick(3, 1), F.lit("prod")).alias("Environment"),
        F.when(pick(7, 0), tag_text).alias("LogTags"),
        kind.alias("kind"),
    )
    fields = F.struct(
        F.when(pick(16, 0), F.concat(F.lit("f"), uid)).alias("UserName"),
        F.when(pick(10, 0), F.concat(F.lit("i"), uid)).alias("UserId"),
        F.when(pick(2, 0), logger).alias("SourceContext"),
        F.when(pick(2, 0), F.concat(F.lit("vm"), uid % 6)).alias("MachineName"),
        F.when(pick(4, 1), path).alias("RequestPath"),
        F.when(pick(4, 1), F.lit("GET")).alias("RequestMethod"),
        F.when(pick(4, 1), words).alias("StatusCode"),
        F.when(pick(6, 3, 5), F.lit("batch")).alias("Application"),
    )
    document = F.struct(
        F.col("event_id").alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("@timestamp"),
        F.when(pick(3, 0), level).alias("level"),
        # every 27th document has both names: the rename fails there
        F.when(pick(3, 1) | pick(27, 0), F.struct(level.alias("level"))).alias("log"),
        message.alias("message"),
        F.when(pick(9, 0), F.struct(F.lit("own").alias("name"))).alias("user"),
        F.when(pick(4, 0), F.struct(path.alias("path"))).alias("url"),
        F.when(pick(4, 0), F.struct(F.struct(number.alias("status_code")).alias("response")))
         .alias("http"),
        F.when(pick(5, 1), F.lit("daily")).alias("tags"),
        F.when(~pick(11, 0), labels).alias("labels"),
        F.when(pick(6, 0), fields).when(pick(2, 1), fields).alias("fields"),
        F.when(pick(13, 0), F.struct(F.lit("crawl, daily").alias("LogTags"))).alias("metadata"),
    )
    return events.select(F.to_json(document).alias("document"))


def clashing_documents(events: DataFrame) -> DataFrame:
    """JSON documents that hold every old field name, and by event id one of the new names or none as well."""
    eid = F.col("event_id")

    def both(nr: int):
        return F.when(eid % 7 == nr, F.lit("new"))

    document = F.struct(
        eid, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("@timestamp"), F.lit("old").alias("level"),
        F.struct(F.concat(F.lit("u"), F.col("user_id")).alias("Username")).alias("labels"),
        F.struct(*[F.lit("old").alias(name) for name in ("SourceContext", "MachineName", "RequestPath", "RequestMethod")],
                 F.lit(200).alias("StatusCode")).alias("fields"),
        F.struct(both(1).alias("level"), both(2).alias("logger")).alias("log"),
        F.struct(both(3).alias("name"), (eid % 3).alias("cores")).alias("host"),
        F.struct(both(4).alias("path")).alias("url"),
        F.struct(F.struct(both(5).alias("method")).alias("request"),
                 F.struct(F.when(eid % 7 == 6, 500).alias("status_code")).alias("response")).alias("http"))
    return events.select("event_id", F.to_json(document).alias("document"))
