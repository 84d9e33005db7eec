"""The same column functions over Structured Streaming sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sentinel.functions import text
from sentinel.functions.index_names import index_matches
from sentinel.functions import sql
from sentinel.config import Span, Target, bucket_seconds
from sentinel.operators.facts import SECOND
from sentinel.session import new_path

#: Seconds by which rows may arrive out of order.
LATENESS = 600
CLOCK = "ts TIMESTAMP_NTZ"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet",
                files_per_batch: int | None = None) -> DataFrame:
    """New parquet files of a folder; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_event_time(logs: DataFrame, lateness: int = LATENESS) -> DataFrame:
    """Watermarks need a zoned clock: read the zone-less one as UTC, in streams only.

    Rows that a later filter drops still move the watermark, a clock's ticks above all. The optimizer would move
    such a filter below it; nothing passes one that is not deterministic.
    """
    timed = logs.withColumn("ts", F.expr("CAST(ts AS TIMESTAMP)")).withWatermark("ts", f"{lateness} seconds")
    return timed.where(F.spark_partition_id() >= 0)


# ---- a clock besides the rows ----------------------------------------------------------------

def new_clock(spark: SparkSession) -> str:
    """Folder of a clock that has not ticked yet."""
    path = new_path(spark, "clock")
    spark.createDataFrame([], CLOCK).write.parquet(path)
    return path


def tick(spark: SparkSession, clock: str, now: int) -> None:
    """Tell streams that read the clock that it is `now`: silence passes time on, too."""
    spark.range(1).selectExpr(f"CAST(timestamp_seconds({now}L) AS TIMESTAMP_NTZ) AS ts").coalesce(1).write.mode("append").parquet(clock)


def with_clock(rows: DataFrame, clock: str) -> DataFrame:
    """Rows of a stream and, with nothing but their time, the ticks of a clock."""
    return rows.unionByName(read_stream(rows.sparkSession, clock, T._parse_datatype_string(CLOCK)), allowMissingColumns=True)


# ---- tables of micro-batches -----------------------------------------------------------------

def batch_sink(path: str, shape: Callable[[DataFrame, int], DataFrame] | None = None, by: tuple[str, ...] = ()):
    """A foreachBatch function that writes each batch, shaped, to a folder of its own number.

    A batch that is repeated after a failure replaces what its first try left. Spark's marker tells a whole
    folder from one that is being written, so a reader never sees half a batch or a batch twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = shape(batch, number) if shape else batch
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={number}")

    return write


def committed(spark: SparkSession, path: str, below: int | None = None) -> list[str]:
    """Folders of whole batches, those before a number only if one is given."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("batch=")]
    whole = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return [p.toString() for p in whole if below is None or int(p.getName().split("=")[1]) < below]


def read_batches(spark: SparkSession, path: str, schema: T.StructType, below: int | None = None) -> DataFrame:
    """All rows of whole batches."""
    folders = committed(spark, path, below)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(schema.names)


def drain(stream: DataFrame, sink, checkpoint: str) -> None:
    """Hand everything that is available now to a foreachBatch function."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def bucket_counts(logs: DataFrame, targets: list[Target], span: Span) -> DataFrame:
    """Count facts of some log rows, a micro-batch or a whole table."""
    step = bucket_seconds(targets)
    return logs.selectExpr(f"{SECOND} - pmod({SECOND} - {span.anchor}L, {step}L) AS bucket", "index_name", "level").groupBy(
        "bucket", "index_name", "level").agg(F.expr("count(*) AS n"))


def merged_counts(batches: DataFrame) -> DataFrame:
    """Facts as of all batches: what each of them counted, added up.

    Nothing waits for a watermark: a bucket is there from its first row on, the newest one included, and a
    row counts however late it comes. No state grows with time; the table holds sums of batches, not rows.
    """
    return batches.groupBy("bucket", "index_name", "level").agg(F.expr("sum(n) AS n"))


def run_bucket_counts(logs: DataFrame, targets: list[Target], span: Span, path: str, checkpoint: str) -> DataFrame:
    """Drain a stream of logs into a table of counts, from where the checkpoint left off, and read it whole."""
    spark = logs.sparkSession
    drain(logs.select("ts", "index_name", "level"), batch_sink(path, lambda batch, _: bucket_counts(batch, targets, span)), checkpoint)
    schema = T._parse_datatype_string("bucket BIGINT, index_name STRING, level STRING, n BIGINT")
    return merged_counts(read_batches(spark, path, schema))


def heartbeat_minutes(logs: DataFrame, targets: list[Target], lateness: int = LATENESS) -> DataFrame:
    """One row per target, service and minute with a sign of life.

    Combined on the map side, so a chatty service reaches its state as at most one row a minute.
    """
    hits = sql.compact([
        sql.when(f"{index_matches([index])} AND {text.has_phrase('words', [phrase])}",
                 sql.struct(target=sql.text(t.name), service=sql.text(service),
                            staleness=f"{t.staleness}L"))
        for t in targets for service, index, phrase in t.heartbeats])
    return (
        with_event_time(logs, lateness)
        .selectExpr("ts", "index_name", f"{text.words('message')} AS words")
        .selectExpr("ts", f"inline({hits})")
        .groupBy(F.window("ts", "1 minute"), "target", "service", "staleness")
        .agg(F.expr("max(ts) AS last_ts"))
        .select(F.window_time("window").alias("ts"), "target", "service", "staleness", "last_ts")
    )


def write_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append to a parquet table with everything that is available now."""
    return (stream.writeStream.format("parquet").outputMode(mode)
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_to_table(stream: DataFrame, label: str, clock: str | None = None, now: int = 0, lateness: int = LATENESS) -> DataFrame:
    """Drain a stream into a new table of the work folder and read it back.

    With a clock, it then ticks so that the stream's watermark reaches `now`, and the same query goes on from its
    checkpoint: what waited for later rows is decided.
    """
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, label), new_path(spark, f"{label}-checkpoint")
    for last in ([False, True] if clock else [True]):
        if clock and last:
            tick(spark, clock, now + lateness)
        query = write_table(stream, path, checkpoint)
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
    return spark.read.schema(stream.schema).parquet(path)


ALERT_KEYS = ["target", "ts", "signature"]


def alert_sink(path: str, schema: T.StructType):
    """A foreachBatch function for alert documents: each alert once, whatever is sent or run again.

    A repeated batch replaces itself; alerts that whole earlier batches have are left out. Of these only the
    months and targets at hand are read.
    """

    def unknown(batch: DataFrame, number: int) -> DataFrame:
        rows = batch.dropDuplicates(ALERT_KEYS)
        earlier = read_batches(batch.sparkSession, path, schema, below=number)
        near = earlier.join(rows.select("target", "month").distinct(), ["target", "month"], "left_semi")
        return rows.join(near.select(ALERT_KEYS), ALERT_KEYS, "left_anti")

    return batch_sink(path, unknown, by=("target", "month"))


def append_new_alerts(path: str):
    """A foreachBatch function that appends alerts once, also when a batch is repeated.

    Only the history of the targets and months of the batch is read for the comparison.
    """
    keys = ALERT_KEYS

    def append(batch: DataFrame, _batch_id: int) -> None:
        batch = batch.dropDuplicates(keys)
        spark = batch.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(jpath):
            known = spark.read.schema(batch.schema).parquet(path)
            seen = known.join(batch.select("target", "month").distinct(), ["target", "month"],
                              "left_semi").select(*keys)
            batch = batch.join(seen, keys, "left_anti")
        batch.write.mode("append").partitionBy("target", "month").parquet(path)

    return append
