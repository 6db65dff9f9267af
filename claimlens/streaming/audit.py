"""The audit feed as Structured Streaming jobs.

A feed is a folder of Parquet files of events. Jobs run with the available data (tests, queries) or with a
processing-time trigger; their state and results lie in folders that all executors share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.sources.scratch import scratch

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def feed(spark: SparkSession, folder: str, glob: str = "events.parquet", late: str = "10 minutes") -> DataFrame:
    """The events of a folder as a stream; at is the event time, with a watermark."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(folder)
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def latest_result(stream: DataFrame, name: str, keys: list[str], path: str | None = None) -> DataFrame:
    """The newest row of each key of an aggregation over all available data.

    Update mode: a micro-batch has the rows that it changed, and goes to a folder of its own by number, so that a repeated one
    replaces itself and nothing is rewritten; state behind the watermark is dropped. With a path of an earlier run the stream goes on
    where that one ended, and both runs' rows count.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.IntegerType())])).option("basePath", f"{path}/result").parquet(f"{path}/result")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


#: Rows of a written file, and the trigger's interval: what is there is written after so many rows or so long.
FLUSH_ROWS, FLUSH_EVERY = 100, "2 seconds"


def ingest(stream: DataFrame, path: str, state: str, every: str | None = None):
    """Appends a stream's micro-batches to a table, each in a folder of its own by number, so that a repeated one replaces itself.

    Texts are cut as the table's columns are. flushed_at is when the micro-batch was taken from the feed, one moment for all its rows, while ts
    stays the event's own. A file has FLUSH_ROWS rows at most. every is a processing-time trigger (FLUSH_EVERY for a live feed), else
    what is available is taken.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("props", F.substring("props", 1, 500)).withColumn("flushed_at", F.current_timestamp()).drop("at")
        rows.write.mode("overwrite").option("maxRecordsPerFile", FLUSH_ROWS).parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", state)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def tumbling(stream: DataFrame, span: str) -> DataFrame:
    g = stream.groupBy(F.window("at", span).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "event_type", "n", "total")


def session_windows(stream: DataFrame, span: str = "30 minutes", slide: str = "10 minutes") -> DataFrame:
    """Events of each session in sliding windows: the state is a number for each session and window, no set of sessions."""
    g = stream.groupBy(F.window("at", span, slide).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "user_id", "n")


def limited(stream: DataFrame, span: str, allowed: int, key: Column | str = "user_id") -> DataFrame:
    """Of each key's events in fixed windows: how many pass and how many are refused."""
    g = stream.groupBy(F.window("at", span).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "user_id", F.least("n", F.lit(allowed)).alias("allowed"), F.greatest(F.col("n") - allowed, F.lit(0)).alias("rejected"))


def stream_audit_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_result(tumbling(feed(spark, sf_dir), "6 hours"), "tumbling", ["bucket", "event_type"])


def stream_active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sessions in sliding windows of half an hour; a null session isn't one."""
    rows = latest_result(session_windows(feed(spark, sf_dir)), "active", ["bucket", "user_id"])
    return rows.groupBy("bucket").agg(F.count("user_id").cast("int").alias("sessions"))


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_result(limited(feed(spark, sf_dir), "1 day", 2), "limited", ["bucket", "user_id"])


QUERIES = {f.__name__: f for f in (stream_audit_tumbling, stream_active_sessions, stream_rate_limit)}

ORACLES = {
    "stream_audit_tumbling": "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "stream_active_sessions": """
        SELECT b AS bucket, count(DISTINCT user_id)::INT AS sessions
        FROM (SELECT user_id, unnest([time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * k for k in [0, 1, 2]]) AS b FROM events) GROUP BY 1""",
    "stream_rate_limit": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket, user_id, least(count(*), 2) AS allowed, greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY 1, 2",
}
