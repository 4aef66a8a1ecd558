"""Structured Streaming jobs over event and score streams: windows, epochs, sessions, logs. Keyed state in event order is in `state`.

Late rows are bounded by watermarks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from groupsight.sources.store import drop_table, shared_path


def event_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the folder as a stream of its files."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(path)
    # watermarks need timestamps with a zone
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if isinstance(f.dataType, T.TimestampNTZType)})


#: Rows of an arrival, and the least number of arrivals where there is so much to tell apart.
ARRIVAL_ROWS, ARRIVALS = 250_000, 8


def arriving(rows: DataFrame, by: str, name: str) -> str:
    """A folder of files that came one after the other, each with the next rows in order of `by`; the column goes, and so do rows without it.

    Rows of one value of `by` come together. The number of files depends on the rows, not on the values of `by`; one pass deals the rows, another writes each file from its own part.
    """
    spark = rows.sparkSession
    path, dealt = shared_path(spark, name), shared_path(spark, f"{name}-dealt")
    rows = rows.where(F.col(by).isNotNull())
    n = max(ARRIVALS, math.ceil(rows.count() / ARRIVAL_ROWS))
    bounds = rows.agg(F.percentile_approx(by, [k / n for k in range(1, n)], 10 * n)).first()[0] or []
    arrival = F.lit(0)
    if bounds := sorted(set(bounds)):
        arrival = F.aggregate(F.array(*map(F.lit, bounds)), F.lit(0), lambda a, b: a + (F.col(by) > b).cast("int"))
    rows.withColumn("arrival", arrival).drop(by).repartition(len(bounds) + 1, "arrival").write.partitionBy("arrival").parquet(dealt)
    parts = spark.read.parquet(dealt)
    for (k,) in sorted(parts.select("arrival").distinct().collect()):
        parts.where(F.col("arrival") == k).drop("arrival").coalesce(1).write.mode("append").parquet(path)
    drop_table(spark, dealt)
    return path


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the batches whose progress is kept (spark.sql.streaming.numRecentProgressUpdates)."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def run_through(stream: DataFrame, name: str) -> tuple[DataFrame, StreamingQuery]:
    """What the stream gives for all that is there now, as a table, and the ended query."""
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), query


def drained(stream: DataFrame, name: str) -> DataFrame:
    return run_through(stream, name)[0]


def tumbling(events: DataFrame, ts: str, length: str, delay: str = "1 hour", start: str = "0 seconds") -> DataFrame:
    """(start, end, event_type, n, mean, std) per window and type, once the watermark has passed it."""
    return sliding(events, ts, length, length, delay, start)


def sliding(events: DataFrame, ts: str, length: str, slide: str, delay: str = "1 hour", start: str = "0 seconds") -> DataFrame:
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    w = F.window(ts, length, slide, start)
    out = rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean", "std")


def sessions(events: DataFrame, ts: str, key: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """(key, start, end, n): events of a key with pauses shorter than the gap."""
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


#: Epochs last 72 hours from the anchor on; before it, a day.
ANCHOR = "2026-05-12 20:00:00"


def epoch(df: DataFrame, ts: str, anchor: str = ANCHOR) -> DataFrame:
    """df with epoch_start, epoch_end and seconds_left; both kinds of epoch start at the anchor's time of day."""
    at, zero = F.unix_timestamp(ts), F.unix_timestamp(F.lit(anchor).cast("timestamp"))
    length = F.when(at >= zero, 72 * 3600).otherwise(24 * 3600)
    begin = at - F.pmod(at - zero, length)
    return df.withColumns({"epoch_start": F.timestamp_seconds(begin), "epoch_end": F.timestamp_seconds(begin + length), "seconds_left": begin + length - at})


def deduplicated_log(events: DataFrame, ts: str, key: str, delay: str = "1 hour") -> DataFrame:
    """Each record of a log once, within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def score_log(messages: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, at: str, delay: str = "1 day", name: str = "score_log") -> DataFrame:
    """A log that only grows, with a row per key: each micro-batch's new messages are scored as a table and written under the batch's number.

    A message holds a whole request; score turns messages into one row per key, such as features and a score. Which keys have been logged is state of the stream, kept for `delay`
    after a message's time, so the work of a batch does not depend on the length of the log. A batch that is run again after a failure writes
    its own folder anew and adds nothing. Messages without a key are left out.
    """
    spark = messages.sparkSession
    path, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    schema = score(spark.createDataFrame([], messages.schema)).schema
    spark.createDataFrame([], schema).write.parquet(f"{path}/start")
    new = messages.where(F.col(key).isNotNull()).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    new.writeStream.foreachBatch(lambda batch, number: put_batch(score(batch).select(*schema.names), path, number)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return read_log(spark, path, schema)


def put_batch(rows: DataFrame, path: str, number: int) -> None:
    """Write a batch's rows in its own folder, in place of what an earlier try left there."""
    rows.write.mode("overwrite").parquet(f"{path}/batch-{number:012d}")


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
