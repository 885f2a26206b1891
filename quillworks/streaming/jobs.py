"""Structured Streaming jobs over the append-only tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillworks.functions.measures import mean_rate, shown_rate
from quillworks.plans.outcome import written
from quillworks.plans.reviews import apply_decisions
from quillworks.streaming.levels import Levels

# Windows are counted from a Thursday; four days later is a Monday.
WEEK = {"windowDuration": "7 days", "startTime": "4 days"}


def stream_parquet(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Files of a Parquet table as a stream, with the schema they have now.

    The path may name a folder or a single file. A stream takes a file only
    through a pattern, so the last character is turned into one.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    bare = path.rstrip("/")
    return reader.parquet(f"{bare[:-1]}[{bare[-1]}]")


def with_event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Stream with a watermark on a time column; zone-less times and dates count as UTC.

    The instant is computed from the distance to the epoch, so the session's zone has no say.
    """
    if stream.schema[column].dataType.typeName() != "timestamp":
        zoneless = f"CAST({column} AS TIMESTAMP_NTZ)"
        instant = f"TIMESTAMP_LTZ '1970-01-01 00:00:00Z' + ({zoneless} - TIMESTAMP_NTZ '1970-01-01 00:00:00')"
        stream = stream.withColumn(column, F.expr(instant))
    return stream.withWatermark(column, delay)


def utc_date(instant: Column) -> Column:
    """Date of an instant in UTC, whatever the session's zone."""
    days = F.floor(F.unix_seconds(instant) / 86400).cast("int")
    return F.date_add(F.lit(datetime.date(1970, 1, 1)), days)


def post_brands(posts: DataFrame, drafts: DataFrame) -> DataFrame:
    """Brand and platform of every post. Store it once for a stream, which reads it per micro-batch."""
    owned = drafts.select("draft_id", "client_id")
    return posts.select("post_id", "draft_id", "platform").join(owned, "draft_id").drop("draft_id")


def weekly_rollup(logs: DataFrame, brands: DataFrame, delay: str | None = "1 day") -> DataFrame:
    """Engagement per brand, platform and week (from Monday) of a snapshot stream.

    ``brands`` comes from :func:`post_brands`. A stream that has its watermark already is given with
    ``delay=None``. A week is emitted once the
    watermark has passed its end; later rows for it are dropped. Snapshots are summed
    per post and week before posts meet their brands, so a post with a large share
    of the stream is one row there. State is one row per open (week, post).
    The batch that closes weeks reads no files, so Spark takes its post sums for an empty table and would
    broadcast all of them through the driver; the hint has both sides shuffled.
    """
    timed = logs if delay is None else with_event_time(logs, "recorded_at", delay)
    per_post = (
        timed
        .groupBy(F.window("recorded_at", **WEEK).alias("week"), "post_id")
        .agg(
            F.sum("engagement_rate").alias("post_total"),
            F.count("engagement_rate").alias("post_count"),
            F.count("*").alias("post_snapshots"),
        )
    )
    return (
        per_post.join(brands.hint("merge"), "post_id")
        .groupBy(F.window(F.window_time("week"), **WEEK).alias("week"), "client_id", "platform")
        .agg(
            F.sum("post_total").alias("rate_total"),
            F.sum("post_count").alias("rate_count"),
            F.sum("post_snapshots").alias("snapshots"),
        )
        .select(
            utc_date(F.col("week.start")).alias("week_start"),
            "client_id",
            "platform",
            shown_rate(mean_rate(F.col("rate_total"), F.col("rate_count"))).alias("avg_rate"),
            "snapshots",
        )
    )


def deduplicated(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Every key once, however often it is delivered within the watermark."""
    return with_event_time(stream, time, delay).dropDuplicatesWithinWatermark([key])


def deduplicated_rollup(logs: DataFrame, brands: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """Weekly engagement of a stream that delivers some snapshots more than once.

    Three stateful steps in one query: a snapshot is taken once per ``key``, then summed per post and
    week, then per brand and platform. One watermark is set in front and each step passes its own on: a snapshot behind it
    is dropped before it can count, a key is forgotten once its time is behind it, and a week is
    emitted when the step before can no longer add to it.
    """
    return weekly_rollup(deduplicated(logs, key, "recorded_at", delay), brands, delay=None)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available now into Parquet files and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def decision_levels(spark: SparkSession, folder: str) -> Levels:
    """The newest decision per post that a decision stream has written, in levels."""
    return Levels(spark, folder, "post_id", "newest")


def start_decisions(
    requests: DataFrame, users: DataFrame, posts: DataFrame, folder: str, checkpoint: str
) -> StreamingQuery:
    """Apply a stream of review decisions.

    Every micro-batch is judged once and written; from that come its approval rows, in a folder
    named after the run and the batch, and the decision that counts per post, as a part of
    :func:`decision_levels`. A repeated attempt of the run replaces its approvals. After a restart the batch numbers of
    a lost checkpoint may mean other requests, so no run touches the approvals of another one. What two
    runs wrote twice is told apart on reading: :func:`streamed_approvals` keeps each approval once, and
    the newest change of a post counts. Posts are not rewritten per batch;
    ``sources.sinks.write_version`` stores the merged result when wanted.
    """
    run = uuid.uuid4().hex
    levels = decision_levels(posts.sparkSession, folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        outcome = apply_decisions(batch, users, posts.select("post_id", "status"), stage=written)
        rows = outcome.appended["approvals"]
        rows.write.mode("overwrite").parquet(f"{folder}/approvals/run={run}/batch={batch_id}")
        newest = F.struct("request_time", "request_id", "approval_status").alias("newest")
        levels.add(outcome.accepted.select("post_id", newest))

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def streamed_approvals(spark: SparkSession, folder: str) -> DataFrame:
    """Approvals that the decision stream wrote, each once, however many runs delivered it."""
    rows = spark.read.parquet(f"{folder}/approvals").drop("run", "batch")
    return rows.dropDuplicates(["approval_id"])


def current_posts(posts: DataFrame, changes: DataFrame) -> DataFrame:
    """Posts with the newest streamed decision of each; ``changes`` is what :func:`decision_levels` reads."""
    newest = changes.groupBy("post_id").agg(F.max("newest").alias("newest"))
    return (
        posts.join(newest, "post_id", "left")
        .withColumn("status", F.coalesce("newest.approval_status", "status"))
        .select(*posts.columns)
    )
