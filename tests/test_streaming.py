"""Streams equal their batch form for everything the watermark has passed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillworks.operators.engagement import weekly_platform_totals
from quillworks.plans.reviews import apply_decisions
from quillworks.streaming import jobs

MONDAY = dt.datetime(2026, 1, 5)
LOGS = "analytics_id string, post_id string, engagement_rate decimal(5,2), views int, likes int, comments int, shares int, recorded_at timestamp_ntz"


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame([("p1", "d1", "twitter"), ("p2", "d2", "tiktok")], "post_id string, draft_id string, platform string")


@pytest.fixture(scope="module")
def drafts(spark):
    return spark.createDataFrame([("d1", "c1"), ("d2", "c1")], "draft_id string, client_id string")


def write(spark, path, schema, rows):
    """One file per call, older first."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def log(ident, post, rate, at):
    from decimal import Decimal

    return (ident, post, Decimal(rate), 1, 1, 1, 1, at)


@pytest.fixture
def log_files(spark, tmp_path):
    path = str(tmp_path / "logs")
    write(spark, path, LOGS, [log("l1", "p1", "1.00", MONDAY), log("l2", "p1", "2.00", MONDAY + dt.timedelta(days=6, hours=23)), log("l3", "p2", "3.00", MONDAY + dt.timedelta(days=7))])
    write(spark, path, LOGS, [log("l4", "p1", "4.00", MONDAY + dt.timedelta(days=15)), log("l5", "p2", "1.00", MONDAY + dt.timedelta(days=14))])
    write(spark, path, LOGS, [log("l7", "p1", "5.00", MONDAY + dt.timedelta(days=16))])
    # A row for the first week. Lateness is judged by the watermark of the batch before.
    write(spark, path, LOGS, [log("l6", "p1", "9.00", MONDAY + dt.timedelta(days=1))])
    return path


def test_weekly_rollup(spark, tmp_path, posts, drafts, log_files):
    stream = jobs.stream_parquet(spark, log_files, files_per_batch=1)
    out = str(tmp_path / "out")
    jobs.write_available(jobs.weekly_rollup(stream, jobs.post_brands(posts, drafts)), out, str(tmp_path / "checkpoint"))
    got = {(r.week_start, r.platform): (r.avg_rate, r.snapshots) for r in spark.read.parquet(out).collect()}
    week = F.date_trunc("week", F.col("recorded_at")).cast("date")
    on_time = spark.read.parquet(log_files).filter("analytics_id <> 'l6'")
    batch = {
        (r.week, r.platform): (float(r.rate_total / r.rate_count), r.snapshots)
        for r in weekly_platform_totals(posts, drafts, on_time, week).collect()
    }
    open_week = dt.date(2026, 1, 19)
    assert got == {k: v for k, v in batch.items() if k[0] != open_week}
    assert got[dt.date(2026, 1, 5), "twitter"] == (1.5, 2)
    assert any(k[0] == open_week for k in batch)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_weeks_start_on_monday_in_any_zone(spark, tmp_path, posts, drafts, log_files, zone):
    out, before = str(tmp_path / "out"), spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        stream = jobs.stream_parquet(spark, log_files, files_per_batch=1)
        jobs.write_available(jobs.weekly_rollup(stream, jobs.post_brands(posts, drafts)), out, str(tmp_path / "checkpoint"))
        got = {(r.week_start, r.platform): r.snapshots for r in spark.read.parquet(out).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got[dt.date(2026, 1, 5), "twitter"] == 2 and got[dt.date(2026, 1, 12), "tiktok"] == 1
    assert all(week.weekday() == 0 for week, _ in got)


def test_a_hot_post_meets_its_brand_as_one_row(spark, posts, drafts, log_files):
    stream = jobs.stream_parquet(spark, log_files)
    plan = jobs.weekly_rollup(stream, jobs.post_brands(posts, drafts))._jdf.queryExecution().logical().toString()
    assert plan.index("Aggregate") < plan.index("Join") < plan.rindex("Aggregate")


def test_closed_weeks_do_not_pass_the_driver(spark, tmp_path, posts, drafts, log_files):
    """The last batch has no new files and emits what the state holds."""
    rollup = jobs.weekly_rollup(jobs.stream_parquet(spark, log_files), jobs.post_brands(posts, drafts))
    writer = rollup.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint"))
    query = writer.trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert query.lastProgress["numInputRows"] == 0 and spark.read.parquet(str(tmp_path / "out")).count() > 0
    plan = query._jsq.explainInternal(False)
    assert "SortMergeJoin [post_id" in plan and "BroadcastExchange" not in plan.split("SortMergeJoin [post_id")[0]


def test_duplicates_are_delivered_once(spark, tmp_path):
    path, out = str(tmp_path / "logs"), str(tmp_path / "out")
    write(spark, path, LOGS, [log("l1", "p1", "1.00", MONDAY), log("l1", "p1", "1.00", MONDAY)])
    write(spark, path, LOGS, [log("l1", "p1", "1.00", MONDAY), log("l2", "p1", "1.00", MONDAY)])
    stream = jobs.stream_parquet(spark, path, files_per_batch=1)
    jobs.write_available(jobs.deduplicated(stream, "analytics_id", "recorded_at"), out, str(tmp_path / "checkpoint"))
    assert sorted(r.analytics_id for r in spark.read.parquet(out).collect()) == ["l1", "l2"]


REQUESTS = "request_id long, request_time timestamp_ntz, user_id string, post_id string, approval_status string, remarks string"


def test_decision_stream_equals_batch(spark, tmp_path):
    path, folder = str(tmp_path / "requests"), str(tmp_path / "state")
    write(spark, path, REQUESTS, [(1, MONDAY, "m", "p1", "rejected", ""), (2, MONDAY, "w", "p2", "approved", "")])
    write(spark, path, REQUESTS, [(4, MONDAY, "m", "p1", "approved", "x"), (3, MONDAY, "m", "p1", "request_edit", ""), (5, MONDAY, "m", "p9", "approved", "")])
    users = spark.createDataFrame([("m", "manager"), ("w", "writer")], "user_id string, role string")
    posts = spark.createDataFrame([("p1", "pending_approval"), ("p2", "pending_approval")], "post_id string, status string")
    stream = jobs.stream_parquet(spark, path, files_per_batch=1)
    for _ in range(2):  # the second run finds nothing new
        jobs.start_decisions(stream, users, posts, folder, str(tmp_path / "checkpoint")).awaitTermination()
    batch = apply_decisions(spark.read.parquet(path), users, posts)
    now = jobs.current_posts(posts, jobs.decision_levels(spark, folder).read())
    assert sorted(now.collect()) == sorted(batch.tables["posts"].collect())
    approvals = jobs.streamed_approvals(spark, folder)
    assert sorted(approvals.collect(), key=str) == sorted(batch.appended["approvals"].collect(), key=str)


def test_batches_take_effect_once(spark, tmp_path):
    """After a lost checkpoint, with another batch size, nothing counts twice and nothing is lost."""
    path, folder = str(tmp_path / "requests"), str(tmp_path / "state")
    write(spark, path, REQUESTS, [(1, MONDAY, "m", "p1", "rejected", "")])
    write(spark, path, REQUESTS, [(2, MONDAY + dt.timedelta(days=1), "m", "p1", "approved", "")])
    users = spark.createDataFrame([("m", "manager")], "user_id string, role string")
    posts = spark.createDataFrame([("p1", "pending_approval")], "post_id string, status string")
    for attempt, files in enumerate((1, None, 1)):
        stream = jobs.stream_parquet(spark, path, files_per_batch=files)
        jobs.start_decisions(stream, users, posts, folder, str(tmp_path / f"checkpoint{attempt}")).awaitTermination()
        assert jobs.streamed_approvals(spark, folder).count() == 2
        now = jobs.current_posts(posts, jobs.decision_levels(spark, folder).read())
        assert now.first().status == "approved"


def test_zone_less_time_gets_a_watermark(spark, log_files):
    stream = jobs.with_event_time(jobs.stream_parquet(spark, log_files), "recorded_at", "1 day")
    assert stream.isStreaming and stream.schema["recorded_at"].dataType.simpleString() == "timestamp"
