"""Engagement operators on hand-made tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillworks.operators import brands, counters, engagement as e, lists, ordering
from quillworks.sources.sinks import chart_payload

T0 = dt.datetime(2026, 1, 5)


@pytest.fixture(scope="module")
def tables(spark):
    """u1: two drafts, posts with three, one and no snapshots; u2: draft without posts; u3: nothing."""

    def table(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return {
        "users": table("user_id string, role string", ("u1", "writer"), ("u2", "writer"), ("u3", "admin")),
        "drafts": table(
            "draft_id string, client_id string, created_by string, draft_title string, draft_status string, created_at date",
            ("d1", "c1", "u1", "one", "draft", dt.date(2026, 1, 1)),
            ("d2", "c2", "u1", "two", "draft", dt.date(2026, 1, 1)),
            ("d3", "c2", "u2", "three", "draft", dt.date(2026, 1, 2)),
        ),
        "posts": table(
            "post_id string, draft_id string, platform string, repurposed_content string, status string, created_at timestamp_ntz",
            ("p1", "d1", "twitter", "x" * 200, "published", T0),
            ("p2", "d1", "linkedin", "short", "approved", T0),
            ("p3", "d2", "twitter", "", "rejected", T0),
            ("p4", "d2", "facebook", "none", "pending_approval", T0),
        ),
        "logs": spark.createDataFrame(
            [
                ("p1", 100, 1, 2, 3, "1.00", T0),
                ("p1", 200, 4, 5, 6, "2.00", T0 + dt.timedelta(days=1)),
                ("p1", 300, 7, 8, 9, "6.01", T0 + dt.timedelta(days=7)),
                ("p2", 50, 1, 0, 0, "6.01", T0),
                ("p3", 10, 0, 0, 0, None, T0),
            ],
            "post_id string, views int, likes int, comments int, shares int, engagement_rate string, recorded_at timestamp_ntz",
        ).withColumn("engagement_rate", F.col("engagement_rate").cast("decimal(5,2)")),
    }


@pytest.fixture(scope="module")
def totals(tables):
    return e.author_platform_totals(tables["posts"], tables["drafts"], tables["logs"])


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_overview(tables, totals):
    rows = by(e.overview(tables["users"], totals), "user_id")
    assert tuple(rows["u1"]) == ("u1", 4, 660, 46, 3.76)  # mean of 1.00, 2.00, 6.01, 6.01 is 3.755
    assert tuple(rows["u2"]) == ("u2", 0, 0, 0, 0.0)
    assert tuple(rows["u3"]) == ("u3", 0, 0, 0, 0.0)


def test_by_platform_keeps_posts_without_snapshots(totals):
    rows = by(e.by_platform(totals), "user_id", "platform")
    assert len(rows) == 3
    twitter = rows["u1", "twitter"]
    assert (twitter.post_count, twitter.likes, twitter.total, twitter.avg_rate) == (2, 12, 45, 3.0)
    facebook = rows["u1", "facebook"]
    assert (facebook.post_count, facebook.total, facebook.avg_rate) == (1, 0, 0.0)


def test_latest_snapshots_option(tables):
    latest = e.author_platform_totals(tables["posts"], tables["drafts"], tables["logs"], snapshots="latest")
    twitter = by(e.by_platform(latest), "user_id", "platform")["u1", "twitter"]
    assert (twitter.likes, twitter.avg_rate) == (7, 6.01)
    with pytest.raises(ValueError):
        e.author_platform_totals(tables["posts"], tables["drafts"], tables["logs"], snapshots="first")


def test_best_platform(tables, totals):
    rows = by(e.best_platforms(tables["users"], e.by_platform(totals)), "user_id")
    assert (rows["u1"].best_platform, rows["u1"].badge) == ("linkedin", "Linkedin")
    assert (rows["u2"].best_platform, rows["u2"].badge) == (None, "None yet")


def test_top_posts_rank_ties_by_id(tables):
    rows = e.top_posts(tables["posts"], tables["drafts"], tables["logs"]).orderBy("rank").collect()
    assert [(r.rank, r.post_id, r.engagement_rate) for r in rows] == [(1, "p1", 6.01), (2, "p2", 6.01), (3, "p3", 0.0)]
    assert rows[0].preview == "x" * 120 + "..."
    assert rows[2].preview == "..."
    assert e.top_posts(tables["posts"], tables["drafts"], tables["logs"], limit=1).count() == 1


def test_platform_means_count_snapshots(tables):
    rows = by(e.platform_means(tables["posts"], tables["logs"]), "platform")
    assert rows["twitter"].post_count == 4
    assert rows["twitter"].avg_engagement == 3.0


def test_latest_snapshot_per_post(tables):
    rows = by(e.latest_snapshots(tables["logs"]), "post_id")
    assert rows["p1"].views == 300 and len(rows) == 3


def test_weekly_best_platform(tables):
    rows = by(e.weekly_best_platforms(tables["posts"], tables["drafts"], tables["logs"]), "client_id", "week")
    assert rows["c1", dt.date(2026, 1, 5)].best_platform == "linkedin"
    assert rows["c1", dt.date(2026, 1, 12)].best_platform == "twitter"
    recent = e.last_days_best_platforms(
        tables["posts"], tables["drafts"], tables["logs"], F.lit("2026-01-12 00:00:00").cast("timestamp_ntz")
    )
    assert by(recent, "client_id")["c1"].snapshots == 1  # linkedin 6.01 beats twitter 3.00


def test_end_date_of_a_week_counts_in_full(spark, tables):
    recommendations = spark.createDataFrame(
        [("r1", "c1", dt.date(2025, 12, 30), dt.date(2026, 1, 5)), ("r2", "c2", dt.date(2026, 1, 5), dt.date(2026, 1, 11))],
        "recommendation_id string, client_id string, week_start_date date, week_end_date date",
    )
    late = tables["logs"].withColumn("recorded_at", F.col("recorded_at") + F.expr("INTERVAL 10 HOURS"))
    rows = e.snapshots_in_weeks(tables["posts"], tables["drafts"], late, recommendations).collect()
    assert sorted((r.recommendation_id, r.post_id) for r in rows) == [("r1", "p1"), ("r1", "p2"), ("r2", "p3")]
    sums = by(e.week_engagement(tables["posts"], tables["drafts"], late, recommendations), "recommendation_id")
    assert (sums["r1"].views, sums["r1"].snapshots) == (150, 2)


def test_status_tabs_have_zeros(tables):
    rows = by(counters.status_tabs(tables["users"], tables["posts"], tables["drafts"]), "user_id")
    assert rows["u1"].all_posts == 4 and rows["u1"].scheduled == 0 and rows["u1"].published == 1
    assert rows["u3"].all_posts == 0
    breakdown = counters.status_breakdown(tables["posts"], tables["drafts"]).collect()
    assert len(breakdown) == 4


def test_dashboard_and_flags(tables):
    dashboard = counters.dashboard_counters(tables["users"], tables["drafts"], tables["posts"])
    rows = by(dashboard, "user_id")
    assert tuple(rows["u1"]) == ("u1", 2, 4, 1, 1)
    assert rows["u3"].total_drafts == 0
    flags = by(counters.workflow_flags(dashboard), "user_id")
    assert tuple(flags["u3"]) == ("u3", "todo", "done", "todo", "todo")
    empty = counters.dashboard_counters(tables["users"], tables["drafts"], tables["posts"].limit(0))
    assert tuple(by(empty, "user_id")["u1"]) == ("u1", 2, 0, 0, 0)


def test_drafts_page(spark, tables):
    clients = spark.createDataFrame([("c1", "Acme")], "client_id string, client_name string")
    page = counters.drafts_page(tables["drafts"], clients, tables["posts"])
    rows = by(page, "draft_id")
    assert (rows["d1"].rank, rows["d1"].post_count, rows["d1"].client_name) == (1, 2, "Acme")
    assert (rows["d3"].post_count, rows["d3"].client_name) == (0, None)
    assert counters.newest_drafts(tables["drafts"], clients, limit=1).count() == 2


def test_queue_line(spark, tables):
    assert counters.queue_length(tables["posts"]).first().line == "1 post waiting for your review"
    assert counters.queue_length(tables["posts"].limit(0)).first().line == "All caught up!"


def test_latest_remark_may_be_null(spark):
    approvals = spark.createDataFrame(
        [
            ("a1", "p1", "fix it", T0),
            ("a2", "p1", None, T0 + dt.timedelta(hours=1)),
            ("a3", "p2", "first", T0),
            ("a4", "p2", "second", T0),
        ],
        "approval_id string, post_id string, remarks string, approval_date timestamp_ntz",
    )
    rows = by(lists.latest_remarks(approvals), "post_id")
    assert rows["p1"].latest_remarks is None
    assert rows["p2"].latest_remarks == "second"


def test_latest_recommendation(spark, tables):
    recommendations = spark.createDataFrame(
        [("r1", "c1", T0, "a"), ("r2", "c2", T0, "b"), ("r3", "c9", T0 + dt.timedelta(days=9), "c")],
        "recommendation_id string, client_id string, created_at timestamp_ntz, recommendation_text string",
    )
    rows = by(e.latest_recommendations(recommendations, tables["drafts"]), "user_id")
    assert rows["u1"].recommendation_id == "r2" and rows["u2"].recommendation_id == "r2" and "u3" not in rows


def test_chart_payload(tables, totals):
    payload = chart_payload(
        e.by_platform(totals), counters.status_breakdown(tables["posts"], tables["drafts"]), e.overview(tables["users"], totals)
    )
    rows = by(payload, "user_id")
    assert rows["u3"].payload == '{"hasPosts":false,"platforms":[],"statuses":[]}'
    assert rows["u1"].payload.startswith('{"hasPosts":true,"platforms":[{"platform":"linkedin"')


def test_best_first_brand(tables):
    assert by(brands.first_brand_of_authors(tables["drafts"]), "user_id")["u1"].client_id == "c1"


def test_newest_first_breaks_ties_by_key(tables):
    ids = [r.post_id for r in ordering.newest_first(tables["posts"], "created_at", "post_id").collect()]
    assert ids == ["p1", "p2", "p3", "p4"]


def test_analytics_screen_parts(spark, tables, totals):
    recommendations = spark.createDataFrame(
        [("r1", "c1", T0)], "recommendation_id string, client_id string, created_at timestamp_ntz"
    )
    screen = e.analytics_screen(
        tables["users"], tables["posts"], tables["drafts"], tables["logs"], recommendations
    )
    assert sorted(screen["overview"].collect()) == sorted(e.overview(tables["users"], totals).collect())
    assert {r.user_id for r in screen["recommendation"].collect()} == {"u1"}
    assert screen["top_posts"].count() == 3 and screen["statuses"].count() == 4
    assert by(screen["best_platform"], "user_id")["u1"].badge == "Linkedin"


def test_sliding_best_platform_of_gaps_ties_and_nulls(spark):
    """Against sums in Python: gaps, a post listed twice, ties, missing rates, platforms, brands and days."""
    drafts = spark.createDataFrame([("d1", "c1"), ("d2", None), ("d2", "c2")], "draft_id string, client_id string")
    listed = [("p1", "d1", "twitter"), ("p2", "d1", "linkedin"), ("p2", "d1", "linkedin"), ("p3", "d1", None), ("p4", "d2", "tiktok")]
    days = {"p1": [0, 0, 3, 20], "p2": [0, 5, 6, 13], "p3": [6, 40, None], "p4": [1, 9, None, None]}
    snapshots = [
        (post, None if (i, post) == (3, "p1") else f"{(i * 7 + n * 3) % 5}.50", None if day is None else T0 + dt.timedelta(days=day, hours=5 * i))
        for n, (post, at) in enumerate(days.items())
        for i, day in enumerate(at)
    ]
    posts = spark.createDataFrame(listed, "post_id string, draft_id string, platform string")
    logs = spark.createDataFrame(snapshots, "post_id string, engagement_rate string, recorded_at timestamp_ntz")
    logs = logs.withColumn("engagement_rate", F.col("engagement_rate").cast("decimal(5,2)"))
    groups = {}
    for post, draft, platform in listed:
        for brand in ["c1"] if draft == "d1" else [None, "c2"]:
            for snapshot_post, rate, at in snapshots:
                if snapshot_post == post:
                    for last in [None] if at is None else [at.date() + dt.timedelta(days=k) for k in range(7)]:
                        groups.setdefault((brand, last), {}).setdefault(platform, []).append(rate)
    expected = set()
    for (brand, last), platforms in groups.items():
        def mean(rates):
            known = [float(r) for r in rates if r is not None]
            return sum(known) / len(known) if known else 0.0
        best = min(platforms, key=lambda p: (-mean(platforms[p]), p is not None, p or ""))
        expected.add((brand, last, best, int(mean(platforms[best]) * 100 + 0.5 + 1e-9) / 100, len(platforms[best])))
    got = [tuple(r) for r in e.sliding_best_platforms(posts, drafts, logs).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
