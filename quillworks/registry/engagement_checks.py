"""Engagement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillworks.operators import brands, engagement as e
from quillworks.operators.skew import salted_join
from quillworks.registry.checks import AS_OF, check, mean6, shown, timestamp
from quillworks.sources.sinks import chart_payload

ALL = ("users", "content_drafts", "posts", "analytics_logs")

# One row per snapshot with its post and author; posts without snapshots keep one row.
AUTHOR_ROWS = """
author_rows AS (
  SELECT cd.created_by AS user_id, cd.client_id, p.post_id, p.platform, p.status, al.views, al.likes,
         al.comments, al.shares, al.engagement_rate, al.recorded_at
  FROM posts p JOIN content_drafts cd ON cd.draft_id = p.draft_id
  LEFT JOIN analytics_logs al ON al.post_id = p.post_id)
"""
PLATFORM_ROWS = f"""
{AUTHOR_ROWS},
platform_rows AS (
  SELECT user_id, platform, count(DISTINCT post_id) AS post_count,
         CAST(COALESCE(sum(likes), 0) AS BIGINT) AS likes,
         CAST(COALESCE(sum(comments), 0) AS BIGINT) AS comments,
         CAST(COALESCE(sum(shares), 0) AS BIGINT) AS shares,
         {mean6("sum(engagement_rate)", "count(engagement_rate)")} AS mean
  FROM author_rows GROUP BY user_id, platform)
"""


def _totals(t, **options):
    return e.author_platform_totals(t.posts, t.content_drafts, t.analytics_logs, **options)


@check(
    "a1_engagement_overview",
    *ALL,
    sql=f"""
WITH {AUTHOR_ROWS}
SELECT u.user_id, count(DISTINCT r.post_id) AS total_posts,
       CAST(COALESCE(sum(r.views), 0) AS BIGINT) AS total_views,
       CAST(COALESCE(sum(r.likes + r.comments + r.shares), 0) AS BIGINT) AS total_engagement,
       {shown(mean6("sum(r.engagement_rate)", "count(r.engagement_rate)"))} AS avg_engagement
FROM users u LEFT JOIN author_rows r ON r.user_id = u.user_id
GROUP BY u.user_id""",
)
def a1(t):
    return e.overview(t.users, _totals(t))


@check(
    "a2_engagement_by_platform",
    *ALL,
    sql=f"""
WITH {PLATFORM_ROWS}
SELECT user_id, platform, post_count, likes, comments, shares, {shown("mean")} AS avg_rate,
       likes + comments + shares AS total
FROM platform_rows""",
)
def a2(t):
    return e.by_platform(_totals(t)).drop("mean_rate")


@check(
    "a2_engagement_by_platform_latest_snapshots",
    *ALL,
    sql=f"""
WITH newest AS (
  SELECT post_id, likes, comments, shares, engagement_rate,
         row_number() OVER (PARTITION BY post_id ORDER BY recorded_at DESC, views DESC, likes DESC,
                            comments DESC, shares DESC, engagement_rate DESC) AS rn
  FROM analytics_logs),
rows_ AS (
  SELECT cd.created_by AS user_id, p.platform, p.post_id, n.likes, n.comments, n.shares, n.engagement_rate
  FROM posts p JOIN content_drafts cd ON cd.draft_id = p.draft_id
  LEFT JOIN newest n ON n.post_id = p.post_id AND n.rn = 1),
grouped AS (
  SELECT user_id, platform, count(DISTINCT post_id) AS post_count,
         CAST(COALESCE(sum(likes), 0) AS BIGINT) AS likes,
         CAST(COALESCE(sum(comments), 0) AS BIGINT) AS comments,
         CAST(COALESCE(sum(shares), 0) AS BIGINT) AS shares,
         {mean6("sum(engagement_rate)", "count(engagement_rate)")} AS mean
  FROM rows_ GROUP BY user_id, platform)
SELECT user_id, platform, post_count, likes, comments, shares, {shown("mean")} AS avg_rate,
       likes + comments + shares AS total
FROM grouped""",
)
def a2_latest(t):
    return e.by_platform(_totals(t, snapshots="latest")).drop("mean_rate")


@check(
    "a4_post_totals",
    "posts",
    "analytics_logs",
    sql="""
SELECT p.post_id, p.platform, p.repurposed_content,
       CAST(sum(al.likes) AS BIGINT) AS likes, CAST(sum(al.comments) AS BIGINT) AS comments,
       CAST(sum(al.shares) AS BIGINT) AS shares,
       CAST(max(al.engagement_rate) AS DOUBLE) AS engagement_rate
FROM posts p JOIN analytics_logs al ON al.post_id = p.post_id
GROUP BY p.post_id, p.platform, p.repurposed_content""",
)
def a4(t):
    scores = e.post_scores(t.posts.select("*"), t.analytics_logs)
    texts = t.posts.select("post_id", "repurposed_content")
    return scores.join(texts, "post_id").select(
        "post_id", "platform", "repurposed_content", "likes", "comments", "shares",
        F.col("best_rate").alias("engagement_rate"),
    )


@check(
    "a9_platform_mean_engagement",
    "posts",
    "analytics_logs",
    sql=f"""
SELECT p.platform, {shown(mean6("sum(al.engagement_rate)", "count(al.engagement_rate)"))} AS avg_engagement,
       count(*) AS post_count
FROM analytics_logs al JOIN posts p ON al.post_id = p.post_id
GROUP BY p.platform""",
)
def a9(t):
    return e.platform_means(t.posts, t.analytics_logs)


@check(
    "a14_best_platform",
    *ALL,
    sql=f"""
WITH {PLATFORM_ROWS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean DESC, platform) AS rn
  FROM platform_rows)
SELECT u.user_id, r.platform AS best_platform, {shown("r.mean")} AS avg_rate,
       COALESCE(concat(upper(substring(r.platform, 1, 1)), substring(r.platform, 2)), 'None yet') AS badge
FROM users u LEFT JOIN ranked r ON r.user_id = u.user_id AND r.rn = 1""",
)
def a14(t):
    return e.best_platforms(t.users, e.by_platform(_totals(t)))


WEEKLY = f"""
weekly AS (
  SELECT cd.client_id, CAST(date_trunc('week', al.recorded_at) AS DATE) AS week, p.platform,
         {mean6("sum(al.engagement_rate)", "count(al.engagement_rate)")} AS mean, count(*) AS snapshots
  FROM analytics_logs al JOIN posts p ON p.post_id = al.post_id
  JOIN content_drafts cd ON cd.draft_id = p.draft_id
  GROUP BY 1, 2, 3)
"""


@check(
    "a16_weekly_best_platform",
    *ALL[1:],
    sql=f"""
WITH {WEEKLY},
ranked AS (SELECT *, row_number() OVER (PARTITION BY client_id, week ORDER BY mean DESC, platform) AS rn
           FROM weekly)
SELECT client_id, CAST(week AS VARCHAR) AS week, platform AS best_platform, {shown("mean")} AS avg_rate,
       snapshots
FROM ranked WHERE rn = 1""",
)
def a16(t):
    return e.weekly_best_platforms(t.posts, t.content_drafts, t.analytics_logs)


@check(
    "a16_sliding_best_platform",
    *ALL[1:],
    sql=f"""
WITH daily AS (
  SELECT cd.client_id, p.platform, CAST(al.recorded_at AS DATE) AS day, al.engagement_rate
  FROM analytics_logs al JOIN posts p ON p.post_id = al.post_id JOIN content_drafts cd ON cd.draft_id = p.draft_id),
grouped AS (
  SELECT client_id, day + CAST(after AS INTEGER) AS last_day, platform,
         {mean6("sum(engagement_rate)", "count(engagement_rate)")} AS mean, count(*) AS snapshots
  FROM daily, unnest(range(7)) AS t(after) GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY client_id, last_day ORDER BY mean DESC, platform) AS rn FROM grouped)
SELECT client_id, CAST(CAST(last_day AS DATE) AS VARCHAR) AS last_day, platform AS best_platform,
       {shown("mean")} AS avg_rate, CAST(snapshots AS BIGINT) AS snapshots
FROM ranked WHERE rn = 1""",
)
def a16_sliding(t):
    return e.sliding_best_platforms(t.posts, t.content_drafts, t.analytics_logs)


@check(
    "a16_last_seven_days_best_platform",
    *ALL[1:],
    sql=f"""
WITH grouped AS (
  SELECT cd.client_id, p.platform,
         {mean6("sum(al.engagement_rate)", "count(al.engagement_rate)")} AS mean, count(*) AS snapshots
  FROM analytics_logs al JOIN posts p ON p.post_id = al.post_id
  JOIN content_drafts cd ON cd.draft_id = p.draft_id
  WHERE al.recorded_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND al.recorded_at <= TIMESTAMP '{AS_OF}'
  GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY mean DESC, platform) AS rn
           FROM grouped)
SELECT client_id, '{AS_OF[:10]}' AS as_of_date, platform AS best_platform, {shown("mean")} AS avg_rate,
       snapshots
FROM ranked WHERE rn = 1""",
)
def a16_recent(t):
    return e.last_days_best_platforms(t.posts, t.content_drafts, t.analytics_logs, timestamp(AS_OF))


@check(
    "a17_published_report",
    "posts",
    "content_drafts",
    "scheduled_posts",
    "analytics_logs",
    sql="""
WITH totals AS (
  SELECT post_id, CAST(sum(views) AS BIGINT) AS views, CAST(sum(likes) AS BIGINT) AS likes,
         CAST(sum(comments) AS BIGINT) AS comments, CAST(sum(shares) AS BIGINT) AS shares,
         max(engagement_rate) AS best FROM analytics_logs GROUP BY post_id)
SELECT p.post_id, cd.created_by AS user_id, cd.draft_title, p.platform, p.created_at, sp.scheduled_time,
       sp.schedule_status, COALESCE(t.views, 0) AS views, COALESCE(t.likes, 0) AS likes,
       COALESCE(t.comments, 0) AS comments, COALESCE(t.shares, 0) AS shares,
       CAST(COALESCE(t.best, 0) AS DOUBLE) AS engagement_rate
FROM posts p JOIN content_drafts cd ON cd.draft_id = p.draft_id
LEFT JOIN scheduled_posts sp ON sp.post_id = p.post_id
LEFT JOIN totals t ON t.post_id = p.post_id
WHERE p.status = 'published'""",
)
def a17(t):
    return e.published_report(t.posts, t.content_drafts, t.scheduled_posts, t.analytics_logs)


@check(
    "w1_top_posts",
    *ALL,
    sql="""
WITH totals AS (
  SELECT cd.created_by AS user_id, p.post_id, p.platform, p.repurposed_content,
         CAST(sum(al.likes) AS BIGINT) AS likes, CAST(sum(al.comments) AS BIGINT) AS comments,
         CAST(sum(al.shares) AS BIGINT) AS shares, max(al.engagement_rate) AS best
  FROM posts p JOIN content_drafts cd ON cd.draft_id = p.draft_id
  JOIN analytics_logs al ON al.post_id = p.post_id
  GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY best DESC, post_id) AS rank FROM totals)
SELECT user_id, rank, post_id, platform, concat(substring(repurposed_content, 1, 120), '...') AS preview,
       likes, comments, shares, CAST(best AS DOUBLE) AS engagement_rate
FROM ranked WHERE rank <= 5""",
)
def w1(t):
    return e.top_posts(t.posts, t.content_drafts, t.analytics_logs)


@check(
    "w3_latest_snapshot",
    "analytics_logs",
    sql="""
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY recorded_at DESC, views DESC, likes DESC,
                               comments DESC, shares DESC, engagement_rate DESC) AS rn
  FROM analytics_logs)
SELECT post_id, views, likes, comments, shares, CAST(engagement_rate AS DOUBLE) AS engagement_rate, recorded_at
FROM ranked WHERE rn = 1""",
)
def w3(t):
    return e.latest_snapshots(t.analytics_logs)


@check(
    "w4_best_platform_per_brand",
    *ALL[1:],
    sql=f"""
WITH grouped AS (
  SELECT cd.client_id, p.platform,
         {mean6("sum(al.engagement_rate)", "count(al.engagement_rate)")} AS mean, count(*) AS snapshots
  FROM analytics_logs al JOIN posts p ON p.post_id = al.post_id
  JOIN content_drafts cd ON cd.draft_id = p.draft_id GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY mean DESC, platform) AS rn FROM grouped)
SELECT client_id, platform AS best_platform, {shown("mean")} AS avg_rate, snapshots
FROM ranked WHERE rn = 1""",
)
def w4(t):
    whole = F.lit("2000-01-01").cast("date")
    totals = e.weekly_platform_totals(t.posts, t.content_drafts, t.analytics_logs, whole)
    return e.best_platform_per_week(totals).drop("week")


@check(
    "w5_latest_recommendation",
    "content_recommendations",
    "content_drafts",
    sql="""
WITH pairs AS (SELECT DISTINCT created_by AS user_id, client_id FROM content_drafts),
ranked AS (
  SELECT d.user_id, cr.*, row_number() OVER (
           PARTITION BY d.user_id ORDER BY cr.created_at DESC, cr.recommendation_id DESC) AS rn
  FROM pairs d JOIN content_recommendations cr ON cr.client_id = d.client_id)
SELECT user_id, recommendation_id, client_id, CAST(week_start_date AS VARCHAR) AS week_start_date,
       CAST(week_end_date AS VARCHAR) AS week_end_date, best_platform, recommendation_text, created_at
FROM ranked WHERE rn = 1""",
)
def w5(t):
    return e.latest_recommendations(t.content_recommendations, t.content_drafts)


# Snapshots lie 28 years before the recommended weeks; the same weekday pattern returns after 28 years.
SHIFTED = """
shifted AS (SELECT al.*, al.recorded_at + INTERVAL 28 YEAR AS moved_at FROM analytics_logs al),
in_week AS (
  SELECT cr.recommendation_id, cr.client_id, p.draft_id, p.platform, s.*
  FROM shifted s JOIN posts p ON p.post_id = s.post_id
  JOIN content_drafts cd ON cd.draft_id = p.draft_id
  JOIN content_recommendations cr ON cr.client_id = cd.client_id
   AND s.moved_at >= cr.week_start_date AND s.moved_at < cr.week_end_date + INTERVAL 1 DAY)
"""


def _shifted(t):
    return t.analytics_logs.withColumn(
        "recorded_at", F.col("recorded_at") + F.make_interval(years=F.lit(28))
    )


@check(
    "j15_snapshots_in_week",
    *ALL[1:],
    "content_recommendations",
    sql=f"""
WITH {SHIFTED}
SELECT recommendation_id, client_id, post_id, draft_id, platform, views, likes, comments, shares,
       CAST(engagement_rate AS DOUBLE) AS engagement_rate, moved_at AS recorded_at
FROM in_week""",
)
def j15(t):
    return e.snapshots_in_weeks(
        t.posts, t.content_drafts, _shifted(t), t.content_recommendations
    ).drop("day")


@check(
    "j15_week_engagement",
    *ALL[1:],
    "content_recommendations",
    sql=f"""
WITH {SHIFTED}
SELECT recommendation_id, client_id, CAST(sum(views) AS BIGINT) AS views, CAST(sum(likes) AS BIGINT) AS likes,
       CAST(sum(comments) AS BIGINT) AS comments, CAST(sum(shares) AS BIGINT) AS shares,
       count(*) AS snapshots
FROM in_week GROUP BY recommendation_id, client_id""",
)
def j15_week(t):
    return e.week_engagement(t.posts, t.content_drafts, _shifted(t), t.content_recommendations)


@check(
    "s7_chart_payload",
    *ALL,
    sql=f"""
WITH {PLATFORM_ROWS},
platform_lists AS (
  SELECT user_id, string_agg(concat('{{"platform":"', platform, '","post_count":', post_count, ',"likes":', likes,
         ',"comments":', comments, ',"shares":', shares, ',"avg_rate":', {shown("mean")}, ',"total":',
         likes + comments + shares, '}}'), ',' ORDER BY mean DESC, platform) AS items
  FROM platform_rows GROUP BY user_id),
status_rows AS (SELECT user_id, status, count(DISTINCT post_id) AS n FROM author_rows GROUP BY user_id, status),
status_lists AS (
  SELECT user_id, string_agg(concat('{{"status":"', status, '","count":', n, '}}'), ',' ORDER BY status) AS items
  FROM status_rows GROUP BY user_id)
SELECT u.user_id, concat('{{"hasPosts":', CASE WHEN p.items IS NULL THEN 'false' ELSE 'true' END,
       ',"platforms":[', COALESCE(p.items, ''), '],"statuses":[', COALESCE(s.items, ''), ']}}') AS payload
FROM users u LEFT JOIN platform_lists p ON p.user_id = u.user_id
LEFT JOIN status_lists s ON s.user_id = u.user_id""",
)
def s7(t):
    from quillworks.operators.counters import status_breakdown

    totals = _totals(t)
    return chart_payload(
        e.by_platform(totals), status_breakdown(t.posts, t.content_drafts), e.overview(t.users, totals)
    )


@check(
    "a13_first_brand_of_author",
    "content_drafts",
    sql="SELECT created_by AS user_id, min(client_id) AS client_id FROM content_drafts GROUP BY created_by",
)
def a13(t):
    return brands.first_brand_of_authors(t.content_drafts)


@check(
    "j9_salted_snapshots",
    "posts",
    "analytics_logs",
    sql="""
WITH logs AS (SELECT CASE WHEN likes % 3 = 0 THEN 1 ELSE post_id END AS post_id, views FROM analytics_logs)
SELECT p.platform, CAST(count(*) AS BIGINT) AS snapshots, CAST(sum(l.views) AS BIGINT) AS views
FROM logs l LEFT JOIN posts p ON p.post_id = l.post_id GROUP BY p.platform""",
)
def salted_snapshots(t):
    # A third of the snapshots belongs to one post; each other post holds a few. Both are over the target here.
    post = F.when(F.col("likes") % 3 == 0, 1).otherwise(F.col("post_id"))
    logs = t.analytics_logs.select(post.alias("post_id"), "views", "likes", "comments", "recorded_at")
    by_post = t.posts.groupBy("post_id").agg(F.max("platform").alias("platform"))
    spread = ["views", "likes", "comments", "recorded_at"]
    joined = salted_join(logs, by_post, ["post_id"], "left", spread, target_rows=3)
    return joined.groupBy("platform").agg(F.count("*").alias("snapshots"), F.sum("views").alias("views"))
