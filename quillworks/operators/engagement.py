"""Engagement: overviews, platforms, rankings, weekly results.

Snapshots are by far the largest table. They are summed per post before the first
join, and posts per draft before the next one. Each step moves one row per key of
the step, and a post, draft or author with a large share of the rows is reduced
by partial sums before anything is shuffled. Weekly and daily results per brand, where such sums
would be about as many rows as the snapshots, join first: :func:`weekly_platform_totals`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillworks.functions.fixed_values import NO_BEST_PLATFORM, TOP_POSTS
from quillworks.functions.measures import mean_rate, shown_rate, zero_if_null
from quillworks.functions.scalars import preview, title_case
from quillworks.operators.counters import status_breakdown
from quillworks.operators.ordering import latest_per_group, top_per_group
from quillworks.operators.skew import salted_join

COUNTERS = ["views", "likes", "comments", "shares"]
SUMS = COUNTERS + ["rate_total", "rate_count"]


def latest_snapshots(logs: DataFrame, tie_break: list[str] | None = None) -> DataFrame:
    """Newest snapshot of every post."""
    columns = COUNTERS + ["engagement_rate", "recorded_at"]
    order = ["recorded_at"] + (tie_break or [])
    return latest_per_group(logs, ["post_id"], order, *columns)


def post_totals(logs: DataFrame, *also_by: Column | str) -> DataFrame:
    """Sums, rate total and count, best rate and number of snapshots per post."""
    return logs.groupBy("post_id", *also_by).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in COUNTERS],
        F.sum("engagement_rate").alias("rate_total"),
        F.count("engagement_rate").alias("rate_count"),
        F.max("engagement_rate").alias("best_rate"),
        F.count("*").alias("snapshots"),
    )


def _summed() -> list[Column]:
    return [F.sum(c).alias(c) for c in SUMS]


def author_platform_totals(
    posts: DataFrame, drafts: DataFrame, logs: DataFrame, snapshots: str = "all"
) -> DataFrame:
    """Post count and sums per author and platform, posts without snapshots included."""
    if snapshots not in ("all", "latest"):
        raise ValueError("snapshots is 'all' or 'latest'")
    used = logs if snapshots == "all" else latest_snapshots(logs)
    per_post = posts.select("post_id", "draft_id", "platform").join(
        post_totals(used).select("post_id", *SUMS), "post_id", "left"
    )
    per_draft = per_post.groupBy("draft_id", "platform").agg(
        F.count("*").alias("post_count"), *_summed()
    )
    authors = drafts.select("draft_id", F.col("created_by").alias("user_id"))
    return (
        per_draft.join(authors, "draft_id")
        .groupBy("user_id", "platform")
        .agg(F.sum("post_count").alias("post_count"), *_summed())
    )


def overview(users: DataFrame, totals: DataFrame) -> DataFrame:
    """Headline numbers of every user, zeros for a user without posts.

    ``totals`` comes from :func:`author_platform_totals`.
    """
    per_user = totals.groupBy("user_id").agg(F.sum("post_count").alias("post_count"), *_summed())
    return (
        users.select("user_id")
        .join(per_user, "user_id", "left")
        .select(
            "user_id",
            zero_if_null(F.col("post_count")).alias("total_posts"),
            zero_if_null(F.col("views")).alias("total_views"),
            zero_if_null(F.col("likes") + F.col("comments") + F.col("shares")).alias(
                "total_engagement"
            ),
            shown_rate(mean_rate(F.col("rate_total"), F.col("rate_count"))).alias("avg_engagement"),
        )
    )


def by_platform(totals: DataFrame) -> DataFrame:
    """Engagement of every user and platform; ``mean_rate`` is the unrounded order value."""
    likes, comments, shares = (zero_if_null(F.col(c)) for c in ("likes", "comments", "shares"))
    mean = mean_rate(F.col("rate_total"), F.col("rate_count"))
    return totals.select(
        "user_id",
        "platform",
        "post_count",
        likes.alias("likes"),
        comments.alias("comments"),
        shares.alias("shares"),
        shown_rate(mean).alias("avg_rate"),
        (likes + comments + shares).alias("total"),
        mean.alias("mean_rate"),
    )


def best_platforms(users: DataFrame, platforms: DataFrame) -> DataFrame:
    """Platform with the highest mean rate of every user; ``None yet`` without posts.

    Equal means go to the platform that comes first in the alphabet.
    """
    best = platforms.groupBy("user_id").agg(
        F.min(F.struct((-F.col("mean_rate")).alias("order"), "platform", "avg_rate")).alias("best")
    )
    return (
        users.select("user_id")
        .join(best, "user_id", "left")
        .select(
            "user_id",
            F.col("best.platform").alias("best_platform"),
            F.col("best.avg_rate").alias("avg_rate"),
            F.coalesce(title_case(F.col("best.platform")), F.lit(NO_BEST_PLATFORM)).alias("badge"),
        )
    )


def platform_means(posts: DataFrame, logs: DataFrame) -> DataFrame:
    """Mean rate per platform; ``post_count`` counts snapshots, as the report always did."""
    return (
        posts.select("post_id", "platform")
        .join(post_totals(logs).select("post_id", "rate_total", "rate_count", "snapshots"), "post_id")
        .groupBy("platform")
        .agg(
            F.sum("rate_total").alias("rate_total"),
            F.sum("rate_count").alias("rate_count"),
            F.sum("snapshots").alias("post_count"),
        )
        .select(
            "platform",
            shown_rate(mean_rate(F.col("rate_total"), F.col("rate_count"))).alias("avg_engagement"),
            "post_count",
        )
        .orderBy(F.desc("avg_engagement"), "platform")
    )


def post_scores(posts: DataFrame, logs: DataFrame) -> DataFrame:
    """Sums and best rate of every post that has snapshots, without its text."""
    return posts.select("post_id", "draft_id", "platform").join(
        post_totals(logs).select(
            "post_id",
            *[zero_if_null(F.col(c)).alias(c) for c in ("likes", "comments", "shares")],
            F.coalesce("best_rate", F.lit(0).cast("decimal(5,2)")).alias("best_rate"),
        ),
        "post_id",
    )


def top_posts(
    posts: DataFrame, drafts: DataFrame, logs: DataFrame, limit: int = TOP_POSTS
) -> DataFrame:
    """Best posts of every user with their rank.

    A draft has one author, so the best posts of an author are among the best of
    the author's drafts: each draft is cut to ``limit`` posts before drafts are
    joined. Texts are read for the ranked posts only.
    """
    order = [F.desc("best_rate"), F.asc("post_id")]
    authors = drafts.select("draft_id", F.col("created_by").alias("user_id"))
    in_draft = top_per_group(post_scores(posts, logs), ["draft_id"], order, limit).drop("rank")
    ranked = top_per_group(in_draft.join(authors, "draft_id"), ["user_id"], order, limit)
    texts = posts.select("post_id", preview(F.col("repurposed_content")).alias("preview"))
    return ranked.join(texts, "post_id").select(
        "user_id",
        "rank",
        "post_id",
        "platform",
        "preview",
        "likes",
        "comments",
        "shares",
        shown_rate(F.col("best_rate")).alias("engagement_rate"),
    )


def latest_recommendations(recommendations: DataFrame, drafts: DataFrame) -> DataFrame:
    """Newest recommendation over the brands each user writes for.

    Recommendations shrink to one per brand before they meet the authors; the
    text is fetched for the chosen rows only.
    """
    newest = F.max(F.struct("created_at", "recommendation_id"))
    per_brand = recommendations.groupBy("client_id").agg(newest.alias("newest"))
    pairs = drafts.select(F.col("created_by").alias("user_id"), "client_id").distinct()
    chosen = (
        salted_join(pairs, per_brand, ["client_id"], "inner", ["user_id"])
        .groupBy("user_id")
        .agg(F.max("newest").alias("newest"))
        .select("user_id", F.col("newest.recommendation_id").alias("recommendation_id"))
    )
    return chosen.join(recommendations, "recommendation_id")


def published_report(
    posts: DataFrame, drafts: DataFrame, schedules: DataFrame, logs: DataFrame
) -> DataFrame:
    """Published posts with draft title, schedule and summed metrics, both optional."""
    published = posts.filter(F.col("status") == "published").select(
        "post_id", "draft_id", "platform", "created_at"
    )
    slots = schedules.select("post_id", "scheduled_time", "schedule_status")
    totals = post_totals(logs).select("post_id", *COUNTERS, "best_rate")
    owned = drafts.select("draft_id", F.col("created_by").alias("user_id"), "draft_title")
    return (
        published.join(slots, "post_id", "left")
        .join(totals, "post_id", "left")
        .join(owned, "draft_id")
        .select(
            "post_id",
            "user_id",
            "draft_title",
            "platform",
            "created_at",
            "scheduled_time",
            "schedule_status",
            *[zero_if_null(F.col(c)).alias(c) for c in COUNTERS],
            shown_rate(F.coalesce("best_rate", F.lit(0).cast("decimal(5,2)"))).alias("engagement_rate"),
        )
    )


def weekly_platform_totals(
    posts: DataFrame, drafts: DataFrame, logs: DataFrame, week: Column
) -> DataFrame:
    """Sums per brand, week and platform; ``week`` is computed from a snapshot row.

    A post has few snapshots in a week, so sums per post and week are about as many rows as the snapshots, wider, and
    would be shuffled once more. Snapshots meet the brand of their post as they are (adaptive execution splits
    a hot post, as both sides come from a shuffle) and are summed once, with partial sums in front of the shuffle.
    """
    brands = posts.select("post_id", "draft_id", "platform").join(
        drafts.select("draft_id", "client_id"), "draft_id"
    )
    return (
        logs.select("post_id", week.alias("week"), "engagement_rate")
        .join(brands.drop("draft_id"), "post_id")
        .groupBy("client_id", "week", "platform")
        .agg(
            F.sum("engagement_rate").alias("rate_total"),
            F.count("engagement_rate").alias("rate_count"),
            F.count("*").alias("snapshots"),
        )
    )


def best_platform_per_week(totals: DataFrame) -> DataFrame:
    """Platform with the highest mean rate per brand and week."""
    mean = mean_rate(F.col("rate_total"), F.col("rate_count"))
    best = F.min(
        F.struct((-F.col("mean")).alias("order"), "platform", "mean", "snapshots")
    ).alias("best")
    return (
        totals.withColumn("mean", mean)
        .groupBy("client_id", "week")
        .agg(best)
        .select("client_id", "week", *_best_columns())
    )


def _best_columns() -> list[Column]:
    return [
        F.col("best.platform").alias("best_platform"),
        shown_rate(F.col("best.mean")).alias("avg_rate"),
        F.col("best.snapshots").alias("snapshots"),
    ]


def weekly_best_platforms(posts: DataFrame, drafts: DataFrame, logs: DataFrame) -> DataFrame:
    """Best platform of every brand in every calendar week (from Monday)."""
    monday = F.date_trunc("week", F.col("recorded_at")).cast("date")
    return best_platform_per_week(weekly_platform_totals(posts, drafts, logs, monday))


def last_days_best_platforms(
    posts: DataFrame, drafts: DataFrame, logs: DataFrame, as_of: Column, days: int = 7
) -> DataFrame:
    """Best platform of every brand over the last days before ``as_of``."""
    recent = logs.filter(
        (F.col("recorded_at") >= as_of - F.make_interval(days=F.lit(days)))
        & (F.col("recorded_at") <= as_of)
    )
    totals = weekly_platform_totals(posts, drafts, recent, as_of.cast("date"))
    return best_platform_per_week(totals).withColumnRenamed("week", "as_of_date")


def sliding_best_platforms(
    posts: DataFrame, drafts: DataFrame, logs: DataFrame, days: int = 7
) -> DataFrame:
    """Best platform of every brand over the ``days`` days that end with each day, where there is a snapshot.

    Snapshots are summed once per brand, platform and day. A range frame hands every day of a brand the sums of the days
    before it, at most one per platform and day of the range. From these the best platform is chosen in the row, for the day
    and for those after it that have no snapshots, up to the next one that has or to the end of the range. So nothing is
    shuffled or sorted after the days are repeated.
    """
    daily = weekly_platform_totals(posts, drafts, logs, F.unix_date(F.to_date("recorded_at"))).withColumnRenamed("week", "day")
    series = Window.partitionBy("client_id").orderBy("day")
    later = F.lead(F.struct("day")).over(series)
    entry = F.struct("day", "platform", "rate_total", "rate_count", "snapshots")
    held = F.collect_list(entry).over(series.rangeBetween(1 - days, 0))
    gap = F.least(F.coalesce(F.col("later.day") - F.col("day"), F.lit(days)), F.lit(days))
    filled = (
        daily.select("client_id", "day", later.alias("later"), held.alias("held"))
        # One row per brand and day: the platforms of a day hold the same.
        .filter(F.col("later").isNull() | ~F.col("later.day").eqNullSafe(F.col("day")))
        .withColumn("after", F.explode(F.sequence(F.lit(0), F.when(F.col("day").isNull(), 0).otherwise(gap - 1))))
        .withColumn("last", F.col("day") + F.col("after"))
    )
    recent = F.filter("held", lambda e: F.coalesce(e["day"] > F.col("last") - days, F.lit(True)))
    best = F.array_min(F.transform(F.array_distinct("recent.platform"), lambda platform: _ranked_sums("recent", platform)))
    return (
        filled.select("client_id", "last", recent.alias("recent"))
        .select("client_id", F.date_from_unix_date("last").alias("last_day"), best.alias("best"))
        .select("client_id", "last_day", *_best_columns())
    )


def _ranked_sums(entries: str, platform: Column) -> Column:
    """Mean and snapshots over the entries of a platform, the highest mean first."""
    own = F.filter(entries, lambda e: e["platform"].eqNullSafe(platform))

    def total(field: str, kind: str) -> Column:
        zero = F.lit(0).cast(kind)
        return F.aggregate(own, zero, lambda held, e: (held + F.coalesce(e[field], zero)).cast(kind))

    mean = mean_rate(total("rate_total", "decimal(38,2)"), total("rate_count", "bigint"))
    return F.struct(
        (-mean).alias("order"), platform.alias("platform"), mean.alias("mean"), total("snapshots", "bigint").alias("snapshots")
    )


def snapshots_in_weeks(
    posts: DataFrame, drafts: DataFrame, logs: DataFrame, recommendations: DataFrame
) -> DataFrame:
    """Snapshots recorded within the week of a recommendation for their brand.

    The end date counts in full. Weeks are unrolled to days, so the range
    condition becomes an equality on brand and day.
    """
    days = recommendations.select(
        "recommendation_id",
        "client_id",
        F.explode(F.sequence("week_start_date", "week_end_date")).alias("day"),
    )
    branded = (
        logs.withColumn("day", F.to_date("recorded_at"))
        .join(posts.select("post_id", "draft_id", "platform"), "post_id")
        .join(drafts.select("draft_id", "client_id"), "draft_id")
    )
    return branded.join(days, ["client_id", "day"])


def week_engagement(
    posts: DataFrame, drafts: DataFrame, logs: DataFrame, recommendations: DataFrame
) -> DataFrame:
    """Sums per recommendation over the snapshots of its week.

    Snapshots are summed per post and day before the joins.
    """
    days = recommendations.select(
        "recommendation_id",
        "client_id",
        F.explode(F.sequence("week_start_date", "week_end_date")).alias("day"),
    )
    summed = [F.sum(c).alias(c) for c in COUNTERS + ["snapshots"]]
    per_post = post_totals(logs.withColumn("day", F.to_date("recorded_at")), "day").select(
        "post_id", "day", *COUNTERS, "snapshots"
    )
    per_brand_day = (
        posts.select("post_id", "draft_id")
        .join(per_post, "post_id")
        .groupBy("draft_id", "day")
        .agg(*summed)
        .join(drafts.select("draft_id", "client_id"), "draft_id")
        .groupBy("client_id", "day")
        .agg(*summed)
    )
    return (
        per_brand_day.join(days, ["client_id", "day"])
        .groupBy("recommendation_id", "client_id")
        .agg(*summed)
    )


def analytics_screen(
    users: DataFrame,
    posts: DataFrame,
    drafts: DataFrame,
    logs: DataFrame,
    recommendations: DataFrame,
) -> dict[str, DataFrame]:
    """All parts of the analytics screen for all users.

    Overview, platforms and badge come from one aggregate per author and platform.
    It is small beside the snapshots and kept after its first use; a lost executor
    only costs its recomputation.
    """
    totals = author_platform_totals(posts, drafts, logs).persist()
    platforms = by_platform(totals)
    return {
        "overview": overview(users, totals),
        "platforms": platforms,
        "statuses": status_breakdown(posts, drafts),
        "top_posts": top_posts(posts, drafts, logs),
        "best_platform": best_platforms(users, platforms),
        "recommendation": latest_recommendations(recommendations, drafts),
    }
