"""Counts for dashboards, tabs and reports.

Posts carry no author, so per-author counts first count posts per draft and then
join the few resulting rows to the drafts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillworks.functions.fixed_values import DRAFTS_PAGE, POST_STATUSES, RECENT_DRAFTS, TOP_BRANDS
from quillworks.functions.measures import zero_if_null
from quillworks.functions.scalars import collated, counted
from quillworks.operators.ordering import top_per_group


def status_breakdown(posts: DataFrame, drafts: DataFrame) -> DataFrame:
    """Posts per user and status, occurring statuses only."""
    per_draft = posts.groupBy("draft_id", "status").agg(F.count("*").alias("post_count"))
    authors = drafts.select("draft_id", F.col("created_by").alias("user_id"))
    return (
        per_draft.join(authors, "draft_id")
        .groupBy("user_id", "status")
        .agg(F.sum("post_count").alias("post_count"))
    )


def status_tabs(users: DataFrame, posts: DataFrame, drafts: DataFrame) -> DataFrame:
    """Tab counts of every user: all posts and one column per status, zeros included."""
    names = ["all_posts", *POST_STATUSES]
    per_draft = posts.groupBy("draft_id").agg(
        F.count("*").alias("all_posts"),
        *[F.count_if(F.col("status") == s).alias(s) for s in POST_STATUSES],
    )
    authors = drafts.select("draft_id", F.col("created_by").alias("user_id"))
    per_user = (
        per_draft.join(authors, "draft_id").groupBy("user_id").agg(*[F.sum(n).alias(n) for n in names])
    )
    return users.select("user_id").join(per_user, "user_id", "left").na.fill(0, names)


def dashboard_counters(users: DataFrame, drafts: DataFrame, posts: DataFrame) -> DataFrame:
    """Own drafts of every user beside the counts over all posts."""
    own = drafts.groupBy(F.col("created_by").alias("user_id")).agg(F.count("*").alias("total_drafts"))
    everywhere = posts.agg(
        F.struct(
            F.count("*").alias("total_posts"),
            F.count_if(F.col("status") == "pending_approval").alias("pending_approval"),
            F.count_if(F.col("status") == "published").alias("published"),
        ).alias("counts")
    )
    return (
        users.select("user_id")
        .join(own, "user_id", "left")
        .withColumn("counts", everywhere.scalar())
        .select("user_id", zero_if_null(F.col("total_drafts")).alias("total_drafts"), "counts.*")
    )


def workflow_flags(counters: DataFrame) -> DataFrame:
    """Which steps of the workflow are done, from :func:`dashboard_counters`."""

    def step(condition: Column) -> Column:
        return F.when(condition, "done").otherwise("todo")

    return counters.select(
        "user_id",
        step(F.col("total_drafts") > 0).alias("write_draft"),
        step(F.col("total_posts") > 0).alias("repurpose"),
        step((F.col("pending_approval") == 0) & (F.col("total_posts") > 0)).alias("get_approval"),
        F.lit("todo").alias("schedule"),
    )


def posts_per_draft(posts: DataFrame) -> DataFrame:
    return posts.groupBy("draft_id").agg(F.count("*").alias("post_count"))


DRAFT_COLUMNS = ["draft_id", "draft_title", "draft_status", "created_at", "client_id"]


def _with_brand(drafts: DataFrame, clients: DataFrame) -> DataFrame:
    names = clients.select("client_id", "client_name")
    return drafts.join(names, "client_id", "left").drop("client_id")


def _with_post_count(drafts: DataFrame, posts: DataFrame) -> DataFrame:
    return drafts.join(posts_per_draft(posts), "draft_id", "left").withColumn(
        "post_count", zero_if_null(F.col("post_count"))
    )


def _newest(drafts: DataFrame, limit: int) -> DataFrame:
    mine = drafts.select(F.col("created_by").alias("user_id"), *DRAFT_COLUMNS)
    return top_per_group(mine, ["user_id"], [F.desc("created_at"), F.asc("draft_id")], limit)


def newest_drafts(drafts: DataFrame, clients: DataFrame, limit: int = RECENT_DRAFTS) -> DataFrame:
    """Newest drafts of every user with rank and brand name."""
    return _with_brand(_newest(drafts, limit), clients)


def drafts_page(
    drafts: DataFrame, clients: DataFrame, posts: DataFrame, limit: int = DRAFTS_PAGE
) -> DataFrame:
    """Newest drafts of every user with rank, brand name and number of posts.

    Drafts are cut to one page per user before posts are counted for them.
    """
    return _with_post_count(newest_drafts(drafts, clients, limit), posts)


def drafts_with_counts(drafts: DataFrame, clients: DataFrame, posts: DataFrame) -> DataFrame:
    """Every draft with brand name and number of posts, 0 without posts."""
    mine = drafts.select(F.col("created_by").alias("user_id"), *DRAFT_COLUMNS)
    return _with_post_count(_with_brand(mine, clients), posts)


def decisions_per_status(approvals: DataFrame) -> DataFrame:
    return approvals.groupBy("approval_status").agg(F.count("*").alias("total"))


def posts_per_status(posts: DataFrame) -> DataFrame:
    return posts.groupBy("status").agg(F.count("*").alias("post_count"))


def most_scheduled_brands(
    clients: DataFrame,
    drafts: DataFrame,
    posts: DataFrame,
    schedules: DataFrame,
    limit: int | None = TOP_BRANDS,
) -> DataFrame:
    """Scheduled posts per brand name, most first; every brand without a limit."""
    summed = F.sum("scheduled_count").alias("scheduled_count")
    per_post = schedules.groupBy("post_id").agg(F.count("schedule_id").alias("scheduled_count"))
    per_draft = (
        posts.select("post_id", "draft_id").join(per_post, "post_id").groupBy("draft_id").agg(summed)
    )
    per_client = (
        drafts.select("draft_id", "client_id").join(per_draft, "draft_id").groupBy("client_id").agg(summed)
    )
    per_name = (
        clients.select("client_id", "client_name")
        .join(per_client, "client_id")
        .groupBy(collated(F.col("client_name")).alias("name"))
        .agg(F.min("client_name").alias("client_name"), summed)
        .select("client_name", "scheduled_count")
    )
    if limit is None:
        return per_name
    return per_name.orderBy(F.desc("scheduled_count"), "client_name").limit(limit)


def audit_trail(audit: DataFrame) -> DataFrame:
    """Actions per day, user, entity kind and action."""
    return audit.groupBy(
        F.to_date("created_at").alias("day"), "user_id", "entity_name", "action"
    ).agg(F.count("*").alias("actions"), F.max("created_at").alias("last_at"))


def members_per_brand(clients: DataFrame, members: DataFrame) -> DataFrame:
    counts = members.groupBy("client_id").agg(F.count("*").alias("members"))
    return (
        clients.select("client_id")
        .join(counts, "client_id", "left")
        .withColumn("members", zero_if_null(F.col("members")))
    )


def queue_length(posts: DataFrame) -> DataFrame:
    """Number of posts waiting for review with the line shown above the queue."""
    waiting = posts.filter(F.col("status") == "pending_approval").agg(F.count("*").alias("waiting"))
    return waiting.withColumn(
        "line",
        F.when(F.col("waiting") == 0, "All caught up!").otherwise(
            F.concat(counted(F.col("waiting"), "post"), F.lit(" waiting for your review"))
        ),
    )
