"""Lists and details of users, drafts, posts, decisions and schedules.

Each list is built for all users at once; a single screen is a filter on top and
the filter reaches the scans. Sorting is left to the caller through
``operators.ordering`` except where the order is part of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillworks.functions.fixed_values import NEWEST_APPROVED, REVEAL_REMARKS_STATUSES
from quillworks.functions.scalars import collated, normal_code, older_than
from quillworks.operators.ordering import newest_first, top_rows


def posts_of_drafts(posts: DataFrame, draft_id=None) -> DataFrame:
    """Posts of one draft newest first, or of every draft in draft order."""
    if draft_id is not None:
        return newest_first(posts.filter(F.col("draft_id") == draft_id), "created_at", "post_id")
    return posts.orderBy("draft_id", F.desc("created_at"), "post_id")


def users_with_role(users: DataFrame, *roles: str) -> DataFrame:
    return users.filter(F.col("role").isin(*roles))


def active_brands(clients: DataFrame) -> DataFrame:
    return (
        clients.filter(F.col("active_status") == 1)
        .select("client_id", "client_name", "timezone")
        .orderBy("client_name", "client_id")
    )


def lookup(keys: DataFrame, table: DataFrame, on: list[str] | str) -> DataFrame:
    """One row per distinct key with the table row it names and whether there is one.

    Keys are made distinct first, so a key asked for a million times is joined once.
    """
    names = [on] if isinstance(on, str) else on
    marked = table.withColumn("found", F.lit(True))
    return (
        keys.select(*names)
        .dropDuplicates()
        .join(marked, names, "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
    )


def users_by_email(keys: DataFrame, users: DataFrame) -> DataFrame:
    """One row per distinct typed e-mail with its user; case, accents and trailing blanks do not matter."""
    people = users.withColumn("email_key", collated(F.col("email"))).drop("email")
    return (
        keys.select("email")
        .dropDuplicates()
        .withColumn("email_key", collated(F.col("email")))
        .join(people, "email_key", "left")
        .drop("email_key")
        .withColumn("found", F.col("user_id").isNotNull())
    )


def rows_for_keys(table: DataFrame, keys: DataFrame, on: list[str] | str) -> DataFrame:
    """Table rows named by a batch of keys."""
    return table.join(keys, on, "left_semi")


def brands_by_code(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """Brand named by each typed invite code, compared as its column is; unknown codes keep a NULL brand."""
    codes = clients.filter(F.col("invite_code").isNotNull()).select(
        collated(F.col("invite_code")).alias("code_key"), "client_id", "client_name"
    )
    typed = requests.withColumn("normal_code", normal_code(F.col("invite_code")))
    return typed.withColumn("code_key", collated(F.col("normal_code"))).join(codes, "code_key", "left").drop("code_key")


def posts_with_status(posts: DataFrame, status: str | None = None) -> DataFrame:
    """Posts on one status tab; all posts without a status."""
    return posts if status is None else posts.filter(F.col("status") == status)


def newest_approved(posts: DataFrame, limit: int = NEWEST_APPROVED) -> DataFrame:
    approved = posts.filter(F.col("status") == "approved")
    newest = top_rows(
        approved.select("post_id", "platform", "status", "created_at"),
        [F.desc("created_at"), F.asc("post_id")],
        limit,
    )
    return newest.select("post_id", "platform", "status")


def stale_pending(posts: DataFrame, days: int, as_of: Column) -> DataFrame:
    return posts.filter(
        (F.col("status") == "pending_approval") & older_than(F.col("created_at"), days, as_of)
    )


def without_email(users: DataFrame) -> DataFrame:
    return users.filter(F.col("email").isNull() | (F.col("email") == ""))


def with_email_like(users: DataFrame, pattern: str) -> DataFrame:
    return users.filter(F.col("email").like(pattern))


def draft_authors(drafts: DataFrame, users: DataFrame, *draft_columns: str) -> DataFrame:
    """Drafts with their author; built before posts are joined, as drafts are fewer."""
    authors = users.select(
        F.col("user_id").alias("created_by"),
        F.col("full_name").alias("author_name"),
        F.col("email").alias("author_email"),
    )
    return drafts.select("draft_id", "created_by", *draft_columns).join(authors, "created_by")


def posts_of_users(posts: DataFrame, drafts: DataFrame) -> DataFrame:
    """Every post with the title and the author id of its draft."""
    owned = drafts.select("draft_id", F.col("created_by").alias("user_id"), "draft_title")
    return posts.join(owned, "draft_id")


def review_queue(posts: DataFrame, drafts: DataFrame, users: DataFrame, status: str = "pending_approval") -> DataFrame:
    authors = draft_authors(drafts, users, "draft_title").drop("created_by", "author_email")
    return posts.filter(F.col("status") == status).join(authors, "draft_id")


def post_details(posts: DataFrame, drafts: DataFrame, users: DataFrame) -> DataFrame:
    authors = draft_authors(drafts, users, "draft_title", "draft_content").drop("created_by")
    return posts.join(authors, "draft_id")


def draft_details(drafts: DataFrame, clients: DataFrame, users: DataFrame) -> DataFrame:
    """Drafts with brand and author names, kept when either is missing."""
    return drafts.join(clients.select("client_id", "client_name"), "client_id", "left").join(
        users.select(F.col("user_id").alias("created_by"), F.col("full_name").alias("author_name")),
        "created_by",
        "left",
    )


def approval_history(approvals: DataFrame, users: DataFrame) -> DataFrame:
    managers = users.select(
        F.col("user_id").alias("manager_id"), F.col("full_name").alias("manager_name")
    )
    return approvals.join(managers, "manager_id")


def latest_remarks(approvals: DataFrame) -> DataFrame:
    """Remark of the newest decision of every post, NULL if that decision has none."""
    newest = F.struct("approval_date", "approval_id")
    return approvals.groupBy("post_id").agg(F.max_by("remarks", newest).alias("latest_remarks"))


def posts_with_schedule(
    posts: DataFrame, drafts: DataFrame, schedules: DataFrame, approvals: DataFrame
) -> DataFrame:
    """Every post with author and title of its draft, and schedule and latest remark if any.

    What is added to a post is joined on keys alone; the posts with their texts
    are moved once, for the last join.
    """
    owned = drafts.select("draft_id", F.col("created_by").alias("user_id"), "draft_title")
    slots = schedules.select("post_id", "schedule_id", "scheduled_time", "schedule_status")
    added = (
        posts.select("post_id", "draft_id")
        .join(owned, "draft_id")
        .drop("draft_id")
        .join(slots, "post_id", "left")
        .join(latest_remarks(approvals), "post_id", "left")
    )
    return posts.join(added, "post_id")


def revealed_remarks(remarks: Column, status: Column) -> Column:
    """Remarks are shown to the writer only while the post needs work."""
    shown = (F.coalesce(remarks, F.lit("")) != "") & status.isin(*REVEAL_REMARKS_STATUSES)
    return F.when(shown, remarks)


def scheduled_chain(
    clients: DataFrame, drafts: DataFrame, posts: DataFrame, schedules: DataFrame
) -> DataFrame:
    """Every scheduled post with its draft and brand."""
    branded = drafts.select("draft_id", "client_id", "draft_title").join(
        clients.select("client_id", "client_name"), "client_id"
    )
    slots = schedules.select("post_id", "schedule_id", "scheduled_time")
    return (
        posts.select("post_id", "draft_id", "platform")
        .join(slots, "post_id")
        .join(branded, "draft_id")
    )
