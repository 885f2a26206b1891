"""Review decisions and schedules applied to posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillworks.functions.fixed_values import APPROVAL_STATUSES, DECIDER_ROLES
from quillworks.functions.scalars import iso_timestamp, stable_id, strip
from quillworks.operators.skew import salted_join
from quillworks.plans.outcome import (
    Outcome,
    Stage,
    first_reason,
    order,
    overwrite,
    unstaged,
    with_roles,
)

LATE_STATUSES = ["scheduled", "published"]


def newest_decisions(accepted: DataFrame) -> DataFrame:
    """The decision that counts for every post: the newest accepted one."""
    return accepted.groupBy("post_id").agg(F.max_by("approval_status", order()).alias("new_status"))


def stored_remarks(remarks: Column) -> Column:
    """Empty remarks are stored as NULL, others stripped."""
    return F.when(remarks != "", strip(remarks))


def apply_decisions(
    requests: DataFrame, users: DataFrame, posts: DataFrame, stage: Stage = unstaged
) -> Outcome:
    """Requests (request_id, request_time, user_id, post_id, approval_status, remarks).

    Every accepted decision becomes an approval row; the newest one sets the
    status of its post. ``flagged`` marks decisions on posts that were already
    scheduled or published, which the workflow allows.
    """
    known = posts.select("post_id", F.col("status").alias("previous_status"))
    decider = F.coalesce(F.col("role").isin(*DECIDER_ROLES), F.lit(False))
    decision = F.coalesce(F.col("approval_status").isin(*APPROVAL_STATUSES), F.lit(False))
    decided = stage(
        with_roles(requests, users)
        .join(known, "post_id", "left")
        .withColumn(
            "reason",
            first_reason(
                (~decider, "forbidden"),
                (~decision, "invalid_status"),
                (F.col("previous_status").isNull(), "not_found"),
            ),
        )
        .withColumn(
            "flagged",
            F.col("reason").isNull() & F.col("previous_status").isin(*LATE_STATUSES),
        )
    )
    accepted = decided.filter(F.col("reason").isNull())
    newest = newest_decisions(accepted)
    after = overwrite(posts, newest, ["post_id"], "status", "new_status")
    return Outcome(decided, {"posts": after}, {"approvals": approval_rows(accepted)})


def approval_rows(accepted: DataFrame) -> DataFrame:
    """Rows of the decision table from accepted decisions."""
    return accepted.select(
        stable_id(F.lit("approval"), F.col("request_id").cast("string")).alias("approval_id"),
        "post_id",
        F.col("user_id").alias("manager_id"),
        "approval_status",
        stored_remarks(F.col("remarks")).alias("remarks"),
        F.col("request_time").alias("approval_date"),
    )


def schedule_rows(accepted: DataFrame) -> DataFrame:
    """Rows of the schedule table from accepted requests with their time ``slot``."""
    return accepted.select(
        stable_id(F.lit("schedule"), F.col("request_id").cast("string")).alias("schedule_id"),
        "post_id",
        F.col("slot").alias("scheduled_time"),
        F.lit("pending").alias("schedule_status"),
        F.col("request_time").alias("created_at"),
    )


def apply_schedules(
    requests: DataFrame,
    posts: DataFrame,
    schedules: DataFrame,
    as_of: Column,
    stage: Stage = unstaged,
) -> Outcome:
    """Requests (request_id, request_time, post_id, scheduled_time as text).

    The first valid request of a post is accepted; afterwards the post is
    scheduled, so later ones find the wrong status.
    """
    slot = iso_timestamp(F.col("scheduled_time"))
    # The first valid request and the number of all, from one pass over the requests.
    per_post = requests.groupBy("post_id").agg(
        F.min(F.when(slot > as_of, order())).alias("winner"), F.count("*").alias("rows")
    )
    taken = schedules.select("post_id", F.lit(True).alias("taken")).distinct()
    free_approved = (F.col("status") == "approved") & F.col("taken").isNull()
    facts = (
        posts.select("post_id", "status")
        .join(taken, "post_id", "left")
        .join(per_post.drop("rows"), "post_id", "left")
        .withColumn("winner", F.when(free_approved, F.col("winner")))
    )
    decided = stage(
        salted_join(
            requests.withColumn("slot", slot), facts, ["post_id"], "left", ["request_id"], counts=per_post.drop("winner")
        )
        .withColumn(
            "reason",
            first_reason(
                (F.col("status").isNull(), "not_found"),
                (F.col("status") != "approved", "wrong_status"),
                (order() > F.col("winner"), "wrong_status"),
                (F.col("taken"), "already_scheduled"),
                (F.col("slot").isNull(), "invalid_date"),
                (F.col("slot") <= as_of, "not_future"),
            ),
        )
        .drop("winner", "taken", "status")
    )
    rows = schedule_rows(decided.filter(F.col("reason").isNull()))
    now_scheduled = facts.filter(F.col("winner").isNotNull()).select(
        "post_id", F.lit("scheduled").alias("new_status")
    )
    after = overwrite(posts, now_scheduled, ["post_id"], "status", "new_status")
    return Outcome(decided, {"posts": after}, {"scheduled_posts": rows})


def set_status(table: DataFrame, requests: DataFrame, key: str, column: str) -> DataFrame:
    """Overwrite a status by id; the newest request (key, new_status) counts."""
    newest = requests.groupBy(key).agg(F.max_by("new_status", order()).alias("new_status"))
    return overwrite(table, newest, [key], column, "new_status")
