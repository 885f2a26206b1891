"""Decisions, schedules and status changes of one batch, each seen by those after it.

``reviews`` judges a batch by the tables before it. Here every request is judged by the state that
the earlier requests of its post left: a post can be approved, scheduled, sent back and
decided again in one batch, as when requests arrive one by one.

The state of a post is its status and whether it has a schedule. Decisions and status changes set the
status whatever it was, so the status that a request meets is that of the last earlier one
of these, unless a schedule was accepted since. A post gets one schedule at most: the first request with
a valid time that finds the post approved. Both are found chunk by chunk (``operators.timeline``): a chunk is summed up
by the last status it sets, its first valid schedule before any status is set, and its first one
behind an approval; one row per post and chunk composes these in order. No post is one list or
one task, whatever share of the batch it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillworks.functions.fixed_values import APPROVAL_STATUSES, DECIDER_ROLES, POST_STATUSES
from quillworks.functions.scalars import iso_timestamp
from quillworks.operators.timeline import CHUNK, LAST, earlier_chunks, in_chunks, stretch
from quillworks.plans.outcome import Outcome, Stage, first_reason, order, overwrite, with_roles, written
from quillworks.plans.reviews import approval_rows, schedule_rows

DECIDE, SCHEDULE, SET_STATUS = "decide", "schedule", "set_status"
KEY, ORDER = ["post_id"], ["request_time", "request_id"]


def _own_fault(as_of: Column) -> Column:
    """What is wrong with a request whatever the state of its post."""
    kind, status, slot = F.col("kind"), F.col("new_status"), F.col("slot")
    decider = F.coalesce(F.col("role").isin(*DECIDER_ROLES), F.lit(False))
    known = {
        DECIDE: F.coalesce(status.isin(*APPROVAL_STATUSES), F.lit(False)),
        SET_STATUS: F.coalesce(status.isin(*POST_STATUSES), F.lit(False)),
    }
    return first_reason(
        (~F.coalesce(kind.isin(DECIDE, SCHEDULE, SET_STATUS), F.lit(False)), "unknown_kind"),
        ((kind == DECIDE) & ~decider, "forbidden"),
        ((kind == DECIDE) & ~known[DECIDE], "invalid_status"),
        ((kind == SET_STATUS) & ~known[SET_STATUS], "invalid_status"),
        ((kind == SCHEDULE) & slot.isNull(), "invalid_date"),
        ((kind == SCHEDULE) & (slot <= as_of), "not_future"),
    )


def _placed(requests: DataFrame, users: DataFrame, as_of: Column, stage: Stage) -> DataFrame:
    """Requests in chunks, with the status set before each and what its chunk comes to."""
    judged = with_roles(requests, users).withColumn("slot", iso_timestamp(F.col("scheduled_time")))
    judged = judged.withColumn("fault", _own_fault(as_of))
    setter = F.col("fault").isNull() & (F.col("kind") != SCHEDULE)
    slot = F.col("fault").isNull() & (F.col("kind") == SCHEDULE)
    before, upto, last = stretch(KEY, ORDER)
    rows = in_chunks(
        judged.withColumn("sets", F.when(setter, F.struct(order().alias("at"), "new_status"))), KEY, ORDER
    )
    held = F.last("sets", ignorenulls=True)
    rows = rows.withColumns({"set_before": held.over(before), "ends_with": held.over(upto), LAST: last})
    unset = F.when(slot & F.col("set_before").isNull(), order())
    approved = F.when(slot & (F.col("set_before.new_status") == "approved"), order())
    return stage(
        rows.withColumns(
            {
                "first_unset": F.first(unset, ignorenulls=True).over(upto),
                "first_approved": F.first(approved, ignorenulls=True).over(upto),
            }
        ).drop("sets")
    )


def _facts(placed: DataFrame, posts: DataFrame, schedules: DataFrame, stage: Stage) -> DataFrame:
    """One row per post and chunk: the state before the batch, the status set by earlier chunks,
    the request whose schedule is accepted, and the last status set."""
    taken = schedules.select("post_id", F.lit(True).alias("was_taken")).distinct()
    state = posts.select("post_id", F.col("status").alias("old_status"), F.lit(True).alias("known"))
    chunks = placed.filter(LAST).select("post_id", CHUNK, "ends_with", "first_unset", "first_approved")
    chunks = chunks.join(state, "post_id", "left").join(taken, "post_id", "left")
    chunks = chunks.withColumn("carried", F.last("ends_with", ignorenulls=True).over(earlier_chunks(KEY)))
    enters = F.coalesce("carried.new_status", "old_status")
    # In a chunk that is entered as approved, a schedule before any status comes first.
    candidate = F.when(enters == "approved", F.coalesce("first_unset", "first_approved")).otherwise(
        F.col("first_approved")
    )
    free = F.col("known") & F.col("was_taken").isNull()
    post = Window.partitionBy("post_id").orderBy(CHUNK).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return stage(
        chunks.withColumn("candidate", F.when(free, candidate)).select(
            "post_id",
            CHUNK,
            "known",
            "old_status",
            "was_taken",
            "carried",
            F.first("candidate", ignorenulls=True).over(post).alias("winner"),
            F.last("ends_with", ignorenulls=True).over(post).alias("last_set"),
            (F.row_number().over(Window.partitionBy("post_id").orderBy(CHUNK)) == 1).alias("first_chunk"),
        )
    )


def _status_after(set_before: Column, old_status: Column, scheduled: Column, winner: Column) -> Column:
    """Status from the last one set and the accepted schedule, if that came already."""
    newer = scheduled & (set_before.isNull() | (set_before["at"] < winner))
    return F.when(newer, F.lit("scheduled")).otherwise(F.coalesce(set_before["new_status"], old_status))


def replay(
    requests: DataFrame,
    users: DataFrame,
    posts: DataFrame,
    schedules: DataFrame,
    as_of: Column,
    stage: Stage = written,
) -> Outcome:
    """Requests (request_id, request_time, kind, user_id, post_id, new_status, scheduled_time, remarks).

    ``kind`` is decide, schedule or set_status. Every request is returned with the status of its post
    before it and the reason of its refusal; ``flagged`` marks accepted decisions on posts that
    were scheduled or published by then. (request_time, request_id) is unique. ``stage`` writes the requests and the
    facts per post and chunk, which are both used more than once.
    """
    placed = _placed(requests, users, as_of, stage)
    facts = _facts(placed, posts, schedules, stage)
    here, winner = order(), F.col("winner")
    scheduled = F.coalesce(winner < here, F.lit(False))
    met = placed.drop("ends_with", "first_unset", "first_approved", LAST).join(
        # A NULL post is unknown, and so are its facts.
        facts.drop("last_set", "first_chunk"),
        [*KEY, CHUNK],
        "left",
    )
    met = met.withColumn("set_before", F.coalesce("set_before", "carried"))
    met = met.withColumn(
        "previous_status", _status_after(F.col("set_before"), F.col("old_status"), scheduled, winner)
    )
    # Both workflows check a post before a time and after the person.
    unknown = F.col("known").isNull()
    own = F.col("fault")
    decided = (
        met.withColumn(
            "reason",
            F.when(F.col("kind") != SCHEDULE, F.coalesce(own, F.when(unknown, "not_found")))
            .when(own == "unknown_kind", own)
            .when(unknown, "not_found")
            .when(~F.col("previous_status").eqNullSafe("approved"), "wrong_status")
            .when(F.col("was_taken") | scheduled, "already_scheduled")
            .otherwise(own),
        )
        .withColumn("previous_status", F.when(~unknown, F.col("previous_status")))
        .withColumn(
            "flagged",
            F.col("reason").isNull()
            & (F.col("kind") == DECIDE)
            & F.col("previous_status").isin("scheduled", "published"),
        )
        .select(*requests.columns, "role", "slot", "previous_status", "reason", "flagged")
    )
    accepted = decided.filter(F.col("reason").isNull())
    decisions = accepted.filter(F.col("kind") == DECIDE)
    slots = accepted.filter(F.col("kind") == SCHEDULE)
    changes = facts.filter("first_chunk and known").select(
        "post_id",
        _status_after(F.col("last_set"), F.col("old_status"), winner.isNotNull(), winner).alias("changed_status"),
    )
    return Outcome(
        decided,
        {"posts": overwrite(posts, changes, KEY, "status", "changed_status")},
        {
            "approvals": approval_rows(decisions.withColumn("approval_status", F.col("new_status"))),
            "scheduled_posts": schedule_rows(slots),
        },
    )
