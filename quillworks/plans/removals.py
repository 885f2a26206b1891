"""Deletes with the reference rules of the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillworks.functions.fixed_values import RETENTION_DAYS
from quillworks.functions.scalars import older_than
from quillworks.operators.skew import salted_join
from quillworks.plans.outcome import Outcome, Stage, first_reason, order, unstaged
from quillworks.sources.catalogue import TABLES

Frames = dict[str, DataFrame]

# Parents before children.
DEPENDENCY_ORDER = [
    "users",
    "clients",
    "client_members",
    "social_accounts",
    "content_recommendations",
    "content_drafts",
    "ai_generations",
    "posts",
    "approvals",
    "scheduled_posts",
    "analytics_logs",
    "audit_logs",
]


def without(
    frames: Frames, table: str, keys: DataFrame, salted: bool = False, stage: Stage = unstaged
) -> Frames:
    """Tables after the rows of ``table`` with the given keys are deleted.

    ``keys`` holds one column, the key of the table. Rows that refer to a deleted
    row are deleted with it or lose the reference, as the catalogue says. Only
    keys travel down the chain. ``salted`` is for keys that were computed grouped
    by themselves, see ``operators.skew``; all other joins of the chain shuffle
    both sides, where adaptive execution splits hot keys. Each list of removed keys goes
    through ``stage`` once, however many tables refer to it. A table or column that refers to
    a deleted row must be among the frames: otherwise orphans would stay behind.
    """
    removed = {table: stage(keys.select(F.col(keys.columns[0]).alias("removed_key")))}
    after = {}
    for name in DEPENDENCY_ORDER:
        info = TABLES[name]
        touched = [r for r in info.references if r.parent in removed and r.on_delete in ("cascade", "set null")]
        if name != table and touched and name not in frames:
            raise ValueError(f"{name} refers to deleted rows of {touched[0].parent} and is missing")
        if name not in frames:
            continue
        frame = frames[name]
        if name == table:
            after[name] = frame.join(
                removed[name], frame[info.key] == removed[name]["removed_key"], "left_anti"
            )
            continue
        kept, gone = frame, []
        for reference in info.references:
            parents = removed.get(reference.parent)
            if parents is None:
                continue
            if reference.column not in frame.columns:
                if reference in touched:
                    raise ValueError(f"{name}.{reference.column} refers to deleted rows and is missing")
                continue
            if reference.on_delete == "cascade":
                spread = salted and reference.parent == table
                kept = _children(kept, parents, reference.column, "left_anti", spread)
                if info.key in frame.columns:
                    hit = _children(frame, parents, reference.column, "left_semi", spread)
                    gone.append(hit.select(F.col(info.key).alias("removed_key")))
            elif reference.on_delete == "set null":
                kept = _clear(kept, parents, reference.column)
        if kept is not frame:
            after[name] = kept
        if gone and any(r.parent == name for child in TABLES.values() for r in child.references):
            removed[name] = stage(reduce(DataFrame.union, gone))
    return after


def _children(frame: DataFrame, keys: DataFrame, column: str, how: str, salted: bool) -> DataFrame:
    """Rows of a child table with (left_semi) or without (left_anti) a deleted parent."""
    parents = keys.select(F.col("removed_key").alias(column))
    if not salted:
        return frame.join(parents, column, how).select(*frame.columns)
    return salted_join(frame, parents, [column], how, frame.columns).select(*frame.columns)


def _clear(frame: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    hit = keys.select(F.col("removed_key").alias(column)).distinct().withColumn("cleared", F.lit(True))
    return (
        salted_join(frame, hit, [column], "left", frame.columns)
        .withColumn(column, F.when(F.col("cleared").isNull(), F.col(column)))
        .select(*frame.columns)
    )


def delete_drafts(requests: DataFrame, frames: Frames, stage: Stage = unstaged) -> Outcome:
    """Requests (request_id, request_time, user_id, draft_id); only the author may delete.

    The first request of the author deletes the draft; any other finds nothing.
    """
    first = requests.groupBy("draft_id", F.col("user_id").alias("created_by")).agg(
        F.min(order()).alias("winner")
    )
    deleted = (
        frames["content_drafts"].select("draft_id", "created_by")
        .join(first, ["draft_id", "created_by"])
        .select("draft_id", "winner")
    )
    found = order() == F.col("winner")
    decided = stage(
        requests.join(deleted, "draft_id", "left")
        .withColumn("reason", F.when(~F.coalesce(found, F.lit(False)), "not_found"))
        .drop("winner")
    )
    return Outcome(decided, without(frames, "content_drafts", deleted.select("draft_id"), stage=stage))


def delete_users(requests: DataFrame, frames: Frames, stage: Stage = unstaged) -> Outcome:
    """Requests (request_id, request_time, user_id).

    Users with drafts or decisions stay. Memberships go with the user; audit rows
    and owned brands lose the reference.
    """
    first = requests.groupBy("user_id").agg(F.min(order()).alias("winner"))
    authors = frames["content_drafts"].select(F.col("created_by").alias("user_id"))
    deciders = frames["approvals"].select(F.col("manager_id").alias("user_id"))
    bound = (
        authors.distinct().union(deciders.distinct()).distinct().withColumn("bound", F.lit(True))
    )
    facts = stage(
        frames["users"].select("user_id").withColumn("known", F.lit(True))
        .join(bound, "user_id", "left")
        .join(first, "user_id")
    )
    decided = stage(
        salted_join(requests, facts, ["user_id"], "left", ["request_id"])
        .withColumn(
            "reason",
            first_reason(
                (F.col("known").isNull(), "not_found"),
                (F.col("bound"), "restricted"),
                (order() > F.col("winner"), "not_found"),
            ),
        )
        .drop("known", "bound", "winner")
    )
    deleted = facts.filter(F.col("known") & F.col("bound").isNull()).select("user_id")
    return Outcome(decided, without(frames, "users", deleted, salted=True, stage=stage))


def purge_rejected(
    frames: Frames, as_of: Column, days: int = RETENTION_DAYS, stage: Stage = unstaged
) -> Frames:
    """Tables after rejected posts older than ``days`` are deleted."""
    expired = (F.col("status") == "rejected") & older_than(F.col("created_at"), days, as_of)
    return without(frames, "posts", frames["posts"].filter(expired).select("post_id"), stage=stage)
