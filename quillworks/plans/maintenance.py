"""Small updates: user profiles, stale posts, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillworks.functions.fixed_values import STALE_AFTER_DAYS
from quillworks.functions.scalars import collated, stable_id
from quillworks.operators.lists import stale_pending
from quillworks.operators.ordering import top_rows
from quillworks.operators.skew import salted_join
from quillworks.operators.timeline import resolved, summed_up, with_last_before
from quillworks.plans.outcome import Outcome, Stage, first_reason, order, overwrite, unstaged, written
from quillworks.sources.catalogue import TABLES

PROFILE_FIELDS = ["full_name", "email", "password_hash", "role"]


# Roles that the user table accepts.
ROLES = next(c.domain for c in TABLES["users"].columns if c.name == "role")


def update_users(requests: DataFrame, users: DataFrame, stage: Stage = unstaged) -> Outcome:
    """Requests (request_id, request_time, user_id, profile fields).

    A NULL field is left as it is; among several accepted requests the newest value of
    each field counts. A request is refused as a whole if its role is not one of the
    table, or if its e-mail belongs to another user or was asked for by another user
    before, without regard to case.
    """
    fields = [c for c in PROFILE_FIELDS if c in users.columns and c in requests.columns]
    known = users.select("user_id", F.lit(True).alias("known"))
    asked = requests.join(known, "user_id", "left").withColumn(
        "fault",
        first_reason(
            (F.col("known").isNull(), "not_found"),
            (_given(requests, "role") & ~F.col("role").isin(*ROLES) if "role" in fields else F.lit(False), "invalid_role"),
        ),
    )
    if "email" in fields:
        asked = asked.withColumn("email_key", collated(F.col("email")))
        first = (
            asked.filter(F.col("fault").isNull() & F.col("email_key").isNotNull())
            .groupBy("email_key")
            .agg(F.min_by("user_id", order()).alias("first_user"))
        )
        holders = users.filter(F.col("email").isNotNull()).groupBy(collated(F.col("email")).alias("email_key"))
        facts = first.join(holders.agg(F.min("user_id").alias("holder")), "email_key", "left")
        asked = salted_join(asked, facts, ["email_key"], "left", ["request_id"])
        taken = F.coalesce("holder", "first_user") != F.col("user_id")
        asked = asked.withColumn("fault", F.coalesce("fault", F.when(taken, "email_taken")))
        asked = asked.drop("email_key", "first_user", "holder")
    decided = stage(asked.withColumnRenamed("fault", "reason").drop("known"))
    return Outcome(decided, {"users": _with_newest_values(users, decided, fields)})


def update_users_in_order(requests: DataFrame, users: DataFrame, stage: Stage = written) -> Outcome:
    """Like :func:`update_users`, but every request meets the addresses as the earlier ones left them.

    A user that takes another address gives up the one it had, and a later request of another user may take that;
    so may a chain of users, and an address may pass through many hands. (request_time, request_id) is unique.

    Whether a request finds its address free depends on earlier requests only: on the newest accepted one for
    that address, and on the next accepted request by which its user moved elsewhere. Starting from all requests for
    addresses that nobody else holds, each round judges all requests by the acceptances of the round before, until none
    changes. A request is settled for good one round after those it depends on, so there are at most two rounds more
    than the longest chain of such steps: two per hand that one address passes through (a claim, and the release
    before it), one per user in a chain of users that move on into each other's place. The number of requests
    does not matter. A round is two passes in which an address or a user with most of the requests lies in
    many tasks (``operators.timeline``); ``stage`` writes the requests of each round once.
    """
    fields = [c for c in PROFILE_FIELDS if c in users.columns and c in requests.columns]
    known = users.select("user_id", F.lit(True).alias("known"))
    role_fault = _given(requests, "role") & ~F.col("role").isin(*ROLES) if "role" in fields else F.lit(False)
    asked = stage(
        requests.join(known, "user_id", "left")
        .withColumn("fault", first_reason((F.col("known").isNull(), "not_found"), (role_fault, "invalid_role")))
        .drop("known")
    )
    taken = _refused_claims(asked, users, stage) if "email" in fields else None
    if taken is None:
        decided = asked.withColumnRenamed("fault", "reason")
    else:
        decided = stage(
            asked.join(taken, "request_id", "left")
            .withColumn("reason", F.coalesce("fault", F.when(F.col("taken"), "email_taken")))
            .drop("fault", "taken")
        )
    return Outcome(decided, {"users": _with_newest_values(users, decided, fields)})


def _refused_claims(asked: DataFrame, users: DataFrame, stage: Stage) -> DataFrame:
    """Identifiers of the requests whose address belongs to another user when they come."""
    holders = users.filter(F.col("email").isNotNull()).groupBy(collated(F.col("email")).alias("address"))
    holders = holders.agg(F.min("user_id").alias("user_id"))
    claims = asked.filter(F.col("fault").isNull() & F.col("email").isNotNull()).select(
        "request_id", "request_time", "user_id", collated(F.col("email")).alias("address")
    )
    # The first guess: nobody gives up an address.
    guess = salted_join(
        claims, holders.withColumnRenamed("user_id", "holder"), ["address"], "left", ["request_id"]
    ).withColumn("accepted", F.coalesce(F.col("holder") == F.col("user_id"), F.lit(True)))
    earliest_first = ["request_time", "request_id"]
    latest_first = [F.desc(c) for c in earliest_first]
    # Who holds an address from the start claimed it before all others.
    rows = guess.drop("holder").unionByName(holders.withColumn("accepted", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumn("was_accepted", F.lit(None).cast("boolean"))
    while True:
        # What a user takes next ends its hold of what it has.
        moves = F.when(F.col("accepted"), order())
        placed = stage(summed_up(rows, ["user_id"], latest_first, moves, "moved_on"))
        if placed.filter(~F.col("accepted").eqNullSafe(F.col("was_accepted"))).isEmpty():
            return placed.filter(~F.col("accepted")).select("request_id", F.lit(True).alias("taken"))
        holder = F.when(F.col("accepted"), F.struct("user_id", "moved_on"))
        rows = resolved(placed, ["user_id"], "moved_on")
        rows = _judged_again(with_last_before(rows, ["address"], earliest_first, holder, "holder", stage))


def _judged_again(rows: DataFrame) -> DataFrame:
    """Claims judged by the newest one for their address that was accepted in the round before."""
    free = (
        F.col("holder").isNull()
        | (F.col("holder.user_id") == F.col("user_id"))
        | F.coalesce(F.col("holder.moved_on") < order(), F.lit(False))
    )
    return rows.select(
        "request_id",
        "request_time",
        "user_id",
        "address",
        F.col("accepted").alias("was_accepted"),
        # An address held from the start is no request.
        (F.col("request_id").isNull() | free).alias("accepted"),
    )


def _with_newest_values(users: DataFrame, decided: DataFrame, fields: list[str]) -> DataFrame:
    """Users with the newest accepted value of each field."""
    accepted = decided.filter(F.col("reason").isNull())
    newest = accepted.groupBy("user_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order())).alias(f"new_{c}") for c in fields]
    )
    return users.join(newest, "user_id", "left").select(
        *[F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in users.columns]
    )


def _given(requests: DataFrame, column: str) -> Column:
    return F.col(column).isNotNull() if column in requests.columns else F.lit(False)


def approve_stale(
    posts: DataFrame, as_of: Column, limit: int = 1, days: int = STALE_AFTER_DAYS
) -> DataFrame:
    """Posts with the oldest waiting ones approved."""
    chosen = top_rows(
        stale_pending(posts, days, as_of).select("post_id", "created_at"),
        [F.asc("created_at"), F.asc("post_id")],
        limit,
    ).withColumn("new_status", F.lit("approved"))
    return overwrite(posts, chosen, ["post_id"], "status", "new_status")


def audit_rows(
    accepted: DataFrame,
    action: Column,
    entity_name: str,
    entity_id: Column,
    actor: Column | None = None,
    workflow: str = "",
) -> DataFrame:
    """One audit row per accepted request, of its user unless another actor is given.

    ``workflow`` keeps the identifiers of two workflows on one entity apart.
    """
    source = [F.lit("audit"), F.lit(entity_name), *([F.lit(workflow)] if workflow else [])]
    return accepted.select(
        stable_id(*source, F.col("request_id").cast("string")).alias("log_id"),
        (F.col("user_id") if actor is None else actor).alias("user_id"),
        action.alias("action"),
        F.lit(entity_name).alias("entity_name"),
        entity_id.cast("string").alias("entity_id"),
        F.col("request_time").alias("created_at"),
    )


def decision_action(status: Column) -> Column:
    """Audit action of a review decision; a requested edit is recorded as an update."""
    return (
        F.when(status == "approved", "APPROVE").when(status == "rejected", "REJECT").otherwise("UPDATE")
    )


def audit_of(outcomes: dict[str, Outcome]) -> DataFrame:
    """Audit rows of several workflows, named as in ``AUDITED``."""
    parts = [
        audit_rows(
            outcome.accepted, action(), entity, entity_id(), ACTORS.get(name, lambda: None)(), SHARED.get(name, "")
        )
        for name, outcome in outcomes.items()
        for action, entity, entity_id in [AUDITED[name]]
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


# Workflows whose entity another workflow audits as well.
SHARED = {
    name: name
    for name in ("drafts", "brand_edits", "profile_updates", "user_deletes", "account_disconnects")
}


def _new(kind: str) -> Column:
    return stable_id(F.lit(kind), F.col("request_id").cast("string"))


# Whom an audit row names where it is not the user of the request: a new user acts for
# itself, and a deleted one can no longer be referred to.
ACTORS = {
    "registrations": lambda: _new("user"),
    "user_deletes": lambda: F.lit(None),
}

# Workflow → action, entity and its id, as expressions over an accepted request.
AUDITED = {
    "decisions": (
        lambda: decision_action(F.col("approval_status")), "approvals", lambda: F.col("post_id"),
    ),
    "schedules": (lambda: F.lit("SCHEDULE"), "scheduled_posts", lambda: F.col("post_id")),
    "drafts": (lambda: F.lit("CREATE"), "content_drafts", lambda: _new("draft")),
    "brands": (lambda: F.lit("CREATE"), "clients", lambda: _new("client")),
    "brand_edits": (lambda: F.lit("UPDATE"), "clients", lambda: F.col("client_id")),
    "draft_deletes": (lambda: F.lit("DELETE"), "content_drafts", lambda: F.col("draft_id")),
    "registrations": (lambda: F.lit("CREATE"), "users", lambda: _new("user")),
    "profile_updates": (lambda: F.lit("UPDATE"), "users", lambda: F.col("user_id")),
    "user_deletes": (lambda: F.lit("DELETE"), "users", lambda: F.col("user_id")),
    "member_joins": (lambda: F.lit("CREATE"), "client_members", lambda: _new("membership")),
    "account_connects": (lambda: F.lit("UPDATE"), "social_accounts", lambda: F.col("client_id")),
    "account_disconnects": (lambda: F.lit("DELETE"), "social_accounts", lambda: F.col("client_id")),
    "recommendations": (lambda: F.lit("CREATE"), "content_recommendations", lambda: _new("recommendation")),
    "generations": (lambda: F.lit("GENERATE"), "ai_generations", lambda: F.col("draft_id")),
}
