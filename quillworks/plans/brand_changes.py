"""New brands, brand edits, members by invite code and social accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillworks.functions.fixed_values import (
    MIN_BRAND_NAME_CHARACTERS,
    MIN_HANDLE_CHARACTERS,
    PLATFORMS,
)
from quillworks.functions.scalars import (
    bare_handle,
    blank_to_null,
    collated,
    handle,
    normal_code,
    stable_id,
    strip,
)
from quillworks.operators.brands import access_of_requests
from quillworks.operators.skew import salted_join
from quillworks.plans.outcome import (
    Outcome,
    Stage,
    by_roles,
    first_reason,
    order,
    unstaged,
    with_roles,
)

OPTIONAL_FIELDS = ["industry", "brand_voice", "target_audience", "do_not_use"]
EDITED_FIELDS = ["industry", "brand_voice", "target_audience", "brand_color", "do_not_use"]


def _new_id(kind: str) -> Column:
    return stable_id(F.lit(kind), F.col("request_id").cast("string"))


def intake_brands(
    requests: DataFrame, users: DataFrame, clients: DataFrame, stage: Stage = unstaged
) -> Outcome:
    """Requests (request_id, request_time, user_id, brand_name, brand_color, optional fields).

    Every accepted brand also makes its owner a manager member.
    """
    named = requests.withColumn("brand_name", strip(F.col("brand_name"))).withColumn(
        "name_key", collated(F.col("brand_name"))
    )
    long_enough = F.coalesce(F.char_length("brand_name") >= MIN_BRAND_NAME_CHARACTERS, F.lit(False))
    first = (
        by_roles(named.filter(long_enough), users, ["admin"])
        .groupBy("name_key")
        .agg(F.min(order()).alias("winner"))
    )
    taken = clients.select(
        collated(F.col("client_name")).alias("name_key"), F.lit(True).alias("taken")
    ).distinct()
    admin = F.coalesce(F.col("role") == "admin", F.lit(False))
    facts = first.join(taken, "name_key", "left")
    decided = stage(
        salted_join(with_roles(named, users), facts, ["name_key"], "left", ["request_id"])
        .withColumn(
            "reason",
            first_reason(
                (~admin, "forbidden"),
                (~long_enough, "name_too_short"),
                (F.col("taken") | (order() > F.col("winner")), "duplicate_name"),
            ),
        )
        .drop("name_key", "taken", "winner", "role")
    )
    accepted = decided.filter(F.col("reason").isNull())
    code = F.col("invite_code") if "invite_code" in requests.columns else F.lit(None).cast("string")
    brands = accepted.select(
        _new_id("client").alias("client_id"),
        F.col("brand_name").alias("client_name"),
        F.col("user_id").alias("owner_id"),
        *[blank_to_null(F.col(c)).alias(c) for c in OPTIONAL_FIELDS],
        "brand_color",
        code.alias("invite_code"),
        F.col("request_time").alias("created_at"),
    )
    members = accepted.select(
        _new_id("membership").alias("membership_id"),
        _new_id("client").alias("client_id"),
        "user_id",
        F.lit("manager").alias("member_role"),
        F.col("request_time").alias("added_at"),
    )
    return Outcome(decided, appended={"clients": brands, "client_members": members})


def edit_brands(requests: DataFrame, clients: DataFrame, stage: Stage = unstaged) -> Outcome:
    """Requests (request_id, request_time, user_id, client_id, the five edited fields).

    Only the owner may edit; the newest accepted request sets all five fields, so
    a blank one empties its field.
    """
    owners = clients.select("client_id", "owner_id")
    owner = F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False))
    decided = stage(
        requests.join(owners, "client_id", "left")
        .withColumn("reason", F.when(~owner, "not_owner"))
        .drop("owner_id")
    )
    values = F.struct(
        *[(F.col(c) if c == "brand_color" else strip(F.col(c))).alias(c) for c in EDITED_FIELDS]
    )
    newest = (
        requests.groupBy("client_id", F.col("user_id").alias("owner_id"))
        .agg(F.max_by(values, order()).alias("edit"))
    )
    after = clients.join(newest, ["client_id", "owner_id"], "left").select(
        *[
            F.when(F.col("edit").isNotNull(), F.col(f"edit.{c}")).otherwise(F.col(c)).alias(c)
            if c in EDITED_FIELDS
            else c
            for c in clients.columns
        ]
    )
    return Outcome(decided, {"clients": after})


def join_brands(
    requests: DataFrame, clients: DataFrame, members: DataFrame, stage: Stage = unstaged
) -> Outcome:
    """Requests (request_id, request_time, user_id, invite_code): new writer members.

    A member who joins again, also within the batch, is ``already_member``.
    """
    codes = clients.filter(F.col("invite_code").isNotNull()).select(
        collated(F.col("invite_code")).alias("code"), "client_id", "client_name"
    )
    asked = requests.withColumn("code", collated(normal_code(F.col("invite_code"))))
    first = asked.groupBy("code", "user_id").agg(F.min(order()).alias("winner"))
    present = members.select("client_id", "user_id", F.lit(True).alias("present")).distinct()
    facts = first.join(codes, "code").join(present, ["client_id", "user_id"], "left")
    decided = stage(
        salted_join(asked, facts, ["code", "user_id"], "left", ["request_id"])
        .withColumn(
            "reason",
            first_reason(
                (F.col("client_id").isNull(), "invalid_code"),
                (F.col("present") | (order() > F.col("winner")), "already_member"),
            ),
        )
        .drop("code", "present", "winner")
    )
    rows = decided.filter(F.col("reason").isNull()).select(
        _new_id("membership").alias("membership_id"),
        "client_id",
        "user_id",
        F.lit("writer").alias("member_role"),
        F.col("request_time").alias("added_at"),
    )
    return Outcome(decided, appended={"client_members": rows})


def _owner_checks(visible: Column, owner: Column) -> list[tuple[Column, str]]:
    return [(~visible, "not_found"), (~owner, "forbidden")]


def connect_accounts(
    requests: DataFrame,
    clients: DataFrame,
    members: DataFrame,
    accounts: DataFrame,
    stage: Stage = unstaged,
) -> Outcome:
    """Requests (request_id, request_time, user_id, client_id, platform, account_name).

    An account that exists for the brand and platform keeps its id and is
    connected again under the newest handle; otherwise one is added.
    """
    access = access_of_requests(requests, clients, members)
    decided = stage(
        access.withColumn(
            "reason",
            first_reason(
                *_owner_checks(F.col("access_type") != "none", F.col("access_type") == "owner"),
                (~F.coalesce(F.col("platform").isin(*PLATFORMS), F.lit(False)), "invalid_platform"),
                (
                    ~F.coalesce(F.char_length(bare_handle(F.col("account_name"))) >= MIN_HANDLE_CHARACTERS, F.lit(False)),
                    "handle_too_short",
                ),
            ),
        ).withColumn("handle", handle(F.col("account_name")))
    )
    changes = (
        decided.filter(F.col("reason").isNull())
        .groupBy("client_id", "platform")
        .agg(
            F.min(order()).alias("first"),
            F.max_by(F.struct("request_id", "handle"), order()).alias("last"),
        )
        .withColumn("changed", F.lit(True))
    )
    changed = F.col("changed").isNotNull()
    new_account = stable_id(F.lit("account"), F.col("first.request_id").cast("string"))
    new_profile = stable_id(F.lit("profile"), F.col("last.request_id").cast("string"))
    values = {
        "account_id": F.coalesce(F.col("account_id").cast("string"), new_account),
        "account_name": F.when(changed, F.col("last.handle")).otherwise(F.col("account_name")),
        "connected_status": F.when(changed, 1).otherwise(F.col("connected_status")),
        "buffer_profile_id": F.when(changed, new_profile).otherwise(F.col("buffer_profile_id"))
        if "buffer_profile_id" in accounts.columns
        else None,
        "connected_at": F.coalesce("connected_at", F.col("first.request_time"))
        if "connected_at" in accounts.columns
        else None,
    }
    after = accounts.join(changes, ["client_id", "platform"], "full").select(
        *[
            values[c].alias(c) if values.get(c) is not None else F.col(c)
            for c in accounts.columns
        ]
    )
    return Outcome(decided, {"social_accounts": after})


def disconnect_accounts(
    requests: DataFrame,
    clients: DataFrame,
    members: DataFrame,
    accounts: DataFrame,
    stage: Stage = unstaged,
) -> Outcome:
    """Requests (request_id, request_time, user_id, client_id, platform); rows are kept."""
    decided = stage(
        access_of_requests(requests, clients, members).withColumn(
            "reason",
            first_reason(
                *_owner_checks(F.col("access_type") != "none", F.col("access_type") == "owner")
            ),
        )
    )
    gone = (
        decided.filter(F.col("reason").isNull())
        .select("client_id", "platform")
        .distinct()
        .withColumn("off", F.lit(0))
    )
    after = (
        accounts.join(gone, ["client_id", "platform"], "left")
        .withColumn("connected_status", F.coalesce("off", "connected_status"))
        .select(*accounts.columns)
    )
    return Outcome(decided, {"social_accounts": after})
