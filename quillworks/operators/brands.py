"""Brands: who may see them, their members, accounts and the context for prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillworks.functions.fixed_values import DEFAULT_BRAND_COLOR, NO_INDUSTRY, PLATFORM_NAMES, PLATFORMS
from quillworks.functions.scalars import initial, or_default
from quillworks.operators.ordering import top_per_group
from quillworks.operators.skew import salted_join


def brand_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.select(
        "client_id", "account_id", "platform", "account_name", "connected_status"
    ).orderBy("client_id", "platform", "account_id")


def connected(accounts: DataFrame) -> DataFrame:
    return accounts.filter(F.col("connected_status") == 1)


def brand_members(members: DataFrame, users: DataFrame) -> DataFrame:
    """Members of every brand, the newest of a brand first.

    The order is one over (brand, time, user), which cuts a brand with most of the members into several tasks.
    """
    people = users.select("user_id", "full_name", "email")
    return members.join(people, "user_id").orderBy("client_id", F.desc("added_at"), "user_id")


def newest_members(members: DataFrame, users: DataFrame, limit: int) -> DataFrame:
    """The first members of every brand's list, with their place on it."""
    first = top_per_group(members, ["client_id"], [F.desc("added_at"), F.asc("user_id")], limit, "place")
    return first.join(users.select("user_id", "full_name", "email"), "user_id")


def owner_pairs(clients: DataFrame) -> DataFrame:
    return clients.filter(F.col("owner_id").isNotNull()).select(
        "client_id", F.col("owner_id").alias("user_id"), F.lit("owner").alias("access_type")
    )


def member_pairs(members: DataFrame) -> DataFrame:
    return members.select("client_id", "user_id", F.col("member_role").alias("access_type"))


def member_brands(clients: DataFrame, members: DataFrame) -> DataFrame:
    """Brands a user was added to, for every user."""
    return member_pairs(members).join(clients, "client_id")


def brand_list(
    users: DataFrame, clients: DataFrame, members: DataFrame, one_row_per_brand: bool = False
) -> DataFrame:
    """Brands on the list of every user.

    Admins see owned and joined brands. An owner is also a member of the own
    brand, which then shows twice with two access types, unless
    ``one_row_per_brand`` keeps the owner row only. Others see joined brands.
    The set union runs on narrow pairs; brand columns are joined to its result.
    """
    admins = users.filter(F.col("role") == "admin").select("user_id")
    owned = owner_pairs(clients).join(admins, "user_id", "left_semi")
    joined = member_pairs(members)
    if one_row_per_brand:
        joined = joined.join(owned.select("client_id", "user_id"), ["client_id", "user_id"], "left_anti")
    return owned.unionByName(joined).distinct().join(clients, "client_id")


def brand_access(clients: DataFrame, members: DataFrame) -> DataFrame:
    """(client_id, user_id, access_type) for every pair with access; owner beats member role."""
    owners = owner_pairs(clients).withColumn("order", F.lit(0))
    joined = member_pairs(members.join(clients, "client_id", "left_semi")).withColumn("order", F.lit(1))
    return (
        owners.unionByName(joined)
        .groupBy("client_id", "user_id")
        .agg(F.min(F.struct("order", "access_type")).alias("access"))
        .select("client_id", "user_id", F.col("access.access_type").alias("access_type"))
    )


def access_of_requests(requests: DataFrame, clients: DataFrame, members: DataFrame) -> DataFrame:
    """Requests (request_id, client_id, user_id, …) with the access of their user, ``none`` without any."""
    access = brand_access(clients, members)
    return salted_join(requests, access, ["client_id", "user_id"], "left", ["request_id"]).withColumn(
        "access_type", F.coalesce("access_type", F.lit("none"))
    )


def brands_with_access(clients: DataFrame, members: DataFrame) -> DataFrame:
    """Every brand a user may open, with the access type."""
    return brand_access(clients, members).join(clients, "client_id")


def brand_cards(brands: DataFrame) -> DataFrame:
    """Card texts of a brand list; the invite code is shown to owners only."""
    return brands.withColumns(
        {
            "avatar": initial(F.col("client_name")),
            "industry_text": or_default(F.col("industry"), NO_INDUSTRY),
            "color": or_default(F.col("brand_color"), DEFAULT_BRAND_COLOR),
            "shown_code": F.when(F.col("access_type") == "owner", F.col("invite_code")),
        }
    )


def brands_of_authors(drafts: DataFrame) -> DataFrame:
    """Distinct (user, brand) pairs of authors."""
    return drafts.select(F.col("created_by").alias("user_id"), "client_id").distinct()


def first_brand_of_authors(drafts: DataFrame) -> DataFrame:
    """One brand per author: the smallest id."""
    return drafts.groupBy(F.col("created_by").alias("user_id")).agg(
        F.min("client_id").alias("client_id")
    )


def brands_with_draft_by(clients: DataFrame, drafts: DataFrame, authors: DataFrame) -> DataFrame:
    """Brands that have a draft by one of the given authors."""
    written = drafts.join(
        authors.select(F.col("user_id").alias("created_by")), "created_by", "left_semi"
    ).select("client_id")
    return clients.join(written.distinct(), "client_id", "left_semi")


def handle_maps(accounts: DataFrame) -> DataFrame:
    """Map platform → handle over the connected accounts of every brand.

    One conditional maximum per platform: no list is built, whatever the number of rows.
    """
    per_platform = connected(accounts).groupBy("client_id").agg(
        *[F.max(F.when(F.col("platform") == p, F.col("account_name"))).alias(p) for p in PLATFORMS]
    )
    entries = [item for p in PLATFORMS for item in (F.lit(p), F.col(p))]
    return per_platform.select(
        "client_id",
        F.map_filter(F.create_map(*entries), lambda _, name: name.isNotNull()).alias("social_handles"),
    )


def connection_matrix(clients: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every brand with all six platforms: connected or not, and the handle if connected.

    Brands meet their handles as one map each and are unrolled afterwards.
    """
    screen = F.array(
        *[
            F.struct(F.lit(key).alias("platform"), F.lit(name).alias("platform_name"))
            for key, name in PLATFORM_NAMES.items()
        ]
    )
    return (
        clients.select("client_id")
        .join(handle_maps(accounts), "client_id", "left")
        .select("client_id", "social_handles", F.explode(screen).alias("p"))
        .select(
            "client_id",
            "p.*",
            F.try_element_at("social_handles", F.col("p.platform")).alias("account_name"),
        )
        .withColumn("is_connected", F.col("account_name").isNotNull())
    )


def brand_context(clients: DataFrame, accounts: DataFrame) -> DataFrame:
    """Identity fields and handles of every brand; an empty map without connected accounts."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return (
        clients.select(
            "client_id",
            F.col("client_name").alias("brand_name"),
            "industry",
            "brand_voice",
            "target_audience",
            "do_not_use",
        )
        .join(handle_maps(accounts), "client_id", "left")
        .withColumn("social_handles", F.coalesce("social_handles", empty))
    )


def handle_text(handles: Column) -> Column:
    """Handles as one text in platform order."""
    entries = F.array_sort(F.map_entries(handles))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
