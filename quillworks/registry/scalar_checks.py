"""Scalar functions over whole columns (F1-F27) and source/sink round trips (S*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillworks.functions import scalars as sc
from quillworks.registry.checks import check, stripped
from quillworks.session import shared_folder
from quillworks.sources import sinks, tables
from quillworks.sources.catalogue import BRAND_COLUMNS, TABLES


@check(
    "f1_defaults",
    "clients",
    sql="SELECT client_id, COALESCE(NULLIF(industry, ''), 'No industry set') AS industry FROM clients",
)
def f1(t):
    return t.clients.select("client_id", sc.or_default(F.col("industry"), "No industry set").alias("industry"))


@check(
    "f5_preview",
    "content_recommendations",
    sql="""
SELECT recommendation_id, concat(substring(COALESCE(recommendation_text, ''), 1, 120), '...') AS preview
FROM content_recommendations""",
)
def f5(t):
    return t.content_recommendations.select(
        "recommendation_id", sc.preview(F.col("recommendation_text")).alias("preview")
    )


@check(
    "f6_title_case",
    "posts",
    sql="""
SELECT post_id, concat(upper(substring(platform, 1, 1)), substring(platform, 2)) AS platform,
       CASE status WHEN 'pending_approval' THEN 'Pending_Approval'
            ELSE concat(upper(substring(status, 1, 1)), substring(status, 2)) END AS status,
       concat(upper(substring(repurposed_content, 1, 1)), substring(repurposed_content, 2)) AS sentence
FROM posts""",
)
def f6(t):
    return t.posts.select(
        "post_id",
        sc.title_case(F.col("platform")).alias("platform"),
        sc.title_case(F.col("status")).alias("status"),
        sc.first_upper(F.col("repurposed_content")).alias("sentence"),
    )


@check(
    "f8_strip",
    sql=f"""
SELECT doc_id, {stripped("concat(chr(160), ' ', text, chr(10), chr(8195))")} AS stripped,
       length({stripped("text")}) AS characters FROM documents""",
)
def f8(t):
    padded = F.concat(F.lit("  "), F.col("text"), F.lit("\n "))
    return t.source("documents").select(
        "doc_id",
        sc.strip(padded).alias("stripped"),
        F.char_length(sc.strip(F.col("text"))).alias("characters"),
    )


@check(
    "f9_handle",
    "account_requests",
    sql="""
SELECT request_id, concat('@', ltrim(trim(account_name), '@')) AS handle FROM account_requests""",
)
def f9(t):
    return t.account_requests.select("request_id", sc.handle(F.col("account_name")).alias("handle"))


@check(
    "f10_spaced_labels",
    "posts",
    sql="SELECT post_id, replace(status, '_', ' ') AS label FROM posts",
)
def f10(t):
    return t.posts.select("post_id", sc.spaced(F.col("status")).alias("label"))


@check(
    "f11_comma_list",
    "platform_requests",
    sql="""
SELECT request_id, array_to_string([trim(x) FOR x IN string_split(platforms, ',') IF trim(x) <> ''], '|') AS items FROM platform_requests""",
)
def f11(t):
    return t.platform_requests.select(
        "request_id", F.array_join(sc.comma_list(F.col("platforms")), "|").alias("items")
    )


@check(
    "f12_text_lengths",
    sql=f"SELECT doc_id, length(text) AS characters, length({stripped('text')}) >= 20 AS long_enough FROM documents",
)
def f12(t):
    text = F.col("text")
    return t.source("documents").select(
        "doc_id",
        F.char_length(text).alias("characters"),
        (F.char_length(sc.strip(text)) >= 20).alias("long_enough"),
    )


@check(
    "f16_week_end",
    "content_drafts",
    sql="SELECT draft_id, CAST(CAST(created_at + 6 AS DATE) AS VARCHAR) AS week_end FROM content_drafts",
)
def f16(t):
    return t.content_drafts.select("draft_id", sc.week_end(F.col("created_at")).alias("week_end"))


@check(
    "f17_schedule_time",
    "schedule_requests",
    sql="""
SELECT request_id, CASE WHEN length(scheduled_time) = 16 THEN CAST(replace(scheduled_time, 'T', ' ') AS TIMESTAMP) END
       AS slot FROM schedule_requests""",
)
def f17(t):
    return t.schedule_requests.select("request_id", sc.iso_timestamp(F.col("scheduled_time")).alias("slot"))


@check(
    "f19_time_prefixes",
    "audit_logs",
    sql="""
SELECT log_id, strftime(created_at, '%Y-%m-%d') AS day, strftime(created_at, '%Y-%m-%d %H:%M') AS minute,
       strftime(created_at, '%Y-%m-%dT%H:%M') AS form_minute FROM audit_logs""",
)
def f19(t):
    at = F.col("created_at")
    return t.audit_logs.select(
        "log_id",
        sc.day_text(at).alias("day"),
        sc.minute_text(at).alias("minute"),
        sc.form_minute(at).alias("form_minute"),
    )


@check(
    "f20_number_labels",
    "analytics_logs",
    sql="""
SELECT post_id, format('{:,}', views) AS views, concat(comments, CASE WHEN comments = 1 THEN ' comment' ELSE ' comments' END)
       AS comments FROM analytics_logs""",
)
def f20(t):
    return t.analytics_logs.select(
        "post_id",
        sc.thousands(F.col("views")).alias("views"),
        sc.counted(F.col("comments"), "comment").alias("comments"),
    )


@check(
    "f23_engagement_rate",
    "analytics_logs",
    sql="""
SELECT post_id, views, CASE WHEN views - 5000 > 0 THEN
       CAST((20000 * (likes + comments + shares) + views - 5000) // (2 * (views - 5000)) AS DOUBLE) / 100.0 END AS rate
FROM analytics_logs""",
)
def f23(t):
    # Views are lowered so that some rows have none.
    views = F.greatest(F.col("views") - 5000, F.lit(0))
    value = sc.rate(F.col("likes"), F.col("comments"), F.col("shares"), views)
    return t.analytics_logs.select("post_id", "views", value.alias("rate"))


@check(
    "f27_invite_code_form",
    "clients",
    sql="""
SELECT client_id, regexp_full_match(invite_code, '[A-Z0-9]{6}') AS plain,
       regexp_full_match(concat(invite_code, '-'), '[A-Z0-9]{6}') AS with_dash FROM clients""",
)
def f27(t):
    return t.clients.select(
        "client_id",
        sc.is_invite_code(F.col("invite_code")).alias("plain"),
        sc.is_invite_code(F.concat("invite_code", F.lit("-"))).alias("with_dash"),
    )


@check(
    "s1_seed_csv_round_trip",
    "approvals",
    sql="""
SELECT CAST(approval_id AS VARCHAR) AS approval_id, CAST(post_id AS VARCHAR) AS post_id,
       CAST(manager_id AS VARCHAR) AS manager_id, approval_status, remarks,
       strftime(approval_date, '%Y-%m-%d %H:%M:%S') AS approval_date FROM approvals""",
)
def s1(t):
    folder = shared_folder(t.spark, "seed")
    names = TABLES["approvals"].schema.names
    rows = t.approvals.select(*[F.col(n).cast("string") for n in names[:-1]], "approval_date")
    rows.write.option("header", True).option("escape", '"').option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
    ).csv(folder)
    seed = tables.read_seed(t.spark, folder, "approvals")
    return seed.withColumn("approval_date", F.date_format("approval_date", "yyyy-MM-dd HH:mm:ss"))


@check(
    "s4_schema_evolution",
    "clients",
    sql="""
SELECT CAST(client_id AS VARCHAR) AS client_id, client_name, CAST(NULL AS VARCHAR) AS owner_id,
       '#0a0a0a' AS brand_color, CAST(NULL AS VARCHAR) AS invite_code FROM clients WHERE active_status = 0
UNION ALL
SELECT CAST(client_id AS VARCHAR), client_name, CAST(owner_id AS VARCHAR), brand_color, invite_code
FROM clients WHERE active_status = 1""",
)
def s4(t):
    # Inactive brands stand for rows written before the brand columns existed.
    new = [c.name for c in BRAND_COLUMNS]
    older = tables.add_columns(t.clients.filter("active_status = 0").drop(*new), BRAND_COLUMNS)
    newer = t.clients.filter("active_status = 1").withColumn("owner_id", F.col("owner_id").cast("string"))
    both = older.unionByName(newer)
    return both.select(F.col("client_id").cast("string"), "client_name", "owner_id", "brand_color", "invite_code")


@check(
    "s6_append_with_defaults",
    "ai_generations",
    sql="""
SELECT CAST(draft_id AS VARCHAR) AS draft_id, platform, generated_text AS repurposed_content,
       'pending_approval' AS status, 36 AS id_length, true AS has_time, CAST(NULL AS VARCHAR) AS caption
FROM ai_generations""",
)
def s6(t):
    folder = shared_folder(t.spark, "append")
    rows = t.ai_generations.select("draft_id", "platform", F.col("generated_text").alias("repurposed_content"))
    for _ in range(2):  # a retried batch counts once
        sinks.append_rows(rows, "posts", folder, batch="generations")
    return sinks.read_appended(t.spark, "posts", folder).select(
        "draft_id",
        "platform",
        "repurposed_content",
        "status",
        F.char_length("post_id").alias("id_length"),
        F.col("created_at").isNotNull().alias("has_time"),
        "caption",
    )
