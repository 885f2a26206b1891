"""Logical tables and request batches over the given Parquet tables.

Each binding is a projection written once in SQL that Spark and DuckDB read the
same way, so the checked query and its oracle start from equal rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PLATFORM_BY_NUMBER = (
    "CASE {n} WHEN 0 THEN 'instagram' WHEN 1 THEN 'linkedin' WHEN 2 THEN 'facebook'"
    " WHEN 3 THEN 'twitter' WHEN 4 THEN 'tiktok' ELSE 'youtube' END"
)


@dataclass(frozen=True)
class Binding:
    source: str
    columns: dict[str, str]
    where: str | None = None
    distinct: bool = False

    def sql(self) -> str:
        items = ", ".join(f"{expr} AS {name}" for name, expr in self.columns.items())
        where = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {'DISTINCT ' if self.distinct else ''}{items} FROM {self.source}{where}"


POST_PLATFORM = (
    "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'instagram' WHEN '2' THEN 'linkedin'"
    " WHEN '3' THEN 'facebook' WHEN '4' THEN 'twitter' ELSE 'tiktok' END"
)
# Keys spread over their whole parent table at every scale: 15 drafts a brand, 3 events a post.
BRAND_OF_CUSTOMER = "CAST(floor(c_custkey / 15) AS BIGINT)"
BRAND_OF_PART = "CAST(floor(p_partkey / 20) AS BIGINT)"
POST_OF_EVENT = "CAST(floor(event_id / 3) * 4 AS BIGINT)"
WEEK_START = "CAST(DATE '2024-01-01' + CAST(7 * (doc_id % 10) AS INT) AS DATE)"

BINDINGS = {
    "users": Binding(
        "nation",
        {
            "user_id": "CAST(n_nationkey AS BIGINT)",
            "full_name": "n_name",
            "email": "concat(lower(n_name), '@example.com')",
            "role": "CASE n_nationkey % 4 WHEN 0 THEN 'writer' WHEN 1 THEN 'manager'"
            " WHEN 2 THEN 'admin' ELSE 'client' END",
        },
    ),
    "clients": Binding(
        "supplier",
        {
            "client_id": "s_suppkey",
            "client_name": "s_name",
            "timezone": "'UTC'",
            "active_status": "CASE WHEN s_acctbal >= 0 THEN 1 ELSE 0 END",
            "owner_id": "CAST(s_nationkey AS BIGINT)",
            "industry": "CASE WHEN s_acctbal < 1000 THEN NULL WHEN s_acctbal < 2000 THEN ''"
            " ELSE concat('industry ', CAST(s_nationkey AS STRING)) END",
            "brand_voice": "concat('voice of ', lower(s_name))",
            "target_audience": "CASE WHEN s_acctbal > 5000 THEN 'loyal buyers' END",
            "brand_color": "CASE WHEN s_acctbal > 8000 THEN '#1a2b3c' ELSE '#0a0a0a' END",
            "do_not_use": "CASE WHEN s_acctbal > 3000 THEN 'slang' END",
            "invite_code": "upper(substring(md5(s_name), 1, 6))",
        },
    ),
    "content_drafts": Binding(
        "customer",
        {
            "draft_id": "c_custkey",
            "client_id": BRAND_OF_CUSTOMER,
            "created_by": "CAST(c_nationkey AS BIGINT)",
            "draft_title": "c_name",
            "draft_content": "concat('Notes by ', c_name, ' for the ', lower(c_mktsegment), ' market')",
            "draft_status": "CASE c_mktsegment WHEN 'BUILDING' THEN 'draft' WHEN 'MACHINERY' THEN"
            " 'submitted' WHEN 'HOUSEHOLD' THEN 'archived' ELSE 'repurposed' END",
            "created_at": "CAST(DATE '2024-01-01' + CAST(c_custkey % 700 AS INT) AS DATE)",
        },
    ),
    "posts": Binding(
        "orders",
        {
            "post_id": "o_orderkey",
            "draft_id": "o_custkey",
            "platform": POST_PLATFORM,
            "repurposed_content": "concat('order ', CAST(o_orderkey AS STRING))",
            "status": "CASE o_orderstatus WHEN 'P' THEN 'pending_approval' WHEN 'F' THEN 'published'"
            " ELSE 'approved' END",
            "created_at": "o_orderdate",
        },
    ),
    "analytics_logs": Binding(
        "lineitem",
        {
            "post_id": "l_orderkey",
            "views": "CAST(floor(l_extendedprice) AS BIGINT)",
            "likes": "CAST(floor(l_quantity) AS BIGINT)",
            "comments": "CAST(l_linenumber AS BIGINT)",
            "shares": "CAST(floor(l_quantity) AS BIGINT) % 7",
            "engagement_rate": "CAST(l_discount * 100 AS DECIMAL(5,2))",
            "recorded_at": "l_shipdate",
        },
    ),
    "approvals": Binding(
        "events",
        {
            "approval_id": "event_id",
            "post_id": POST_OF_EVENT,
            "manager_id": "user_id % 25",
            "approval_status": "CASE WHEN event_type IN ('purchase', 'signup') THEN 'approved'"
            " WHEN event_type = 'error' THEN 'rejected' ELSE 'request_edit' END",
            "remarks": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END",
            "approval_date": "ts",
        },
    ),
    "scheduled_posts": Binding(
        "orders",
        {
            "schedule_id": "o_orderkey",
            "post_id": "o_orderkey",
            "scheduled_time": "o_orderdate + INTERVAL 7 DAY",
            "schedule_status": "'pending'",
        },
        where="o_orderstatus = 'O' AND o_orderkey % 2 = 0",
    ),
    "audit_logs": Binding(
        "events",
        {
            "log_id": "event_id",
            "user_id": "user_id % 25",
            "action": "upper(event_type)",
            "entity_name": "'posts'",
            "entity_id": POST_OF_EVENT,
            "created_at": "ts",
        },
    ),
    "social_accounts": Binding(
        "part",
        {
            "account_id": "p_partkey",
            # Quotient and remainder: every (brand, platform) occurs once, and no row is left out.
            "client_id": "CAST(floor(p_partkey / 6) AS BIGINT)",
            "platform": PLATFORM_BY_NUMBER.format(n="p_partkey % 6"),
            "account_name": "concat('@', replace(p_name, ' ', '_'))",
            "connected_status": "CASE WHEN p_retailprice >= 950 THEN 1 ELSE 0 END",
        },
    ),
    "client_members": Binding(
        "customer",
        {
            "client_id": BRAND_OF_CUSTOMER,
            "user_id": "CAST(c_nationkey AS BIGINT)",
            "member_role": "CASE WHEN c_nationkey % 2 = 0 THEN 'writer' ELSE 'manager' END",
            "added_at": f"CAST(DATE '2024-01-01' + CAST(({BRAND_OF_CUSTOMER} * 7 + c_nationkey * 11) % 90 AS INT) AS TIMESTAMP)",
        },
        distinct=True,
    ),
    "content_recommendations": Binding(
        "documents",
        {
            "recommendation_id": "doc_id",
            "client_id": "CAST(floor(doc_id / 10) AS BIGINT)",
            "week_start_date": WEEK_START,
            "week_end_date": f"CAST({WEEK_START} + 6 AS DATE)",
            "best_platform": PLATFORM_BY_NUMBER.format(n="doc_id % 6"),
            "recommendation_text": "text",
            "created_at": f"CAST({WEEK_START} AS TIMESTAMP)",
        },
    ),
    "ai_generations": Binding(
        "conversations",
        {
            "generation_id": "conv_id * 1000 + turn",
            "draft_id": "conv_id",
            "platform": PLATFORM_BY_NUMBER.format(n="turn % 6"),
            "generated_text": "text",
        },
    ),
    # Snapshots with a key of their own, delivered in three parts: the first half of the month but for some, the second half,
    # and then those left out (most of them late) and, again, one in seven of the first half.
    "snapshot_deliveries": Binding(
        "events",
        {
            "analytics_id": "event_id",
            "post_id": POST_OF_EVENT,
            "engagement_rate": "CAST(event_id % 1000 / 100.0 AS DECIMAL(5,2))",
            "recorded_at": "ts",
            "first_half": "ts < TIMESTAMP '2024-01-16 00:00:00'",
            "held_back": "event_id % 11 = 0",
            "again": "event_id % 7 = 0",
        },
    ),
    # Request batches: every event or master row asks for something.
    "decision_requests": Binding(
        "events",
        {
            "request_id": "event_id",
            "request_time": "ts",
            "user_id": "user_id % 30",
            "post_id": "CASE WHEN event_id % 11 = 0 THEN -1 - event_id ELSE " + POST_OF_EVENT + " END",
            "approval_status": "CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN"
            " 'rejected' WHEN 'view' THEN 'request_edit' ELSE event_type END",
            "remarks": "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('  ', props, ' ')"
            " WHEN 2 THEN '   ' ELSE NULL END",
        },
    ),
    "schedule_requests": Binding(
        "events",
        {
            "request_id": "event_id",
            "request_time": "ts",
            "user_id": "user_id % 25",
            "post_id": "CASE WHEN event_id % 13 = 0 THEN -1 - event_id ELSE " + POST_OF_EVENT + " END",
            "scheduled_time": "CASE event_id % 7 WHEN 0 THEN 'soon' WHEN 1 THEN '2024-06' ELSE"
            " replace(substring(CAST(ts AS STRING), 1, 16), ' ', 'T') END",
        },
    ),
    # Decisions, schedules and status changes in time order: twenty a post, and a third of all for one post.
    "review_events": Binding(
        "events",
        {
            "request_id": "event_id",
            "request_time": "ts",
            "kind": "CASE event_id % 5 WHEN 0 THEN 'schedule' WHEN 1 THEN 'set_status' WHEN 2 THEN 'schedule'"
            " ELSE 'decide' END",
            "user_id": "user_id % 27",
            "post_id": "CASE WHEN event_id % 3 = 0 THEN 4 WHEN event_id % 17 = 0 THEN -1 - event_id ELSE"
            " CAST(floor(event_id / 20) * 4 AS BIGINT) END",
            "new_status": "CASE WHEN event_type = 'error' AND event_id % 5 = 1 THEN 'pending_approval'"
            " WHEN event_type = 'error' THEN 'rejected' WHEN event_type = 'view' THEN 'request_edit'"
            " WHEN event_id % 19 = 0 THEN 'lost' ELSE 'approved' END",
            "scheduled_time": "CASE event_id % 7 WHEN 0 THEN 'soon' WHEN 1 THEN '2024-06' ELSE"
            " replace(substring(CAST(ts AS STRING), 1, 16), ' ', 'T') END",
            "remarks": "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('  ', props, ' ') END",
        },
    ),
    "draft_requests": Binding(
        "conversations",
        {
            "request_id": "conv_id * 1000 + turn",
            "request_time": "TIMESTAMP '2024-02-01 00:00:00'",
            "user_id": "conv_id % 25",
            "client_id": "conv_id",
            "draft_title": "CASE WHEN turn % 3 = 0 THEN ' ab ' WHEN conv_id % 9 = 1 THEN NULL"
            " ELSE concat(' ', role, ' ', CAST(conv_id AS STRING), ' ') END",
            "draft_content": "CASE WHEN turn % 5 = 0 THEN '  not enough text   ' WHEN conv_id % 8 = 3"
            " THEN NULL ELSE text END",
        },
    ),
    "brand_requests": Binding(
        "part",
        {
            "request_id": "p_partkey",
            "request_time": "TIMESTAMP '2024-02-01 00:00:00'",
            "user_id": "p_partkey % 27",
            "brand_name": "CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_size % 10 = 0 THEN ' x ' WHEN p_size % 10 = 1 THEN"
            " concat('supplier#00000000', CAST(p_partkey % 10 AS STRING), ' ')"
            " ELSE concat(' ', upper(p_name), ' ', p_type) END",
            "industry": "CASE WHEN p_size % 2 = 0 THEN '  ' ELSE p_type END",
            "brand_voice": "p_name",
            "target_audience": "''",
            "do_not_use": "concat(p_brand, ' ')",
            "brand_color": "'#0a0a0a'",
        },
    ),
    "brand_edits": Binding(
        "part",
        {
            "request_id": "p_partkey",
            "request_time": "TIMESTAMP '2024-02-01 00:00:00'",
            "client_id": "CASE WHEN p_partkey % 12 = 0 THEN -1 - p_partkey ELSE " + BRAND_OF_PART + " END",
            "user_id": "CAST(p_size % 25 AS BIGINT)",
            "industry": "concat(' ', p_type)",
            "brand_voice": "p_name",
            "target_audience": "CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_brand END",
            "brand_color": "'#ffffff'",
            "do_not_use": "''",
        },
    ),
    "join_requests": Binding(
        "customer",
        {
            "request_id": "c_custkey",
            "request_time": "TIMESTAMP '2024-02-01 00:00:00'",
            "user_id": "CAST(c_nationkey AS BIGINT)",
            "invite_code": "CASE WHEN c_custkey % 9 = 0 THEN 'NOCODE' ELSE concat(' ',"
            " lower(substring(md5(concat('Supplier#', lpad(CAST(" + BRAND_OF_CUSTOMER + " AS STRING), 9, '0'))),"
            " 1, 6)), ' ') END",
        },
    ),
    "account_requests": Binding(
        "part",
        {
            "request_id": "p_partkey",
            "request_time": "TIMESTAMP '2024-02-01 00:00:00'",
            "user_id": "CAST(p_size % 25 AS BIGINT)",
            "client_id": "CASE WHEN p_partkey % 11 = 0 THEN -1 - p_partkey ELSE " + BRAND_OF_PART + " END",
            "platform": "CASE WHEN p_size % 7 = 6 THEN 'myspace' ELSE "
            + PLATFORM_BY_NUMBER.format(n="p_size % 7")
            + " END",
            "account_name": "CASE WHEN p_partkey % 8 = 0 THEN ' @a ' ELSE concat(' @@', p_name) END",
        },
    ),
    "profile_requests": Binding(
        "customer",
        {
            "request_id": "c_custkey",
            "request_time": "TIMESTAMP '2024-02-01 00:00:00'",
            "user_id": "c_custkey % 28",
            "full_name": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END",
            "email": "CASE WHEN c_custkey % 4 = 0 THEN concat(lower(c_mktsegment), '@example.org') END",
            "role": "CASE WHEN c_custkey % 50 = 0 THEN 'client' WHEN c_custkey % 51 = 0 THEN 'guest' END",
        },
    ),
    # One person per supplier and fifteen phases of requests, all of a phase before the next one. Every other person
    # moves to a new address (0); then each asks for the address of the one before (1), freed in the same
    # phase by its holder moving on, in chains of up to five; for that of the one after (2); a third asks for one address (3), leaves
    # it (4) and asks again (5); cycles (6, 7); the rest changes names and roles.
    "people": Binding(
        "supplier",
        {
            "user_id": "s_suppkey",
            "full_name": "s_name",
            "email": "concat('P', CAST(s_suppkey AS STRING), '@example.com')",
            "role": "'writer'",
        },
    ),
    "email_requests": Binding(
        "customer",
        {
            "request_id": "(c_custkey % 15) * 100000000 + c_custkey",
            "request_time": "TIMESTAMP '2024-02-01 00:00:00'",
            "user_id": BRAND_OF_CUSTOMER,
            "full_name": "CASE WHEN c_custkey % 15 > 7 THEN c_name END",
            "email": f"""CASE c_custkey % 15
 WHEN 0 THEN CASE WHEN {BRAND_OF_CUSTOMER} % 2 = 0 THEN concat('new', CAST({BRAND_OF_CUSTOMER} AS STRING), '@example.org') END
 WHEN 1 THEN CASE WHEN {BRAND_OF_CUSTOMER} % 5 > 0 THEN concat('p', CAST({BRAND_OF_CUSTOMER} - 1 AS STRING), '@Example.com') END
 WHEN 2 THEN concat('p', CAST({BRAND_OF_CUSTOMER} + 1 AS STRING), '@example.com')
 WHEN 3 THEN CASE WHEN {BRAND_OF_CUSTOMER} % 3 = 0 THEN 'press@example.com' END
 WHEN 4 THEN CASE WHEN {BRAND_OF_CUSTOMER} % 3 = 0 THEN concat('p', CAST({BRAND_OF_CUSTOMER} AS STRING), '@example.com') END
 WHEN 5 THEN CASE WHEN {BRAND_OF_CUSTOMER} % 3 < 2 THEN 'PRESS@example.com' END
 WHEN 6 THEN concat('p', CAST({BRAND_OF_CUSTOMER} + 1 - 2 * ({BRAND_OF_CUSTOMER} % 2) AS STRING), '@example.com')
 WHEN 7 THEN concat('new', CAST({BRAND_OF_CUSTOMER} + 1 - 2 * ({BRAND_OF_CUSTOMER} % 2) AS STRING), '@example.org') END""",
            "role": "CASE WHEN c_custkey % 15 = 9 THEN 'guest' WHEN c_custkey % 15 = 10 THEN 'manager' END",
        },
    ),
    # Client users neither write nor decide: their drafts and decisions are those of the user before.
    "staff_drafts": Binding(
        "customer",
        {"draft_id": "c_custkey", "created_by": "CAST(c_nationkey - CASE WHEN c_nationkey % 4 = 3 THEN 1 ELSE 0 END AS BIGINT)"},
    ),
    "staff_approvals": Binding(
        "events",
        {"approval_id": "event_id", "manager_id": "user_id % 25 - CASE WHEN user_id % 25 % 4 = 3 THEN 1 ELSE 0 END"},
    ),
    "draft_deletes": Binding(
        "customer",
        {
            "request_id": "c_custkey",
            "request_time": "TIMESTAMP '2024-02-01 00:00:00'",
            # Two requests for every other draft.
            "draft_id": "CAST(floor(c_custkey / 2) * 2 AS BIGINT)",
            "user_id": "CAST((c_nationkey + c_custkey % 2) AS BIGINT)",
        },
    ),
    "user_deletes": Binding(
        "supplier",
        {
            "request_id": "s_suppkey",
            "request_time": "TIMESTAMP '2024-02-01 00:00:00'",
            "user_id": "CAST(s_nationkey + s_suppkey % 5 AS BIGINT)",
        },
    ),
    "registrations": Binding(
        "customer",
        {
            "request_id": "c_custkey",
            "request_time": "TIMESTAMP '2024-02-01 00:00:00'",
            "full_name": "c_name",
            "email": "CASE WHEN c_custkey % 10 = 0 THEN concat('Nation_', CAST(c_nationkey AS STRING),"
            " '@EXAMPLE.com') WHEN c_custkey % 10 = 1 THEN 'nowhere' WHEN c_custkey % 10 < 5 THEN"
            " concat('USER', CAST(c_custkey % 100 AS STRING), '@mail.example') ELSE"
            " concat('user', CAST(c_custkey % 200 AS STRING), '@mail.example') END",
            "password_hash": "md5(c_name)",
            "role": "CASE c_custkey % 6 WHEN 0 THEN 'Writer' WHEN 1 THEN 'employee' ELSE 'manager' END",
        },
    ),
    "recommendation_requests": Binding(
        "customer",
        {
            "request_id": "c_custkey",
            "request_time": "TIMESTAMP '2024-02-01 00:00:00'",
            "user_id": "CAST(c_nationkey + c_custkey % 3 AS BIGINT)",
        },
    ),
    "status_requests": Binding(
        "events",
        {
            "request_id": "event_id",
            "request_time": "ts",
            "draft_id": "user_id",
            "new_status": "CASE event_type WHEN 'view' THEN 'submitted' WHEN 'click' THEN 'draft'"
            " ELSE 'archived' END",
        },
    ),
    "platform_requests": Binding(
        "customer",
        {
            "request_id": "c_custkey",
            "draft_id": "c_custkey",
            "user_id": "CAST(c_nationkey AS BIGINT)",
            "platforms": "CASE c_custkey % 4 WHEN 0 THEN 'instagram, linkedin' WHEN 1 THEN"
            " ' twitter ,,facebook,' WHEN 2 THEN ' , ' ELSE 'tiktok,instagram,tiktok' END",
        },
    ),
}


@cache
def schema_at(path: str) -> T.StructType:
    """Schema of a source table; the footers are read once per path, not once per query."""
    return SparkSession.active().read.parquet(path).schema


class Tables:
    """Logical tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, source: str) -> str:
        return f"{self.folder}/{source}.parquet"

    def source(self, name: str) -> DataFrame:
        return self.spark.read.schema(schema_at(self.path(name))).parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BINDINGS:
            raise AttributeError(name)
        return bound(self.source(BINDINGS[name].source), name)

    def named(self, *names: str) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in names}


def bound(source: DataFrame, name: str) -> DataFrame:
    """A logical table computed from its source, which may be a stream."""
    binding = BINDINGS[name]
    df = source.filter(binding.where) if binding.where else source
    df = df.selectExpr(*[f"{expr} AS {column}" for column, expr in binding.columns.items()])
    return df.distinct() if binding.distinct else df


def with_tables(body: str, *names: str) -> str:
    """Oracle SQL whose logical tables are common table expressions."""
    ctes = ",\n".join(f"{name} AS ({BINDINGS[name].sql()})" for name in names)
    text = body.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(opening):
            return f"{opening}{ctes},\n{text[len(opening):].lstrip()}"
    return f"WITH {ctes}\n{text}"
