"""Counters and data-quality reports (A3, A5-A8, A10-A12, A15, A18, A19, J11, Q*, U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillworks.operators import counters as c
from quillworks.operators import quality as q
from quillworks.registry.bindings import BINDINGS
from quillworks.registry.checks import check
from quillworks.sources.catalogue import TABLES

POST_STATUSES = "pending_approval approved rejected request_edit scheduled published".split()
AUTHORED = "posts p JOIN content_drafts cd ON cd.draft_id = p.draft_id"


@check(
    "a3_status_breakdown",
    "posts",
    "content_drafts",
    sql=f"SELECT cd.created_by AS user_id, p.status, count(*) AS post_count FROM {AUTHORED} GROUP BY 1, 2",
)
def a3(t):
    return c.status_breakdown(t.posts, t.content_drafts)


COUNTERS_SQL = """
counts AS (SELECT count(*) AS total_posts, count(*) FILTER (status = 'pending_approval') AS pending_approval,
                  count(*) FILTER (status = 'published') AS published FROM posts),
own AS (SELECT created_by, count(*) AS n FROM content_drafts GROUP BY created_by),
counters AS (SELECT u.user_id, COALESCE(o.n, 0) AS total_drafts, counts.*
             FROM users u LEFT JOIN own o ON o.created_by = u.user_id CROSS JOIN counts)
"""


@check(
    "a5_dashboard_counters",
    "users",
    "content_drafts",
    "posts",
    sql=f"WITH {COUNTERS_SQL} SELECT * FROM counters",
)
def a5(t):
    return c.dashboard_counters(t.users, t.content_drafts, t.posts)


@check(
    "a6_workflow_flags",
    "users",
    "content_drafts",
    "posts",
    sql=f"""
WITH {COUNTERS_SQL}
SELECT user_id, CASE WHEN total_drafts > 0 THEN 'done' ELSE 'todo' END AS write_draft,
       CASE WHEN total_posts > 0 THEN 'done' ELSE 'todo' END AS repurpose,
       CASE WHEN pending_approval = 0 AND total_posts > 0 THEN 'done' ELSE 'todo' END AS get_approval,
       'todo' AS schedule
FROM counters""",
)
def a6(t):
    return c.workflow_flags(c.dashboard_counters(t.users, t.content_drafts, t.posts))


@check(
    "a7_status_tabs",
    "users",
    "posts",
    "content_drafts",
    sql="SELECT u.user_id, count(p.post_id) AS all_posts, "
    + ", ".join(f"count(*) FILTER (p.status = '{s}') AS {s}" for s in POST_STATUSES)
    + """
FROM users u LEFT JOIN content_drafts cd ON cd.created_by = u.user_id
LEFT JOIN posts p ON p.draft_id = cd.draft_id GROUP BY u.user_id""",
)
def a7(t):
    return c.status_tabs(t.users, t.posts, t.content_drafts)


@check(
    "a10_decisions_per_status",
    "approvals",
    sql="SELECT approval_status, count(*) AS total FROM approvals GROUP BY approval_status",
)
def a10(t):
    return c.decisions_per_status(t.approvals)


@check(
    "a11_scheduled_per_brand",
    "clients",
    "content_drafts",
    "posts",
    "scheduled_posts",
    sql="""
SELECT min(c.client_name) AS client_name, count(sp.schedule_id) AS scheduled_count
FROM clients c JOIN content_drafts cd ON cd.client_id = c.client_id
JOIN posts p ON p.draft_id = cd.draft_id JOIN scheduled_posts sp ON sp.post_id = p.post_id
GROUP BY lower(rtrim(c.client_name))""",
)
def a11(t):
    return c.most_scheduled_brands(t.clients, t.content_drafts, t.posts, t.scheduled_posts, limit=None)


@check("a12_posts_per_status", "posts", sql="SELECT status, count(*) AS post_count FROM posts GROUP BY status")
def a12(t):
    return c.posts_per_status(t.posts)


@check(
    "a18_audit_trail",
    "audit_logs",
    sql="""
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, user_id, entity_name, action, count(*) AS actions,
       max(created_at) AS last_at
FROM audit_logs GROUP BY 1, 2, 3, 4""",
)
def a18(t):
    return c.audit_trail(t.audit_logs)


@check(
    "a19_members_per_brand",
    "clients",
    "client_members",
    sql="""
SELECT c.client_id, count(m.user_id) AS members
FROM clients c LEFT JOIN client_members m ON m.client_id = c.client_id GROUP BY c.client_id""",
)
def a19(t):
    return c.members_per_brand(t.clients, t.client_members)


@check(
    "a19_queue_length",
    "posts",
    sql="""
SELECT count(*) AS waiting, CASE count(*) WHEN 0 THEN 'All caught up!' WHEN 1 THEN '1 post waiting for your review'
       ELSE concat(count(*), ' posts waiting for your review') END AS line
FROM posts WHERE status = 'pending_approval'""",
)
def a19_queue(t):
    return c.queue_length(t.posts)


# Tables of the row-count report, in its order.
COUNTED = [
    "users", "clients", "social_accounts", "content_drafts", "posts", "ai_generations", "approvals",
    "scheduled_posts", "analytics_logs", "content_recommendations", "audit_logs",
]
BOUND = [*COUNTED, "client_members"]


@check(
    "q1_row_counts",
    *COUNTED,
    sql=" UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count, count(*) > 0 AS ok FROM {n}" for n in COUNTED
    ),
)
def q1(t):
    return q.row_counts(t.named(*COUNTED))


# Damaged copies of the bound tables, so that every report has something to find.
DAMAGED = {
    "users": "SELECT * REPLACE (CASE WHEN user_id % 7 = 0 THEN '' WHEN user_id % 7 = 1 THEN NULL ELSE email END AS email) FROM users",
    "content_drafts": "SELECT * REPLACE (CASE WHEN draft_id % 11 = 0 THEN NULL ELSE created_by END AS created_by,"
    " CASE WHEN draft_id % 5 = 0 THEN client_id + 1000 WHEN draft_id % 13 = 0 THEN NULL ELSE client_id END AS client_id)"
    " FROM content_drafts",
    "posts": "SELECT * REPLACE (CASE WHEN post_id % 17 = 0 THEN NULL WHEN post_id % 19 = 0 THEN draft_id + 1000000"
    " ELSE draft_id END AS draft_id) FROM posts",
    "approvals": "SELECT * REPLACE (CASE WHEN approval_id % 23 = 0 THEN NULL WHEN approval_id % 29 = 0 THEN -post_id - 1"
    " ELSE post_id END AS post_id, CASE WHEN approval_id % 31 = 0 THEN manager_id + 100 ELSE manager_id END AS manager_id)"
    " FROM approvals",
    "analytics_logs": "SELECT * REPLACE (CASE WHEN views % 37 = 0 THEN NULL ELSE engagement_rate END AS engagement_rate,"
    " CASE WHEN views % 41 = 0 THEN -post_id - 1 ELSE post_id END AS post_id) FROM analytics_logs",
    "scheduled_posts": "SELECT * REPLACE (CASE WHEN post_id % 43 = 0 THEN NULL ELSE scheduled_time END AS scheduled_time,"
    " CASE WHEN post_id % 47 = 0 THEN -post_id - 1 ELSE post_id END AS post_id) FROM scheduled_posts",
    "social_accounts": "SELECT * REPLACE (CASE WHEN account_id % 3 = 0 THEN client_id + 1000 ELSE client_id END AS client_id)"
    " FROM social_accounts",
}
DAMAGED_CTES = ", ".join(f"damaged_{n} AS ({sql})" for n, sql in DAMAGED.items())


def damaged(t):
    """The damaged copies in Spark: the same replacements as columns."""
    frames = t.named(*BOUND)
    for name, sql in DAMAGED.items():
        body = sql[sql.index("(") + 1 : sql.rindex(")")]
        for item in _split_items(body):
            expr, column = item.rsplit(" AS ", 1)
            frames[name] = frames[name].withColumn(f"__{column}", F.expr(expr))
        for item in _split_items(body):
            column = item.rsplit(" AS ", 1)[1].strip()
            frames[name] = frames[name].withColumn(column, F.col(f"__{column}")).drop(f"__{column}")
    return frames


def _split_items(body: str) -> list[str]:
    """The replacements of a damaged copy; each one is a CASE expression."""
    return [part if part.startswith("CASE") else f"CASE{part}" for part in body.split(", CASE")]


NULLS_SQL = " UNION ALL ".join(
    f"SELECT '{label}' AS check_name, count(*) AS null_count FROM damaged_{table} WHERE {column} IS NULL"
    + (f" OR {column} = ''" if column == "email" else "")
    for label, table, column in q.NULL_CHECKS
)


@check("q2_null_report", *BOUND, sql=f"WITH {DAMAGED_CTES} {NULLS_SQL}")
def q2(t):
    return q.null_report(damaged(t))


def _parent(table: str, column: str):
    return next(r for r in TABLES[table].references if r.column == column)


def _orphans_sql(select: str, table: str, column: str) -> str:
    ref = _parent(table, column)
    parent = f"damaged_{ref.parent}" if ref.parent in DAMAGED else ref.parent
    child = f"damaged_{table}" if table in DAMAGED else table
    return f"{select} FROM {child} c LEFT JOIN {parent} p ON c.{column} = p.{ref.parent_column} WHERE p.{ref.parent_column} IS NULL"


@check(
    "q3_orphan_report",
    *BOUND,
    sql=f"WITH {DAMAGED_CTES} "
    + " UNION ALL ".join(
        _orphans_sql(f"SELECT '{label}' AS fk_check, count(*) AS orphan_count", table, column)
        for label, table, column in q.ORPHAN_CHECKS
    ),
)
def q3(t):
    return q.orphan_report(damaged(t))


@check(
    "q3_reference_report",
    *BOUND,
    sql=f"WITH {DAMAGED_CTES} "
    + " UNION ALL ".join(
        _orphans_sql(
            f"SELECT '{table}.{r.column} -> {r.parent}' AS reference, count(*) FILTER (c.{r.column} IS NULL) AS null_keys,"
            f" count(*) FILTER (c.{r.column} IS NOT NULL) AS dangling",
            table,
            r.column,
        )
        for table in BOUND
        for r in TABLES[table].references
    ),
)
def q3_all(t):
    return q.reference_report(damaged(t))


@check(
    "j11_orphan_keys",
    "posts",
    "approvals",
    sql=f"WITH damaged_approvals AS ({DAMAGED['approvals']})"
    """
SELECT a.post_id AS key, count(*) AS rows, a.post_id IS NULL AS is_null
FROM damaged_approvals a LEFT JOIN posts p ON p.post_id = a.post_id WHERE p.post_id IS NULL GROUP BY a.post_id""",
)
def j11(t):
    return q.orphan_keys(damaged(t)["approvals"], t.posts, "post_id", "post_id")


# Keys whose columns are bound.
UNIQUE_KEYS = [
    (table, columns)
    for table in BOUND
    for columns in ((TABLES[table].key,), *TABLES[table].unique)
    if set(columns) <= set(BINDINGS[table].columns)
]


def _unique_sql(table: str, columns: tuple[str, ...]) -> str:
    collated = ("email", "client_name", "invite_code")
    keys = ", ".join(f"lower(rtrim({col}))" if col in collated else col for col in columns)
    present = " AND ".join(f"{col} IS NOT NULL" for col in columns)
    return (
        f"SELECT '{table}({', '.join(columns)})' AS unique_key, count(*) AS duplicate_keys,"
        f" CAST(COALESCE(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM (SELECT count(*) AS n FROM {table}"
        f" WHERE {present} GROUP BY {keys} HAVING count(*) > 1) d"
    )


@check("q4_uniqueness_report", *BOUND, sql=" UNION ALL ".join(_unique_sql(*key) for key in UNIQUE_KEYS))
def q4(t):
    return q.uniqueness_report(t.named(*BOUND))


@check(
    "q4_duplicate_schedules",
    "approvals",
    sql="SELECT post_id, count(*) AS rows FROM approvals GROUP BY post_id HAVING count(*) > 1",
)
def q4_rows(t):
    return q.duplicate_keys(t.approvals, ["post_id"])


def _row_sql(conditions: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, {label} AS check_name, count(*) FILTER ({cond}) AS violations FROM {source}"
        for table, label, cond in conditions
        for source in [f"damaged_{table}" if table in DAMAGED else table]
    )


def _bound_columns(table: str):
    return [col for col in TABLES[table].columns if col.name in BINDINGS[table].columns]


RULES = [
    (table, f"'check: {rule}'", f"NOT ({cond.replace('TIMESTAMP_NTZ', 'TIMESTAMP').replace('char_length', 'length')})")
    for table in BOUND
    for rule, cond in TABLES[table].rules.items()
]
DOMAINS = [
    (table, f"'domain: {col.name}'", f"{col.name} NOT IN ({', '.join(repr(v) for v in col.domain)})")
    for table in BOUND
    for col in _bound_columns(table)
    if col.domain
]
NOT_NULLS = [
    (table, f"'not null: {col.name}'", f"{col.name} IS NULL")
    for table in BOUND
    for col in _bound_columns(table)
    if not col.nullable
]
LENGTHS = [
    (table, f"'length: {col.name}'", f"length(CAST({col.name} AS VARCHAR)) > {col.length}")
    for table in BOUND
    for col in _bound_columns(table)
    if col.length
]


@check("q5_rule_report", *BOUND, sql=f"WITH {DAMAGED_CTES} {_row_sql(RULES)}")
def q5(t):
    return q.row_check_report(damaged(t), "rules")


@check("q6_domain_report", *BOUND, sql=f"WITH {DAMAGED_CTES} {_row_sql(DOMAINS)}")
def q6(t):
    return q.row_check_report(damaged(t), "domains")


@check("q7_null_and_length_report", *BOUND, sql=f"WITH {DAMAGED_CTES} {_row_sql(NOT_NULLS + LENGTHS)}")
def q7(t):
    return q.row_check_report(damaged(t), "nulls", "lengths")


@check("u2_all_row_checks", *BOUND, sql=f"WITH {DAMAGED_CTES} {_row_sql(RULES + DOMAINS + NOT_NULLS + LENGTHS)}")
def u2(t):
    return q.row_check_report(damaged(t))


RATE_SQL = """
computed AS (
  SELECT *, COALESCE(CAST((2 * 10000 * (likes + comments + shares) + views) // (2 * NULLIF(views, 0)) AS DECIMAL(18,2)) / 100, 0)
         AS computed_rate FROM analytics_logs)
"""


@check(
    "q8_rate_mismatches",
    "analytics_logs",
    sql=f"""
WITH {RATE_SQL}
SELECT post_id, views, likes, comments, shares, CAST(engagement_rate AS DOUBLE) AS engagement_rate, recorded_at,
       CAST(computed_rate AS DOUBLE) AS computed_rate
FROM computed WHERE abs(CAST(engagement_rate * 100 AS BIGINT) - CAST(round(computed_rate * 100) AS BIGINT)) > 1""",
)
def q8(t):
    return q.rate_mismatches(t.analytics_logs)


@check(
    "q9_week_end_mismatches",
    "content_recommendations",
    sql="""
WITH changed AS (
  SELECT recommendation_id, client_id, week_start_date,
         CAST(week_end_date + CASE WHEN client_id = 3 THEN 1 ELSE 0 END AS DATE) AS week_end_date
  FROM content_recommendations)
SELECT recommendation_id, client_id, CAST(week_start_date AS VARCHAR) AS week_start_date,
       CAST(week_end_date AS VARCHAR) AS week_end_date
FROM changed WHERE week_end_date <> week_start_date + 6""",
)
def q9(t):
    changed = t.content_recommendations.select(
        "recommendation_id",
        "client_id",
        "week_start_date",
        F.date_add("week_end_date", F.when(F.col("client_id") == 3, 1).otherwise(0)).alias("week_end_date"),
    )
    return q.week_end_mismatches(changed)
