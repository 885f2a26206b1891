"""Batch workflows over request batches (M1-M19) and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillworks.plans import brand_changes, intake, maintenance, removals, replay, reviews
from quillworks.plans.outcome import role_gate, written
from quillworks.registry.bindings import bound
from quillworks.registry.checks import (
    EVENTS_AS_OF,
    check,
    mean6,
    shown,
    stable_id_sql,
    stripped,
    timestamp,
)
from quillworks.registry.content_checks import INPUTS, PARSED, answers, recommendation_inputs
from quillworks.operators import content as g
from quillworks.session import shared_folder
from quillworks.streaming import jobs

# M1: review decisions.

DECIDED = """
decided AS (
  SELECT r.*, p.status AS previous_status, u.role,
         CASE WHEN u.role IS NULL OR u.role NOT IN ('manager', 'admin') THEN 'forbidden'
              WHEN r.approval_status NOT IN ('approved', 'rejected', 'request_edit') THEN 'invalid_status'
              WHEN p.post_id IS NULL THEN 'not_found' END AS reason
  FROM decision_requests r LEFT JOIN users u ON u.user_id = r.user_id
  LEFT JOIN posts p ON p.post_id = r.post_id),
last_decision AS (
  SELECT post_id, approval_status, row_number() OVER (
           PARTITION BY post_id ORDER BY request_time DESC, request_id DESC) AS rn
  FROM decided WHERE reason IS NULL)
"""
POSTS_AFTER = """
SELECT p.post_id, p.draft_id, p.platform, p.repurposed_content, COALESCE(d.approval_status, p.status) AS status,
       p.created_at
FROM posts p LEFT JOIN last_decision d ON d.post_id = p.post_id AND d.rn = 1
"""
DECISION_TABLES = ("decision_requests", "users", "posts")


def _decisions(t):
    return reviews.apply_decisions(t.decision_requests, t.users, t.posts)


@check(
    "m1_decision_outcomes",
    *DECISION_TABLES,
    sql=f"""
WITH {DECIDED}
SELECT request_id, post_id, user_id, approval_status, previous_status, role, reason,
       reason IS NULL AND previous_status IN ('scheduled', 'published') AS flagged
FROM decided""",
)
def m1(t):
    return _decisions(t).decided.drop("remarks", "request_time")


@check("m1_posts_after_decisions", *DECISION_TABLES, sql=f"WITH {DECIDED} {POSTS_AFTER}")
def m1_posts(t):
    return _decisions(t).tables["posts"]


@check(
    "m1_approval_rows",
    *DECISION_TABLES,
    sql=f"""
WITH {DECIDED}
SELECT {stable_id_sql("'approval'", "CAST(request_id AS VARCHAR)")} AS approval_id, post_id, user_id AS manager_id,
       approval_status, CASE WHEN remarks <> '' THEN {stripped("remarks")} END AS remarks,
       request_time AS approval_date
FROM decided WHERE reason IS NULL""",
)
def m1_rows(t):
    return _decisions(t).appended["approvals"]


# M2: schedules.

SLOTS = f"""
asked AS (SELECT *, CASE WHEN length(scheduled_time) = 16
                         THEN CAST(replace(scheduled_time, 'T', ' ') AS TIMESTAMP) END AS slot FROM schedule_requests),
checked AS (
  SELECT a.*, p.status, s.post_id IS NOT NULL AS taken,
         p.status = 'approved' AND s.post_id IS NULL AND a.slot > TIMESTAMP '{EVENTS_AS_OF}' AS valid
  FROM asked a LEFT JOIN posts p ON p.post_id = a.post_id
  LEFT JOIN scheduled_posts s ON s.post_id = a.post_id),
winners AS (
  SELECT post_id, request_time, request_id, slot FROM (
    SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY request_time, request_id) AS rn
    FROM checked WHERE valid) v WHERE rn = 1),
decided AS (
  SELECT c.request_id, c.post_id, c.user_id, c.scheduled_time, c.slot, c.request_time,
         CASE WHEN c.status IS NULL THEN 'not_found'
              WHEN c.status <> 'approved' THEN 'wrong_status'
              WHEN w.post_id IS NOT NULL AND (c.request_time > w.request_time
                   OR (c.request_time = w.request_time AND c.request_id > w.request_id)) THEN 'wrong_status'
              WHEN c.taken THEN 'already_scheduled'
              WHEN c.slot IS NULL THEN 'invalid_date'
              WHEN c.slot <= TIMESTAMP '{EVENTS_AS_OF}' THEN 'not_future' END AS reason
  FROM checked c LEFT JOIN winners w ON w.post_id = c.post_id)
"""
SCHEDULE_TABLES = ("schedule_requests", "posts", "scheduled_posts")


def _schedules(t):
    return reviews.apply_schedules(t.schedule_requests, t.posts, t.scheduled_posts, timestamp(EVENTS_AS_OF))


@check("m2_schedule_outcomes", *SCHEDULE_TABLES, sql=f"WITH {SLOTS} SELECT * FROM decided")
def m2(t):
    return _schedules(t).decided


@check(
    "m2_posts_after_scheduling",
    *SCHEDULE_TABLES,
    sql=f"""
WITH {SLOTS}
SELECT p.post_id, p.draft_id, p.platform, p.repurposed_content,
       CASE WHEN w.post_id IS NOT NULL THEN 'scheduled' ELSE p.status END AS status, p.created_at
FROM posts p LEFT JOIN winners w ON w.post_id = p.post_id""",
)
def m2_posts(t):
    return _schedules(t).tables["posts"]


@check(
    "m2_schedule_rows",
    *SCHEDULE_TABLES,
    sql=f"""
WITH {SLOTS}
SELECT {stable_id_sql("'schedule'", "CAST(request_id AS VARCHAR)")} AS schedule_id, post_id, slot AS scheduled_time,
       'pending' AS schedule_status, request_time AS created_at
FROM winners""",
)
def m2_rows(t):
    return _schedules(t).appended["scheduled_posts"]


# M1, M2 and M16 in one batch, in the order of time.

REPLAYED = f"""
asked AS (
  SELECT e.*, u.role, p.status AS old_status, p.post_id IS NOT NULL AS known,
         e.post_id IN (SELECT post_id FROM scheduled_posts) AS was_taken,
         CASE WHEN length(e.scheduled_time) = 16 THEN CAST(replace(e.scheduled_time, 'T', ' ') AS TIMESTAMP) END AS slot,
         row_number() OVER (PARTITION BY e.post_id ORDER BY e.request_time, e.request_id) AS step
  FROM review_events e LEFT JOIN users u ON u.user_id = e.user_id LEFT JOIN posts p ON p.post_id = e.post_id),
judged AS (
  SELECT *, CASE WHEN kind = 'decide' AND (role IS NULL OR role NOT IN ('manager', 'admin')) THEN 'forbidden'
                 WHEN kind = 'decide' AND new_status NOT IN ('approved', 'rejected', 'request_edit') THEN 'invalid_status'
                 WHEN kind = 'set_status' AND new_status NOT IN ('pending_approval', 'approved', 'rejected', 'request_edit',
                      'scheduled', 'published') THEN 'invalid_status'
                 WHEN kind = 'schedule' AND slot IS NULL THEN 'invalid_date'
                 WHEN kind = 'schedule' AND slot <= TIMESTAMP '{EVENTS_AS_OF}' THEN 'not_future' END AS fault
  FROM asked),
stepped AS (
  SELECT post_id, CAST(0 AS BIGINT) AS step, CAST(NULL AS VARCHAR) AS met, CAST(NULL AS VARCHAR) AS reason,
         any_value(old_status) AS status, bool_or(was_taken) AS taken
  FROM judged GROUP BY post_id
  UNION ALL
  SELECT post_id, step, met, reason,
         CASE WHEN reason IS NOT NULL THEN met WHEN kind = 'schedule' THEN 'scheduled' ELSE new_status END,
         was_taken OR (reason IS NULL AND kind = 'schedule')
  FROM (SELECT j.post_id, j.step, s.status AS met, s.taken AS was_taken, j.kind, j.new_status,
               CASE WHEN j.kind <> 'schedule' THEN COALESCE(j.fault, CASE WHEN NOT j.known THEN 'not_found' END)
                    WHEN NOT j.known THEN 'not_found' WHEN s.status <> 'approved' THEN 'wrong_status'
                    WHEN s.taken THEN 'already_scheduled' ELSE j.fault END AS reason
        FROM stepped s JOIN judged j ON j.post_id = s.post_id AND j.step = s.step + 1) r),
decided AS (
  SELECT j.request_id, j.request_time, j.kind, j.user_id, j.post_id, j.new_status, j.scheduled_time, j.slot, j.role,
         j.remarks, CASE WHEN j.known THEN s.met END AS previous_status, s.reason,
         s.reason IS NULL AND j.kind = 'decide' AND s.met IN ('scheduled', 'published') AS flagged, s.status, s.step
  FROM judged j JOIN stepped s ON s.post_id = j.post_id AND s.step = j.step)
"""
REPLAY_TABLES = ("review_events", "users", "posts", "scheduled_posts")


def _replay(t):
    return replay.replay(t.review_events, t.users, t.posts, t.scheduled_posts, timestamp(EVENTS_AS_OF))


@check(
    "m1_m2_replay",
    *REPLAY_TABLES,
    sql=f"WITH RECURSIVE {REPLAYED} SELECT * EXCLUDE (remarks, status, step) FROM decided",
)
def m1_m2(t):
    return _replay(t).decided.drop("remarks")


@check(
    "m1_m2_posts_after_replay",
    *REPLAY_TABLES,
    sql=f"""
WITH RECURSIVE {REPLAYED}
SELECT p.post_id, p.draft_id, p.platform, p.repurposed_content, COALESCE(d.status, p.status) AS status, p.created_at
FROM posts p LEFT JOIN (SELECT post_id, arg_max(status, step) AS status FROM decided GROUP BY post_id) d
     ON d.post_id = p.post_id""",
)
def m1_m2_posts(t):
    return _replay(t).tables["posts"]


@check(
    "m1_m2_rows_of_replay",
    *REPLAY_TABLES,
    sql=f"""
WITH RECURSIVE {REPLAYED}
SELECT {stable_id_sql("'approval'", "CAST(request_id AS VARCHAR)")} AS row_id, post_id, new_status AS status,
       CASE WHEN remarks <> '' THEN {stripped("remarks")} END AS remarks, request_time AS at
FROM decided WHERE reason IS NULL AND kind = 'decide'
UNION ALL
SELECT {stable_id_sql("'schedule'", "CAST(request_id AS VARCHAR)")}, post_id, 'pending', NULL, slot
FROM decided WHERE reason IS NULL AND kind = 'schedule'""",
)
def m1_m2_rows(t):
    rows = _replay(t).appended
    decisions = rows["approvals"].selectExpr(
        "approval_id AS row_id", "post_id", "approval_status AS status", "remarks", "approval_date AS at"
    )
    slots = rows["scheduled_posts"].selectExpr(
        "schedule_id AS row_id", "post_id", "schedule_status AS status", "CAST(NULL AS STRING) AS remarks", "scheduled_time AS at"
    )
    return decisions.unionByName(slots)


# M3: drafts.


@check(
    "m3_draft_intake",
    "draft_requests",
    sql=f"""
WITH cut AS (SELECT request_id, user_id, client_id, {stripped("draft_title")} AS draft_title,
                    {stripped("draft_content")} AS draft_content FROM draft_requests)
SELECT *, CASE WHEN COALESCE(length(draft_title), 0) < 3 THEN 'title_too_short'
               WHEN COALESCE(length(draft_content), 0) < 20 THEN 'content_too_short' END AS reason
FROM cut""",
)
def m3(t):
    return intake.intake_drafts(t.draft_requests).decided.drop("request_time")


# M4: brands.

BRANDS_DECIDED = f"""
named AS (SELECT *, {stripped("brand_name")} AS name FROM brand_requests),
keyed AS (SELECT n.*, lower(rtrim(n.name)) AS name_key, COALESCE(u.role = 'admin', false) AS admin
          FROM named n LEFT JOIN users u ON u.user_id = n.user_id),
first_of_name AS (SELECT name_key, min(request_id) AS winner FROM keyed WHERE admin AND length(name) >= 2 GROUP BY name_key),
decided AS (
  SELECT k.*, CASE WHEN NOT k.admin THEN 'forbidden' WHEN COALESCE(length(k.name), 0) < 2 THEN 'name_too_short'
                   WHEN k.name_key IN (SELECT lower(rtrim(client_name)) FROM clients) OR k.request_id > f.winner
                   THEN 'duplicate_name' END AS reason
  FROM keyed k LEFT JOIN first_of_name f ON f.name_key = k.name_key)
"""
BRAND_TABLES = ("brand_requests", "users", "clients")


def _brands(t):
    return brand_changes.intake_brands(t.brand_requests, t.users, t.clients)


@check(
    "m4_brand_intake",
    *BRAND_TABLES,
    sql=f"WITH {BRANDS_DECIDED} SELECT request_id, user_id, name AS brand_name, reason FROM decided",
)
def m4(t):
    return _brands(t).decided.select("request_id", "user_id", "brand_name", "reason")


@check(
    "m4_new_brands",
    *BRAND_TABLES,
    sql=f"""
WITH {BRANDS_DECIDED}
SELECT {stable_id_sql("'client'", "CAST(request_id AS VARCHAR)")} AS client_id, name AS client_name, user_id AS owner_id,
       NULLIF({stripped("industry")}, '') AS industry, NULLIF({stripped("brand_voice")}, '') AS brand_voice,
       NULLIF({stripped("target_audience")}, '') AS target_audience, NULLIF({stripped("do_not_use")}, '') AS do_not_use,
       brand_color, CAST(NULL AS VARCHAR) AS invite_code, request_time AS created_at
FROM decided WHERE reason IS NULL""",
)
def m4_rows(t):
    return _brands(t).appended["clients"]


@check(
    "m4_new_owner_members",
    *BRAND_TABLES,
    sql=f"""
WITH {BRANDS_DECIDED}
SELECT {stable_id_sql("'membership'", "CAST(request_id AS VARCHAR)")} AS membership_id,
       {stable_id_sql("'client'", "CAST(request_id AS VARCHAR)")} AS client_id, user_id, 'manager' AS member_role,
       request_time AS added_at
FROM decided WHERE reason IS NULL""",
)
def m4_members(t):
    return _brands(t).appended["client_members"]


# M5: brand edits.

EDIT_FIELDS = ["industry", "brand_voice", "target_audience", "brand_color", "do_not_use"]


@check(
    "m5_brand_edit_outcomes",
    "brand_edits",
    "clients",
    sql="""
SELECT r.request_id, r.client_id, r.user_id, CASE WHEN c.owner_id = r.user_id THEN NULL ELSE 'not_owner' END AS reason
FROM brand_edits r LEFT JOIN clients c ON c.client_id = r.client_id""",
)
def m5(t):
    decided = brand_changes.edit_brands(t.brand_edits, t.clients).decided
    return decided.select("request_id", "client_id", "user_id", "reason")


@check(
    "m5_brands_after_edits",
    "brand_edits",
    "clients",
    sql=f"""
WITH newest AS (
  SELECT r.*, row_number() OVER (PARTITION BY r.client_id ORDER BY r.request_time DESC, r.request_id DESC) AS rn
  FROM brand_edits r JOIN clients c ON c.client_id = r.client_id AND c.owner_id = r.user_id)
SELECT c.client_id, c.client_name, c.timezone, c.active_status, c.owner_id, c.invite_code,
       {", ".join(f"CASE WHEN n.client_id IS NULL THEN c.{f} ELSE {stripped(f'n.{f}')} END AS {f}" for f in EDIT_FIELDS)}
FROM clients c LEFT JOIN newest n ON n.client_id = c.client_id AND n.rn = 1""",
)
def m5_brands(t):
    return brand_changes.edit_brands(t.brand_edits, t.clients).tables["clients"]


# M6: members by invite code.

JOINED = f"""
asked AS (SELECT r.*, c.client_id, c.client_name FROM join_requests r
          LEFT JOIN clients c ON c.invite_code = upper({stripped("r.invite_code")})),
first_join AS (SELECT client_id, user_id, min(request_id) AS winner FROM asked WHERE client_id IS NOT NULL GROUP BY 1, 2),
decided AS (
  SELECT a.*, CASE WHEN a.client_id IS NULL THEN 'invalid_code'
                   WHEN m.user_id IS NOT NULL OR a.request_id > f.winner THEN 'already_member' END AS reason
  FROM asked a LEFT JOIN client_members m ON m.client_id = a.client_id AND m.user_id = a.user_id
  LEFT JOIN first_join f ON f.client_id = a.client_id AND f.user_id = a.user_id)
"""
JOIN_TABLES = ("join_requests", "clients", "client_members")


def _joins(t):
    return brand_changes.join_brands(t.join_requests, t.clients, t.client_members)


@check(
    "m6_join_outcomes",
    *JOIN_TABLES,
    sql=f"WITH {JOINED} SELECT request_id, user_id, client_id, client_name, reason FROM decided",
)
def m6(t):
    return _joins(t).decided.select("request_id", "user_id", "client_id", "client_name", "reason")


@check(
    "m6_new_members",
    *JOIN_TABLES,
    sql=f"""
WITH {JOINED}
SELECT {stable_id_sql("'membership'", "CAST(request_id AS VARCHAR)")} AS membership_id, client_id, user_id,
       'writer' AS member_role, request_time AS added_at
FROM decided WHERE reason IS NULL""",
)
def m6_rows(t):
    return _joins(t).appended["client_members"]


# M7, M8: social accounts.

ACCESS = """
access AS (
  SELECT r.*, CASE WHEN c.owner_id = r.user_id THEN 'owner' WHEN c.client_id IS NULL THEN 'none'
                   ELSE COALESCE(m.member_role, 'none') END AS access_type
  FROM account_requests r LEFT JOIN clients c ON c.client_id = r.client_id
  LEFT JOIN client_members m ON m.client_id = r.client_id AND m.user_id = r.user_id)
"""
CONNECTED = f"""
{ACCESS},
decided AS (
  SELECT *, concat('@', ltrim({stripped("account_name")}, '@')) AS handle,
         CASE WHEN access_type = 'none' THEN 'not_found' WHEN access_type <> 'owner' THEN 'forbidden'
              WHEN platform NOT IN ('instagram', 'linkedin', 'facebook', 'twitter', 'tiktok', 'youtube') THEN 'invalid_platform'
              WHEN length(ltrim({stripped("account_name")}, '@')) < 2 THEN 'handle_too_short' END AS reason
  FROM access),
changes AS (SELECT client_id, platform, min(request_id) AS first_id, max(request_id) AS last_id,
                   arg_max(handle, request_id) AS handle FROM decided WHERE reason IS NULL GROUP BY 1, 2)
"""
ACCOUNT_TABLES = ("account_requests", "clients", "client_members", "social_accounts")


def _connects(t):
    accounts = t.social_accounts.withColumn("buffer_profile_id", F.lit(None).cast("string"))
    return brand_changes.connect_accounts(t.account_requests, t.clients, t.client_members, accounts)


@check(
    "m7_connect_outcomes",
    *ACCOUNT_TABLES,
    sql=f"WITH {CONNECTED} SELECT request_id, client_id, user_id, platform, access_type, handle, reason FROM decided",
)
def m7(t):
    return _connects(t).decided.drop("request_time", "account_name")


@check(
    "m7_accounts_after_connects",
    *ACCOUNT_TABLES,
    sql=f"""
WITH {CONNECTED}
SELECT COALESCE(a.client_id, c.client_id) AS client_id, COALESCE(a.platform, c.platform) AS platform,
       COALESCE(CAST(a.account_id AS VARCHAR), {stable_id_sql("'account'", "CAST(c.first_id AS VARCHAR)")}) AS account_id,
       COALESCE(c.handle, a.account_name) AS account_name,
       CASE WHEN c.client_id IS NOT NULL THEN 1 ELSE a.connected_status END AS connected_status,
       CASE WHEN c.client_id IS NOT NULL THEN {stable_id_sql("'profile'", "CAST(c.last_id AS VARCHAR)")} END AS buffer_profile_id
FROM social_accounts a FULL JOIN changes c ON c.client_id = a.client_id AND c.platform = a.platform""",
)
def m7_accounts(t):
    return _connects(t).tables["social_accounts"]


@check(
    "m8_accounts_after_disconnects",
    *ACCOUNT_TABLES,
    sql=f"""
WITH {ACCESS}
SELECT a.account_id, a.client_id, a.platform, a.account_name,
       CASE WHEN EXISTS (SELECT 1 FROM access x WHERE x.access_type = 'owner' AND x.client_id = a.client_id
                         AND x.platform = a.platform) THEN 0 ELSE a.connected_status END AS connected_status
FROM social_accounts a""",
)
def m8(t):
    requests = t.account_requests.drop("account_name")
    outcome = brand_changes.disconnect_accounts(requests, t.clients, t.client_members, t.social_accounts)
    return outcome.tables["social_accounts"]


# M9: profiles.


@check(
    "m9_users_after_updates",
    "profile_requests",
    "users",
    sql="""
WITH sound AS (
  SELECT * FROM profile_requests WHERE user_id IN (SELECT user_id FROM users)
     AND (role IS NULL OR role IN ('writer', 'manager', 'admin', 'client'))),
first_asked AS (
  SELECT lower(email) AS k, arg_min(user_id, request_id) AS first_user FROM sound WHERE email IS NOT NULL GROUP BY 1),
accepted AS (
  SELECT s.* FROM sound s LEFT JOIN first_asked f ON f.k = lower(s.email)
  LEFT JOIN users h ON lower(h.email) = lower(s.email)
  WHERE s.email IS NULL OR COALESCE(h.user_id, f.first_user) = s.user_id),
newest AS (
  SELECT user_id, arg_max(full_name, request_id) FILTER (full_name IS NOT NULL) AS full_name,
         arg_max(email, request_id) FILTER (email IS NOT NULL) AS email,
         arg_max(role, request_id) FILTER (role IS NOT NULL) AS role
  FROM accepted GROUP BY user_id)
SELECT u.user_id, COALESCE(n.full_name, u.full_name) AS full_name, COALESCE(n.email, u.email) AS email,
       COALESCE(n.role, u.role) AS role
FROM users u LEFT JOIN newest n ON n.user_id = u.user_id""",
)
def m9(t):
    return maintenance.update_users(t.profile_requests, t.users).tables["users"]


# M9 in the order of time: addresses that are given up can be taken.

CHAINS = """
asked AS (
  SELECT r.*, lower(email) AS address, row_number() OVER (ORDER BY request_time, request_id) AS step,
         CASE WHEN r.user_id NOT IN (SELECT user_id FROM people) THEN 'not_found'
              WHEN role NOT IN ('writer', 'manager', 'admin', 'client') THEN 'invalid_role' END AS fault
  FROM email_requests r),
place AS (SELECT list(user_id ORDER BY user_id) AS ids, list(lower(email) ORDER BY user_id) AS held FROM people),
stepped AS (
  SELECT CAST(0 AS BIGINT) AS step, CAST(NULL AS VARCHAR) AS reason, held FROM place
  UNION ALL
  SELECT step, reason,
         CASE WHEN reason IS NULL AND address IS NOT NULL
              THEN list_transform(held, lambda x, i: CASE WHEN i = own THEN address ELSE x END) ELSE held END
  FROM (SELECT a.step, a.address, s.held, list_position(p.ids, a.user_id) AS own,
               CASE WHEN a.fault IS NOT NULL THEN a.fault
                    WHEN a.address IS NOT NULL AND COALESCE(list_position(s.held, a.address), list_position(p.ids, a.user_id))
                         <> list_position(p.ids, a.user_id) THEN 'email_taken' END AS reason
        FROM stepped s JOIN asked a ON a.step = s.step + 1 CROSS JOIN place p) r),
decided AS (SELECT a.*, s.reason FROM asked a JOIN stepped s ON s.step = a.step)
"""


@check(
    "m9_email_chains",
    "email_requests",
    "people",
    sql=f"""
WITH RECURSIVE {CHAINS}
SELECT request_id, request_time, user_id, full_name, email, role, reason FROM decided""",
)
def m9_chains(t):
    return maintenance.update_users_in_order(t.email_requests, t.people).decided


@check(
    "m9_users_after_email_chains",
    "email_requests",
    "people",
    sql=f"""
WITH RECURSIVE {CHAINS},
newest AS (
  SELECT user_id, arg_max(full_name, request_id) FILTER (full_name IS NOT NULL) AS full_name,
         arg_max(email, request_id) FILTER (email IS NOT NULL) AS email,
         arg_max(role, request_id) FILTER (role IS NOT NULL) AS role
  FROM decided WHERE reason IS NULL GROUP BY user_id)
SELECT u.user_id, COALESCE(n.full_name, u.full_name) AS full_name, COALESCE(n.email, u.email) AS email,
       COALESCE(n.role, u.role) AS role
FROM people u LEFT JOIN newest n ON n.user_id = u.user_id""",
)
def m9_chained_users(t):
    return maintenance.update_users_in_order(t.email_requests, t.people).tables["users"]


# Deletes. Each result lists the keys that remain, per table.

DRAFTS_DELETED = """
winners AS (
  SELECT r.draft_id, min(r.request_id) AS winner FROM draft_deletes r
  JOIN content_drafts cd ON cd.draft_id = r.draft_id AND cd.created_by = r.user_id GROUP BY r.draft_id)
"""
DRAFT_TABLES = (
    "content_drafts", "ai_generations", "posts", "approvals", "scheduled_posts", "analytics_logs",
)


def _draft_deletes(t):
    return removals.delete_drafts(t.draft_deletes, t.named(*DRAFT_TABLES), stage=written)


def _remaining(tables, columns):
    """(table_name, key, rows) of what is left, one row per key."""
    parts = [
        tables[name].groupBy(F.col(column).cast("bigint").alias("key")).agg(F.count("*").alias("rows"))
        .select(F.lit(name).alias("table_name"), "key", "rows")
        for name, column in columns.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _remaining_sql(conditions: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {column} AS key, count(*) AS rows FROM {name} WHERE {condition} GROUP BY {column}"
        for name, (column, condition) in conditions.items()
    )


LEFT_DRAFTS = "draft_id NOT IN (SELECT draft_id FROM winners)"
GONE_POSTS = "(SELECT post_id FROM posts WHERE draft_id IN (SELECT draft_id FROM winners))"


@check(
    "m10_draft_delete_outcomes",
    "draft_deletes",
    "content_drafts",
    sql=f"""
WITH {DRAFTS_DELETED}
SELECT r.request_id, r.draft_id, r.user_id, CASE WHEN w.winner = r.request_id THEN NULL ELSE 'not_found' END AS reason
FROM draft_deletes r LEFT JOIN winners w ON w.draft_id = r.draft_id""",
)
def m10(t):
    return _draft_deletes(t).decided.drop("request_time")


@check(
    "m10_tables_after_draft_deletes",
    "draft_deletes",
    *DRAFT_TABLES,
    sql=f"WITH {DRAFTS_DELETED} "
    + _remaining_sql(
        {
            "content_drafts": ("draft_id", LEFT_DRAFTS),
            "ai_generations": ("generation_id", LEFT_DRAFTS),
            "posts": ("post_id", LEFT_DRAFTS),
            "approvals": ("approval_id", f"post_id NOT IN {GONE_POSTS}"),
            "scheduled_posts": ("schedule_id", f"post_id NOT IN {GONE_POSTS}"),
            "analytics_logs": ("post_id", f"post_id NOT IN {GONE_POSTS}"),
        }
    ),
)
def m10_tables(t):
    after = _draft_deletes(t).tables
    return _remaining(
        after,
        {
            "content_drafts": "draft_id",
            "ai_generations": "generation_id",
            "posts": "post_id",
            "approvals": "approval_id",
            "scheduled_posts": "schedule_id",
            "analytics_logs": "post_id",
        },
    )


USERS_DELETED = """
bound_users AS (SELECT created_by AS user_id FROM staff_drafts UNION SELECT manager_id FROM staff_approvals),
deleted AS (SELECT user_id, min(request_id) AS winner FROM user_deletes
            WHERE user_id IN (SELECT user_id FROM users) AND user_id NOT IN (SELECT user_id FROM bound_users)
            GROUP BY user_id)
"""
USER_TABLES = ("users", "clients", "client_members", "staff_drafts", "staff_approvals", "audit_logs")


def _user_deletes(t):
    frames = t.named("users", "clients", "client_members", "audit_logs")
    frames |= {"content_drafts": t.staff_drafts, "approvals": t.staff_approvals}
    return removals.delete_users(t.user_deletes, frames, stage=written)


@check(
    "m11_user_delete_outcomes",
    "user_deletes",
    "users",
    "staff_drafts",
    "staff_approvals",
    sql=f"""
WITH {USERS_DELETED}
SELECT r.request_id, r.user_id, CASE WHEN r.user_id NOT IN (SELECT user_id FROM users) THEN 'not_found'
       WHEN r.user_id IN (SELECT user_id FROM bound_users) THEN 'restricted'
       WHEN r.request_id > d.winner THEN 'not_found' END AS reason
FROM user_deletes r LEFT JOIN deleted d ON d.user_id = r.user_id""",
)
def m11(t):
    return _user_deletes(t).decided.drop("request_time")


@check(
    "m11_members_after_user_deletes",
    "user_deletes",
    *USER_TABLES,
    sql=f"WITH {USERS_DELETED} SELECT * FROM client_members WHERE user_id NOT IN (SELECT user_id FROM deleted)",
)
def m11_members(t):
    return _user_deletes(t).tables["client_members"]


@check(
    "m11_audit_after_user_deletes",
    "user_deletes",
    *USER_TABLES,
    sql=f"""
WITH {USERS_DELETED}
SELECT log_id, CASE WHEN user_id IN (SELECT user_id FROM deleted) THEN NULL ELSE user_id END AS user_id,
       action, entity_name, entity_id, created_at
FROM audit_logs""",
)
def m11_audit(t):
    return _user_deletes(t).tables["audit_logs"]


@check(
    "m11_brands_after_user_deletes",
    "user_deletes",
    *USER_TABLES,
    sql=f"""
WITH {USERS_DELETED}
SELECT client_id, client_name, CASE WHEN owner_id IN (SELECT user_id FROM deleted) THEN NULL ELSE owner_id END AS owner_id
FROM clients""",
)
def m11_brands(t):
    return _user_deletes(t).tables["clients"].select("client_id", "client_name", "owner_id")


@check(
    "m12_posts_after_stale_approval",
    "posts",
    sql="""
WITH oldest AS (SELECT post_id FROM posts WHERE status = 'pending_approval'
                AND created_at < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 7 DAY ORDER BY created_at, post_id LIMIT 1)
SELECT post_id, draft_id, platform, repurposed_content,
       CASE WHEN post_id IN (SELECT post_id FROM oldest) THEN 'approved' ELSE status END AS status, created_at
FROM posts""",
)
def m12(t):
    return maintenance.approve_stale(t.posts, timestamp("1998-06-01 00:00:00"))


REJECTED_POSTS = (
    "rejected_posts AS (SELECT * REPLACE (CASE WHEN status = 'pending_approval' THEN 'rejected' ELSE status END AS status)"
    " FROM posts), winners AS (SELECT post_id FROM rejected_posts WHERE status = 'rejected'"
    " AND created_at < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 60 DAY)"
)
KEPT_POSTS = "post_id NOT IN (SELECT post_id FROM winners)"


@check(
    "m13_tables_after_purge",
    "posts",
    "approvals",
    "scheduled_posts",
    "analytics_logs",
    sql=f"WITH {REJECTED_POSTS} "
    + _remaining_sql(
        {
            "posts": ("post_id", KEPT_POSTS),
            "approvals": ("approval_id", KEPT_POSTS),
            "scheduled_posts": ("schedule_id", KEPT_POSTS),
            "analytics_logs": ("post_id", KEPT_POSTS),
        }
    ),
)
def m13(t):
    # Waiting posts stand for rejected ones, which the bound posts lack.
    frames = t.named("posts", "approvals", "scheduled_posts", "analytics_logs")
    status = F.when(F.col("status") == "pending_approval", "rejected").otherwise(F.col("status"))
    frames["posts"] = frames["posts"].withColumn("status", status)
    after = removals.purge_rejected(frames, timestamp("1998-06-01 00:00:00"), stage=written)
    return _remaining(
        after,
        {"posts": "post_id", "approvals": "approval_id", "scheduled_posts": "schedule_id", "analytics_logs": "post_id"},
    )


# Registrations.

REGISTERED = """
asked AS (SELECT *, lower(role) AS stored_role, lower(rtrim(email)) AS email_key,
                 CASE WHEN lower(role) NOT IN ('writer', 'manager', 'admin', 'client') THEN 'invalid_role'
                      WHEN email NOT LIKE '%@%.%' THEN 'invalid_email' END AS fault FROM registrations),
first_of_email AS (SELECT email_key, min(request_id) AS winner FROM asked WHERE fault IS NULL GROUP BY email_key),
decided AS (
  SELECT a.*, CASE WHEN a.email_key IN (SELECT lower(rtrim(email)) FROM users) OR a.request_id > f.winner
                   THEN 'email_taken' ELSE a.fault END AS reason
  FROM asked a LEFT JOIN first_of_email f ON f.email_key = a.email_key)
"""


@check(
    "m14_registration_outcomes",
    "registrations",
    "users",
    sql=f"WITH {REGISTERED} SELECT request_id, full_name, email, stored_role AS role, reason FROM decided",
)
def m14(t):
    return intake.intake_users(t.registrations, t.users).decided.drop("request_time", "password_hash")


@check(
    "m14_new_users",
    "registrations",
    "users",
    sql=f"""
WITH {REGISTERED}
SELECT {stable_id_sql("'user'", "CAST(request_id AS VARCHAR)")} AS user_id, full_name, email, password_hash,
       stored_role AS role, request_time AS created_at
FROM decided WHERE reason IS NULL""",
)
def m14_rows(t):
    return intake.intake_users(t.registrations, t.users).appended["users"]


# Recommendations.

RUN_DATE = "2024-03-04"
RECOMMENDATION_TABLES = (
    "recommendation_requests", "users", "content_drafts", "posts", "analytics_logs", "content_recommendations",
)
# Authors are spread over more brands than have a recommendation for the week.
RECOMMENDED = f"""
existing AS (SELECT client_id FROM content_recommendations WHERE week_start_date = DATE '{RUN_DATE}'),
brand AS (SELECT created_by AS user_id, min(client_id + created_by) AS client_id FROM content_drafts GROUP BY created_by),
asked AS (SELECT r.*, b.client_id FROM recommendation_requests r LEFT JOIN brand b ON b.user_id = r.user_id),
winners AS (SELECT client_id, min(request_id) AS winner FROM asked WHERE client_id IS NOT NULL GROUP BY client_id),
decided AS (
  SELECT a.*, CASE WHEN a.client_id IS NULL THEN 'no_draft'
                   WHEN a.client_id IN (SELECT client_id FROM existing) OR a.request_id > w.winner THEN 'duplicate_week' END AS reason
  FROM asked a LEFT JOIN winners w ON w.client_id = a.client_id)
"""


def _recommendations(t):
    drafts = t.content_drafts.withColumn("client_id", F.col("client_id") + F.col("created_by"))
    texts = recommendation_inputs(t).withColumnRenamed("fallback_text", "recommendation_text")
    return intake.intake_recommendations(
        t.recommendation_requests,
        drafts,
        t.content_recommendations,
        texts,
        F.lit(RUN_DATE).cast("date"),
    )


@check(
    "m15_recommendation_outcomes",
    "recommendation_requests",
    "content_drafts",
    "content_recommendations",
    sql=f"WITH {RECOMMENDED} SELECT request_id, user_id, client_id, reason FROM decided",
)
def m15(t):
    return _recommendations(t).decided.drop("request_time")


@check(
    "m15_new_recommendations",
    *RECOMMENDATION_TABLES,
    sql=f"""
WITH {RECOMMENDED}, {INPUTS}
SELECT {stable_id_sql("'recommendation'", "CAST(d.request_id AS VARCHAR)")} AS recommendation_id, d.client_id,
       '{RUN_DATE}' AS week_start_date, '2024-03-10' AS week_end_date, i.best_platform,
       i.fallback_text AS recommendation_text, d.request_time AS created_at
FROM decided d JOIN inputs i ON i.user_id = d.user_id WHERE d.reason IS NULL""",
)
def m15_rows(t):
    return _recommendations(t).appended["content_recommendations"]


@check(
    "m16_drafts_after_status_requests",
    "status_requests",
    "content_drafts",
    sql="""
WITH newest AS (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY request_time DESC, request_id DESC) AS rn
                FROM status_requests)
SELECT cd.draft_id, cd.client_id, cd.created_by, cd.draft_title, cd.draft_content,
       COALESCE(n.new_status, cd.draft_status) AS draft_status, CAST(cd.created_at AS VARCHAR) AS created_at
FROM content_drafts cd LEFT JOIN newest n ON n.draft_id = cd.draft_id AND n.rn = 1""",
)
def m16(t):
    return reviews.set_status(t.content_drafts, t.status_requests, "draft_id", "draft_status")


@check(
    "m17_audit_rows",
    "decision_requests",
    "users",
    "posts",
    "draft_deletes",
    "content_drafts",
    sql=f"""
WITH {DECIDED}, {DRAFTS_DELETED}
SELECT {stable_id_sql("'audit'", "'approvals'", "CAST(request_id AS VARCHAR)")} AS log_id, user_id,
       CASE approval_status WHEN 'approved' THEN 'APPROVE' WHEN 'rejected' THEN 'REJECT' ELSE 'UPDATE' END AS action,
       'approvals' AS entity_name, CAST(post_id AS VARCHAR) AS entity_id, request_time AS created_at
FROM decided WHERE reason IS NULL
UNION ALL
SELECT {stable_id_sql("'audit'", "'content_drafts'", "CAST(r.request_id AS VARCHAR)")}, r.user_id, 'DELETE', 'content_drafts',
       CAST(r.draft_id AS VARCHAR), r.request_time
FROM draft_deletes r JOIN winners w ON w.winner = r.request_id AND w.draft_id = r.draft_id""",
)
def m17(t):
    return maintenance.audit_of({"decisions": _decisions(t), "draft_deletes": _draft_deletes(t)})


def _generated(t):
    # Parsed once for both tables.
    parsed = written(g.parse_answers(answers(t)).withColumn("prompt", F.lit("p")))
    return intake.intake_generations(parsed, timestamp(EVENTS_AS_OF))


@check(
    "m18_generation_rows",
    sql=f"""
WITH {PARSED}
SELECT {stable_id_sql("'generation'", "CAST(request_id AS VARCHAR)", "'0'")} AS generation_id, draft_id, platform,
       'p' AS prompt, repurposed_content AS generated_text, TIMESTAMP '{EVENTS_AS_OF}' AS generated_at
FROM parsed WHERE success""",
)
def m18(t):
    return _generated(t)["ai_generations"]


@check(
    "m18_post_rows",
    sql=f"""
WITH {PARSED}
SELECT {stable_id_sql("'post'", "CAST(request_id AS VARCHAR)", "'0'")} AS post_id, draft_id, platform, repurposed_content,
       caption, hashtags, 'pending_approval' AS status, TIMESTAMP '{EVENTS_AS_OF}' AS created_at
FROM parsed WHERE success""",
)
def m18_posts(t):
    return _generated(t)["posts"]


@check(
    "m19_role_gate",
    "decision_requests",
    "users",
    sql="""
SELECT r.request_id, r.user_id, u.role,
       CASE WHEN u.role IN ('manager', 'admin') THEN NULL ELSE 'forbidden' END AS reason
FROM decision_requests r LEFT JOIN users u ON u.user_id = r.user_id""",
)
def m19(t):
    gated = role_gate(t.decision_requests, t.users, ["manager", "admin"])
    return gated.select("request_id", "user_id", "role", "reason")


# Streaming forms.


def _stream(t, name: str, source: str):
    return bound(jobs.stream_parquet(t.spark, t.path(source)), name)


@check(
    "t1_weekly_rollup_stream",
    "posts",
    "content_drafts",
    "analytics_logs",
    sql=f"""
WITH weekly AS (
  SELECT CAST(date_trunc('week', al.recorded_at) AS DATE) AS week, cd.client_id, p.platform,
         {mean6("sum(al.engagement_rate)", "count(al.engagement_rate)")} AS mean, count(*) AS snapshots
  FROM analytics_logs al JOIN posts p ON p.post_id = al.post_id
  JOIN content_drafts cd ON cd.draft_id = p.draft_id
  GROUP BY 1, 2, 3)
SELECT CAST(week AS VARCHAR) AS week_start, client_id, platform, {shown("mean")} AS avg_rate, snapshots
FROM weekly WHERE week + 7 <= (SELECT max(recorded_at) FROM analytics_logs) - INTERVAL 1 DAY""",
)
def t1(t):
    folder = shared_folder(t.spark, "weekly")
    logs = _stream(t, "analytics_logs", "lineitem")
    rollup = jobs.weekly_rollup(logs, written(jobs.post_brands(t.posts, t.content_drafts)))
    jobs.write_available(rollup, f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out")


@check(
    "t1_deduplicated_rollup",
    "posts",
    "content_drafts",
    "snapshot_deliveries",
    sql=f"""
WITH delivered AS (
  SELECT *, (SELECT max(recorded_at) FROM snapshot_deliveries WHERE first_half AND NOT held_back) AS seen
  FROM snapshot_deliveries),
weekly AS (
  SELECT CAST(date_trunc('week', s.recorded_at) AS DATE) AS week, cd.client_id, p.platform,
         {mean6("sum(s.engagement_rate)", "count(s.engagement_rate)")} AS mean, count(*) AS snapshots
  FROM delivered s JOIN posts p ON p.post_id = s.post_id JOIN content_drafts cd ON cd.draft_id = p.draft_id
  WHERE NOT (first_half AND held_back) OR s.recorded_at > seen - INTERVAL 1 DAY
  GROUP BY 1, 2, 3)
SELECT CAST(week AS VARCHAR) AS week_start, client_id, platform, {shown("mean")} AS avg_rate, snapshots
FROM weekly WHERE week + 7 <= (SELECT max(recorded_at) FROM snapshot_deliveries) - INTERVAL 1 DAY""",
)
def t1_deduplicated(t):
    folder = shared_folder(t.spark, "deliveries")
    rows = t.snapshot_deliveries
    first = F.col("first_half") & ~F.col("held_back")
    held_back = F.col("first_half") & F.col("held_back")
    late = rows.filter(held_back).unionByName(rows.filter(first & F.col("again")))
    # A file each, older ones first. A row is late by the watermark of the batch before the last one.
    for part in (rows.filter(first), rows.filter(~F.col("first_half")), late):
        once = part.unionByName(part)
        once.drop("first_half", "held_back", "again").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    logs = jobs.stream_parquet(t.spark, f"{folder}/in", files_per_batch=1)
    brands = written(jobs.post_brands(t.posts, t.content_drafts))
    rollup = jobs.deduplicated_rollup(logs, brands, "analytics_id")
    jobs.write_available(rollup, f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out")


@check("t2_posts_after_decision_stream", *DECISION_TABLES, sql=f"WITH {DECIDED} {POSTS_AFTER}")
def t2(t):
    folder = shared_folder(t.spark, "decisions")
    requests = _stream(t, "decision_requests", "events")
    query = jobs.start_decisions(requests, t.users, t.posts, folder, f"{folder}/checkpoint")
    query.awaitTermination()
    return jobs.current_posts(t.posts, jobs.decision_levels(t.spark, folder).read())


@check(
    "t3_deduplicated_stream",
    "audit_logs",
    sql="SELECT log_id, user_id, action, entity_id FROM audit_logs",
)
def t3(t):
    folder = shared_folder(t.spark, "unique")
    # Every row is delivered twice.
    once, again = (_stream(t, "audit_logs", "events") for _ in range(2))
    unique = jobs.deduplicated(once.unionByName(again), "log_id", "created_at")
    jobs.write_available(unique, f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out").select("log_id", "user_id", "action", "entity_id")
