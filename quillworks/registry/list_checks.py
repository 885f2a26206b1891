"""Lists, details, access and set operations (P*, J1-J12, J16, K*, U1, W2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillworks.operators import brands as b
from quillworks.operators import counters as c
from quillworks.operators import lists as ls
from quillworks.operators import ordering
from quillworks.operators import quality as q
from quillworks.registry.checks import check, timestamp

POST_COLUMNS = "p.post_id, p.draft_id, p.platform, p.repurposed_content, p.status, p.created_at"


@check("p1_posts_of_drafts", "posts", sql="SELECT * FROM posts")
def p1(t):
    return ls.posts_of_drafts(t.posts)


@check("p2_users_by_role", "users", sql="SELECT * FROM users WHERE role = 'manager'")
def p2(t):
    return ls.users_with_role(t.users, "manager")


@check(
    "p3_active_brands",
    "clients",
    sql="SELECT client_id, client_name, timezone FROM clients WHERE active_status = 1",
)
def p3(t):
    return ls.active_brands(t.clients)


@check(
    "p4_schedule_lookup",
    "audit_logs",
    "scheduled_posts",
    sql="""
WITH keys AS (SELECT DISTINCT entity_id AS post_id FROM audit_logs)
SELECT k.post_id, s.schedule_id, s.scheduled_time, s.schedule_status, s.post_id IS NOT NULL AS found
FROM keys k LEFT JOIN scheduled_posts s ON s.post_id = k.post_id""",
)
def p4(t):
    keys = t.audit_logs.select(F.col("entity_id").alias("post_id"))
    return ls.lookup(keys, t.scheduled_posts, "post_id")


@check(
    "p4_rows_for_keys",
    "audit_logs",
    "posts",
    sql="SELECT * FROM posts WHERE post_id IN (SELECT entity_id FROM audit_logs)",
)
def p4_rows(t):
    return ls.rows_for_keys(t.posts, t.audit_logs.select(F.col("entity_id").alias("post_id")), "post_id")


@check(
    "p4_users_by_email",
    "registrations",
    "users",
    sql="""
WITH keys AS (SELECT DISTINCT email FROM registrations)
SELECT k.email, u.user_id, u.full_name, u.role, u.user_id IS NOT NULL AS found
FROM keys k LEFT JOIN users u ON lower(rtrim(u.email)) = lower(rtrim(k.email))""",
)
def p4_email(t):
    return ls.users_by_email(t.registrations, t.users)


@check(
    "p5_brands_by_code",
    "join_requests",
    "clients",
    sql="""
SELECT r.request_id, r.user_id, upper(trim(r.invite_code)) AS normal_code, c.client_id, c.client_name
FROM join_requests r LEFT JOIN clients c ON c.invite_code = upper(trim(r.invite_code))""",
)
def p5(t):
    return ls.brands_by_code(t.join_requests, t.clients).drop("invite_code", "request_time")


@check(
    "p6_brand_accounts",
    "social_accounts",
    sql="SELECT client_id, account_id, platform, account_name, connected_status FROM social_accounts",
)
def p6(t):
    return b.brand_accounts(t.social_accounts)


@check("p7_connected_accounts", "social_accounts", sql="SELECT * FROM social_accounts WHERE connected_status = 1")
def p7(t):
    return b.connected(t.social_accounts)


@check(
    "p8_stale_pending_posts",
    "posts",
    sql=f"""
SELECT * FROM posts
WHERE status = 'pending_approval' AND created_at < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 7 DAY""",
)
def p8(t):
    return ls.stale_pending(t.posts, 7, timestamp("1998-06-01 00:00:00"))


@check(
    "p9_users_without_email",
    "users",
    sql="SELECT * FROM (SELECT user_id, CASE role WHEN 'client' THEN '' WHEN 'admin' THEN NULL ELSE email END AS email"
    " FROM users) u WHERE email IS NULL OR email = ''",
)
def p9(t):
    users = t.users.selectExpr(
        "user_id", "CASE role WHEN 'client' THEN '' WHEN 'admin' THEN NULL ELSE email END AS email"
    )
    return ls.without_email(users)


@check(
    "p10_email_pattern",
    "registrations",
    sql="SELECT request_id, email FROM registrations WHERE email LIKE '%@%.%'",
)
def p10(t):
    return ls.with_email_like(t.registrations, "%@%.%").select("request_id", "email")


@check(
    "p11_sound_snapshots",
    "analytics_logs",
    sql="""
SELECT post_id, views, likes, comments, shares, CAST(engagement_rate AS DOUBLE) AS engagement_rate, recorded_at
FROM analytics_logs WHERE views >= 0 AND likes >= 0 AND comments >= 0 AND shares >= 0
AND engagement_rate BETWEEN 0 AND 100""",
)
def p11(t):
    return q.sound_rows(t.analytics_logs, "analytics_logs")


@check(
    "p12_visible_brands",
    "clients",
    "client_members",
    "users",
    sql="""
SELECT u.user_id, c.client_id, c.client_name FROM clients c JOIN users u ON c.owner_id = u.user_id
  OR EXISTS (SELECT 1 FROM client_members m WHERE m.client_id = c.client_id AND m.user_id = u.user_id)""",
)
def p12(t):
    return b.brands_with_access(t.clients, t.client_members).select("user_id", "client_id", "client_name")


@check("p13_posts_with_status", "posts", sql="SELECT * FROM posts WHERE status = 'published'")
def p13(t):
    return ls.posts_with_status(t.posts, "published")


@check(
    "p14_newest_approved",
    "posts",
    sql="""
SELECT post_id, platform, status FROM posts WHERE status = 'approved'
ORDER BY created_at DESC, post_id LIMIT 3""",
)
def p14(t):
    return ls.newest_approved(t.posts)


W2_SQL = """
newest AS (
  SELECT post_id, remarks, row_number() OVER (
           PARTITION BY post_id ORDER BY approval_date DESC, approval_id DESC) AS rn FROM approvals)
"""


@check(
    "p15_revealed_remarks",
    "posts",
    "approvals",
    sql=f"""
WITH {W2_SQL},
state AS (SELECT p.post_id, CASE WHEN p.status = 'approved' THEN 'request_edit' ELSE p.status END AS status,
                 n.remarks FROM posts p JOIN newest n ON n.post_id = p.post_id AND n.rn = 1)
SELECT post_id, status, CASE WHEN status IN ('rejected', 'request_edit') AND remarks <> '' THEN remarks END
       AS shown_remarks
FROM state""",
)
def p15(t):
    # The bound posts have no edit state, so approved ones stand in for it.
    status = F.when(F.col("status") == "approved", "request_edit").otherwise(F.col("status"))
    state = t.posts.select("post_id", status.alias("status")).join(
        ls.latest_remarks(t.approvals), "post_id"
    )
    shown = ls.revealed_remarks(F.col("latest_remarks"), F.col("status"))
    return state.select("post_id", "status", shown.alias("shown_remarks"))


@check(
    "p15_brand_cards",
    "users",
    "clients",
    "client_members",
    sql="""
WITH admins AS (SELECT user_id FROM users WHERE role = 'admin'),
pairs AS (SELECT client_id, owner_id AS user_id, 'owner' AS access_type FROM clients
          WHERE owner_id IN (SELECT user_id FROM admins)
          UNION SELECT client_id, user_id, member_role FROM client_members)
SELECT p.user_id, p.client_id, p.access_type, upper(substring(c.client_name, 1, 1)) AS avatar,
       COALESCE(NULLIF(c.industry, ''), 'No industry set') AS industry_text,
       COALESCE(NULLIF(c.brand_color, ''), '#0a0a0a') AS color,
       CASE WHEN p.access_type = 'owner' THEN c.invite_code END AS shown_code
FROM pairs p JOIN clients c ON c.client_id = p.client_id""",
)
def p15_cards(t):
    return b.brand_cards(b.brand_list(t.users, t.clients, t.client_members)).select(
        "user_id", "client_id", "access_type", "avatar", "industry_text", "color", "shown_code"
    )


@check(
    "j1_posts_of_users",
    "posts",
    "content_drafts",
    sql=f"""
SELECT {POST_COLUMNS}, cd.created_by AS user_id, cd.draft_title
FROM posts p JOIN content_drafts cd ON cd.draft_id = p.draft_id""",
)
def j1(t):
    return ls.posts_of_users(t.posts, t.content_drafts)


@check(
    "j2_review_queue",
    "posts",
    "content_drafts",
    "users",
    sql=f"""
SELECT {POST_COLUMNS}, cd.draft_title, u.full_name AS author_name
FROM posts p JOIN content_drafts cd ON cd.draft_id = p.draft_id JOIN users u ON u.user_id = cd.created_by
WHERE p.status = 'pending_approval'""",
)
def j2(t):
    queue = ls.review_queue(t.posts, t.content_drafts, t.users)
    return ordering.newest_first(queue, "created_at", "post_id")


@check(
    "j3_post_details",
    "posts",
    "content_drafts",
    "users",
    sql=f"""
SELECT {POST_COLUMNS}, cd.draft_title, cd.draft_content, u.full_name AS author_name, u.email AS author_email
FROM posts p JOIN content_drafts cd ON cd.draft_id = p.draft_id JOIN users u ON u.user_id = cd.created_by""",
)
def j3(t):
    return ls.post_details(t.posts, t.content_drafts, t.users)


@check(
    "j4_draft_details",
    "content_drafts",
    "clients",
    "users",
    sql="""
WITH gaps AS (SELECT draft_id, CASE WHEN draft_id % 7 = 0 THEN -1 - draft_id ELSE client_id END AS client_id,
                     CASE WHEN draft_id % 11 = 0 THEN -1 - draft_id ELSE created_by END AS created_by,
                     draft_title, draft_content, draft_status, created_at FROM content_drafts)
SELECT cd.draft_id, cd.client_id, cd.created_by, cd.draft_title, cd.draft_content, cd.draft_status,
       CAST(cd.created_at AS VARCHAR) AS created_at, c.client_name, u.full_name AS author_name
FROM gaps cd
LEFT JOIN clients c ON c.client_id = cd.client_id
LEFT JOIN users u ON u.user_id = cd.created_by""",
)
def j4(t):
    # Some drafts name a brand or an author that does not exist, so that both optional sides have gaps.
    unknown = -1 - F.col("draft_id")
    drafts = t.content_drafts.withColumns(
        {
            "client_id": F.when(F.col("draft_id") % 7 == 0, unknown).otherwise(F.col("client_id")),
            "created_by": F.when(F.col("draft_id") % 11 == 0, unknown).otherwise(F.col("created_by")),
        }
    )
    return ls.draft_details(drafts, t.clients, t.users)


@check(
    "j5_approval_history",
    "approvals",
    "users",
    sql="SELECT a.*, u.full_name AS manager_name FROM approvals a JOIN users u ON u.user_id = a.manager_id",
)
def j5(t):
    history = ls.approval_history(t.approvals, t.users)
    return history.orderBy("post_id", F.desc("approval_date"), "approval_id")


@check(
    "j6_brand_members",
    "client_members",
    "users",
    sql="""
SELECT m.client_id, m.user_id, m.member_role, m.added_at, u.full_name, u.email
FROM client_members m JOIN users u ON u.user_id = m.user_id""",
)
def j6(t):
    return b.brand_members(t.client_members, t.users)


@check(
    "j6_newest_members",
    "client_members",
    "users",
    sql="""
SELECT client_id, user_id, member_role, added_at, full_name, email, place FROM (
  SELECT m.*, u.full_name, u.email,
         CAST(row_number() OVER (PARTITION BY m.client_id ORDER BY m.added_at DESC, m.user_id) AS INTEGER) AS place
  FROM client_members m JOIN users u ON u.user_id = m.user_id) r
WHERE place <= 5""",
)
def j6_newest(t):
    return b.newest_members(t.client_members, t.users, 5)


@check(
    "j7_member_brands",
    "client_members",
    "clients",
    sql="""
SELECT m.user_id, m.member_role AS access_type, c.*
FROM client_members m JOIN clients c ON c.client_id = m.client_id""",
)
def j7(t):
    return b.member_brands(t.clients, t.client_members)


@check(
    "j8_posts_with_schedule",
    "posts",
    "content_drafts",
    "scheduled_posts",
    "approvals",
    sql=f"""
WITH {W2_SQL}
SELECT {POST_COLUMNS}, cd.created_by AS user_id, cd.draft_title, sp.schedule_id, sp.scheduled_time,
       sp.schedule_status, n.remarks AS latest_remarks
FROM posts p JOIN content_drafts cd ON cd.draft_id = p.draft_id
LEFT JOIN scheduled_posts sp ON sp.post_id = p.post_id
LEFT JOIN newest n ON n.post_id = p.post_id AND n.rn = 1""",
)
def j8(t):
    return ls.posts_with_schedule(t.posts, t.content_drafts, t.scheduled_posts, t.approvals)


@check(
    "j9_brand_access",
    "users",
    "clients",
    "client_members",
    sql="""
SELECT u.user_id, CASE WHEN c.owner_id = u.user_id THEN 'owner' ELSE COALESCE(m.member_role, 'none') END
       AS access_type, c.*
FROM users u JOIN clients c ON true
LEFT JOIN client_members m ON m.client_id = c.client_id AND m.user_id = u.user_id
WHERE c.owner_id = u.user_id OR m.user_id = u.user_id""",
)
def j9(t):
    return b.brands_with_access(t.clients, t.client_members)


@check(
    "j9_access_of_requests",
    "brand_edits",
    "clients",
    "client_members",
    sql="""
SELECT r.request_id, r.client_id, r.user_id,
       CASE WHEN c.owner_id = r.user_id THEN 'owner' WHEN c.client_id IS NULL THEN 'none'
            ELSE COALESCE(m.member_role, 'none') END AS access_type
FROM brand_edits r LEFT JOIN clients c ON c.client_id = r.client_id
LEFT JOIN client_members m ON m.client_id = r.client_id AND m.user_id = r.user_id""",
)
def j9_requests(t):
    requests = t.brand_edits.select("request_id", "client_id", "user_id")
    return b.access_of_requests(requests, t.clients, t.client_members)


@check(
    "j10_brands_with_draft",
    "clients",
    "content_drafts",
    "users",
    sql="""
SELECT * FROM clients WHERE client_id IN (
  SELECT DISTINCT client_id FROM content_drafts
  WHERE created_by IN (SELECT user_id FROM users WHERE role = 'writer'))""",
)
def j10(t):
    return b.brands_with_draft_by(t.clients, t.content_drafts, ls.users_with_role(t.users, "writer"))


@check(
    "j10_brands_of_authors",
    "content_drafts",
    sql="SELECT DISTINCT created_by AS user_id, client_id FROM content_drafts",
)
def j10_pairs(t):
    return b.brands_of_authors(t.content_drafts)


@check(
    "j12_scheduled_chain",
    "clients",
    "content_drafts",
    "posts",
    "scheduled_posts",
    sql="""
SELECT c.client_id, c.client_name, cd.draft_id, cd.draft_title, p.post_id, p.platform, sp.schedule_id,
       sp.scheduled_time
FROM clients c JOIN content_drafts cd ON cd.client_id = c.client_id
JOIN posts p ON p.draft_id = cd.draft_id JOIN scheduled_posts sp ON sp.post_id = p.post_id""",
)
def j12(t):
    return ls.scheduled_chain(t.clients, t.content_drafts, t.posts, t.scheduled_posts)


@check(
    "j16_connection_matrix",
    "clients",
    "social_accounts",
    sql="""
WITH names(platform, platform_name) AS (VALUES ('instagram', 'Instagram'), ('linkedin', 'LinkedIn'),
  ('twitter', 'Twitter / X'), ('facebook', 'Facebook'), ('tiktok', 'TikTok'), ('youtube', 'YouTube'))
SELECT c.client_id, n.platform, n.platform_name, a.account_name, a.account_name IS NOT NULL AS is_connected
FROM clients c CROSS JOIN names n LEFT JOIN social_accounts a
  ON a.client_id = c.client_id AND a.platform = n.platform AND a.connected_status = 1""",
)
def j16(t):
    return b.connection_matrix(t.clients, t.social_accounts)


RANKED_DRAFTS = """
ranked AS (
  SELECT cd.created_by AS user_id, cd.*, c.client_name, row_number() OVER (
           PARTITION BY cd.created_by ORDER BY cd.created_at DESC, cd.draft_id) AS rank
  FROM content_drafts cd LEFT JOIN clients c ON c.client_id = cd.client_id)
"""


@check(
    "k1_recent_drafts",
    "content_drafts",
    "clients",
    sql=f"""
WITH {RANKED_DRAFTS}
SELECT user_id, rank, draft_id, draft_title, draft_status, CAST(created_at AS VARCHAR) AS created_at, client_name
FROM ranked WHERE rank <= 5""",
)
def k1(t):
    return c.newest_drafts(t.content_drafts, t.clients)


DRAFTS_PAGE_SQL = f"""
WITH {RANKED_DRAFTS},
counts AS (SELECT draft_id, count(*) AS n FROM posts GROUP BY draft_id)
SELECT r.user_id, r.rank, r.draft_id, r.draft_title, r.draft_status, CAST(r.created_at AS VARCHAR) AS created_at,
       r.client_name, COALESCE(n.n, 0) AS post_count
FROM ranked r LEFT JOIN counts n ON n.draft_id = r.draft_id WHERE rank <= 50"""


@check(
    "a8_posts_per_draft",
    "content_drafts",
    "clients",
    "posts",
    sql="""
SELECT cd.created_by AS user_id, cd.draft_id, cd.draft_title, cd.draft_status,
       CAST(cd.created_at AS VARCHAR) AS created_at, c.client_name,
       (SELECT count(*) FROM posts p WHERE p.draft_id = cd.draft_id) AS post_count
FROM content_drafts cd LEFT JOIN clients c ON c.client_id = cd.client_id""",
)
def a8(t):
    return c.drafts_with_counts(t.content_drafts, t.clients, t.posts)


@check("k2_drafts_page", "content_drafts", "clients", "posts", sql=DRAFTS_PAGE_SQL)
def k2(t):
    return c.drafts_page(t.content_drafts, t.clients, t.posts)


@check("k3_posts_newest_first", "posts", sql="SELECT * FROM posts")
def k3(t):
    return ordering.newest_first(t.posts, "created_at", "post_id")


@check("k3_brands_by_name", "clients", sql="SELECT * FROM clients")
def k3_names(t):
    return ordering.by_name(t.clients, "client_name", "client_id")


@check(
    "k4_newest_decisions",
    "approvals",
    sql="SELECT * FROM approvals ORDER BY approval_date DESC, approval_id LIMIT 5",
)
def k4(t):
    return ordering.top_rows(t.approvals, [F.desc("approval_date"), F.asc("approval_id")], 5)


@check(
    "k5_top_scheduled_brands",
    "clients",
    "content_drafts",
    "posts",
    "scheduled_posts",
    sql="""
SELECT min(c.client_name) AS client_name, count(sp.schedule_id) AS scheduled_count
FROM clients c JOIN content_drafts cd ON cd.client_id = c.client_id
JOIN posts p ON p.draft_id = cd.draft_id JOIN scheduled_posts sp ON sp.post_id = p.post_id
GROUP BY lower(rtrim(c.client_name)) ORDER BY scheduled_count DESC, client_name LIMIT 5""",
)
def k5(t):
    return c.most_scheduled_brands(t.clients, t.content_drafts, t.posts, t.scheduled_posts)


U1_PAIRS = """
pairs AS (SELECT client_id, owner_id AS user_id, 'owner' AS access_type FROM clients
          WHERE owner_id IN (SELECT user_id FROM users WHERE role = 'admin')
          UNION SELECT client_id, user_id, member_role FROM client_members)
"""


@check(
    "u1_brand_list",
    "users",
    "clients",
    "client_members",
    sql=f"WITH {U1_PAIRS} SELECT p.user_id, p.access_type, c.* FROM pairs p JOIN clients c ON c.client_id = p.client_id",
)
def u1(t):
    return b.brand_list(t.users, t.clients, t.client_members)


@check(
    "u1_brand_list_one_row_per_brand",
    "users",
    "clients",
    "client_members",
    sql=f"""
WITH {U1_PAIRS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY client_id, user_id ORDER BY access_type = 'owner' DESC) AS rn
           FROM pairs)
SELECT p.user_id, p.access_type, c.* FROM ranked p JOIN clients c ON c.client_id = p.client_id WHERE rn = 1""",
)
def u1_one(t):
    return b.brand_list(t.users, t.clients, t.client_members, one_row_per_brand=True)


@check(
    "w2_latest_remarks",
    "approvals",
    sql=f"WITH {W2_SQL} SELECT post_id, remarks AS latest_remarks FROM newest WHERE rn = 1",
)
def w2(t):
    return ls.latest_remarks(t.approvals)
