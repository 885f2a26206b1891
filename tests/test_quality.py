"""Data-quality reports: planted defects are found, clean tables give zeros."""

import datetime as dt
import decimal

import pytest

from quillworks.operators import quality as q
from quillworks.sources.catalogue import TABLES

T0 = dt.datetime(2026, 1, 5, 10)
DAY = dt.date(2026, 1, 5)


def ident(text: str) -> str:
    return text.ljust(36, "0")


GOOD = {
    "users": [(ident("u1"), "Ann", "ann@mail.org", "h", "manager", T0)],
    "clients": [(ident("c1"), "Acme", "UTC", 1, T0, ident("u1"), None, None, None, "#0a0a0a", None, "AMC8X2")],
    "social_accounts": [(ident("a1"), ident("c1"), "twitter", "@acme", 1, None, T0)],
    "content_drafts": [(ident("d1"), ident("c1"), ident("u1"), "Title", "Content", "draft", T0)],
    "posts": [(ident("p1"), ident("d1"), "twitter", "text", None, None, "approved", T0)],
    "ai_generations": [(ident("g1"), ident("d1"), "twitter", "prompt", "text", T0)],
    "approvals": [(ident("v1"), ident("p1"), ident("u1"), "approved", None, T0)],
    "scheduled_posts": [(ident("s1"), ident("p1"), None, T0, "pending", T0)],
    "analytics_logs": [(ident("l1"), ident("p1"), 100, 1, 2, 1, decimal.Decimal("4.00"), T0)],
    "content_recommendations": [(ident("r1"), ident("c1"), DAY, DAY + dt.timedelta(days=6), "twitter", "text", T0)],
    "audit_logs": [(ident("o1"), None, "LOGIN", "users", None, T0)],
    "client_members": [(ident("m1"), ident("c1"), ident("u1"), "manager", T0)],
}

# Rows that break one or more rules, with the fields to change.
BAD = {
    "users": [
        {"user_id": ident("u2"), "email": "ANN@mail.org "},
        {"user_id": ident("u3"), "email": "", "role": "employee"},
        {"user_id": ident("u4"), "email": None, "full_name": "x" * 121},
    ],
    "clients": [{"client_id": ident("c2"), "client_name": "acme", "active_status": 2, "owner_id": ident("u9"), "invite_code": None}],
    "social_accounts": [{"account_id": ident("a2"), "client_id": ident("c1")}, {"account_id": ident("a3"), "client_id": ident("c9"), "platform": "myspace"}],
    "content_drafts": [{"draft_id": ident("d2"), "client_id": None, "created_by": None, "draft_title": "ab"}],
    "posts": [{"post_id": ident("p2"), "draft_id": ident("d9")}, {"post_id": ident("p1"), "status": "lost"}],
    "approvals": [{"approval_id": ident("v2"), "post_id": None, "manager_id": ident("u9")}],
    "scheduled_posts": [{"schedule_id": ident("s2"), "scheduled_time": dt.datetime(2023, 1, 1)}],
    "analytics_logs": [
        {"analytics_id": ident("l2"), "views": -1, "engagement_rate": decimal.Decimal("100.01")},
        {"analytics_id": ident("l3"), "views": 0, "engagement_rate": decimal.Decimal("0.00")},
        {"analytics_id": ident("l4"), "engagement_rate": decimal.Decimal("4.02")},
        {"analytics_id": ident("l5"), "engagement_rate": decimal.Decimal("4.01")},
    ],
    "content_recommendations": [{"recommendation_id": ident("r2"), "week_end_date": DAY}],
}


def build(spark, changes):
    frames = {}
    for name, rows in GOOD.items():
        schema = TABLES[name].schema
        for f in schema.fields:
            f.nullable = True
        names = schema.names
        extra = [tuple({**dict(zip(names, rows[0])), **change}[n] for n in names) for change in changes.get(name, [])]
        frames[name] = spark.createDataFrame(rows + extra, schema)
    return frames


@pytest.fixture(scope="module")
def clean(spark):
    return build(spark, {})


@pytest.fixture(scope="module")
def dirty(spark):
    return build(spark, BAD)


def found(df, label, *values):
    return {r[label]: tuple(r[v] for v in values) if len(values) > 1 else r[values[0]] for r in df.collect()}


def test_clean_tables(clean):
    assert all(r.ok and r.row_count == 1 for r in q.row_counts(clean).collect())
    assert set(found(q.null_report(clean), "check_name", "null_count").values()) == {0}
    assert set(found(q.orphan_report(clean), "fk_check", "orphan_count").values()) == {0}
    assert {r.dangling for r in q.reference_report(clean).collect()} == {0}
    assert {r.duplicate_keys for r in q.uniqueness_report(clean).collect()} == {0}
    assert {r.violations for r in q.row_check_report(clean).collect()} == {0}
    assert q.rate_mismatches(clean["analytics_logs"]).count() == 0
    assert q.week_end_mismatches(clean["content_recommendations"]).count() == 0


def test_all_references_and_keys_are_checked(clean):
    assert q.reference_report(clean).count() == 15 - 1
    assert q.uniqueness_report(clean).count() == 12 + 7
    assert q.row_check_report(clean, "rules").count() == 11
    assert q.row_check_report(clean, "domains").count() == 10


def test_nulls(dirty):
    got = found(q.null_report(dirty), "check_name", "null_count")
    assert len(got) == 8
    assert got["users - NULL email"] == 2
    assert got["drafts - NULL created_by"] == 1
    assert got["approvals - NULL post_id"] == 1
    assert got["posts - NULL draft_id"] == 0


def test_orphans_count_null_and_dangling(dirty):
    got = found(q.orphan_report(dirty), "fk_check", "orphan_count")
    assert got["orphan posts (no draft)"] == 1
    assert got["orphan approvals (no post)"] == 1
    assert got["orphan approvals (no manager)"] == 1
    assert got["orphan drafts (no client)"] == 1
    both = found(q.reference_report(dirty), "reference", "null_keys", "dangling")
    assert both["approvals.post_id -> posts"] == (1, 0)
    assert both["approvals.manager_id -> users"] == (0, 1)
    assert both["clients.owner_id -> users"] == (0, 1)
    assert both["audit_logs.user_id -> users"] == (1, 0)


def test_uniqueness_ignores_case_and_nulls(dirty):
    got = found(q.uniqueness_report(dirty), "unique_key", "duplicate_keys", "surplus_rows")
    assert got["users(email)"] == (1, 1)
    assert got["clients(client_name)"] == (1, 1)
    assert got["clients(invite_code)"] == (0, 0)
    assert got["social_accounts(client_id, platform)"] == (1, 1)
    assert got["posts(post_id)"] == (1, 1)
    assert got["scheduled_posts(post_id)"] == (1, 1)
    assert got["analytics_logs(analytics_id)"] == (0, 0)


def test_row_checks(dirty):
    got = {(r.table_name, r.check_name): r.violations for r in q.row_check_report(dirty).collect()}
    assert got["users", "check: email_pattern"] == 1  # NULL passes
    assert got["users", "domain: role"] == 1
    assert got["users", "not null: email"] == 1
    assert got["users", "length: full_name"] == 1
    assert got["clients", "check: active_flag"] == 1
    assert got["social_accounts", "domain: platform"] == 1
    assert got["content_drafts", "check: title_length"] == 1
    assert got["posts", "domain: status"] == 1
    assert got["scheduled_posts", "check: schedule_after_start"] == 1
    assert got["analytics_logs", "check: views_not_negative"] == 1
    assert got["analytics_logs", "check: rate_in_percent"] == 1
    assert got["content_recommendations", "check: week_order"] == 1


def test_rates_and_weeks(dirty):
    ids = {r.analytics_id[:2] for r in q.rate_mismatches(dirty["analytics_logs"]).collect()}
    assert ids == {"l2", "l4"}
    assert q.week_end_mismatches(dirty["content_recommendations"]).count() == 1
