"""Batch workflows against a replay of the same requests one by one in plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillworks.plans import brand_changes, intake, maintenance, removals, reviews
from quillworks.plans.outcome import checkpointed

T0 = dt.datetime(2026, 3, 1)
NOW = dt.datetime(2026, 3, 2)
SEEDS = [1, 2, 3]


def table(spark, schema, data):
    return spark.createDataFrame([tuple(r) for r in data], schema)


def in_order(requests):
    return sorted(requests, key=lambda r: (r["request_time"], r["request_id"]))


def reasons(outcome):
    return {r.request_id: r.reason for r in outcome.decided.collect()}


def times(rng, n):
    """Few distinct times, so that the request id has to break ties."""
    return [T0 + dt.timedelta(minutes=rng.randrange(n // 3 + 1)) for _ in range(n)]


def shuffled(rng, requests):
    return rng.sample(requests, len(requests))


def frame(spark, requests, schema):
    names = [part.split()[0] for part in schema.split(", ")]
    return table(spark, schema, [[r[n] for n in names] for r in requests])


@pytest.mark.parametrize("seed", SEEDS)
def test_decisions(spark, seed):
    rng = random.Random(seed)
    users = {"w": "writer", "m": "manager", "a": "admin"}
    posts = {f"p{i}": rng.choice(["pending_approval", "approved", "published"]) for i in range(6)}
    requests = [
        {
            "request_id": i,
            "request_time": t,
            "user_id": rng.choice(["w", "m", "a", "ghost"]),
            "post_id": rng.choice([*posts, "p99"]),
            "approval_status": rng.choice(["approved", "rejected", "request_edit", "maybe"]),
            "remarks": rng.choice([None, "", "  ", " fine "]),
        }
        for i, t in enumerate(times(rng, 60))
    ]
    state, want, rows = dict(posts), {}, []
    for r in in_order(requests):
        if users.get(r["user_id"]) not in ("manager", "admin"):
            want[r["request_id"]] = "forbidden"
        elif r["approval_status"] not in ("approved", "rejected", "request_edit"):
            want[r["request_id"]] = "invalid_status"
        elif r["post_id"] not in state:
            want[r["request_id"]] = "not_found"
        else:
            want[r["request_id"]] = None
            rows.append((r["post_id"], r["user_id"], r["remarks"].strip() if r["remarks"] else None))
            state[r["post_id"]] = r["approval_status"]
    schema = "request_id long, request_time timestamp_ntz, user_id string, post_id string, approval_status string, remarks string"
    outcome = reviews.apply_decisions(
        frame(spark, shuffled(rng, requests), schema),
        table(spark, "user_id string, role string", users.items()),
        table(spark, "post_id string, status string", posts.items()),
    )
    assert reasons(outcome) == want
    assert {r.post_id: r.status for r in outcome.tables["posts"].collect()} == state
    got = [(r.post_id, r.manager_id, r.remarks) for r in outcome.appended["approvals"].collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
    flagged = {r.request_id for r in outcome.decided.filter("flagged").collect()}
    assert flagged == {
        r["request_id"] for r in requests if want[r["request_id"]] is None and posts[r["post_id"]] == "published"
    }
    assert outcome.accepted.count() + outcome.rejected.count() == len(requests)


@pytest.mark.parametrize("seed", SEEDS)
def test_schedules(spark, seed):
    rng = random.Random(seed)
    posts = {f"p{i}": rng.choice(["approved", "approved", "rejected"]) for i in range(8)}
    scheduled = {"p1", "p2"}
    slots = ["2026-06-15T14:30", "2026-06", "soon", "2026-01-01T00:00", "2026-03-02T00:00", "2026-03-02 00:01"]
    requests = [
        {
            "request_id": i,
            "request_time": t,
            "user_id": "w",
            "post_id": rng.choice([*posts, "p99"]),
            "scheduled_time": rng.choice(slots),
        }
        for i, t in enumerate(times(rng, 60))
    ]
    state, taken, want = dict(posts), set(scheduled), {}
    for r in in_order(requests):
        post = r["post_id"]
        if post not in state:
            want[r["request_id"]] = "not_found"
        elif state[post] != "approved":
            want[r["request_id"]] = "wrong_status"
        elif post in taken:
            want[r["request_id"]] = "already_scheduled"
        elif r["scheduled_time"] in ("2026-06", "soon"):
            want[r["request_id"]] = "invalid_date"
        elif dt.datetime.fromisoformat(r["scheduled_time"]) <= NOW:
            want[r["request_id"]] = "not_future"
        else:
            want[r["request_id"]] = None
            taken.add(post)
            state[post] = "scheduled"
    schema = "request_id long, request_time timestamp_ntz, user_id string, post_id string, scheduled_time string"
    outcome = reviews.apply_schedules(
        frame(spark, shuffled(rng, requests), schema),
        table(spark, "post_id string, status string", posts.items()),
        table(spark, "schedule_id string, post_id string", [(p, p) for p in scheduled]),
        F.lit(str(NOW)).cast("timestamp_ntz"),
    )
    assert reasons(outcome) == want
    assert {r.post_id: r.status for r in outcome.tables["posts"].collect()} == state
    assert {r.post_id for r in outcome.appended["scheduled_posts"].collect()} == taken - scheduled


@pytest.mark.parametrize("seed", SEEDS)
def test_joins_by_code(spark, seed):
    rng = random.Random(seed)
    codes = {"AMC8X2": "c1", "B00000": "c2"}
    members = {("c1", "u1")}
    requests = [
        {
            "request_id": i,
            "request_time": t,
            "user_id": rng.choice(["u1", "u2", "u3"]),
            "invite_code": rng.choice(["amc8x2", " B00000 ", "NOPE", "", "b00000"]),
        }
        for i, t in enumerate(times(rng, 30))
    ]
    state, want = set(members), {}
    for r in in_order(requests):
        brand = codes.get(r["invite_code"].strip().upper())
        if brand is None:
            want[r["request_id"]] = "invalid_code"
        elif (brand, r["user_id"]) in state:
            want[r["request_id"]] = "already_member"
        else:
            want[r["request_id"]] = None
            state.add((brand, r["user_id"]))
    outcome = brand_changes.join_brands(
        frame(spark, shuffled(rng, requests), "request_id long, request_time timestamp_ntz, user_id string, invite_code string"),
        table(spark, "client_id string, client_name string, invite_code string", [(c, c, code) for code, c in codes.items()] + [("c3", "c3", None)]),
        table(spark, "client_id string, user_id string, member_role string", [(*m, "writer") for m in members]),
    )
    assert reasons(outcome) == want
    new = {(r.client_id, r.user_id) for r in outcome.appended["client_members"].collect()}
    assert new == state - members


@pytest.mark.parametrize("seed", SEEDS)
def test_registrations(spark, seed):
    rng = random.Random(seed)
    emails = ["ann@mail.org", "ANN@mail.org", "bob@mail.org", "Bob@Mail.org ", "nowhere", "new@mail.org"]
    requests = [
        {
            "request_id": i,
            "request_time": t,
            "full_name": f"n{i}",
            "email": rng.choice(emails),
            "password_hash": "h",
            "role": rng.choice(["Writer", "manager", "employee", None]),
        }
        for i, t in enumerate(times(rng, 30))
    ]
    taken, want = {"ann@mail.org"}, {}
    for r in in_order(requests):
        key = r["email"].rstrip().lower()
        if key in taken:
            want[r["request_id"]] = "email_taken"
        elif (r["role"] or "").lower() not in ("writer", "manager", "admin", "client"):
            want[r["request_id"]] = "invalid_role"
        elif key == "nowhere":
            want[r["request_id"]] = "invalid_email"
        else:
            want[r["request_id"]] = None
            taken.add(key)
    schema = "request_id long, request_time timestamp_ntz, full_name string, email string, password_hash string, role string"
    outcome = intake.intake_users(
        frame(spark, shuffled(rng, requests), schema),
        table(spark, "user_id string, email string", [("u0", "ann@mail.org")]),
    )
    assert reasons(outcome) == want
    assert all(r.role in ("writer", "manager") for r in outcome.appended["users"].collect())


@pytest.mark.parametrize("seed", SEEDS)
def test_brands(spark, seed):
    rng = random.Random(seed)
    users = {"a": "admin", "b": "admin", "w": "writer"}
    requests = [
        {
            "request_id": i,
            "request_time": t,
            "user_id": rng.choice(["a", "b", "w", "ghost"]),
            "brand_name": rng.choice([" Acme ", "acme", "Bolt", "BOLT ", "x", "  ", "Zed"]),
            "industry": rng.choice(["", " toys "]),
            "brand_voice": "",
            "target_audience": " ",
            "brand_color": "#000000",
            "do_not_use": None,
        }
        for i, t in enumerate(times(rng, 30))
    ]
    taken, want = {"zed"}, {}
    for r in in_order(requests):
        name = r["brand_name"].strip()
        if users.get(r["user_id"]) != "admin":
            want[r["request_id"]] = "forbidden"
        elif len(name) < 2:
            want[r["request_id"]] = "name_too_short"
        elif name.lower() in taken:
            want[r["request_id"]] = "duplicate_name"
        else:
            want[r["request_id"]] = None
            taken.add(name.lower())
    schema = (
        "request_id long, request_time timestamp_ntz, user_id string, brand_name string, industry string,"
        " brand_voice string, target_audience string, brand_color string, do_not_use string"
    )
    outcome = brand_changes.intake_brands(
        frame(spark, shuffled(rng, requests), schema.replace(",  ", ", ")),
        table(spark, "user_id string, role string", users.items()),
        table(spark, "client_id string, client_name string", [("c0", "Zed")]),
    )
    assert reasons(outcome) == want
    brands = outcome.appended["clients"].collect()
    assert all(r.industry in (None, "toys") and r.brand_voice is None for r in brands)
    members = {(r.client_id, r.user_id, r.member_role) for r in outcome.appended["client_members"].collect()}
    assert members == {(r.client_id, r.owner_id, "manager") for r in brands}


@pytest.fixture(scope="module")
def brand_tables(spark):
    clients = table(
        spark,
        "client_id string, client_name string, owner_id string, industry string, brand_voice string,"
        " target_audience string, brand_color string, do_not_use string",
        [("c1", "Acme", "a", "old", "old", "old", "#000000", "old"), ("c2", "Bolt", None, "x", "x", "x", "#1", "x")],
    )
    members = table(spark, "client_id string, user_id string, member_role string", [("c1", "a", "manager"), ("c1", "w", "writer")])
    return clients, members


@pytest.mark.parametrize("seed", SEEDS)
def test_accounts(spark, brand_tables, seed):
    rng = random.Random(seed)
    accounts = {("c1", "twitter"): ("a1", "@old", 0, None)}
    requests = [
        {
            "request_id": i,
            "request_time": t,
            "user_id": rng.choice(["a", "a", "w", "ghost"]),
            "client_id": rng.choice(["c1", "c1", "c2", "c9"]),
            "platform": rng.choice(["twitter", "tiktok", "myspace"]),
            "account_name": rng.choice(["@@name", " name ", "@", "x", "@ab"]),
        }
        for i, t in enumerate(times(rng, 40))
    ]
    access = {("c1", "a"): "owner", ("c1", "w"): "writer"}
    state, want = {k: v[:3] for k, v in accounts.items()}, {}
    for r in in_order(requests):
        name = r["account_name"].strip().lstrip("@")
        key = (r["client_id"], r["platform"])
        if (r["client_id"], r["user_id"]) not in access:
            want[r["request_id"]] = "not_found"
        elif access[r["client_id"], r["user_id"]] != "owner":
            want[r["request_id"]] = "forbidden"
        elif r["platform"] == "myspace":
            want[r["request_id"]] = "invalid_platform"
        elif len(name) < 2:
            want[r["request_id"]] = "handle_too_short"
        else:
            want[r["request_id"]] = None
            state[key] = (state[key][0] if key in state else "new", f"@{name}", 1)
    outcome = brand_changes.connect_accounts(
        frame(spark, shuffled(rng, requests), "request_id long, request_time timestamp_ntz, user_id string, client_id string, platform string, account_name string"),
        *brand_tables,
        table(
            spark,
            "account_id string, client_id string, platform string, account_name string, connected_status int, buffer_profile_id string, connected_at timestamp_ntz",
            [(v[0], *k, v[1], v[2], v[3], T0) for k, v in accounts.items()],
        ),
    )
    assert reasons(outcome) == want
    after = {(r.client_id, r.platform): r for r in outcome.tables["social_accounts"].collect()}
    got = {k: (r.account_id if r.account_id == "a1" else "new", r.account_name, r.connected_status) for k, r in after.items()}
    assert got == state
    assert all(r.connected_at is not None for r in after.values())


def test_disconnect_keeps_the_row(spark, brand_tables):
    accounts = table(
        spark,
        "account_id string, client_id string, platform string, connected_status int",
        [("a1", "c1", "twitter", 1), ("a2", "c1", "tiktok", 1), ("a3", "c2", "twitter", 1)],
    )
    requests = table(
        spark,
        "request_id long, request_time timestamp_ntz, user_id string, client_id string, platform string",
        [(1, T0, "a", "c1", "twitter"), (2, T0, "w", "c1", "tiktok"), (3, T0, "a", "c2", "twitter"), (4, T0, "a", "c1", "youtube")],
    )
    outcome = brand_changes.disconnect_accounts(requests, *brand_tables, accounts)
    assert reasons(outcome) == {1: None, 2: "forbidden", 3: "not_found", 4: None}
    assert {r.account_id: r.connected_status for r in outcome.tables["social_accounts"].collect()} == {"a1": 0, "a2": 1, "a3": 1}


def test_brand_edits(spark, brand_tables):
    schema = (
        "request_id long, request_time timestamp_ntz, user_id string, client_id string, industry string, brand_voice string,"
        " target_audience string, brand_color string, do_not_use string"
    )
    requests = table(
        spark,
        schema,
        [
            (2, T0, "a", "c1", " new ", "", " ", "#ffffff", "b"),
            (1, T0, "a", "c1", "earlier", "e", "e", "#111111", "e"),
            (3, T0, "w", "c1", "no", "no", "no", "#222222", "no"),
            (4, T0, "a", "c2", "no", "no", "no", "#222222", "no"),
        ],
    )
    outcome = brand_changes.edit_brands(requests, brand_tables[0])
    assert reasons(outcome) == {1: None, 2: None, 3: "not_owner", 4: "not_owner"}
    rows = {r.client_id: r for r in outcome.tables["clients"].collect()}
    assert tuple(rows["c1"])[3:] == ("new", "", "", "#ffffff", "b")
    assert rows["c2"].industry == "x"


def test_draft_intake(spark):
    requests = table(
        spark,
        "request_id long, request_time timestamp_ntz, user_id string, client_id string, draft_title string, draft_content string",
        [
            (1, T0, "u", "c", "  abc ", " " + "x" * 20 + "\n"),
            (2, T0, "u", "c", " ab ", "x" * 30),
            (3, T0, "u", "c", "title", " " + "x" * 19 + " "),
        ],
    )
    outcome = intake.intake_drafts(requests)
    assert reasons(outcome) == {1: None, 2: "title_too_short", 3: "content_too_short"}
    row = outcome.appended["content_drafts"].first()
    assert (row.draft_title, row.draft_content, row.draft_status) == ("abc", "x" * 20, "draft")


def test_profile_updates_change_supplied_fields_only(spark):
    users = table(spark, "user_id string, full_name string, email string, password_hash string, role string", [("u1", "Ann", "a@b.c", "h", "writer"), ("u2", "Bob", "b@b.c", "h", "admin")])
    requests = table(
        spark,
        "request_id long, request_time timestamp_ntz, user_id string, full_name string, email string, password_hash string, role string",
        [(1, T0, "u1", "Anna", None, None, "manager"), (2, T0, "u1", None, "x@y.z", None, "admin"), (3, T0, "u9", "no", None, None, None), (4, T0, "u2", None, None, None, None)],
    )
    outcome = maintenance.update_users(requests, users)
    assert reasons(outcome) == {1: None, 2: None, 3: "not_found", 4: None}
    rows = {r.user_id: tuple(r) for r in outcome.tables["users"].collect()}
    assert rows == {"u1": ("u1", "Anna", "x@y.z", "h", "admin"), "u2": ("u2", "Bob", "b@b.c", "h", "admin")}


@pytest.fixture(scope="module")
def linked(spark):
    """d1 has posts with decisions, a schedule and snapshots; u3 has audit rows and a brand only."""
    return {
        "users": table(spark, "user_id string", [("u1",), ("u2",), ("u3",)]),
        "clients": table(spark, "client_id string, owner_id string", [("c1", "u3"), ("c2", "u1")]),
        "client_members": table(spark, "membership_id string, client_id string, user_id string", [("m1", "c1", "u3"), ("m2", "c1", "u1")]),
        "content_drafts": table(spark, "draft_id string, client_id string, created_by string", [("d1", "c1", "u1"), ("d2", "c1", "u1")]),
        "ai_generations": table(spark, "generation_id string, draft_id string", [("g1", "d1"), ("g2", "d2")]),
        "posts": table(
            spark,
            "post_id string, draft_id string, status string, created_at timestamp_ntz",
            [("p1", "d1", "rejected", T0), ("p2", "d1", "approved", T0), ("p3", "d2", "rejected", NOW)],
        ),
        "approvals": table(spark, "approval_id string, post_id string, manager_id string", [("v1", "p1", "u2"), ("v2", "p1", "u2"), ("v3", "p3", "u2")]),
        "scheduled_posts": table(spark, "schedule_id string, post_id string", [("s2", "p2")]),
        "analytics_logs": table(spark, "analytics_id string, post_id string", [("l1", "p1"), ("l2", "p2"), ("l3", "p3")]),
        "audit_logs": table(spark, "log_id string, user_id string", [("o1", "u3"), ("o2", "u1"), ("o3", None)]),
    }


def left(tables, name):
    return sorted(str(r[0]) for r in tables[name].collect())


def test_draft_delete_cascades(spark, linked):
    requests = table(
        spark,
        "request_id long, request_time timestamp_ntz, user_id string, draft_id string",
        [(1, T0, "u2", "d1"), (2, T0, "u1", "d1"), (3, T0, "u1", "d1"), (4, T0, "u1", "d9")],
    )
    outcome = removals.delete_drafts(requests, linked)
    assert reasons(outcome) == {1: "not_found", 2: None, 3: "not_found", 4: "not_found"}
    assert left(outcome.tables, "content_drafts") == ["d2"]
    assert left(outcome.tables, "ai_generations") == ["g2"]
    assert left(outcome.tables, "posts") == ["p3"]
    assert left(outcome.tables, "approvals") == ["v3"]
    assert left(outcome.tables, "scheduled_posts") == []
    assert left(outcome.tables, "analytics_logs") == ["l3"]
    assert "users" not in outcome.tables and "audit_logs" not in outcome.tables


def test_user_delete_follows_the_reference_rules(spark, linked):
    requests = table(
        spark,
        "request_id long, request_time timestamp_ntz, user_id string",
        [(1, T0, "u1"), (2, T0, "u2"), (3, T0, "u3"), (4, T0, "u3"), (5, T0, "u9")],
    )
    outcome = removals.delete_users(requests, linked)
    assert reasons(outcome) == {1: "restricted", 2: "restricted", 3: None, 4: "not_found", 5: "not_found"}
    assert left(outcome.tables, "users") == ["u1", "u2"]
    assert left(outcome.tables, "client_members") == ["m2"]
    assert {r.log_id: r.user_id for r in outcome.tables["audit_logs"].collect()} == {"o1": None, "o2": "u1", "o3": None}
    assert {r.client_id: r.owner_id for r in outcome.tables["clients"].collect()} == {"c1": None, "c2": "u1"}


def test_purge_and_stale_approval(spark, linked):
    as_of = F.lit(str(T0 + dt.timedelta(days=60, seconds=1))).cast("timestamp_ntz")
    after = removals.purge_rejected(linked, as_of)
    assert left(after, "posts") == ["p2", "p3"]
    assert left(after, "approvals") == ["v3"]
    posts = table(
        spark,
        "post_id string, status string, created_at timestamp_ntz",
        [("p2", "pending_approval", T0), ("p1", "pending_approval", T0), ("p0", "approved", T0), ("p3", "pending_approval", NOW)],
    )
    as_of = F.lit(str(T0 + dt.timedelta(days=7, seconds=1))).cast("timestamp_ntz")
    one = {r.post_id: r.status for r in maintenance.approve_stale(posts, as_of).collect()}
    assert one == {"p0": "approved", "p1": "approved", "p2": "pending_approval", "p3": "pending_approval"}
    many = {r.post_id: r.status for r in maintenance.approve_stale(posts, as_of, limit=5).collect()}
    assert many["p2"] == "approved" and many["p3"] == "pending_approval"


def test_recommendations_one_per_brand_and_week(spark):
    drafts = table(spark, "draft_id string, client_id string, created_by string", [("d1", "c2", "u1"), ("d2", "c1", "u1"), ("d3", "c1", "u2"), ("d4", "c3", "u3")])
    existing = table(spark, "recommendation_id string, client_id string, week_start_date date", [("r", "c3", dt.date(2026, 3, 2)), ("r2", "c1", dt.date(2026, 2, 23))])
    requests = table(spark, "request_id long, request_time timestamp_ntz, user_id string", [(1, NOW, "u1"), (2, T0, "u2"), (3, T0, "u3"), (4, T0, "u4")])
    texts = table(spark, "user_id string, best_platform string, recommendation_text string", [(u, "twitter", f"for {u}") for u in ("u1", "u2", "u3", "u4")])
    outcome = intake.intake_recommendations(requests, drafts, existing, texts, F.lit("2026-03-02").cast("date"))
    assert reasons(outcome) == {1: "duplicate_week", 2: None, 3: "duplicate_week", 4: "no_draft"}
    row = outcome.appended["content_recommendations"].first()
    assert (row.client_id, row.week_end_date, row.recommendation_text) == ("c1", dt.date(2026, 3, 8), "for u2")


def test_generations_and_audit(spark):
    results = table(
        spark,
        "request_id long, position int, draft_id string, platform string, prompt string, repurposed_content string, caption string, hashtags string, success boolean",
        [(1, 0, "d1", "twitter", "p", "text", "c", "#h", True), (1, 1, "d1", "tiktok", "p", "", "", "", False)],
    )
    rows = intake.intake_generations(results, F.lit(str(T0)).cast("timestamp_ntz"))
    assert rows["ai_generations"].count() == rows["posts"].count() == 1
    assert rows["posts"].first().status == "pending_approval"
    requests = table(
        spark,
        "request_id long, request_time timestamp_ntz, user_id string, post_id string, approval_status string, remarks string",
        [(1, T0, "m", "p1", "approved", ""), (2, T0, "m", "p1", "request_edit", ""), (3, T0, "m", "p9", "rejected", "")],
    )
    outcome = reviews.apply_decisions(
        requests,
        table(spark, "user_id string, role string", [("m", "manager")]),
        table(spark, "post_id string, status string", [("p1", "approved")]),
    )
    audit = maintenance.audit_of({"decisions": outcome}).collect()
    assert sorted((r.action, r.entity_name, r.entity_id, r.user_id) for r in audit) == [
        ("APPROVE", "approvals", "p1", "m"),
        ("UPDATE", "approvals", "p1", "m"),
    ]


def test_decisions_can_be_staged_in_the_shared_folder(spark):
    requests = table(
        spark,
        "request_id long, request_time timestamp_ntz, user_id string, post_id string, approval_status string, remarks string",
        [(1, T0, "m", "p1", "approved", "")],
    )
    outcome = reviews.apply_decisions(
        requests,
        table(spark, "user_id string, role string", [("m", "manager")]),
        table(spark, "post_id string, status string", [("p1", "approved")]),
        stage=checkpointed,
    )
    assert "ExistingRDD" in outcome.decided._jdf.queryExecution().analyzed().toString() or outcome.decided.count() == 1
    assert outcome.accepted.count() == 1


def test_status_by_id_last_request_wins(spark):
    drafts = table(spark, "draft_id string, draft_status string", [("d1", "draft"), ("d2", "draft")])
    requests = table(spark, "request_id long, request_time timestamp_ntz, draft_id string, new_status string", [(1, NOW, "d1", "archived"), (2, T0, "d1", "submitted")])
    after = reviews.set_status(drafts, requests, "draft_id", "draft_status")
    assert {r.draft_id: r.draft_status for r in after.collect()} == {"d1": "archived", "d2": "draft"}


def test_every_workflow_has_audit_rows_of_its_own(spark):
    from quillworks.plans.outcome import Outcome
    from quillworks.sources.catalogue import TABLES

    columns = "request_id long, request_time timestamp_ntz, user_id string, post_id string, client_id string, draft_id string, approval_status string"
    accepted = table(spark, columns + ", reason string", [(1, T0, "u", "p", "c", "d", "approved", None)])
    rows = maintenance.audit_of({name: Outcome(accepted) for name in maintenance.AUDITED}).collect()
    assert len(rows) == len({r.log_id for r in rows}) == len(maintenance.AUDITED) == 14
    actions = next(c.domain for c in TABLES["audit_logs"].columns if c.name == "action")
    assert not actions or {r.action for r in rows} <= set(actions)
    deleted = [r for r in rows if r.entity_name == "users" and r.action == "DELETE"]
    created = [r for r in rows if r.entity_name == "users" and r.action == "CREATE"]
    assert deleted[0].user_id is None and created[0].user_id == created[0].entity_id
