"""Workflows in the order of time against a replay one by one, with keys that lie in several tasks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillworks.operators.timeline import with_last_before
from quillworks.plans import maintenance, replay
from quillworks.plans.outcome import written
from quillworks.registry.all_checks import QUERIES

T0 = dt.datetime(2026, 3, 1)
NOW = dt.datetime(2026, 3, 2)
EVENTS = (
    "request_id long, request_time timestamp_ntz, kind string, user_id string, post_id string, new_status string,"
    " scheduled_time string, remarks string"
)
STATUSES = ["pending_approval", "approved", "rejected", "request_edit", "scheduled", "published"]


@pytest.fixture
def many_chunks(spark):
    """Small partitions stay apart, so that a key with many rows lies in several."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def replayed(events, users, posts, taken):
    """(reasons, previous statuses, statuses after, accepted schedules), request by request."""
    status, taken = dict(posts), set(taken)
    reasons, met, slots = {}, {}, {}
    for r in sorted(events, key=lambda e: (e["request_time"], e["request_id"])):
        post, kind, new = r["post_id"], r["kind"], r["new_status"]
        known = post in status
        met[r["request_id"]] = status.get(post)
        slot = dt.datetime.fromisoformat(r["scheduled_time"]) if r["scheduled_time"] not in (None, "soon") else None
        if kind not in ("decide", "schedule", "set_status"):
            reason = "unknown_kind"
        elif kind == "decide" and users.get(r["user_id"]) not in ("manager", "admin"):
            reason = "forbidden"
        elif kind == "decide" and new not in ("approved", "rejected", "request_edit"):
            reason = "invalid_status"
        elif kind == "set_status" and new not in STATUSES:
            reason = "invalid_status"
        elif not known:
            reason = "not_found"
        elif kind != "schedule":
            reason = None
        elif status[post] != "approved":
            reason = "wrong_status"
        elif post in taken:
            reason = "already_scheduled"
        elif slot is None:
            reason = "invalid_date"
        else:
            reason = "not_future" if slot <= NOW else None
        reasons[r["request_id"]] = reason
        if reason is None and kind == "schedule":
            status[post] = "scheduled"
            taken.add(post)
            slots[post] = (r["request_id"], slot)
        elif reason is None:
            status[post] = new
    return reasons, met, status, slots


@pytest.mark.parametrize("seed", range(4))
def test_posts_decided_scheduled_and_decided_again(spark, many_chunks, seed):
    rng = random.Random(seed)
    users = {"w": "writer", "m": "manager", "a": "admin"}
    posts = {f"p{i}": rng.choice([*STATUSES, None]) for i in range(25)}
    taken = [p for p in posts if rng.random() < 0.2]
    names = [f.split()[0] for f in EVENTS.split(", ")]
    events = [
        {
            "request_id": i,
            "request_time": T0 + dt.timedelta(minutes=rng.randrange(120)),
            "kind": rng.choice(["decide", "decide", "schedule", "schedule", "set_status", "lost" if i % 40 == 0 else "decide"]),
            "user_id": rng.choice(["w", "m", "a", "a", "ghost", None]),
            # A third of all for one post.
            "post_id": rng.choice(["p0", "p0", rng.choice([*posts, "p99", None]), rng.choice([*posts])]),
            "new_status": rng.choice(["approved", "approved", "rejected", "pending_approval", "maybe", None]),
            "scheduled_time": rng.choice([None, "soon", "2026-03-01T10:00", "2026-03-09T10:00", "2026-03-10T10:00"]),
            "remarks": rng.choice([None, "", " fine "]),
        }
        for i in rng.sample(range(900), 900)
    ]
    outcome = replay.replay(
        spark.createDataFrame([[e[n] for n in names] for e in events], EVENTS),
        spark.createDataFrame([*users.items()], "user_id string, role string"),
        spark.createDataFrame([*posts.items()], "post_id string, status string"),
        spark.createDataFrame([(p, p) for p in taken], "schedule_id string, post_id string"),
        F.lit(NOW),
    )
    reasons, met, status, slots = replayed(events, users, posts, taken)
    decided = outcome.decided.collect()
    assert {r.request_id: r.reason for r in decided} == reasons and len(decided) == len(events)
    assert {r.request_id: r.previous_status for r in decided} == met
    late = {i for i, reason in reasons.items() if reason is None and met[i] in ("scheduled", "published")}
    assert {r.request_id for r in decided if r.flagged and r.kind == "decide"} == {
        e["request_id"] for e in events if e["request_id"] in late and e["kind"] == "decide"
    }
    assert {r.post_id: r.status for r in outcome.tables["posts"].collect()} == status
    rows = outcome.appended["scheduled_posts"].collect()
    assert {r.post_id: r.scheduled_time for r in rows} == {p: slot for p, (_, slot) in slots.items()}
    assert outcome.appended["approvals"].count() == sum(
        reasons[e["request_id"]] is None and e["kind"] == "decide" for e in events
    )
    assert slots and any(status[p] != "scheduled" for p in slots)


def test_replay_of_nothing(spark):
    outcome = replay.replay(
        spark.createDataFrame([], EVENTS),
        spark.createDataFrame([], "user_id string, role string"),
        spark.createDataFrame([("p", "approved")], "post_id string, status string"),
        spark.createDataFrame([], "schedule_id string, post_id string"),
        F.lit(NOW),
    )
    assert outcome.decided.count() == 0
    assert [tuple(r) for r in outcome.tables["posts"].collect()] == [("p", "approved")]


@pytest.mark.parametrize("descending", [False, True])
def test_last_value_before_a_row(spark, many_chunks, descending):
    rng = random.Random(9)
    data = [
        (i, rng.choice([1, 1, 1, rng.randrange(40), None]), rng.randrange(50), rng.choice([None, None, f"v{i}"])) for i in range(2000)
    ]
    rows = spark.createDataFrame(data, "id long, k long, t long, v string")
    order = [F.desc("t"), F.desc("id")] if descending else ["t", "id"]
    got = with_last_before(rows, ["k"], order, F.col("v"), "found", written).collect()
    want, last = {}, {}
    for i, k, _, v in sorted(data, key=lambda r: (r[2], r[0]), reverse=descending):
        want[i] = None if k is None else last.get(k)
        last[k] = v or last.get(k)
    assert {r.id: r.found for r in got} == want
    assert len(got) == len(data)


PEOPLE = "user_id string, full_name string, email string, role string"
REQUESTS = f"request_id long, request_time timestamp_ntz, {PEOPLE}"


def profiles(requests, users):
    """(reasons, users after) one by one."""
    state, reasons = {u[0]: list(u) for u in users}, {}
    for i, t, user, name, email, role in sorted(requests, key=lambda r: (r[1], r[0])):
        holder = next((u for u, row in state.items() if email and (row[2] or "").lower() == email.lower()), user)
        if user not in state:
            reasons[i] = "not_found"
        elif role not in (None, "writer", "manager", "admin", "client"):
            reasons[i] = "invalid_role"
        else:
            reasons[i] = "email_taken" if holder != user else None
        if reasons[i] is None:
            state[user] = [user, *(new if new is not None else old for new, old in zip((name, email, role), state[user][1:], strict=True))]
    return reasons, {u: tuple(row) for u, row in state.items()}


@pytest.mark.parametrize("seed", range(3))
def test_addresses_given_up_and_taken(spark, many_chunks, seed):
    rng = random.Random(seed)
    users = [(f"u{i}", f"n{i}", f"a{i}@x" if i else None, "writer") for i in range(12)]
    requests = [
        (
            i,
            T0 + dt.timedelta(minutes=rng.randrange(30)),
            rng.choice([f"u{rng.randrange(12)}", "ghost" if i % 9 == 0 else "u1"]),
            rng.choice([None, f"name {i}"]),
            rng.choice([None, f"A{rng.randrange(14)}@x", f"a{rng.randrange(14)}@X", "a3@x"]),
            rng.choice([None, None, "manager", "guest"]),
        )
        for i in range(120)
    ]
    outcome = maintenance.update_users_in_order(
        spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(users, PEOPLE)
    )
    reasons, after = profiles(requests, users)
    assert {r.request_id: r.reason for r in outcome.decided.collect()} == reasons
    assert {r.user_id: tuple(r) for r in outcome.tables["users"].collect()} == after


def rounds_of(spark, requests, users):
    stages = []

    def counted(df):
        stages.append(1)
        return written(df)

    outcome = maintenance.update_users_in_order(
        spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(users, PEOPLE), counted
    )
    reasons, _ = profiles(requests, users)
    assert {r.request_id: r.reason for r in outcome.decided.collect()} == reasons
    # Two writes before and after the rounds, one to see that nothing changed, two per round.
    return (len(stages) - 3) // 2, reasons


def claim(i, user, email):
    return i, T0, user, None, email, None


def test_rounds_follow_the_longest_chain_not_the_number_of_requests(spark):
    users = [(f"u{i}", None, f"a{i}@x", "writer") for i in range(40)]
    # Everybody moves on to a new place, then into the next one's.
    ring = [claim(i, f"u{i}", f"b{i}@x") for i in range(40)] + [claim(100 + i, f"u{i}", f"a{(i + 1) % 40}@x") for i in range(40)]
    rounds, reasons = rounds_of(spark, ring, users)
    assert rounds <= 3 and not any(reasons.values())
    # One address, asked for by everybody many times.
    hot = [claim(i, f"u{i % 40}", "one@x") for i in range(400)]
    rounds, reasons = rounds_of(spark, hot, users)
    assert rounds <= 3 and sum(r is None for r in reasons.values()) == 10
    # A chain of six, each into the place that the one before has just left; a swap of two cannot be.
    chain = [claim(0, "u0", "free@x")] + [claim(i, f"u{i}", f"a{i - 1}@x") for i in range(1, 6)]
    swap = [claim(50, "u20", "a21@x"), claim(51, "u21", "a20@x")]
    rounds, reasons = rounds_of(spark, chain + swap, users)
    assert rounds <= 2 * 6 + 2 and reasons[50] == reasons[51] == "email_taken"
    assert all(reasons[i] is None for i in range(6))
    # One address through the hands of five users.
    hands = []
    for i in range(5):
        hands += [claim(10 * i, f"u{i}", "one@x"), claim(10 * i + 1, f"u{i + 1}", "one@x"), claim(10 * i + 2, f"u{i}", f"c{i}@x")]
    rounds, reasons = rounds_of(spark, hands, users)
    assert rounds <= 2 * 5 + 2


def scans(df, source):
    """File scans of a source in the plan that ran; a reused exchange is read once."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return sum("FileScan" in line and f"{source}.parquet" in line for line in final.splitlines())


@pytest.mark.parametrize(
    "name",
    [
        "m1_decision_outcomes",
        "m1_posts_after_decisions",
        "m2_schedule_outcomes",
        "m10_tables_after_draft_deletes",
        "m11_audit_after_user_deletes",
        "m13_tables_after_purge",
    ],
)
def test_sources_are_read_twice_at_most(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    for source in ("events", "orders", "customer", "lineitem"):
        assert scans(df, source) <= 2, source


def test_timeline_windows_run_inside_chunks(spark):
    """No window of a replay or of a hand-over round is over a whole post or address of requests."""
    rows = spark.createDataFrame([(1, 1, "v")], "id long, k long, v string")
    df = with_last_before(rows, ["k"], ["id"], F.col("v"), "found", lambda placed: placed)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "[k#" in plan and ", _chunk#" in plan
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert all("_chunk" in line for line in windows)
