"""Brand lists, access and accounts."""

import pytest

from quillworks.operators import brands as b
from quillworks.operators import lists


@pytest.fixture(scope="module")
def tables(spark):
    def table(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return {
        "users": table("user_id string, role string", ("admin", "admin"), ("writer", "writer"), ("other", "manager")),
        "clients": table(
            "client_id string, client_name string, owner_id string, industry string, brand_voice string,"
            " target_audience string, brand_color string, do_not_use string, invite_code string",
            ("c1", "Acme", "admin", "", "calm", None, "", None, "AMC8X2"),
            ("c2", "Bolt", None, "bikes", None, None, "#ffffff", None, None),
        ),
        "members": table(
            "client_id string, user_id string, member_role string",
            ("c1", "admin", "manager"),
            ("c1", "writer", "writer"),
            ("c2", "writer", "manager"),
        ),
        "accounts": table(
            "account_id string, client_id string, platform string, account_name string, connected_status int",
            ("a1", "c1", "twitter", "@acme", 1),
            ("a2", "c1", "tiktok", "@old", 0),
        ),
    }


def pairs(df):
    return sorted((r.user_id, r.client_id, r.access_type) for r in df.collect())


def test_owner_shows_twice_by_default(tables):
    rows = pairs(b.brand_list(tables["users"], tables["clients"], tables["members"]))
    assert rows == [
        ("admin", "c1", "manager"),
        ("admin", "c1", "owner"),
        ("writer", "c1", "writer"),
        ("writer", "c2", "manager"),
    ]


def test_one_row_per_brand(tables):
    rows = pairs(b.brand_list(tables["users"], tables["clients"], tables["members"], one_row_per_brand=True))
    assert ("admin", "c1", "manager") not in rows and len(rows) == 3


def test_access_prefers_owner(tables):
    rows = pairs(b.brand_access(tables["clients"], tables["members"]))
    assert rows == [("admin", "c1", "owner"), ("writer", "c1", "writer"), ("writer", "c2", "manager")]


def test_access_of_requests(spark, tables):
    requests = spark.createDataFrame(
        [(1, "c1", "admin"), (2, "c1", "other"), (3, "c9", "admin"), (4, "c2", "writer")],
        "request_id int, client_id string, user_id string",
    )
    rows = b.access_of_requests(requests, tables["clients"], tables["members"]).collect()
    assert sorted((r.request_id, r.access_type) for r in rows) == [(1, "owner"), (2, "none"), (3, "none"), (4, "manager")]


def test_cards_show_the_code_to_owners_only(tables):
    cards = b.brand_cards(b.brand_list(tables["users"], tables["clients"], tables["members"])).collect()
    owner = next(r for r in cards if r.access_type == "owner")
    assert (owner.avatar, owner.industry_text, owner.color, owner.shown_code) == (
        "A",
        "No industry set",
        "#0a0a0a",
        "AMC8X2",
    )
    assert all(r.shown_code is None for r in cards if r.access_type != "owner")


def test_connection_matrix_treats_disconnected_as_missing(tables):
    rows = {(r.client_id, r.platform): r for r in b.connection_matrix(tables["clients"], tables["accounts"]).collect()}
    assert len(rows) == 12
    assert rows["c1", "twitter"].is_connected and rows["c1", "twitter"].account_name == "@acme"
    assert not rows["c1", "tiktok"].is_connected and rows["c1", "tiktok"].account_name is None


def test_context_has_handles_of_connected_accounts(tables):
    rows = {r.client_id: r for r in b.brand_context(tables["clients"], tables["accounts"]).collect()}
    assert rows["c1"].social_handles == {"twitter": "@acme"}
    assert rows["c2"].social_handles == {}


def test_code_lookup(spark, tables):
    requests = spark.createDataFrame([(1, " amc8x2 "), (2, "NOPE"), (3, "")], "request_id int, invite_code string")
    rows = {r.request_id: r.client_id for r in lists.brands_by_code(requests, tables["clients"]).collect()}
    assert rows == {1: "c1", 2: None, 3: None}


def test_lookup_marks_missing_keys_and_asks_once(spark, tables):
    keys = spark.createDataFrame([("c1",), ("c1",), ("c9",)], "client_id string")
    rows = {r.client_id: r.found for r in lists.lookup(keys, tables["clients"], "client_id").collect()}
    assert rows == {"c1": True, "c9": False}


def test_revealed_remarks(rows):
    from pyspark.sql import functions as F

    df = rows("remarks string, status string", ("a", "rejected"), ("a", "approved"), ("", "rejected"), (None, "request_edit"))
    shown = [r.v for r in df.select(lists.revealed_remarks(F.col("remarks"), F.col("status")).alias("v")).collect()]
    assert shown == ["a", None, None, None]
