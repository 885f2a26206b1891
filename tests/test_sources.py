"""Readers, schema evolution, sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillworks.sources import sinks, tables
from quillworks.sources.catalogue import BRAND_COLUMNS, SEED_TABLES, TABLES

HEADERS = {
    "users": "user_id,full_name,email,password_hash,role,created_at",
    "social_accounts": "account_id,client_id,platform,account_name,connected_status,buffer_profile_id,connected_at",
    "analytics_logs": "analytics_id,post_id,views,likes,comments,shares,engagement_rate,recorded_at",
    "content_recommendations": "recommendation_id,client_id,week_start_date,week_end_date,best_platform,recommendation_text,created_at",
    "scheduled_posts": "schedule_id,post_id,buffer_update_id,scheduled_time,schedule_status,created_at",
}
LINES = {
    "users": 'user-one,"Hill, Ann",ann@hill.example,secret,writer,2030-01-02 03:04:05',
    "social_accounts": "account-one,brand-one,tiktok,@hill,1,,2030-02-03 04:05:06",
    "analytics_logs": "log-one,post-one,1000,100,20,3,12.3,2030-03-04 05:06:07",
    "content_recommendations": 'advice-one,brand-one,2030-04-01,2030-04-07,facebook,"Say ""hi"", then post.",2030-03-31 08:09:10',
    "scheduled_posts": "slot-one,post-one,,2030-05-06 07:08:09,sent,2030-05-05 06:07:08",
}


@pytest.fixture
def seed(spark, tmp_path):
    def read(table, ending="\r\n", line=None):
        path = tmp_path / f"{table}.csv"
        path.write_text(HEADERS[table] + ending + (line or LINES[table]) + ending, newline="")
        return tables.read_seed(spark, str(path), table).collect()

    return read


def test_quoted_comma_and_quotes(seed):
    assert seed("users")[0].full_name == "Hill, Ann"
    assert seed("content_recommendations")[0].recommendation_text == 'Say "hi", then post.'


def test_empty_field_is_null(seed):
    assert seed("social_accounts")[0].buffer_profile_id is None
    assert seed("scheduled_posts")[0].buffer_update_id is None


def test_types(seed):
    row = seed("analytics_logs", ending="\n")[0]
    assert str(row.engagement_rate) == "12.30" and row.views == 1000
    assert row.recorded_at == dt.datetime(2030, 3, 4, 5, 6, 7)
    assert seed("content_recommendations")[0].week_end_date == dt.date(2030, 4, 7)
    assert seed("scheduled_posts")[0].scheduled_time == dt.datetime(2030, 5, 6, 7, 8, 9)


def test_bad_row_fails(seed):
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|CAST|PARSE"):
        seed("analytics_logs", line="log-one,post-one,many,1,1,1,1.0,2030-03-04 05:06:07")


def test_twelve_tables():
    assert len(TABLES) == 12 and len(SEED_TABLES["clients"].columns) == 5
    assert len(TABLES["clients"].columns) == 5 + len(BRAND_COLUMNS) == 12


def test_evolution_adds_defaults(spark):
    old = spark.createDataFrame([("c1", "Acme", "UTC", 1, dt.datetime(2026, 1, 1))], SEED_TABLES["clients"].schema)
    new = tables.evolve(old, TABLES["clients"])
    assert new.columns == TABLES["clients"].schema.names
    row = new.first()
    assert row.brand_color == "#0a0a0a" and row.owner_id is None
    both = tables.merge_generations(old, new.withColumn("brand_color", F.lit("#ffffff")), TABLES["clients"])
    assert sorted(r.brand_color for r in both.collect()) == ["#0a0a0a", "#ffffff"]


def test_schema_report(spark):
    frames = {name: spark.createDataFrame([], t.schema) for name, t in TABLES.items()}
    report = tables.schema_report(frames)
    assert report.count() == sum(len(t.columns) for t in TABLES.values())
    row = report.filter("table_name = 'analytics_logs' AND column_name = 'engagement_rate'").first()
    assert (row.position, row.data_type, row.nullable) == (7, "decimal(5,2)", False)


def test_append_fills_defaults(spark, tmp_path):
    path = str(tmp_path / "posts")
    rows = spark.createDataFrame([("d1", "twitter", "text"), ("d2", "tiktok", "more")], "draft_id string, platform string, repurposed_content string")
    for _ in range(2):  # a retry of the first batch replaces it
        sinks.append_rows(rows, "posts", path, batch=1)
    sinks.append_rows(rows.withColumn("status", F.lit("approved")), "posts", path, batch=2)
    back = sinks.read_appended(spark, "posts", path)
    assert back.columns == TABLES["posts"].schema.names
    got = back.collect()
    assert len({r.post_id for r in got}) == 4 and all(len(r.post_id) == 36 for r in got)
    assert sorted(r.status for r in got) == ["approved", "approved", "pending_approval", "pending_approval"]
    assert all(r.caption is None and r.created_at is not None for r in got)


def test_required_column_must_be_supplied(spark):
    rows = spark.createDataFrame([("d1",)], "draft_id string")
    with pytest.raises(ValueError, match="platform"):
        sinks.with_defaults(rows, "posts")


def test_written_version_replaces_itself(spark, tmp_path):
    df = spark.range(3)
    first = sinks.write_version(df, str(tmp_path), 1)
    assert sinks.write_version(df, str(tmp_path), 1) == first
    assert spark.read.parquet(first).count() == 3


def test_newest_version_is_read(spark, tmp_path):
    for version, rows in ((9, 2), (10, 5)):
        sinks.write_version(spark.range(rows), str(tmp_path), version)
    spark.range(9).write.parquet(f"{tmp_path}/version=11")  # never finished: no mark
    latest = sinks.read_latest_version(spark, str(tmp_path))
    assert latest.columns == ["id"] and latest.count() == 5


def test_read_table_adds_columns_missing_in_old_files(spark, tmp_path):
    old = spark.createDataFrame([("c1", "Acme", "UTC", 1, dt.datetime(2026, 1, 1))], SEED_TABLES["clients"].schema)
    old.write.parquet(str(tmp_path / "clients"))
    assert tables.read_table(spark, str(tmp_path), "clients").first().invite_code is None


def test_jdbc_reader_needs_bounds_to_split(spark):
    with pytest.raises(ValueError, match="bounds"):
        tables.read_jdbc(spark, "jdbc:mysql://host/db", "posts", partition_column="id")
