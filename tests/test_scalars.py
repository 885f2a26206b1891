"""Column functions on edge cases."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from quillworks.functions import scalars as sc
from quillworks.functions.measures import mean_rate, shown_rate
from quillworks.functions.fixed_values import WHITESPACE


def value(spark, column, **inputs):
    """Value of an expression over literal columns."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("text", ["", "  a b \n", "　x\xa0", "\x1c y\x85", "plain", " \t "])
def test_strip_equals_python(spark, text):
    assert value(spark, sc.strip(F.col("t")), t=text) == text.strip()


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(c) for c in range(0x3001) if chr(c).isspace()}


def test_defaults_replace_null_and_empty(spark):
    null = F.lit(None).cast("string")
    assert value(spark, sc.or_default(null, "d")) == "d"
    assert value(spark, sc.or_default(F.lit(""), "d")) == "d"
    assert value(spark, sc.or_default(F.lit(" "), "d")) == " "
    assert value(spark, sc.blank_to_null(F.lit("  "))) is None


@pytest.mark.parametrize(
    ("text", "want"), [(None, "..."), ("abcde", "abcde..."), ("x" * 200, "x" * 120 + "..."), ("é" * 130, "é" * 120 + "...")]
)
def test_preview(spark, text, want):
    assert value(spark, sc.preview(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    ("name", "want"), [("@@name", "@name"), (" name ", "@name"), ("@", "@"), ("a@b", "@a@b"), (" @ x", "@ x")]
)
def test_handle(spark, name, want):
    assert value(spark, sc.handle(F.col("n")), n=name) == want


def test_labels(spark):
    assert value(spark, sc.title_case(F.lit("request_edit"))) == "Request_Edit" == "request_edit".title()
    assert value(spark, sc.title_case(F.lit("instagram"))) == "Instagram"
    assert value(spark, sc.first_upper(F.lit("linkedIn"))) == "LinkedIn"
    assert value(spark, sc.initial(F.lit("acme"))) == "A"
    assert value(spark, sc.spaced(F.lit("request_edit"))) == "request edit"
    assert value(spark, sc.counted(F.lit(1), "post")) == "1 post"
    assert value(spark, sc.counted(F.lit(0), "post")) == "0 posts"
    assert value(spark, sc.thousands(F.lit(1234567))) == "1,234,567"


def test_comma_list(spark):
    assert value(spark, sc.comma_list(F.lit("a, b,,c"))) == ["a", "b", "c"]
    assert value(spark, sc.comma_list(F.lit(" , ,"))) == []
    assert value(spark, sc.comma_list(F.lit("x,x"))) == ["x", "x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2026-06-15T14:30", dt.datetime(2026, 6, 15, 14, 30)),
        ("2026-06-15 14:30:05", dt.datetime(2026, 6, 15, 14, 30, 5)),
        ("2026-06-15T14:30:05.123456", dt.datetime(2026, 6, 15, 14, 30, 5, 123456)),
        ("2026-06-15T14", dt.datetime(2026, 6, 15, 14)),
        ("2026-06-15", dt.datetime(2026, 6, 15)),
        ("2026-06", None),
        ("soon", None),
        ("2026-13-01", None),
        ("2026-02-30T10:00", None),
        ("", None),
    ],
)
def test_iso_timestamp_equals_python(spark, text, want):
    assert value(spark, sc.iso_timestamp(F.col("t")), t=text) == want
    if want is not None:
        assert dt.datetime.fromisoformat(text) == want


def test_rate(spark):
    def rate(*counts):
        return value(spark, sc.rate(*[F.lit(n).cast("bigint") for n in counts]))

    assert rate(1, 1, 1, 0) is None
    assert rate(469, 248, 195, 19342) == decimal.Decimal("4.72")
    assert rate(1, 0, 0, 800) == decimal.Decimal("0.13")  # 0.125 rounds away from zero


def test_mean_rate(spark):
    total, none = F.lit("2.01").cast("decimal(15,2)"), F.lit(0).cast("bigint")
    assert value(spark, mean_rate(total, F.lit(2).cast("bigint"))) == decimal.Decimal("1.005000")
    assert value(spark, shown_rate(mean_rate(total, F.lit(2).cast("bigint")))) == 1.01
    assert value(spark, mean_rate(F.lit(None).cast("decimal(15,2)"), none)) == 0


def test_invite_codes(spark):
    assert value(spark, sc.normal_code(F.lit(" amc8x2\n"))) == "AMC8X2"
    assert value(spark, sc.is_invite_code(F.lit("AMC8X2"))) is True
    assert value(spark, sc.is_invite_code(F.lit("AMC8X"))) is False
    assert value(spark, sc.is_invite_code(F.lit("amc8x2"))) is False


def test_collated_keys(spark):
    same = value(spark, sc.collated(F.lit("José@X.org ")) == sc.collated(F.lit("jose@x.ORG")))
    assert same is True


def test_dates(spark):
    at = F.lit("2026-03-04 05:06:07").cast("timestamp_ntz")
    assert value(spark, sc.day_text(at)) == "2026-03-04"
    assert value(spark, sc.minute_text(at)) == "2026-03-04 05:06"
    assert value(spark, sc.form_minute(at)) == "2026-03-04T05:06"
    assert value(spark, sc.week_end(F.lit("2026-12-29").cast("date"))) == dt.date(2027, 1, 4)
    week_old = F.lit("2026-02-25 05:06:07").cast("timestamp_ntz")
    assert value(spark, sc.older_than(week_old, 7, at)) is False
    assert value(spark, sc.older_than(week_old, 6, at)) is True


def test_stable_id_is_a_uuid_and_repeats(spark):
    first = value(spark, sc.stable_id(F.lit("post"), F.lit("1")))
    again = value(spark, sc.stable_id(F.lit("post"), F.lit("1")))
    other = value(spark, sc.stable_id(F.lit("post"), F.lit("2")))
    assert first == again != other
    assert [len(p) for p in first.split("-")] == [8, 4, 4, 4, 12]


ISO_FORMS = [
    "2024-05-06", "20240506", "2024-05-06T07", "2024-05-06 07:08", "2024-05-06x07:08:09", "20240506T0708", "20240506T070809.5",
    "2024-05-06T07:08:09.1", "2024-05-06T07:08:09,123456789", "2024-W19-1T07:08", "2024W191T0708", "2024-W19", "2020-W53-7T01",
    "2021-W53-1T01", "2024-13-01", "2024-02-30", "2024-05-06T25", "2024-05-06T07:8", "2024-05", "soon", "", "2024-05-06T",
    "2024-05-06T07:08:60", "202405-06", "2024-0506", "2024-W00-1T01",
]


@pytest.mark.parametrize("text", ISO_FORMS)
def test_iso_forms_equal_python(spark, text):
    try:
        want = dt.datetime.fromisoformat(text)
    except ValueError:
        want = None
    assert value(spark, sc.iso_timestamp(F.col("t")), t=text) == want
