"""Physical plans: no pair joins, no Python, filters and columns pushed to the scans."""

import pytest

from quillworks.registry.all_checks import QUERIES

FOLDER = "/root/testdata/sf0.001"
STREAMED_OR_WRITTEN = ("t1_", "t2_", "t3_", "s1_", "s6_")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(STREAMED_OR_WRITTEN)))
def test_plan_has_no_pair_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert unwanted not in text


def test_status_filter_reaches_the_scan(spark):
    text = plan(QUERIES["p13_posts_with_status"](spark, FOLDER))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    # The bound status is a case over o_orderstatus, which the scan tests row by row.
    assert "o_orderstatus" in scan.split("DataFilters: [")[1].split("], Format")[0]
    assert "o_totalprice" not in text


def test_engagement_reads_only_needed_columns(spark):
    text = plan(QUERIES["a2_engagement_by_platform"](spark, FOLDER))
    assert "struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_discount:double>" in text
    assert "struct<c_custkey:bigint,c_nationkey:int>" in text


def test_a_failed_answer_filter_does_not_repeat_the_parsing(spark):
    from quillworks.operators.content import parse_answers

    answers = spark.createDataFrame([(1, "{}")], "request_id int, answer string")
    good = parse_answers(answers).filter("success")
    assert good._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 2


def test_tables_are_written_and_filtered_on_real_columns(spark, tmp_path):
    from quillworks.operators.lists import posts_with_status

    path = str(tmp_path / "posts")
    posts = spark.createDataFrame([(1, "published"), (2, "approved")], "post_id long, status string")
    posts.write.parquet(path)
    text = plan(posts_with_status(spark.read.parquet(path), "published"))
    assert "EqualTo(status,published)" in text


def test_top_posts_cut_groups_before_the_shuffle(spark):
    text = plan(QUERIES["w1_top_posts"](spark, FOLDER))
    assert text.count("WindowGroupLimit") == 4
    assert "Partial" in text


def test_snapshots_are_summed_before_the_join(spark):
    text = plan(QUERIES["a9_platform_mean_engagement"](spark, FOLDER))
    assert text.index("Join") < text.index("partial_sum(UnscaledValue(engagement_rate")


def test_weekly_snapshots_are_summed_in_one_shuffle(spark):
    """One for the sums per brand, week and platform, one for the best of them; the joins have their own."""
    text = plan(QUERIES["a16_weekly_best_platform"](spark, FOLDER))
    keys = [line.split("hashpartitioning(")[1] for line in text.splitlines() if "Exchange hashpartitioning(" in line]
    assert not any("week" in k and ("post_id" in k or "draft_id" in k) for k in keys)
    assert sum("week" in k for k in keys) == 2


def test_repeated_days_are_neither_shuffled_nor_sorted(spark):
    text = plan(QUERIES["a16_sliding_best_platform"](spark, FOLDER))
    after = text.split("Generate explode")[0]
    assert after != text and not any(step in after for step in ("Exchange", "Sort", "Aggregate", "Window"))
