"""Levelled changes: bounded reading, and lost parts that change nothing."""

import random
import shutil

import pytest

from quillworks.streaming.levels import Levels

SCHEMA = "post_id string, newest struct<at: int, request_id: int, status: string>"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def changes_of(number, rng, request):
    return [(f"p{rng.randrange(30)}", (number, request + i, f"s{number}.{i}")) for i in range(rng.randrange(6))]


def newest_of(batches):
    found = {}
    for rows in batches:
        for post, change in rows:
            found[post] = max(found.get(post, change), change)
    return found


def shown(levels):
    return {r.post_id: tuple(r.newest) for r in levels.read().collect()}


@pytest.fixture
def small(spark):
    """A single partition: the tables here are tiny."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fifty_batches_are_read_from_few_folders(spark, small, tmp_path):
    rng, levels, batches = random.Random(1), Levels(spark, str(tmp_path), "post_id", "newest"), []
    with pytest.raises(ValueError, match="no batch"):
        levels.read()
    most = 0
    for number in range(50):
        batches.append(changes_of(number, rng, 10 * number))
        levels.add(batch(spark, batches[-1]))
        most = max(most, len(levels.live()))
        if number % 7 == 0:
            assert shown(levels) == newest_of(batches)
    assert shown(levels) == newest_of(batches)
    # Three levels above the batches: 50 is 302 to the base 4.
    assert len(levels.live()) == 3 + 0 + 2 and most <= 3 * 3
    # Folders are a ring of eight per level, however many batches came.
    folders = [p for p in tmp_path.glob("changes/level=*/slot=*") if any(p.glob("*.parquet"))]
    assert len(folders) <= 8 * 3
    # A reader of everything sees the same, only from more folders.
    assert {r.post_id: tuple(r.newest) for r in levels.newest(spark.read.parquet(f"{tmp_path}/changes")).collect()} == shown(levels)


@pytest.mark.parametrize("fan_out", [2, 3])
def test_lost_marks_and_parts_change_nothing(spark, small, tmp_path, fan_out):
    """After every batch a merge or the batch itself may be lost half-way."""
    rng, levels, batches = random.Random(fan_out), Levels(spark, str(tmp_path), "post_id", "newest", fan_out), []
    lost = 0
    for number in range(20):
        batches.append(changes_of(number, rng, 10 * number))
        levels.add(batch(spark, batches[-1]))
        marked = levels.marked()
        upper = [level for level in marked if level and marked[level]]
        if upper and rng.random() < 0.4:
            # The newest merge of some level loses its mark and its data, as if it had never ended.
            level = rng.choice(upper)
            newest = max(marked[level])
            below = {n for n in range(newest * fan_out, (newest + 1) * fan_out)}
            if below <= marked.get(level - 1, set()):
                slot = f"level={level}/slot={newest % (2 * fan_out)}"
                shutil.rmtree(tmp_path / "marks" / slot)
                shutil.rmtree(tmp_path / "changes" / slot)
                lost += 1
        assert shown(levels) == newest_of(batches)
    assert lost > 2


def test_a_batch_lost_before_its_mark_is_delivered_again(spark, small, tmp_path):
    levels = Levels(spark, str(tmp_path), "post_id", "newest", 2)
    first = [("p1", (1, 1, "approved"))]
    levels.add(batch(spark, first))
    # The part was written, the mark was not.
    levels.newest(batch(spark, [("p1", (9, 9, "half"))])).write.parquet(levels.path(0, 1))
    assert shown(levels) == newest_of([first])
    second = [("p1", (2, 2, "rejected")), ("p2", (2, 3, "approved"))]
    levels.add(batch(spark, second))
    levels.add(batch(spark, second))  # delivered twice
    assert shown(levels) == newest_of([first, second])
    assert levels.marked()[0] == {0, 1, 2}


def test_an_empty_batch_is_a_part(spark, small, tmp_path):
    levels = Levels(spark, str(tmp_path), "post_id", "newest", 2)
    for _ in range(3):
        levels.add(batch(spark, []))
    assert shown(levels) == {} and len(levels.live()) == 2
