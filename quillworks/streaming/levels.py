"""Changes of a stream in levels: what a reader opens does not grow with the number of batches.

A *part* is a folder with one row per key: the newest change of it among the batches it covers. The parts of
level 0 are the batches, numbered as they come; ``fan_out`` neighbours of a level are merged into
one part of the next, so part n of level i covers the batches from n * fan_out^i on. Reading takes at most fan_out - 1
parts of each level, and there are as many levels as the number of batches has digits to the base fan_out.

Parts of a level lie in a ring of ``2 * fan_out`` folders. A part is overwritten only when the part above that
covers it is marked. The *mark* of a part is a row written after it, so a part that was lost half-way does not
count: a lost batch is delivered again and takes the same place, and a lost merge is made up when its parts are needed, while
readers go on with the parts below. A change that is delivered twice is the same change: the newest one counts.
One stream at a time may write to a folder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN_OUT = 4


class Levels:
    """Parts below ``folder`` with the newest ``value`` (a struct that begins with its order) per ``key``."""

    def __init__(self, spark: SparkSession, folder: str, key: str, value: str, fan_out: int = FAN_OUT):
        self.spark, self.folder, self.key, self.value, self.fan_out = spark, folder.rstrip("/"), key, value, fan_out

    def _slot(self, level: int, number: int) -> str:
        return f"level={level}/slot={number % (2 * self.fan_out)}"

    def path(self, level: int, number: int) -> str:
        return f"{self.folder}/changes/{self._slot(level, number)}"

    def marked(self) -> dict[int, set[int]]:
        """Numbers of the finished parts of each level: at most 2 * fan_out rows per level."""
        try:
            marks = self.spark.read.schema("number long, level int").parquet(f"{self.folder}/marks")
            rows = marks.select("level", "number").collect()
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing.getCondition()):
                raise
            rows = []
        found: dict[int, set[int]] = {}
        for row in rows:
            found.setdefault(row["level"], set()).add(row["number"])
        return found

    def newest(self, changes: DataFrame) -> DataFrame:
        return changes.groupBy(self.key).agg(F.max(self.value).alias(self.value))

    def add(self, changes: DataFrame) -> None:
        """The changes of a batch as the next part, and the merges that it completes."""
        marked = self.marked()
        self._write(0, max(marked.get(0, ()), default=-1) + 1, changes, marked)

    def _write(self, level: int, number: int, changes: DataFrame, marked: dict[int, set[int]]) -> None:
        replaced = number - 2 * self.fan_out
        if replaced in marked.get(level, ()):
            self._make_up(level + 1, replaced // self.fan_out, marked)
        self.newest(changes).write.mode("overwrite").parquet(self.path(level, number))
        mark = self.spark.range(number, number + 1).select(F.col("id").alias("number"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/marks/{self._slot(level, number)}")
        marked.setdefault(level, set()).discard(replaced)
        marked[level].add(number)
        if (number + 1) % self.fan_out == 0:
            self._make_up(level + 1, number // self.fan_out, marked)

    def _make_up(self, level: int, number: int, marked: dict[int, set[int]]) -> None:
        """Merge the parts below a part, unless that is done or they have been merged further up."""
        if number in marked.get(level, ()) or any(
            number // self.fan_out ** (above - level) in numbers for above, numbers in marked.items() if above > level
        ):
            return
        below = range(number * self.fan_out, (number + 1) * self.fan_out)
        for part in below:
            if level > 1:
                self._make_up(level - 1, part, marked)
        # Keys of different parts meet in the aggregate of _write.
        changes = self.spark.read.parquet(*(self.path(level - 1, part) for part in below))
        self._write(level, number, changes.select(self.key, self.value), marked)

    def live(self) -> list[str]:
        """Folders that together hold the newest change of every key, oldest batches first."""
        marked = self.marked()
        last = max(marked.get(0, ()), default=-1)
        return list(self._cover(marked, last))

    def _cover(self, marked: dict[int, set[int]], last: int) -> Iterator[str]:
        begin = 0
        while begin <= last:
            fitting = [
                level
                for level, numbers in marked.items()
                if begin % self.fan_out**level == 0 and begin // self.fan_out**level in numbers
            ]
            if not fitting:
                raise ValueError(f"batch {begin} of {self.folder} is in no finished part")
            level = max(fitting)
            yield self.path(level, begin // self.fan_out**level)
            begin += self.fan_out**level

    def read(self) -> DataFrame:
        """The newest change of every key."""
        paths = self.live()
        if not paths:
            raise ValueError(f"no batch has been written to {self.folder}")
        return self.newest(self.spark.read.parquet(*paths).select(self.key, self.value))
