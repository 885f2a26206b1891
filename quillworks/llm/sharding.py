"""Sharding by minimax contiguous partition of ordered atomic groups.

Documents with equal texts form one group that is never split. Groups are ordered by
their total size, largest first, then by text hash. The smallest feasible shard
capacity is found by binary search; whether a capacity is feasible is checked
greedily, and the groups are cut where the greedy walk for the smallest one cuts.

The walk needs only how many groups there are of each total size: inside a run of
equal sizes the next cut is a division. This histogram is all that reaches the
driver. It has at most sqrt(2 x total bytes) entries, since distinct sizes add up
to no more than the total. A leading group that alone exceeds the mean of what is left
takes a shard of its own, and the rest is partitioned anew over the other shards;
one huge group of copies then does not set the capacity of all shards.

Defined cases: a null text has no bytes and counts as an empty one; repeated rows are
copies; a null doc_id ranks first inside its group; an empty table gives an empty
result; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillworks.llm.common import hash_pair, order_id, staged, with_row_number

ROW_BYTES = 16


def greedy_cuts(sizes: list[tuple[int, int]], capacity: int) -> list[int]:
    """Cut points, as numbers of groups, of the greedy walk; sizes are (size, groups) in order."""
    cuts, used, done = [], 0, 0
    for size, groups in sizes:
        while groups:
            fit = min(groups, (capacity - used) // size)
            if fit == 0:
                cuts.append(done)
                used = 0
                continue
            used += fit * size
            done += fit
            groups -= fit
    return cuts


def minimax_cuts(sizes: list[tuple[int, int]], shards: int) -> list[int]:
    """Cut points of the contiguous partition whose largest shard is smallest; sizes fall."""
    sizes = [list(s) for s in sizes]
    cuts, done = [], 0
    rest = sum(size * groups for size, groups in sizes)
    while shards > 1 and sizes and sizes[0][0] * shards >= rest:
        # Larger than the mean of what is left: a shard of its own.
        done += 1
        rest -= sizes[0][0]
        cuts.append(done)
        shards -= 1
        sizes[0][1] -= 1
        if not sizes[0][1]:
            sizes.pop(0)
    if not sizes:
        return cuts
    low, high = max(sizes[0][0], -(-rest // shards)), rest
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(sizes, middle)) < shards:
            high = middle
        else:
            low = middle + 1
    return cuts + [done + cut for cut in greedy_cuts(sizes, low)]


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    text = F.coalesce("text", F.lit(""))
    h1, h2 = hash_pair(text)
    rows = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            h1.alias("h1"),
            h2.alias("h2"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "shard-rows",
    )
    groups = rows.groupBy("h1", "h2", "size").agg(F.count("*").alias("copies"))
    groups = groups.withColumn("total", F.col("size") * F.col("copies"))
    order = [F.desc("total"), F.col("h1"), F.col("h2"), F.col("size")]
    numbered = with_row_number(groups, order, "number", "shard-groups")
    histogram = numbered.groupBy("total").agg(F.count("*").alias("groups")).collect()
    sizes = sorted(((r["total"], r["groups"]) for r in histogram), reverse=True)
    cuts = F.array(*[F.lit(c).cast("long") for c in minimax_cuts(sizes, shards)]).cast("array<long>")
    shard = F.size(F.filter(cuts, lambda cut: cut <= F.col("number"))).cast("int")
    placed = staged(numbered.select("h1", "h2", "size", "number", shard.alias("shard")), "shard-placed")
    joined = rows.join(placed, ["h1", "h2", "size"])
    by_place = [F.col("number"), order_id("doc_id"), F.col("row")]
    ordered = with_row_number(joined, by_place, "row_number", "shard-slots")
    first = ordered.groupBy("shard").agg(F.min("row_number").alias("first"))  # a row per shard
    return ordered.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row_number") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
