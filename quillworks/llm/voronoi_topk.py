"""Exact top-k by inner product as a Voronoi kNN join.

Vectors are grouped by their nearest pivot. A summary of each group (rows, and the
radius around its pivot) bounds every score without looking at the rows: for a query q
and a group with pivot p and radius r, q.p - |q| r <= q.x <= q.p + |q| r. Adding up groups by
their lower bounds until k candidates are sure gives a threshold (the rows that bear the
query's own vec_id are counted beforehand and come on top of k); a query is sent only to groups whose upper bound reaches it. Groups are cut into blocks of
``block_rows`` rows, so that a group with most of the rows is many tasks; queries of a group come in runs of about
``run_rows``. Each (block, run) pair is solved by itself and the best k are merged.

Scores are integers: components become floor(1024 x). Bounds are rounded outwards, so that
no candidate is lost; ties go to the smaller vec_id.

Defined cases: vectors that are null or hold null or non-finite components take no part;
neither do rows without a vec_id. Only vectors of equal length are compared. Repeated
vec_ids are candidates each by itself, but never for a query with the same vec_id; of
query rows with one vec_id the smallest vector is asked. Scores are exact while every floor(1024 x) fits into
31 bits. Empty tables give an empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillworks.llm.common import staged

SCALE = 1024
PAIR = "query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame) -> DataFrame:
    """vec_id, v (array of long) and dim of the vectors that take part."""
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall(
            F.col("embedding"),
            lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
        )
    )
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return df.filter(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"), F.size("embedding").alias("dim")
    )


def pivots_of(vectors: DataFrame, n_pivots: int) -> dict[int, np.ndarray]:
    """At most ``n_pivots`` vectors per length, by a hash of their content; they only steer the pruning."""
    h = F.xxhash64("v")
    order = Window.partitionBy("dim").orderBy("h", "v")
    rows = (
        vectors.select("dim", "v", h.alias("h"))
        .groupBy("dim", "h")
        .agg(F.min("v").alias("v"))
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= n_pivots)
        .collect()  # n_pivots rows per vector length
    )
    by_dim: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["n"])):
        by_dim.setdefault(r["dim"], []).append(r["v"])
    return {dim: np.array(v, dtype=np.float64).reshape(len(v), dim) for dim, v in by_dim.items()}


def _stack(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def _assign(pivots: dict[int, np.ndarray]):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x, p = _stack(part["v"]), pivots[dim]
                d2 = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T
                near = d2.argmin(1)
                distance = np.sqrt(((x - p[near]) ** 2).sum(1))
                yield part.assign(pivot=near.astype(np.int32), distance=distance)[
                    ["vec_id", "v", "dim", "pivot", "distance"]
                ]

    return assign


def _targets(pivots: dict[int, np.ndarray], groups: dict[int, list[tuple[int, int, float]]], k: int):
    """For each query the groups whose upper bound reaches what k candidates are sure to reach."""

    def targets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                ids = np.array([g[0] for g in groups[dim]])
                rows = np.array([g[1] for g in groups[dim]])
                radius = np.array([g[2] for g in groups[dim]])
                q = _stack(part["v"])
                middle = q @ pivots[dim][ids].T
                slack = np.sqrt((q * q).sum(1))[:, None] * radius[None, :] * (1 + 1e-9) + 1e-6 * (
                    1 + np.abs(middle)
                )
                low, high = middle - slack, middle + slack
                order = np.argsort(-low, axis=1)
                sure = np.cumsum(rows[order], axis=1)
                # So many rows more than k: those with the query's vec_id are no candidates.
                need = k + part["own_rows"].to_numpy()[:, None]
                at = (sure >= need).argmax(1)
                enough = sure[:, -1] >= need[:, 0]
                bound = np.where(
                    enough, np.take_along_axis(low, order, 1)[np.arange(len(q)), at], -np.inf
                )
                row, column = np.nonzero(high >= bound[:, None])
                yield pd.DataFrame(
                    {
                        "query_id": part["vec_id"].to_numpy()[row],
                        "q": part["v"].to_numpy()[row],
                        "dim": np.int32(dim),
                        "pivot": ids[column].astype(np.int32),
                    }
                )

    return targets


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, without the query's own rows."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        floor = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= floor]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _solve(k: int):
    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(data):
            q, x = _stack(queries["q"]), _stack(data["v"])
            ids = data["vec_id"].to_numpy()
            exact = max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * q.shape[1] < 2**53
            if not exact:  # floats no longer hold every sum
                q, x = q.astype(np.int64), x.astype(np.int64)
            for start in range(0, len(q), 256):
                scores = (q[start : start + 256] @ x.T).astype(np.int64)
                for own, row in zip(queries["query_id"][start : start + 256], scores, strict=True):
                    at = _best(row, ids, own, k)
                    found.append((np.full(len(at), own), ids[at], row[at]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True))).astype("int64")

    return solve


def top_k(
    queries: DataFrame,
    data: DataFrame,
    k: int = 10,
    n_pivots: int = 32,
    block_rows: int = 4096,
    run_rows: int = 4096,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows of ``data`` for each row of ``queries``."""
    vectors = integer_vectors(data)
    pivots = pivots_of(vectors, n_pivots)
    schema = "vec_id long, v array<long>, dim int, pivot int, distance double"
    assigned = vectors.mapInPandas(_assign(pivots), schema)
    grouped = staged(assigned.withColumn("row", F.monotonically_increasing_id()), "topk-grouped")
    summary = (
        grouped.groupBy("dim", "pivot")
        .agg(F.count("*").alias("rows"), F.max("distance").alias("radius"))
        .collect()  # a row per pivot
    )
    groups: dict[int, list] = {}
    for r in sorted(summary):
        groups.setdefault(r["dim"], []).append((r["pivot"], r["rows"], r["radius"]))
    asked = integer_vectors(queries).filter(F.col("dim").isin(list(groups)))
    asked = asked.groupBy("dim", "vec_id").agg(F.min("v").alias("v"))
    same_id = grouped.groupBy("dim", "vec_id").agg(F.count("*").alias("own_rows"))
    asked = asked.join(same_id, ["dim", "vec_id"], "left").fillna(0, ["own_rows"])
    sent = staged(
        asked.mapInPandas(
            _targets(pivots, groups, k), "query_id long, q array<long>, dim int, pivot int"
        ),
        "topk-targets",
    )
    asking = {(r["dim"], r["pivot"]): r["count"] for r in sent.groupBy("dim", "pivot").count().collect()}
    sizes = [
        (r["dim"], r["pivot"], -(-r["rows"] // block_rows), -(-asking[r["dim"], r["pivot"]] // run_rows))
        for r in summary
        if (r["dim"], r["pivot"]) in asking
    ]
    # A row per pivot.
    cut = F.broadcast(
        grouped.sparkSession.createDataFrame(sizes, "dim int, pivot int, blocks int, runs int")
    )
    key = ["dim", "pivot", "block", "run"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked_runs = (
        sent.join(cut, ["dim", "pivot"])
        .withColumn("run", F.pmod(F.xxhash64("query_id"), F.col("runs")).cast("int"))
        .withColumn("block", every("blocks"))
        .select(*key, "query_id", "q")
    )
    data_blocks = (
        grouped.join(cut, ["dim", "pivot"])
        .withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        .withColumn("run", every("runs"))
        .select(*key, "vec_id", "v")
    )
    local = (
        asked_runs.groupBy(*key).cogroup(data_blocks.groupBy(*key)).applyInPandas(_solve(k), PAIR)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        local.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
