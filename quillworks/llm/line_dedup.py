"""Line deduplication with levelled sorted runs of line hashes.

The key hashes of all lines are written once. Documents are taken in batches of falling doc_id. A batch reduces its lines to one
row per line key, merge-anti-joins the runs written so far to find the keys that
are new, and adds its own sorted run: a new key brings the largest document that
holds it, a known one only adds to the count of documents. When a level holds
``fan_out`` runs they are merged into one run of the next level, so that a batch
never meets more than a few runs per level.

A line's key is the line without blanks at both ends, with A-Z in lower case. Keys of
at least ``min_chars`` code points that occur in at least ``min_docs`` documents
lose all their lines except those of the largest document holding the key.

Defined cases: a null or empty text is one empty line; a null doc_id ranks below all
others and rows without one count as one document, as do rows that share a doc_id
(each row is judged and returned by itself); an empty table gives an empty result;
other columns of the input are carried in ``row`` and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillworks.llm.common import BLANKS, NO_ID, hash_pair, order_id, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped line with A-Z in lower case; other letters stay."""
    stripped = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, UPPER, LOWER))


def key_hashes(text: Column, min_chars: int) -> Column:
    """Per line: a struct of two hashes, null for keys that are too short to count."""

    def hashes(line: Column) -> Column:
        key = line_key(line)
        h1, h2 = hash_pair(key)
        pair = F.struct(h1.alias("h1"), h2.alias("h2"))
        return F.when(F.char_length(key) >= min_chars, pair)

    return F.transform(lines_of(text), hashes)


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row per line that counts: document, hash of its text, number of the line, key. Written once for all uses."""
    keys = F.posexplode(key_hashes(F.col("text"), min_chars)).alias("at", "k")
    return staged(
        docs.select(order_id("doc_id").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), keys)
        .filter(F.col("k").isNotNull())
        .select("d", "t", "at", "k.h1", "k.h2"),
        "line-hashes",
    )


def _batch(lines: DataFrame, low: int, high: int) -> DataFrame:
    """One row per line key of the batch: number of its documents and the largest of them."""
    own = lines.filter((F.col("d") >= low) & (F.col("d") <= high))
    return own.groupBy("h1", "h2").agg(F.count_distinct("d").alias("docs"), F.max("d").alias("newest"))


def _merged(runs: list[DataFrame]) -> DataFrame:
    rows = runs[0]
    for other in runs[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("newest").alias("newest"))


def _written(run: DataFrame, purpose: str) -> DataFrame:
    """A run: sorted by key, on disk."""
    return staged(run.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2"), purpose)


def _bounds(lines: DataFrame, batches: int) -> list[tuple[int, int]]:
    """Ranges of doc_id that cover all documents, about as many lines each, the largest ids first."""
    shares = [i / batches for i in range(1, batches)]
    cuts = lines.agg(F.percentile_approx("d", shares)).first()[0] if shares else None
    starts = [NO_ID, *sorted({cut + 1 for cut in cuts or [] if NO_ID < cut < 2**63 - 1})]
    ends = [*(s - 1 for s in starts[1:]), 2**63 - 1]
    return list(zip(starts, ends, strict=True))[::-1]


def line_runs(lines: DataFrame, batches: int, fan_out: int) -> DataFrame:
    """All line keys with the number of documents and the largest document that hold them."""
    levels: list[list[DataFrame]] = [[]]
    for low, high in _bounds(lines, batches):
        batch = _batch(lines, low, high)
        known = [run for level in levels for run in level]
        if known:
            batch = staged(batch, "line-batch")
            new = batch
            for run in known:
                new = new.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
            seen = batch.join(new.select("h1", "h2"), ["h1", "h2"], "left_anti")
            # A key that a newer run holds has its largest document there.
            batch = new.unionByName(seen.withColumn("newest", F.lit(None).cast("long")))
        levels[0].append(_written(batch, "line-run-0"))
        for k in range(len(levels)):
            if len(levels[k]) >= fan_out:
                if k + 1 == len(levels):
                    levels.append([])
                levels[k + 1].append(_written(_merged(levels[k]), f"line-run-{k + 1}"))
                levels[k] = []
    return _merged([run for level in levels for run in level])


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fan_out: int = 2
) -> DataFrame:
    """Rows of ``docs`` as ``row``, with ``n_lines`` before dropping, ``n_dropped`` and the text ``kept``."""
    hashed = hashed_lines(docs, min_chars)
    frequent = staged(
        line_runs(hashed, batches, fan_out).filter(F.col("docs") >= min_docs).drop("docs"),
        "line-frequent",
    )
    text = F.coalesce(F.col("row.text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).withColumns(
        {"d": order_id("row.doc_id"), "t": F.xxhash64(text)}
    )
    # Rows that share doc_id and text share their lines: one of them is enough.
    found = (
        hashed.join(frequent, ["h1", "h2"])
        .filter(F.col("d") != F.col("newest"))
        .groupBy("d", "t")
        .agg(F.array_sort(F.collect_set("at")).alias("dropped"))
    )
    lines = lines_of(F.col("row.text"))
    joined = rows.join(found, ["d", "t"], "left").withColumn("lines", lines)
    # What lies between two dropped lines stays; cut slice by slice, in one pass.
    none = F.array().cast("array<int>")
    ends = F.concat(F.coalesce(F.col("dropped"), none), F.array(F.size("lines")))
    kept = F.when(F.col("dropped").isNull(), text).otherwise(
        F.array_join(
            F.flatten(
                F.transform(
                    F.arrays_zip(
                        F.concat(F.array(F.lit(-1)), F.col("dropped")).alias("a"), ends.alias("b")
                    ),
                    lambda x: F.slice(F.col("lines"), x["a"] + 2, x["b"] - x["a"] - 1),
                )
            ),
            "\n",
        )
    )
    return joined.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    return drop_repeated_lines(docs.select("doc_id", "text")).select(
        "row.doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def clean(docs: DataFrame, **parameters) -> DataFrame:
    """Rows of ``docs``, all columns, with what is left of the text (and its n_chars, if there).

    A null text stays null; a document that loses all lines stays with an empty text.
    """
    kept = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    columns = {"text": kept, "n_chars": F.char_length(kept).cast("long")}
    return drop_repeated_lines(docs, **parameters).select(
        *[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )
