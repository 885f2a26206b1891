"""Benchmark decontamination with spaced seeds.

Words are runs of letters, digits and bytes above ASCII, with A-Z in lower case. A mask picks
five words out of a span and ignores the others, so a substitution at an ignored place does
not hide a match. Of items under ``SPAN`` words a substitution can leave no five words in such a pattern, so masks
of four words are hashed as well, if the benchmark has such items: with similarity 0.8 every pattern of
substitutions leaves some mask intact. All masks are hashed at every place of the benchmark items; documents
are hashed the same way and a place whose hash may be in the benchmark is a hit. Around
hits, a region of words is kept. Hits join the benchmark's hashes, which gives an item
and an alignment; there, every stretch of ``stretch`` words (the whole item, if it is
shorter) is compared word by word. A document is contaminated if a stretch agrees in at least
``min_similarity`` of its words.

"May be in the benchmark" is a bit table of fixed size (``BITS`` bits), the only thing
sent to all tasks; the exact join follows. Should the benchmark grow, more places pass the
table and the join does more of the work, with the same result.

Defined cases: null and empty texts have no words and never match; items of under five words cannot
be judged and match nothing; repeated items are reported each by itself, repeated documents once per row
of distinct (doc_id, text); null identifiers are kept as null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillworks.llm.common import staged

#: Places of the five words that count; the first is always 0.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 3, 5, 6), (0, 2, 3, 6, 7))
SPAN = 8
#: Masks that items under SPAN words need as well.
SHORT_MASKS = ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4))
LEAST_WORDS = 5
BITS = 1 << 24
#: A longer region is cut, with an overlap that no stretch exceeds.
REGION = 2048
_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)
)


def word_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").translate(_WORD).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def is_short(words: np.ndarray) -> bool:
    """Whether an item needs SHORT_MASKS."""
    return LEAST_WORDS <= len(words) < SPAN


def seeds(words: np.ndarray, short: bool = False) -> list[np.ndarray]:
    """Hash of each mask at each place where it fits; ``short``: of SHORT_MASKS too."""
    found = []
    for number, mask in enumerate(MASKS + SHORT_MASKS if short else MASKS):
        places = max(len(words) - mask[-1], 0)
        h = np.full(places, number + 1, dtype=np.uint64)
        for offset in mask:
            h = _mixed(h + words[offset : offset + places])
        found.append(h)
    return found


def _spots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in the table."""
    return (h & np.uint64(BITS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(BITS - 1)).astype(np.int64)


def _items(bench: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            found = [seeds(w, is_short(w)) for w in words]
            columns = [
                batch.column("item_id"),
                batch.column("item"),
                pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())),
                pa.array([np.concatenate(s).view(np.int64) for s in found], pa.list_(pa.int64())),
                pa.array([np.concatenate([np.arange(len(x)) for x in s]) for s in found], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "item", "words", "h", "at"])

    rows = bench.select(
        F.col("item_id").cast("long").alias("item_id"), F.monotonically_increasing_id().alias("item"), "text"
    )
    schema = "item_id long, item long, words array<long>, h array<long>, at array<int>"
    return staged(rows.mapInArrow(read, schema), "decon-items")


def _bit_table(hashes: DataFrame) -> np.ndarray:
    """Bits of all hashes; at most BITS / 32 rows reach the driver."""

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _spots(batch.column("h").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([a, b])))], names=["spot"])

    word = F.floor(F.col("spot") / 32).cast("int")
    bit = F.expr("shiftleft(1L, int(spot % 32))")
    words = hashes.mapInArrow(spots, "spot long").groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    table = np.zeros(BITS // 32, dtype=np.uint32)
    found = words.toArrow()
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return table


def _passes(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places whose hash may be in the benchmark."""
    first, _ = _spots(h)
    at = np.flatnonzero((table[first >> 5] >> (first & 31).astype(np.uint32)) & np.uint32(1))
    _, second = _spots(h[at])
    return at[((table[second >> 5] >> (second & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)]


def _regions(table: np.ndarray, reach: int, short: bool):
    """Words around the hits of a document: (first word, words, hits and their hashes)."""

    def cut(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        found = [(at := _passes(h, table), h[at]) for h in seeds(words, short)]
        at = np.concatenate([a for a, _ in found])
        if not len(at):
            return
        order = np.argsort(at, kind="stable")
        at, h = at[order], np.concatenate([h for _, h in found])[order]
        begin = 0
        while begin < len(at):
            gaps = np.flatnonzero(np.diff(at[begin:]) > 2 * reach)
            end = begin + int(gaps[0]) + 1 if len(gaps) else len(at)
            end = min(end, begin + int(np.searchsorted(at[begin:end], at[begin] + REGION)))
            low, high = max(int(at[begin]) - reach, 0), int(at[end - 1]) + reach + SPAN
            yield low, words[low:high], at[begin:end] - low, h[begin:end]
            begin = end

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [
                    (i, *region)
                    for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist())
                    for region in cut(word_hashes(text))
                ]
                if not rows:
                    continue
                i, low, words, at, h = zip(*rows, strict=True)
                i = pa.array(i, pa.int64())
                columns = [
                    part.column("doc_id").take(i),
                    part.column("t").take(i),
                    pa.array(low, pa.int64()),
                    pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())),
                    pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
                    pa.array([x.view(np.int64) for x in h], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "low", "doc_words", "at", "h"])

    return read


def best_stretch(
    item: np.ndarray, words: np.ndarray, shift: int, stretch: int
) -> tuple[int, int, int] | None:
    """(equal words, words compared, first word in the region) of the best stretch on one alignment.

    ``shift`` is the place of the item's first word in the region, which may be negative.
    """
    size = min(stretch, len(item))
    begin, end = max(0, -shift), min(len(item), len(words) - shift)
    if end - begin < size:
        return None
    equal = np.concatenate([[0], np.cumsum(item[begin:end] == words[begin + shift : end + shift])])
    sums = equal[size:] - equal[:-size]
    best = int(sums.argmax())
    return int(sums[best]), size, begin + shift + best


def _verify(stretch: int, min_similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                item, words = (np.array(row[c], dtype=np.int64) for c in ("words", "doc_words"))
                found = [best_stretch(item, words, shift, stretch) for shift in row["shifts"]]
                found = [x for x in found if x is not None]
                if found:
                    equal, size, at = max(found, key=lambda x: (x[0], -x[2]))
                    if equal >= min_similarity * size:
                        out.append((row["doc_id"], row["t"], row["item_id"], row["item"], row["low"] + at, size, equal))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "item_id", "item", "at", "words", "equal"])

    return verify


def contaminated(
    docs: DataFrame, bench: DataFrame, stretch: int = 16, min_similarity: float = 0.8
) -> DataFrame:
    """Best agreement of each document with each item that it contains.

    doc_id, t (hash of the text), item_id, at (first word in the document), n_words
    compared, n_equal and similarity; only pairs that reach ``min_similarity``.
    """
    items = _items(bench)
    exploded = items.select("item", F.explode(F.arrays_zip("h", "at")).alias("s"))
    index = staged(exploded.select("item", F.col("s.h").alias("h"), F.col("s.at").alias("item_at")), "decon-seeds")
    table = _bit_table(index.select("h"))
    size = F.size("words")
    short = bool(items.filter((size >= LEAST_WORDS) & (size < SPAN)).select("item").head(1))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text"
    )
    regions = rows.mapInArrow(
        _regions(table, stretch + SPAN, short),
        "doc_id long, t long, low long, doc_words array<long>, at array<int>, h array<long>",
    )
    regions = staged(regions.withColumn("region", F.monotonically_increasing_id()), "decon-regions")
    aligned = (
        regions.select("region", F.explode(F.arrays_zip("h", "at")).alias("s"))
        .select("region", F.col("s.h").alias("h"), F.col("s.at").alias("doc_at"))
        .join(index, "h")
        .groupBy("region", "item")
        .agg(F.collect_set((F.col("doc_at") - F.col("item_at")).cast("int")).alias("shifts"))
    )
    aligned = staged(aligned, "decon-aligned")
    pairs = aligned.join(regions.select("region", "doc_id", "t", "low", "doc_words"), "region").join(
        items.select("item", "item_id", "words"), "item"
    )
    schema = "doc_id long, t long, item_id long, item long, at long, words long, equal long"
    found = pairs.mapInArrow(_verify(stretch, min_similarity), schema)
    best = F.max_by(F.struct("at", "words", "equal"), F.struct("equal", -F.col("at"))).alias("b")
    return (
        found.groupBy("doc_id", "t", "item", "item_id")
        .agg(best)
        .select(
            "doc_id",
            "t",
            "item_id",
            "b.at",
            F.col("b.words").alias("n_words"),
            F.col("b.equal").alias("n_equal"),
            (F.col("b.equal") / F.col("b.words")).alias("similarity"),
        )
    )


def clean(docs: DataFrame, bench: DataFrame, **parameters) -> DataFrame:
    """Rows of ``docs`` without contaminated ones, all columns kept."""
    found = staged(contaminated(docs.select("doc_id", "text"), bench, **parameters), "decon-found")
    found = found.select("doc_id", "t").distinct()
    rows = docs.select(F.struct("*").alias("row")).withColumn("t", F.xxhash64("row.text"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(found["doc_id"]) & (rows["t"] == found["t"])
    return rows.join(found, same, "left_anti").select("row.*")
