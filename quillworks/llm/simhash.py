"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has a bit set where more than half of the shingle hashes have it. Two
fingerprints link at ``max_bits`` or fewer differing bits. The 64 bits form a ring of
max_bits + 1 segments. If two fingerprints link, some segment starts a chain in which,
for every length l, the first l segments differ in at most l * max_bits / segments bits
(rounded down): nothing in the first segment, one bit in the first two, and so on. With
three bits: 0, 1, 2 and 3 bits in chains of one to four segments.

The index holds the first two conditions in one key: the start segment in full and three of
the four nibbles of the next one (one differing bit leaves three of them equal). Pairs
that share a key go through the longer chains and then the full Hamming check.

No key's members meet as one unbounded group: a key with more than ``block_rows`` members is cut
into blocks by hash, and pairs of blocks are compared in separate groups. A group gives
a spanning forest of its links, not all of them, so output stays linear; components
need no more. Equal fingerprints are one node.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other;
fewer words than a shingle form one shingle of all words; a null doc_id ranks below
all others, rows that share one are nodes of one fingerprint each; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillworks.llm.common import NO_ID, order_id, staged
from quillworks.llm.components import components

SEED = 42
SEGMENTS, WIDTH, BITS = 4, 16, 3
_UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of one UTF-8 text as an unsigned number."""
    words = (text or b"").translate(_UPPER_TO_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    last = max(len(words) - shingle, 0)
    first = starts[: last + 1].tolist()
    stop = ends[min(shingle, len(words)) - 1 :].tolist()
    count = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), 65536):
        hashes = np.array(
            [digest(line[a:b], SEED) for a, b in zip(first[at : at + 65536], stop[at : at + 65536], strict=False)],
            dtype=">u8",
        )
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = (count * 2 > len(first)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text hash and fingerprint (as a signed long) of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                found = [fingerprint(text, shingle) for text in texts]
                f = np.array(found, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("t"), pa.array(f)], names=["doc_id", "t", "f"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(compute, "doc_id long, t long, f long")


def index_keys() -> list[tuple[int, int, int]]:
    """(start segment, left-out nibble, mask of the bits in the key)."""
    keys = []
    for start in range(SEGMENTS):
        following = (start + 1) % SEGMENTS
        for nibble in range(4):
            mask = (0xFFFF << (WIDTH * start)) | ((0xFFFF & ~(0xF << (4 * nibble))) << (WIDTH * following))
            keys.append((start, nibble, mask))
    return keys


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def chain_holds(x: np.ndarray, start: int) -> np.ndarray:
    """Whether each chain that starts at this segment keeps its budget; x: xor of the pairs."""
    holds = np.ones(x.shape, dtype=bool)
    total = np.zeros(x.shape, dtype=np.int64)
    for length in range(1, SEGMENTS + 1):
        segment = (start + length - 1) % SEGMENTS
        total += np.bitwise_count((x >> np.uint64(WIDTH * segment)) & np.uint64(0xFFFF))
        holds &= total <= length * BITS // SEGMENTS
    return holds


def spanning_links(left: np.ndarray, right: np.ndarray | None, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``left``, or between ``left`` and ``right``."""
    values = left if right is None else np.concatenate([left, right])
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    offset = 0 if right is None else len(left)
    others = left if right is None else right
    for i, value in enumerate(left):
        from_ = i + 1 if right is None else 0
        x = others[from_:] ^ value
        ok = chain_holds(x, start)
        ok &= np.bitwise_count(x) <= BITS
        for j in np.nonzero(ok)[0]:
            j = int(j) + from_ + offset
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                links.append((int(values[i]), int(values[j])))
    return links


GROUP = ["g", "id", "key"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by group and side; a group may go on in the next batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        cuts = _cuts(table)
        last = cuts[-2]
        yield _links_of(table.slice(0, last), cuts[:-1])
        rest = table.slice(last)
    if rest is not None:
        yield _links_of(rest, _cuts(rest))


def _cuts(table: pa.Table) -> list[int]:
    """Where groups begin, and the end."""
    new = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for name in GROUP:
        values = table.column(name).to_numpy()
        new |= values[1:] != values[:-1]
    return [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]


def _links_of(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
    found: list[tuple[int, int]] = []
    f, side, start = (table.column(c).to_numpy() for c in ("f", "side", "start"))
    f = f.view(np.uint64)
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a < 2:
            continue
        middle = a + int(np.searchsorted(side[a:b], 1))
        if middle in (a, b):
            found += spanning_links(f[a:b], None, int(start[a]))
        else:
            found += spanning_links(f[a:middle], f[middle:b], int(start[a]))
    pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    columns = [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def links(nodes: DataFrame, block_rows: int = 2048) -> DataFrame:
    """Links (a, b) that span the components of the fingerprints in ``nodes`` (distinct f)."""
    keys = index_keys()
    indexed = F.array(
        *[
            F.struct(
                F.lit(n).cast("int").alias("id"),
                F.lit(start).cast("int").alias("start"),
                F.col("f").bitwiseAND(F.lit(_signed(mask))).alias("key"),
            )
            for n, (start, _, mask) in enumerate(keys)
        ]
    )
    rows = nodes.select("f", F.explode(indexed).alias("k")).select("f", "k.id", "k.start", "k.key")
    counts = rows.groupBy("id", "key").agg(F.count("*").alias("n")).filter("n > 1")
    counts = staged(
        counts.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")).drop("n"), "simhash-keys"
    )
    own = F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")
    grouped = (
        rows.join(counts, ["id", "key"])
        .withColumn("own", own)
        # The row meets every block of its key: once per pair of blocks.
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64("id", "key", F.least("own", "other"), F.greatest("own", "other")).alias("g"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "id",
            "key",
            "start",
            "f",
        )
    )
    placed = grouped.repartition("g").sortWithinPartitions(*GROUP, "side")
    return placed.mapInArrow(_compare, "a long, b long").distinct()


def _components(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """doc_id, t (hash of the text), f, root (fingerprint) and component (smallest order id) of every row.

    The root names a component. The smallest order id does not: rows of several components may share it.
    """
    if max_bits != BITS:
        raise ValueError(f"the index is laid out for {BITS} bits")
    rows = staged(fingerprints(docs, shingle), "simhash-rows")
    nodes = staged(rows.groupBy("f").agg(F.min(order_id("doc_id")).alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("f")))
    rooted = nodes.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn(
        "root", F.coalesce("root", "f")
    )
    rooted = staged(rooted, "simhash-rooted")
    least = staged(rooted.groupBy("root").agg(F.min("first").alias("component")), "simhash-least")
    named = staged(rooted.join(least, "root").select("f", "root", "component"), "simhash-named")
    return rows.join(named, "f")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs``; null stands for a null doc_id."""
    return _components(docs, shingle, max_bits).select(
        "doc_id",
        F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"),
    )


def clean(docs: DataFrame, shingle: int = 3, max_bits: int = BITS) -> DataFrame:
    """One row of each group of near-duplicates, all columns: the smallest doc_id, of repeated rows any."""
    found = _components(docs.select("doc_id", "text"), shingle, max_bits)
    place = F.struct(order_id("doc_id").alias("d"), F.col("t"))
    chosen = staged(found.groupBy("root").agg(F.min(place).alias("p")).select("p.d", "p.t"), "simhash-chosen")
    rows = docs.select(F.struct("*").alias("row")).withColumns(
        {"d": order_id("row.doc_id"), "t": F.xxhash64("row.text")}
    )
    # Repeated rows are alike in (d, t). One text has one fingerprint, so (d, t) stands in one component.
    alike = Window.partitionBy("d", "t").orderBy("d")
    once = rows.join(chosen, ["d", "t"], "left_semi").withColumn("n", F.row_number().over(alike))
    return once.filter("n = 1").select("row.*")
