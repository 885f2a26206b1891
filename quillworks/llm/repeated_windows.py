"""Windows of fixed length that also occur earlier: the frame of substring and suffix-array dedup.

A text is a sequence of symbols (bytes or words). A window is ``window`` consecutive symbols of one
text; all of them are judged, but only few rows are shuffled:

1. Sampling. Among the grams (``gram`` symbols) of a window, the one with the smallest hash is
   its sample, the last one on ties. Equal windows have equal samples at equal offsets. Consecutive
   windows with one sample form a run, on average some 2 / (window - gram + 2) runs per symbol. A run
   is a row: hash of the sample, hash of all its symbols, document, place.
2. Runs that share a sample meet in one group. A run whose symbols equal those of an earlier
   run is removed as a whole. A group whose runs are all equal is settled by that. So is a
   sample that occurs once: none of its windows occur elsewhere.
3. What remains are runs that share a sample but differ around it: the ends of copies. Their symbols
   are sent to one group per sample and solved window by window, by the method of the operator.
   A sample with more than ``crowd`` of them gets a longer key, the whole window, so no group
   outgrows memory.

Tasks settle what is equal inside their own batch before the shuffle, so a passage that a third of
all texts hold costs one row per batch. Texts move compressed, joined by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillworks.llm.common import order_id

#: Window starts that are sampled at a time.
STEP = 1 << 16
#: Text bytes that a task looks at before it settles what is equal among them.
BATCH_BYTES = 8 << 20
PLACE_BITS = 40
REMOVED, OPEN, CROWDED = 1, 2, 3
_PLACE = np.uint64((1 << 24) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95)


@dataclass(frozen=True)
class Frame:
    """How one operator reads texts and solves groups."""

    window: int
    gram: int
    #: Symbols (64 bits each) of a text.
    symbols: Callable[[bytes], np.ndarray]
    #: Bytes of the symbols from a to b, and the way to cut many such pieces from one text.
    pieces: Callable[[bytes], Callable[[int, int], bytes]]
    #: Which windows of a block of runs also occur earlier in it.
    solve: Callable[[Block], np.ndarray]
    #: Only smaller documents count, not earlier places of the same one.
    other_documents: bool
    crowd: int = 4000
    block_windows: int = 120_000


@dataclass
class Block:
    """Runs of whole groups, sorted by group, document and place."""

    group: np.ndarray
    doc: np.ndarray
    #: Hash of the whole text: parts texts of one document where their places agree.
    text_hash: np.ndarray
    place: np.ndarray
    windows: np.ndarray
    text: list[bytes]
    #: Per window: its run, and its number in the run.
    run: np.ndarray = field(init=False)
    number: np.ndarray = field(init=False)

    def __post_init__(self):
        self.run = np.repeat(np.arange(len(self.windows)), self.windows)
        first = np.cumsum(self.windows) - self.windows
        self.number = np.arange(len(self.run)) - first[self.run]


#: Powers of the bases and of their inverses, as long as any text piece asked for so far.
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    known = _POWERS.get(base)
    if known is None or len(known[0]) < size:
        up = np.cumprod(np.full(size, base, dtype=np.uint64))
        down = np.cumprod(np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64))
        known = _POWERS[base] = (up, down)
    return known


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(symbols: np.ndarray, which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums, and factors that make the hash of [a, b) ``(sums[b] - sums[a]) * factor[a]``."""
    up, down = _powers(_BASES[which], size)
    sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=sums[1:])
    return sums, down


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def sampled_runs(symbols: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first window, last window, offset of the sample, sample hash, run hash) as arrays."""
    size = STEP + window
    for start in range(0, len(symbols) - window + 1, STEP):
        part = symbols[start : start + STEP + window - 1]
        sums, down = prefix_hash(part, 0, size)
        grams = mixed((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        places = np.arange(len(grams), dtype=np.uint64)
        least = _sliding_min((grams & ~_PLACE) | (_PLACE - places), window - gram + 1)
        sample = (_PLACE - (least & _PLACE)).astype(np.int64)
        cut = np.flatnonzero(sample[1:] != sample[:-1]) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(sample)]]) - 1
        at = sample[first]
        sums, down = prefix_hash(part, 1, size)
        whole = (sums[last + window] - sums[first]) * down[first]
        shape = ((at - first) << 32 | (last - first)).astype(np.uint64)
        yield first + start, last + start, at - first, grams[at], mixed(whole ^ mixed(shape))


def later_copies(
    keys: tuple[np.ndarray, ...], doc: np.ndarray, place: np.ndarray, text_hash: np.ndarray, other_documents: bool
):
    """Whether the keys of a row also occur in a row that comes before it, by document, place and text."""
    order = np.lexsort((text_hash, place, doc, *keys))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    later = np.zeros(len(order), dtype=bool)
    later[order] = doc[order] > doc[first]
    if not other_documents:
        beyond = (place[order] > place[first]) | ((place[order] == place[first]) & (text_hash[order] > text_hash[first]))
        later[order] |= (doc[order] == doc[first]) & beyond
    return later


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about BATCH_BYTES of text each."""
    sizes = batch.column(column).cast(pa.binary())
    lengths = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in sizes])
    part = np.cumsum(lengths) // BATCH_BYTES
    begin = 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]:
        if end > begin:
            yield batch.slice(begin, end - begin)
        begin = end


RUNS = "kind int, g long, c long, d long, t long, place long, shape int"
#: A shape is (number of windows - 1) << SHAPE_BITS | offset of the sample; both fit into a byte.
SHAPE_BITS, SHAPE_MASK = 8, 255
KIND_AT = PLACE_BITS + 2 * SHAPE_BITS


def _runs(frame: Frame):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                found = []
                keys = zip(*(part.column(c).to_pylist() for c in ("d", "t", "p")), strict=True)
                texts = part.column("text").cast(pa.binary())
                for (d, t, p), text in zip(keys, texts, strict=True):
                    for first, last, offset, g, c in sampled_runs(
                        frame.symbols(text.as_py() or b""), frame.window, frame.gram
                    ):
                        shape = ((last - first) << SHAPE_BITS | offset).astype(np.int32)
                        found.append((g, c, np.full(len(g), d), np.full(len(g), t), (p << PLACE_BITS) + first, shape))
                if not found:
                    continue
                g, c, d, t, place, shape = (np.concatenate(x) for x in zip(*found, strict=True))
                later = later_copies((g, c), d, place, t, frame.other_documents)
                kind = np.where(later, REMOVED, OPEN).astype(np.int32)
                arrays = (kind, g.view(np.int64), c.view(np.int64), d, t, place, shape)
                names = ["kind", "g", "c", "d", "t", "place", "shape"]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)

    return read


def _judged(runs: DataFrame, frame: Frame) -> DataFrame:
    """Runs that are removed or open after all runs with one sample have met."""
    # What is removed already needs no company.
    key = F.when(F.col("kind") == REMOVED, F.xxhash64("d", "t", "place")).otherwise(F.col("g"))
    rows = runs.withColumn("g", key).repartition("g")
    same = Window.partitionBy("g", "kind", "c").orderBy("d", "place", "t")
    group = Window.partitionBy("g", "kind")
    first = {f"first_{c}": F.first(c).over(same) for c in ("d", "place", "t")}
    later = F.col("d") > F.col("first_d")
    if not frame.other_documents:
        beyond = F.col("place") > F.col("first_place")
        later = later | beyond | ((F.col("place") == F.col("first_place")) & (F.col("t") > F.col("first_t")))
    # In this order the rows are sorted once: the groups are already together.
    met = rows.withColumns(first)
    met = met.withColumns({"least": F.min("c").over(group), "most": F.max("c").over(group)})
    met = met.withColumn("n", F.count("*").over(group)).withColumn("mixed", F.col("least") != F.col("most"))
    kind = (
        F.when((F.col("kind") == REMOVED) | later, REMOVED)
        .when(F.col("mixed"), F.when(F.col("n") > frame.crowd, CROWDED).otherwise(OPEN))
        .otherwise(0)
    )
    return met.withColumn("kind", kind).filter("kind > 0").select("kind", "g", "d", "t", "place", "shape")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part in _slices(batch, "text"):
            texts = [pack.compress(x or b"") for x in part.column("text").cast(pa.binary()).to_pylist()]
            columns = [*(part.column(c) for c in ("doc_id", "d", "t", "p")), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "d", "t", "p", "z"])


PIECES = "kind int, g long, d long, t long, place long, shape int, piece binary"


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "g", "d", "t", "place", "shape", "piece"])


def _open_pieces(frame: Frame):
    """Symbols of open runs; a crowded run becomes its windows, each a group of its own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in _slices(batch, "z"):
                rows, crowded = [], []
                for doc in part.to_pylist():
                    still_open = [m for m in doc["marks"] or () if m["mark"] >> KIND_AT != REMOVED]
                    if not still_open:
                        continue
                    cut = frame.pieces(unpack.decompress(doc["z"]))
                    text = doc["p"] << PLACE_BITS
                    for entry in still_open:
                        mark = entry["mark"]
                        first = mark & ((1 << PLACE_BITS) - 1)
                        shape = mark >> PLACE_BITS & ((1 << 2 * SHAPE_BITS) - 1)
                        last = first + (shape >> SHAPE_BITS)
                        if mark >> KIND_AT == OPEN:
                            piece = cut(first, last + frame.window)
                            rows.append((OPEN, entry["g"], doc["d"], doc["t"], text + first, shape, piece))
                            continue
                        for at in range(first, last + 1):
                            piece = cut(at, at + frame.window)
                            g = xxhash.xxh64_intdigest(piece, 7)
                            crowded.append((g, doc["d"], doc["t"], text + at, piece))
                if crowded:
                    g, d, t, place, pieces = zip(*crowded, strict=True)
                    g, d, t, place = np.array(g, dtype=np.uint64), np.array(d), np.array(t), np.array(place)
                    later = later_copies((g,), d, place, t, frame.other_documents)
                    for i, signed in enumerate(g.view(np.int64).tolist()):
                        kind, piece = (REMOVED, b"") if later[i] else (OPEN, pieces[i])
                        rows.append((kind, signed, d[i], t[i], place[i], 0, piece))
                if rows:
                    yield _row_batch(rows)

    return read


def _block_of(table: pa.Table, begin: int, end: int) -> Block:
    part = table.slice(begin, end - begin)
    g, d, t, place, shape = (part.column(c).to_numpy() for c in ("g", "d", "t", "place", "shape"))
    return Block(g, d, t, place, (shape >> SHAPE_BITS) + 1, part.column("piece").to_pylist())


def _removed_spans(frame: Frame, block: Block) -> pa.RecordBatch:
    """Spans (d, t, place, shape) of consecutive windows that also occur earlier."""
    dup = frame.solve(block)
    edge = np.ones(len(dup), dtype=bool)
    edge[1:] = (block.run[1:] != block.run[:-1]) | (dup[1:] != dup[:-1])
    begin = np.flatnonzero(edge)
    length = np.diff(np.append(begin, len(dup)))
    keep = dup[begin]
    begin, length = begin[keep], length[keep]
    run = block.run[begin]
    place, shape = block.place[run] + block.number[begin], ((length - 1) << SHAPE_BITS).astype(np.int32)
    columns = [block.doc[run], block.text_hash[run], place, shape]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "t", "place", "shape"])


def _solved(frame: Frame):
    """Spans of rows sorted by group, document and place, a bounded block of groups at a time."""

    def blocks(table: pa.Table, whole: bool) -> tuple[list[tuple[int, int]], int]:
        g = table.column("g").to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), *([len(g)] if whole else [])]
        windows = np.cumsum((table.column("shape").to_numpy() >> SHAPE_BITS) + 1)
        found, begin = [], 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - begin > 1 and a > begin and windows[b - 1] - (windows[begin - 1] if begin else 0) > frame.block_windows:
                found.append((begin, a))
                begin = a
        if cuts[-1] > begin:
            found.append((begin, cuts[-1]))
        return found, cuts[-1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            done = batch.filter(pa.array(kinds == REMOVED))
            yield done.select(["d", "t", "place", "shape"])
            table = pa.Table.from_batches([batch.filter(pa.array(kinds != REMOVED))])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            found, end = blocks(table, False)
            for a, b in found:
                yield _removed_spans(frame, _block_of(table, a, b))
            rest = table.slice(end)
        if rest is not None and rest.num_rows:
            for a, b in blocks(rest, True)[0]:
                yield _removed_spans(frame, _block_of(rest, a, b))

    return read


def removed_mask(spans: np.ndarray, window: int, size: int) -> np.ndarray:
    """Which of ``size`` symbols the marks in ``spans`` cover."""
    change = np.zeros(size + 1, dtype=np.int32)
    begin = spans & ((1 << PLACE_BITS) - 1)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + (spans >> (PLACE_BITS + SHAPE_BITS) & SHAPE_MASK) + window, -1)
    return np.cumsum(change[:-1]) > 0


def judged_texts(docs: DataFrame, frame: Frame, finish: Callable[[bytes, Callable], tuple], result: str) -> DataFrame:
    """``finish(text, mask)`` of every row: ``mask(n)`` tells which of its n symbols are removed.

    ``result`` is the schema of what it gives, after doc_id.
    """
    # A text is named by 64 bits of one hash and, in its places, 23 bits of another one.
    text_hash = F.xxhash64(F.lit(1), "text").bitwiseAND(F.lit((1 << 23) - 1))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        order_id("doc_id").alias("d"),
        F.xxhash64("text").alias("t"),
        text_hash.alias("p"),
        "text",
    )
    judged = _judged(rows.select("d", "t", "p", "text").mapInArrow(_runs(frame), RUNS), frame)
    # Kind, shape and place in one number: a removed run costs eight bytes.
    mark = F.expr(
        f"shiftleft(cast(kind as long), {KIND_AT}) | shiftleft(cast(shape as long), {PLACE_BITS})"
        f" | (place & {(1 << PLACE_BITS) - 1}L)"
    )
    # A set: rows that repeat an id with its text have the same marks, and share one list of them.
    entry = F.struct(mark.alias("mark"), F.when(F.col("kind") != REMOVED, F.col("g")).alias("g"))
    of_text = F.shiftright("place", PLACE_BITS).alias("p")
    marks = judged.groupBy("d", "t", of_text).agg(F.collect_set(entry).alias("marks"))
    packed = rows.mapInArrow(_packed, "doc_id long, d long, t long, p long, z binary")
    # Used twice below, with the same columns and no filter on one side: so Spark sees the same
    # plan in both and shuffles texts and marks once.
    marked = packed.join(marks, ["d", "t", "p"], "left")
    pieces = marked.mapInArrow(_open_pieces(frame), PIECES)
    placed = pieces.repartition("g").sortWithinPartitions("g", "d", "place", "t")
    spans = placed.mapInArrow(_solved(frame), "d long, t long, place long, shape int")
    spans = spans.groupBy("d", "t", of_text).agg(
        F.collect_set(
            F.expr(
                f"shiftleft(cast(shape as long), {PLACE_BITS}) | (place & {(1 << PLACE_BITS) - 1}L)"
            )
        ).alias("spans")
    )
    # Already joined by document, so texts do not move again.
    joined = marked.join(spans, ["d", "t", "p"], "left").select("doc_id", "z", "marks", "spans")

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in _slices(batch, "z"):
                out = []
                for row in part.to_pylist():
                    settled = [m["mark"] for m in row["marks"] or () if m["mark"] >> KIND_AT == REMOVED]
                    spans = np.array([*settled, *(row["spans"] or ())], dtype=np.int64)
                    mask = partial(removed_mask, spans, frame.window)
                    out.append(finish(unpack.decompress(row["z"]), mask))
                columns = [part.column("doc_id"), *(pa.array(c) for c in zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", *(field.strip().split(" ")[0] for field in result.split(","))]
    return joined.mapInArrow(final, f"doc_id long, {result}")
