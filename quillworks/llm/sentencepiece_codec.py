"""SentencePiece encoding and decoding with a given piece table.

Text is cut into units that no piece crosses: blanks become U+2581, a unit is a run of those with the
characters that follow, and a line feed is a unit by itself if no piece holds one.

The lattice is relational: Spark counts the units of all texts, explodes the substrings of each frequent
unit up to the longest piece, joins them to the piece table by equality, groups the edges by
unit (units are still partitioned as they were, so nothing moves) and folds each lattice with the
higher-order function ``aggregate``. For a unigram model the fold is Viterbi: per end position the
best score so far. A BPE model ranks its pieces by the order of merges, and the path of the best
sum is not what SentencePiece returns for it; the fold then applies merges over the same edges,
best rank first and left before right. Both give the ids of the reference library.

The result is a dictionary of the ``dictionary_units`` most frequent units, with at most
``unit_chars`` characters each; this bounds its size, and it is sent to all tasks. Units outside it are
folded where they stand, by the same rules; the README has the figures of shuffling every unit instead.

Defined cases: null and empty texts have no pieces; characters without a piece become the pieces of their
UTF-8 bytes; U+2581 in a text decodes to a blank; repeated rows are encoded each by itself; an empty
table gives an empty result; other columns of the input are carried in ``row`` and cannot clash.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.llm.common import staged

SPACE = "▁"
ROWS = 128
#: Units folded on the spot that a task remembers before it starts anew.
REMEMBERED = 80_000
REMEMBERED_IDS = 1 << 22
#: Units of the texts that a task encodes together.
TOGETHER = 1 << 14
#: Distinct units that a task counts before it hands them on.
COUNTED = 100_000
#: Longer units are merged with a heap, shorter ones many at a time.
SHORT = 64
#: Tasks that fold the dictionary.
FOLD_TASKS = 48
#: Edges are keyed by begin * EDGE + end.
EDGE = 1024


@dataclass(frozen=True)
class Pieces:
    """Piece table: texts with id and score, ids of byte pieces, and the kind of model."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: dict[int, int]
    unknown: int
    kind: str

    @property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    @property
    def pattern(self) -> str:
        if any("\n" in piece for piece in self.ids):
            return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        return f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"


def load(model: str, kind: str = "bpe") -> Pieces:
    """Pieces of a model file; ``kind`` is bpe or unigram."""
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    every = range(processor.get_piece_size())
    special = {i for i in every if processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i)}
    texts = {i: processor.id_to_piece(i) for i in every}
    normal = [i for i in every if i not in special and not processor.is_unused(i)]
    return Pieces(
        ids={texts[i]: i for i in normal},
        scores={texts[i]: processor.get_score(i) for i in normal},
        byte_ids={int(texts[i][1:-1], 16): i for i in every if processor.is_byte(i)},
        unknown=processor.unk_id(),
        kind=kind,
    )


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """piece, id and score; as many rows as the vocabulary has pieces."""
    rows = [(text, number, pieces.scores[text]) for text, number in pieces.ids.items()]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Units of a text, cut by the pattern or, with the same result, by blanks alone where there are single ones only."""
    find = re.compile(pattern).findall
    lines = pattern.endswith("\n")

    def units(text: str) -> list[str]:
        if not text:
            return []
        if not lines or "  " in text or SPACE in text or text[0] == " ":
            return find((SPACE + text).replace(" ", SPACE))
        parts = (SPACE + text).replace(" ", " " + SPACE).replace("\n", " \n ").split(" ")
        return list(filter(None, parts))

    return units


# The lattice in Spark.


def lattice(units: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """Edges of each distinct ``unit``: arrays of (begin * EDGE + end, score and id)."""
    n = F.length("unit")

    def from_begin(begin: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(longest), n - begin))
        return F.transform(
            sizes,
            lambda size: F.struct(
                (begin * EDGE + begin + size).alias("edge"), F.substr("unit", begin + 1, size).alias("piece")
            ),
        )

    parts = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), from_begin))
    edges = units.select("unit", F.explode(parts).alias("p")).select("unit", "p.edge", "p.piece")
    found = edges.join(F.broadcast(table), "piece")  # bounded by the vocabulary
    value = F.struct(F.col("score"), F.col("id"))
    return found.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("edge", value))).alias("edges"))


def _at(edges: Column, begin: Column, end: Column) -> Column:
    return F.try_element_at(edges, begin * EDGE + end)


def merge_fold(unit: Column, edges: Column) -> Column:
    """Ends of the pieces after all merges: 0, ..., length."""
    n = F.length(unit)

    def merged(ends: Column, _: Column) -> Column:
        inner = F.sequence(F.lit(1), F.size(ends) - 2)
        costs = F.transform(
            inner,
            lambda i: F.struct(
                (-_at(edges, F.get(ends, i - 1), F.get(ends, i + 1))["score"]).alias("cost"), i.alias("i")
            ),
        )
        best = F.array_min(F.filter(costs, lambda c: c["cost"].isNotNull()))

        def without(cut: Column) -> Column:
            return F.concat(F.slice(ends, F.lit(1), cut["i"]), F.slice(ends, cut["i"] + 2, F.size(ends)))

        # As the one element of a list, the best merge is computed once.
        merged_once = F.transform(F.array(best), lambda cut: F.when(cut.isNull(), ends).otherwise(without(cut)))
        return F.when(F.size(ends) > 2, merged_once[0]).otherwise(ends)

    return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), merged)


def viterbi_fold(unit: Column, edges: Column) -> Column:
    """Ends of the pieces on the best path; null if no path of pieces spans the unit."""
    n = F.length(unit)
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("back")))

    def step(best: Column, end: Column) -> Column:
        arrivals = F.transform(
            F.sequence(F.lit(0), end - 1),
            lambda begin: F.struct(
                (F.get(best, begin)["score"] + _at(edges, begin, end)["score"]).alias("score"),
                begin.alias("back"),
            ),
        )
        reached = F.filter(arrivals, lambda a: a["score"].isNotNull())
        none = F.struct(F.lit(None).cast("double").alias("score"), F.lit(-1).alias("back"))
        return F.concat(best, F.array(F.coalesce(F.array_max(reached), none)))

    best = F.aggregate(F.sequence(F.lit(1), n), start, step)

    def back(ends: Column, _: Column) -> Column:
        head = F.get(ends, F.lit(0))
        return F.when(head > 0, F.concat(F.array(F.get(best, head)["back"]), ends)).otherwise(ends)

    path = F.aggregate(F.sequence(F.lit(1), n), F.array(n), back)
    return F.when(F.get(best, n)["score"].isNotNull(), path)


def folded(edges: DataFrame, kind: str) -> DataFrame:
    """unit and ids of the units whose path consists of pieces."""
    fold = merge_fold if kind == "bpe" else viterbi_fold
    ends = edges.select("unit", "edges", fold(F.col("unit"), F.col("edges")).alias("ends"))
    found = F.transform(
        F.sequence(F.lit(1), F.size("ends") - 1),
        lambda i: _at(F.col("edges"), F.get("ends", i - 1), F.get("ends", i))["id"],
    )
    ids = ends.filter(F.col("ends").isNotNull()).select("unit", found.alias("ids"))
    return ids.filter(F.forall("ids", lambda x: x.isNotNull()))


def dictionary(
    docs: DataFrame, pieces: Pieces, dictionary_units: int, unit_chars: int, min_count: int = 2
) -> dict[str, tuple[int, ...]]:
    """Ids of the most frequent units; at most ``dictionary_units`` rows.

    The least count that still fits is read off a histogram of eighths of powers of two, so
    the units are never ordered in one task. Units below ``min_count`` are left out.
    """
    pattern = pieces.pattern

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units_of = splitter(pattern)

        def counted(counts: Counter) -> pa.RecordBatch:
            kept = [(u, n) for u, n in counts.items() if len(u) <= unit_chars]
            columns = [pa.array([u for u, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["unit", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(units_of(text.as_py() or ""))
                if len(counts) > COUNTED:
                    yield counted(counts)
                    counts = Counter()
        yield counted(counts)

    counted = docs.select("text").mapInArrow(count, "unit string, n long")
    counted = counted.groupBy("unit").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    counted = staged(counted.withColumn("grade", F.floor(8 * F.log2("n")).cast("int")), "codec-units")
    grades = {r["grade"]: r["count"] for r in counted.groupBy("grade").count().collect()}  # some 500 rows
    least, fitting = max(grades, default=0) + 1, 0
    for grade in sorted(grades, reverse=True):
        fitting += grades[grade]
        if fitting > dictionary_units:
            break
        least = grade
    # A fixed number of partitions: the units are few bytes but much work.
    frequent = counted.filter(F.col("grade") >= least).select("unit").repartition(FOLD_TASKS, "unit")
    table = piece_table(docs.sparkSession, pieces)
    found = folded(lattice(frequent, table, pieces.longest), pieces.kind).toArrow()
    return dict(zip(found.column("unit").to_pylist(), map(tuple, found.column("ids").to_pylist()), strict=True))


# The same folds where a unit stands.


def merged_ends(unit: str, scores: dict[str, float]) -> list[int]:
    """Ends of the pieces after all merges: best score first, left before right."""
    return list(accumulate(map(len, short_parts(unit, scores.get)))) if len(unit) <= SHORT else long_ends(unit, scores)


def short_parts(unit: str, score, none: float = -math.inf) -> list[str]:
    """Pieces after all merges, by a list of the scores of neighbours; quadratic, and fast for a word."""
    parts = list(unit)
    joined = [score(unit[i : i + 2], none) for i in range(len(unit) - 1)]
    while joined:
        best = max(joined)
        if best == none:
            break
        i = joined.index(best)
        both = parts[i] + parts.pop(i + 1)
        parts[i] = both
        del joined[i]
        if i < len(joined):
            joined[i] = score(both + parts[i + 1], none)
        if i:
            joined[i - 1] = score(parts[i - 1] + both, none)
    return parts


def long_ends(unit: str, scores: dict[str, float]) -> list[int]:
    """Merges by a heap, for long units."""
    n = len(unit)
    size, before = [1] * n, list(range(-1, n - 1))
    heap = [(-s, i, 2) for i in range(n - 1) if (s := scores.get(unit[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int, length: int) -> None:
        score = scores.get(unit[i : i + length])
        if score is not None:
            heapq.heappush(heap, (-score, i, length))

    while heap:
        _, i, length = heapq.heappop(heap)
        j = i + size[i]
        if not size[i] or j >= n or size[i] + size[j] != length:
            continue  # one of the two has been merged meanwhile
        size[i], size[j] = length, 0
        after = i + length
        if after < n:
            before[after] = i
            offer(i, length + size[after])
        if before[i] >= 0:
            offer(before[i], size[before[i]] + length)
    return [i + s for i, s in enumerate(size) if s]


def best_ends(unit: str, scores: dict[str, float], longest: int) -> list[int]:
    """Ends of the pieces on the best path; a character without a piece counts as one, at a high price."""
    price = min(scores.values(), default=0.0) - 10.0
    best, back = [0.0], [-1]
    for end in range(1, len(unit) + 1):
        found = (-math.inf, -1)
        for begin in range(max(0, end - longest), end):
            score = scores.get(unit[begin:end], price if end - begin == 1 else None)
            if score is not None:
                found = max(found, (best[begin] + score, begin))
        best.append(found[0])
        back.append(found[1])
    ends, at = [], len(unit)
    while at > 0:
        ends.append(at)
        at = back[at]
    return ends[::-1]


def fold_unit(unit: str, pieces: Pieces, longest: int) -> tuple[int, ...]:
    """Ids of one unit."""
    bpe = pieces.kind == "bpe"
    if bpe and len(unit) <= SHORT:
        found = [pieces.ids.get(part) for part in short_parts(unit, pieces.scores.get)]
        if None not in found:
            return tuple(found)
    ends = merged_ends(unit, pieces.scores) if bpe else best_ends(unit, pieces.scores, longest)
    ids: list[int] = []
    begin = 0
    for end in ends:
        piece = unit[begin:end]
        known = pieces.ids.get(piece)
        if known is not None:
            ids.append(known)
        elif pieces.byte_ids:
            ids.extend(pieces.byte_ids[b] for b in piece.encode())
        else:
            ids.append(pieces.unknown)
        begin = end
    return tuple(ids)


@dataclass(frozen=True)
class Merges:
    """All pairs of pieces that make a piece, as arrays, to merge many units at once.

    Symbols are the pieces by number, then the characters that are in pieces without being one; a last
    symbol stands for every other character. Pairs are ``left * symbols + right``, sorted. ``ranks`` orders the pieces by
    score, with 1 for the least; 0 is no piece.
    """

    characters: np.ndarray
    character_symbols: np.ndarray
    pairs: np.ndarray
    merged: np.ndarray
    ranks: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, pieces: Pieces) -> Merges:
        symbols = {text: i for i, text in enumerate(pieces.ids)}
        for text in pieces.ids:
            for character in text:
                symbols.setdefault(character, len(symbols))
        size = len(symbols) + 1
        found = {}
        for text in pieces.ids:
            for cut in range(1, len(text)):
                left, right = symbols.get(text[:cut]), symbols.get(text[cut:])
                if left is not None and right is not None:
                    found[left * size + right] = symbols[text]
        order = np.array(sorted(found), dtype=np.int64)
        single = sorted((ord(text), i) for text, i in symbols.items() if len(text) == 1)
        ids = np.full(size, -1, dtype=np.int32)
        ids[: len(pieces.ids)] = list(pieces.ids.values())
        return cls(
            characters=np.array([c for c, _ in single], dtype=np.uint32),
            character_symbols=np.array([i for _, i in single], dtype=np.int32),
            pairs=order,
            merged=np.array([found[pair] for pair in order.tolist()], dtype=np.int32),
            ranks=(np.unique([pieces.scores[text] for text in pieces.ids], return_inverse=True)[1] + 1).astype(np.int32),
            ids=ids,
        )

    def symbols_of(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        at = np.minimum(np.searchsorted(self.characters, codes), len(self.characters) - 1)
        last = np.int32(len(self.ids) - 1)
        return np.where(self.characters[at] == codes, self.character_symbols[at], last)

    def joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and rank of the piece that two symbols make; the rank is 0 if they make none."""
        pair = left.astype(np.int64) * len(self.ids) + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        symbol = self.merged[at]
        return symbol, np.where(self.pairs[at] == pair, self.ranks[symbol], np.int32(0))

    def fold(self, units: list[str]) -> Iterator[tuple[list[int], list[bytes | None]]]:
        """Numbers of units and their packed ids after all merges; None for units with characters that are no piece."""
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        flat = self.symbols_of("".join(units))
        begins = np.cumsum(lengths) - lengths
        for width in (8, 16, 32, SHORT):
            rows = np.flatnonzero((lengths <= width) & (lengths > (width // 2 if width > 8 else 0)))
            for start in range(0, len(rows), 1 << 14):
                part = rows[start : start + (1 << 14)]
                yield part.tolist(), self._fold_rows(part, begins, lengths, flat, width)

    def _fold_rows(self, rows, begins, lengths, flat, width) -> list[bytes | None]:
        size = lengths[rows]
        places = np.arange(width, dtype=np.int32)
        symbol = flat[np.minimum(begins[rows][:, None] + places, len(flat) - 1)]
        pair, rank = np.zeros_like(symbol), np.zeros_like(symbol)
        line, place = np.nonzero(places < size[:, None] - 1)
        pair[line, place], rank[line, place] = self.joined(symbol[line, place], symbol[line, place + 1])
        going = np.arange(len(rows))
        done, sizes = symbol.copy(), size.copy()
        while len(going):
            at = rank.argmax(axis=1)  # the first of equals
            lines = np.arange(len(going))
            over = rank[lines, at] == 0
            if over.any():
                # No pair is left in these.
                done[going[over]], sizes[going[over]] = symbol[over], size[over]
                going, symbol, pair, rank, size, at = (x[~over] for x in (going, symbol, pair, rank, size, at))
                lines = np.arange(len(going))
            symbol[lines, at] = pair[lines, at]
            # The right one goes; what follows moves up, and so do the pairs.
            size = size - 1
            moving = places[:-1] > at[:, None]
            for row in (symbol, pair, rank):
                np.copyto(row[:, :-1], row[:, 1:].copy(), where=moving)
            rank[lines, size - 1] = 0
            for place, valid in ((at, at + 1 < size), (at - 1, at > 0)):
                i, j = lines[valid], place[valid]
                pair[i, j], rank[i, j] = self.joined(symbol[i, j], symbol[i, j + 1])
        ids = self.ids[done]
        unknown = ((ids < 0) & (places < sizes[:, None])).any(axis=1)
        packed = ids[places < sizes[:, None]].tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        found: list[bytes | None] = [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for row in np.flatnonzero(unknown).tolist():
            found[row] = None
        return found


def _packed(ids) -> bytes:
    return array("i", ids).tobytes()


class Memory(dict):
    """Numbers of units by their text, and the ids of each number one after the other.

    A unit that is looked up for the first time gets a number and waits in ``new`` for its ids.
    """

    def __init__(self, known: dict[str, tuple[int, ...]]):
        super().__init__(zip(known, range(len(known)), strict=True))
        self.numbered, self.new = len(known), []
        self.ids = np.fromiter(chain.from_iterable(known.values()), dtype=np.int32)
        sizes = np.fromiter(map(len, known.values()), dtype=np.int64, count=len(known))
        self.ends = np.concatenate([[0], np.cumsum(sizes)])

    def __missing__(self, unit: str) -> int:
        number = self[unit] = self.numbered
        self.numbered += 1
        self.new.append(unit)
        return number

    def learn(self, packed: list[bytes], unit_chars: int) -> None:
        """The ids of the new units; long units are not looked up again, so that their texts go."""
        sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(packed), dtype=np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        for unit in self.new:
            if len(unit) > unit_chars:
                del self[unit]
        self.new = []

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = self.ends[numbers]
        sizes = self.ends[numbers + 1] - begins
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(begins - ends + sizes, sizes) + np.arange(total)], sizes

    def full(self, known: int) -> bool:
        return self.numbered > known + REMEMBERED or len(self.ids) > REMEMBERED_IDS


#: What a task does with its rows.
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def encode(
    docs: DataFrame, pieces: Pieces, dictionary_units: int = 20_000, unit_chars: int = 24
) -> DataFrame:
    """Rows of ``docs`` as ``row`` with the ``ids`` of their whole text."""
    rows = _with_text(docs)
    step = encoder(docs, pieces, dictionary_units, unit_chars)
    return rows.mapInArrow(step, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>")


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.col("text").alias("t"))


def encoder(docs: DataFrame, pieces: Pieces, dictionary_units: int = 20_000, unit_chars: int = 24) -> Step:
    """From rows (row, t) to rows (row, ids), with a dictionary of the units of ``docs``."""
    known = dictionary(docs, pieces, dictionary_units, unit_chars)
    pattern, longest = pieces.pattern, pieces.longest
    merges = Merges.of(pieces) if pieces.kind == "bpe" and longest > 1 else None

    def packed(new: list[str]) -> dict[str, bytes]:
        """Ids of units that are not in the dictionary."""
        found: dict[str, bytes | None] = {}
        if merges is not None:
            short = [unit for unit in new if len(unit) <= SHORT]
            for numbers, ids in merges.fold(short) if short else ():
                found.update(zip(map(short.__getitem__, numbers), ids, strict=True))
        slow = [unit for unit in new if found.get(unit) is None]
        found.update((unit, _packed(fold_unit(unit, pieces, longest))) for unit in slow)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units_of, memory = splitter(pattern), Memory(known)

        def joined(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
            """Ids of all texts one after the other, and the number of each text's ids."""
            nonlocal memory
            counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            numbers = np.fromiter(
                map(memory.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=counts.sum()
            )
            if memory.new:
                found = packed(memory.new)
                memory.learn([found[unit] for unit in memory.new], unit_chars)
            ids, sizes = memory.ids_of(numbers)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
            if memory.full(len(known)):
                memory = Memory(known)
            return ids, np.diff(ends)

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found, waiting, size = [], [], 0
                for text in part.column("t"):
                    waiting.append(units_of(text.as_py() or ""))
                    size += len(waiting[-1])
                    if size > TOGETHER:
                        found.append(joined(waiting))
                        waiting, size = [], 0
                found.append(joined(waiting))
                flat = pa.array(np.concatenate([ids for ids, _ in found]))
                ends = np.cumsum([0, *np.concatenate([sizes for _, sizes in found])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("row"), lists], names=["row", "ids"])

    return run


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``, to rows (row, ids)."""
    schema = encoded.schema["row"].dataType.simpleString()
    return encoded.mapInArrow(decoder(pieces), f"row {schema}, ids array<int>, decoded string")


def decoder(pieces: Pieces) -> Step:
    """From rows (row, ids) to rows (row, ids, decoded)."""
    parts = {i: text.replace(SPACE, " ").encode() for text, i in pieces.ids.items()}
    parts |= {i: bytes([value]) for value, i in pieces.byte_ids.items()}

    size = max(parts, default=-1) + 1
    lengths = np.array([len(parts.get(i, b"")) for i in range(size)], dtype=np.int64)
    letters = np.frombuffer(b"".join(parts.get(i, b"") for i in range(size)), dtype=np.uint8)
    begins = np.cumsum(lengths) - lengths

    def texts_of(lists: pa.ListArray) -> pa.Array:
        """Texts of lists of ids: the bytes of all pieces, gathered at once."""
        ids = lists.flatten().to_numpy()
        counts = lists.value_lengths().fill_null(0).to_numpy()
        long = lengths[ids]
        ends = np.concatenate([[0], np.cumsum(long)])
        data = letters[np.repeat(begins[ids] - ends[:-1], long) + np.arange(ends[-1])]
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
        # The blank before the first unit was added by encoding.
        first = bounds[:-1][bounds[1:] > bounds[:-1]]
        added = np.zeros(len(data), dtype=bool)
        added[first] = data[first] == 32
        bounds = bounds - np.concatenate([[0], np.cumsum(added)])[bounds]
        data = data[~added]
        binary = pa.Array.from_buffers(
            pa.binary(), len(lists), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]
        )
        try:
            return binary.cast(pa.string())
        except pa.ArrowInvalid:  # ids that nobody encoded may part the bytes of a letter
            return pa.array([b.decode("utf-8", "replace") for b in binary.to_pylist()], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                lists = part.column("ids")
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), lists, texts_of(lists)], names=["row", "ids", "decoded"]
                )

    return run


def round_trip(docs: DataFrame, pieces: Pieces, **parameters) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gives back the text.

    A task encodes, decodes and compares its rows in one go, so texts are sent to it once and only ids come back.
    """
    texts = docs.select("doc_id", "text")
    encoding, decoding = encoder(texts, pieces, **parameters), decoder(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decoding(encoding(batches)):
            row = batch.column("row")
            doc_id, text = row.field("doc_id"), row.field("text").cast(pa.string()).fill_null("")
            same = pc.equal(batch.column("decoded"), text)
            yield pa.RecordBatch.from_arrays([doc_id, batch.column("ids"), same], names=["doc_id", "ids", "restored"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    back = _with_text(texts).mapInArrow(run, f"doc_id {id_type}, ids array<int>, restored boolean")
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "restored")
