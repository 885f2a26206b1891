"""Periodic runs of words: stretches that repeat a block of words at least four times over.

A run with period q is a stretch of consecutive words in which words q apart are identical, q is the smallest
such number, the length is at least ``max(6, 4 * q)``, and no neighbouring word extends it. All runs of a text
are found:

* Periods up to ``SHORT`` are scanned directly: every lag compares the text with itself shifted by it.
* Longer ones are found at scales of doubling width. The scale for periods in (w, 2w] names every gram of 2w
  words by a hash and keeps the grams that are least among some w neighbours. Inside a run with period q the
  windows repeat at distance q, so a kept gram is kept again q words on. A gram is at least as long as the
  period, so inside the run it comes back at multiples of the period only, and the next kept gram of the same
  name is exactly one period away. Four periods always hold such a pair: q + w + 2w - 1 < 4q words.
* Neighbouring kept grams of one name, with a distance that belongs to the scale, seed an extension: the words
  themselves are compared in both directions until they differ. So a clash of hashes never makes a run.

A stretch found with several lags keeps the smallest one, its period. Texts are rows, and tasks work on some
hundred thousand words at a time; words of different texts never meet, for the texts of a block are parted by a
symbol that occurs once. A text needs about 100 bytes of memory per word.

Words are maximal runs without blank, tab, line feed, vertical tab, form feed and carriage return.

Defined cases: a null, empty or blank text has no words and no runs; rows are judged one by one, so ties and
repeated rows give equal results and a null doc_id is carried; an empty table gives an empty result; columns
besides doc_id and text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillworks.llm.repeated_windows import BATCH_BYTES, mixed

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Longest period that is scanned directly; the first scale begins above it.
SHORT = 8
#: Words that a task looks at together.
BLOCK_WORDS = 1 << 18
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def least_length(period):
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * period)


def _scanned(ids: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal stretches with this lag that are long enough."""
    differ = np.flatnonzero(ids[period:] != ids[:-period])
    edges = np.concatenate([[-1], differ, [len(ids) - period]])
    length = np.diff(edges) - 1 + period
    long = length >= least_length(period)
    begin = edges[:-1][long] + 1
    return begin, begin + length[long]


def _agreeing(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on, in the direction of ``step``, equal the word ``lag`` later."""
    count, width = 0, 64
    room = len(ids) - lag - at if step > 0 else at + 1
    while room > 0:
        width = min(width, room)
        a = at if step > 0 else at - width + 1
        same = ids[a : a + width] == ids[a + lag : a + lag + width]
        if step < 0:
            same = same[::-1]
        if not same.all():
            return count + int(same.argmin())
        count, room, at, width = count + width, room - width, at + step * width, width * 2
    return count


def _kept(names: np.ndarray, width: int) -> np.ndarray:
    """Places whose name is the least, the first on ties, of some ``width`` neighbours."""
    if len(names) < width:
        return np.empty(0, dtype=np.int64)
    place = np.uint64((1 << len(names).bit_length()) - 1)
    least = (names & ~place) | np.arange(len(names), dtype=np.uint64)
    done = 1
    while done < width:  # a power of two
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    at = (least & place).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def runs_of(ids: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period), by start and period. ``longest`` is the size of the largest text among the ids."""
    found: dict[tuple[int, int], int] = {}
    for period in range(1, min(SHORT, longest // LEAST_PERIODS) + 1):
        for begin, end in zip(*(x.tolist() for x in _scanned(ids, period)), strict=True):
            found.setdefault((begin, end), period)
    names, gram, low = mixed(ids.astype(np.uint64) + _FACTOR), 1, SHORT
    while LEAST_PERIODS * (low + 1) <= longest:
        while gram < 2 * low:
            names = mixed(names[:-gram] * _FACTOR + names[gram:])
            gram *= 2
        at = _kept(names, low)
        name = names[at]
        order = np.argsort(name, kind="stable")
        at, name = at[order], name[order]
        lag = at[1:] - at[:-1]
        seed = np.flatnonzero((name[1:] == name[:-1]) & (lag > low) & (lag <= 2 * low))
        reached: dict[int, int] = {}
        pairs = sorted(zip(at[seed].tolist(), lag[seed].tolist(), strict=True))
        for place, period in pairs:
            if place < reached.get(period, 0):
                continue
            ahead = _agreeing(ids, place, period, 1)
            begin = place - _agreeing(ids, place - 1, period, -1)
            reached[period] = place + max(ahead, 1)
            end = place + ahead + period
            if ahead and end - begin >= least_length(period):
                found[begin, end] = min(period, found.get((begin, end), period))
        low *= 2
    rows = sorted((begin, end - begin, period) for (begin, end), period in found.items())
    rows.sort(key=lambda r: (r[0], r[2]))
    return np.array(rows, dtype=np.int64).reshape(-1, 3)


def collapsed_mask(runs: np.ndarray, size: int) -> np.ndarray:
    """Which words some run contains after its first period."""
    change = np.zeros(size + 1, dtype=np.int32)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def _judged(block: list[list[bytes]]) -> Iterator[tuple[np.ndarray, bytes]]:
    """Runs and collapsed text of every text of a block."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    parts, begins, size = [], [], 0
    for i, words in enumerate(block):
        begins.append(size)
        parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
        parts.append(np.array([-1 - i]))
        size += len(words) + 1
    runs = runs_of(np.concatenate(parts), max(map(len, block)))
    cuts = np.searchsorted(runs[:, 0], [*begins, size])
    for i, words in enumerate(block):
        own = runs[cuts[i] : cuts[i + 1]] - [begins[i], 0, 0]
        if len(own):
            gone = collapsed_mask(own, len(words)).tolist()
            words = [w for w, g in zip(words, gone, strict=True) if not g]
        yield own, b" ".join(words)


def _result(ids: list, counts: list[int], found: list[tuple[np.ndarray, bytes]]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *(len(runs) for runs, _ in found)]).astype(np.int32)
    rows = np.concatenate([runs for runs, _ in found])
    entries = pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(counts, pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), entries),
            pa.array([text.decode() for _, text in found], pa.string()),
        ],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, block, words, size = [], [], 0, 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            text = text.as_py() or b""
            ids.append(doc_id)
            block.append(text.split())
            words += len(block[-1])
            size += len(text)
            if words >= BLOCK_WORDS or size >= BATCH_BYTES:
                yield _result(ids, [*map(len, block)], [*_judged(block)])
                ids, block, words, size = [], [], 0, 0
        if ids:
            yield _result(ids, [*map(len, block)], [*_judged(block)])


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, all ``runs`` (word number of the start, length, period) by start and period, and ``collapsed``:
    the text, its words joined by a blank, without the words that a run contains after its first period."""
    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return columns.mapInArrow(_find, FOUND)
