"""Suffix-array dedup of bytes by sparse prefix doubling.

Every byte covered by a string of ``window`` bytes that also starts earlier (smaller doc_id, or the
same document and an earlier start) is removed. Spark groups runs of windows once, by the hash of
their sample (24 bytes), drops runs whose sample is unique and settles those with equal run hashes. There are no
Spark sorts of rank pairs and no reranking rounds. Only for the positions that remain, inside a task, hashes of
25 bytes serve as ranks and are paired at offset 25 and then 50, which ranks all 100-byte
prefixes; equal neighbours in that order are compared byte by byte. Doubling stops there,
past the threshold. ``repeated_windows`` describes how positions are sampled and distributed.

Sampling is a departure from plain doubling, which would sort every byte position in every round; the
README has the figures.

Defined cases: a null text has no bytes; texts shorter than a window stay whole; a null doc_id ranks
lowest; rows that share a doc_id are ordered by 23 bits of a hash of their text, then by the place, then by
another hash of 64 bits, and identical rows are not copies of each other; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from quillworks.llm.repeated_windows import Block, Frame, judged_texts, later_copies, mixed, prefix_hash

WINDOW = 100
FIRST_RANK = 25
#: A fixed 64-bit value for each byte, by a rule.
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def symbols(text: bytes) -> np.ndarray:
    return _VALUES[np.frombuffer(text, dtype=np.uint8)]


def pieces(text: bytes):
    return lambda a, b: text[a:b]


def _paired(rank: np.ndarray, at: np.ndarray, offset: int) -> np.ndarray:
    """Rank of twice the length: the pair of the ranks at a position and ``offset`` after it."""
    return mixed(rank[at] ^ mixed(rank[at + offset] + np.uint64(offset)))


def solve(block: Block) -> np.ndarray:
    """Windows of a block that also start earlier in it."""
    joined = np.frombuffer(b"".join(block.text), dtype=np.uint8)
    begin = np.cumsum([0, *map(len, block.text)])[:-1]
    at = begin[block.run] + block.number
    sums, down = prefix_hash(_VALUES[joined], 0, 1 << (len(joined) - 1).bit_length())
    rank25 = (sums[FIRST_RANK:] - sums[:-FIRST_RANK]) * down[: len(joined) - FIRST_RANK + 1]
    rank50 = _paired(rank25, np.arange(len(rank25) - FIRST_RANK), FIRST_RANK)
    rank100 = _paired(rank50, at, 2 * FIRST_RANK)
    group, doc = block.group[block.run], block.doc[block.run]
    place = block.place[block.run] + block.number
    order = np.lexsort((place, doc, rank100, group))
    g, r = group[order], rank100[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    # Byte by byte against the neighbour: ranks that clash by chance part here.
    same = np.flatnonzero(~new)
    view = np.lib.stride_tricks.sliding_window_view(joined, WINDOW)
    for start in range(0, len(same), 1 << 16):
        i = same[start : start + (1 << 16)]
        new[i] = (view[at[order[i]]] != view[at[order[i - 1]]]).any(axis=1)
    classes = np.empty(len(order), dtype=np.int64)
    classes[order] = np.cumsum(new)
    return later_copies((classes,), doc, place, block.text_hash[block.run], other_documents=False)


FRAME = Frame(window=WINDOW, gram=24, symbols=symbols, pieces=pieces, solve=solve, other_documents=False)


def kept_bytes(text: bytes, mask: np.ndarray) -> bytes:
    return np.frombuffer(text, dtype=np.uint8)[~mask].tobytes()


def _finish(text: bytes, mask) -> tuple:
    gone = mask(len(text))
    spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
    return len(text), int(gone.sum()), spans, hashlib.sha256(kept_bytes(text, gone)).hexdigest()


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    return judged_texts(docs, FRAME, _finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id and the bytes that stay (cutting may part the bytes of a letter)."""
    return judged_texts(docs, FRAME, lambda text, mask: (kept_bytes(text, mask(len(text))),), "kept binary")
