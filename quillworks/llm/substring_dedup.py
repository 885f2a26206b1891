"""Substring dedup of words by equality of sampled windows.

Every word covered by a window of ``window`` consecutive words whose word sequence also starts
in a document with a smaller doc_id is removed. Windows are split into groups by the minimising 12
words at any place in them, and a crowded group by the whole window. Most copies are settled by equal hashes of
runs; of what is left, a task sorts the windows of a group as rows of ``window`` words, and those with
equal rows are one class. That is the level of depth ``window`` of a suffix tree and nothing deeper: no tree over
whole suffixes is built and no maximal repeat found. A window is a copy if one of a smaller document is in its
class. ``repeated_windows`` describes how windows are sampled and distributed.

Words are maximal runs without blank, tab, line feed, vertical tab, form feed and carriage return.

Defined cases: a null text has no words; texts shorter than a window stay whole; a null doc_id ranks
lowest; rows that share a doc_id do not remove each other's words, whether they repeat each other or not;
repeats inside one document stay; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from quillworks.llm.repeated_windows import Block, Frame, judged_texts

WINDOW = 50


def symbols(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def pieces(text: bytes):
    words = text.split()
    return lambda a, b: b" ".join(words[a:b])


def tree_intervals(suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (rows of words), and for each place in it the number of its deep node.

    Neighbours with a common prefix of ``depth`` words or more hang below one node.
    """
    width = suffixes.shape[1]
    letters = suffixes.astype(">u8").view(np.uint8).reshape(len(suffixes), -1)
    order = np.argsort(np.ascontiguousarray(letters).view(f"S{8 * width}").ravel(), kind="stable")
    lines = suffixes[order]
    agree = lines[1:] == lines[:-1]
    lcp = np.where(agree.all(axis=1), width, agree.argmin(axis=1))
    node = np.concatenate([[0], np.cumsum(lcp < depth)])
    return order, node


def solve(block: Block) -> np.ndarray:
    """Windows of a block whose words also start in a smaller document of it."""
    words = [symbols(text) for text in block.text]
    joined = np.concatenate(words)
    begin = np.cumsum([0, *map(len, words)])[:-1]
    at = begin[block.run] + block.number
    suffixes = np.empty((len(at), WINDOW + 1), dtype=np.uint64)
    # The group comes first: each group is a subtree of its own.
    suffixes[:, 0] = block.group[block.run].view(np.uint64)
    suffixes[:, 1:] = np.lib.stride_tricks.sliding_window_view(joined, WINDOW)[at]
    order, node = tree_intervals(suffixes, WINDOW + 1)
    doc = block.doc[block.run]
    least = np.full(node[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, doc[order])
    copies = np.empty(len(at), dtype=bool)
    copies[order] = doc[order] > least[node]
    return copies


FRAME = Frame(
    window=WINDOW,
    gram=12,
    symbols=symbols,
    pieces=pieces,
    solve=solve,
    other_documents=True,
    block_windows=60_000,
)


def kept_words(text: bytes, mask) -> tuple[list[bytes], np.ndarray]:
    words = text.split()
    gone = mask(len(words))
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], gone


def _finish(text: bytes, mask) -> tuple:
    kept, gone = kept_words(text, mask)
    return len(gone), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words that stay, joined by a blank."""
    return judged_texts(docs, FRAME, _finish, "n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id and the words that stay, joined by a blank."""
    return judged_texts(docs, FRAME, lambda t, mask: (b" ".join(kept_words(t, mask)[0]).decode(),), "kept string")
