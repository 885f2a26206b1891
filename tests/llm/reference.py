"""Brute-force versions of the operators, in plain Python over small inputs."""

from __future__ import annotations

import hashlib

import xxhash


def order(doc_id):
    return -(2**63) if doc_id is None else doc_id


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def substring_dedup(docs, window=50):
    """(doc_id, n_words, n_removed, kept_sha256) of rows (doc_id, text)."""
    words = [(d, (t or "").encode().split()) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, order(d)), order(d))
    out = []
    for d, w in words:
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order(d):
                gone[i : i + window] = b"\1" * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), sha(kept)))
    return out


def suffix_dedup(docs, window=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of rows (doc_id, text) with distinct doc_ids."""
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda r: order(r[0])):
        text = (t or "").encode()
        gone = bytearray(len(text))
        for i in range(len(text) - window + 1):
            piece = text[i : i + window]
            if piece in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(piece)
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(text), sum(gone), spans, sha(kept)))
    return out


def fingerprint(text, shingle=3):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = data.split()
    if not w:
        return 0
    pieces = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values: list[int], linked) -> list[int]:
    """Root position of each value under the relation ``linked``."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if linked(a, values[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(values))]


BLANK = " \t\n\x0b\f\r"


def line_dedup(docs, min_chars=20, min_docs=3):
    """(doc_id, n_lines, n_dropped, kept text) of rows (doc_id, text)."""

    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))

    holders: dict[str, set] = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(order(d))
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [
            x
            for x in lines
            if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == order(d)
        ]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def decontaminate(docs, items, words_of, stretch=16, least=0.8):
    """{(doc_id, item_id)}: some alignment has a stretch with enough equal words."""
    found = set()
    for d, text in docs:
        w = words_of(text)
        for item, other in items:
            q = words_of(other)
            size = min(stretch, len(q))
            if len(q) < 5:
                continue
            for i in range(len(w) - size + 1):
                for j in range(len(q) - size + 1):
                    if sum(a == b for a, b in zip(w[i : i + size], q[j : j + size], strict=True)) >= least * size:
                        found.add((d, item))
    return found
