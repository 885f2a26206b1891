"""Texts that share a doc_id, or have none, are told apart however many they are."""

import random

import pytest
from pyspark.sql import functions as F

from quillworks.llm import substring_dedup, suffix_array_dedup

SCHEMA = "doc_id long, text string"


def text_of(rng):
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(61))


@pytest.mark.parametrize("which", ["first hash", "second hash"])
def test_texts_of_one_id_whose_hashes_share_bits(spark, which):
    rng = random.Random(6)
    texts = [text_of(rng) for _ in range(9000)]
    hashed = F.xxhash64("text") if which == "first hash" else F.xxhash64(F.lit(1), "text")
    bits = hashed.bitwiseAND(F.lit((1 << 23) - 1))
    seen, pair = {}, None
    for row in spark.createDataFrame([(t,) for t in texts], "text string").select("text", bits.alias("b")).collect():
        pair = pair or (seen.get(row.b) and (seen[row.b], row.text))
        seen[row.b] = row.text
    assert pair, "no clash among these texts"
    a, b = pair
    for shared in (5, None):
        # The copy ranks above the null id, or below the shared one.
        other = 1 if shared else 9
        df = spark.createDataFrame([(other, a), (shared, a), (shared, b)], SCHEMA)
        for operator, size in ((substring_dedup, lambda t: len(t.split())), (suffix_array_dedup, len)):
            got = {(r.doc_id, r[1], r.n_removed) for r in operator.digest(df).collect()}
            removed_from = shared if shared else other
            assert {x for x in got if x[2]} == {(removed_from, size(a), size(a))}
            assert (shared, size(b), 0) in got


def test_thousands_of_rows_without_an_id(spark):
    rng = random.Random(7)
    texts = [text_of(rng) for _ in range(6000)]
    rows = [(None, t) for t in texts] + [(i, texts[i]) for i in range(1, 40)] + [(None, texts[0])] * 50
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = substring_dedup.digest(df).collect()
    assert len(got) == len(rows)
    assert sorted(r.doc_id for r in got if r.n_removed) == list(range(1, 40))
    assert all(r.n_removed == r.n_words == 61 for r in got if r.doc_id is not None)
    got = suffix_array_dedup.digest(df).collect()
    assert sorted(r.doc_id for r in got if r.n_removed) == list(range(1, 40))
    assert all(r.n_removed == r.n_bytes for r in got if r.doc_id is not None)
