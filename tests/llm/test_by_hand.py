"""Language scores and shards, worked out by other means."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillworks.llm import language_id
from quillworks.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def grams(text):
    data = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode()
    return {data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}


@pytest.fixture(scope="module")
def taught():
    rng = random.Random(4)
    words = {"aa": "the of and this house Water", "bb": "der die und das Haus Wasser", "cc": "le la et les maison eau é"}
    return [
        (10 * i + j, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(3, 12))), lang)
        for i in range(14)
        for j, lang in enumerate(words)
        if i < 9 or lang != "cc"
    ]


def test_scores_are_those_of_a_kernel_ridge_regression(spark, taught):
    """The same regression by sets of n-grams, a Cholesky factor and least squares."""
    texts = [*{(lang, text) for _, text, lang in taught}]
    languages = sorted({lang for lang, _ in texts})
    counts = Counter(g for _, text in texts for g in grams(text))
    vocabulary = {g for g, n in counts.items() if n >= 2}

    def kernel(a, b):
        a, b = grams(a) & vocabulary, grams(b) & vocabulary
        return len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))

    marks = [text for _, text in texts]
    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    factor = np.linalg.cholesky(gram)  # features F with F F' = K; any rotation of them gives the same fit

    def features(some):
        cross = np.array([[kernel(text, mark) for mark in marks] for text in some])
        return np.linalg.solve(factor, cross.T).T

    target = np.array([[float(lang == name) for name in languages] for lang, _ in texts])
    weight = np.sqrt((target / target.sum(0)).sum(1) / len(languages))
    size = len(marks)
    rows = np.vstack(
        [
            weight[:, None] * np.hstack([features(marks), np.ones((size, 1))]),
            np.hstack([np.sqrt(1e-2 / size) * np.eye(size), np.zeros((size, 1))]),
        ]
    )
    wanted = np.vstack([weight[:, None] * target, np.zeros((size, len(languages)))])
    solved = np.linalg.lstsq(rows, wanted, rcond=None)[0]

    asked = ["the house", "das Wasser und", "et la maison", "water der eau", "quite other words 42", "é"]
    scores = np.hstack([features(asked), np.ones((len(asked), 1))]) @ solved
    schema = "doc_id long, text string, lang string"
    model = language_id.fit(spark.createDataFrame(taught, schema), F.lit(True), landmarks=3 * 14)
    assert len(model.landmarks) == size and len(model.codes) == len(vocabulary)
    found = language_id.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model)
    got = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in found.collect()}
    for i, row in enumerate(scores):
        assert got[i][0] == languages[row.argmax()]
        assert got[i][1] == pytest.approx(min(max(row.max(), 0), 1), abs=2e-3)


def test_shards_of_all_documents(spark):
    """Every promise of the result, from the rows themselves."""
    table = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table}
    found = QUERIES["op3_sharding"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    total, slots, of_text = Counter(), {}, {}
    for r in found:
        text = texts[r.doc_id]
        assert r.size == len(text) + 16 and r.text_crc32 == zlib.crc32(text)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 40
        total[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert of_text.setdefault(text, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Groups larger than the mean of what is left are alone; no contiguous partition of the others has a smaller largest shard.
    groups = Counter()
    for text in texts.values():
        groups[text] += len(text) + 16
    sizes = sorted(groups.values(), reverse=True)
    alone, rest, shards = 0, sum(sizes), 40
    while sizes[alone] * shards >= rest:
        rest, shards, alone = rest - sizes[alone], shards - 1, alone + 1

    def fits(capacity):
        used, need = 0, 1
        for size in sizes[alone:]:
            if used + size > capacity:
                used, need = 0, need + 1
            used += size
        return need <= shards

    loads, single = Counter(total.values()), Counter(sizes[:alone])
    assert single <= loads
    largest = max((loads - single).elements())
    assert fits(largest) and not fits(largest - 1)
