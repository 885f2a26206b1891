"""Registered queries of the subpackage on the smallest given tables, against oracle SQL or brute force."""

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quillworks.llm import decontamination, language_id, url_filter
from quillworks.llm.queries import ORACLES, PIECE_MODEL, QUERIES
from tests.llm import reference
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def result(spark, name, *columns):
    return [tuple(r) for r in QUERIES[name](spark, FOLDER).select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


def test_op1(spark, docs):
    found = result(spark, "op1_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(found) == sorted(reference.substring_dedup(docs))
    assert any(n for _, _, n, _ in found)


def test_op2(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    found = {d: (list(ids), restored) for d, ids, restored in result(spark, "op2_sentencepiece", "doc_id", "ids", "restored")}
    assert found == {d: (library.encode(t or ""), True) for d, t in docs}


def test_op3(spark, docs):
    found = QUERIES["op3_sharding"](spark, FOLDER).collect()
    texts = dict(docs)
    assert sorted(r.doc_id for r in found) == sorted(texts)
    by_text, by_shard = {}, {}
    for r in found:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 16
        by_text.setdefault(texts[r.doc_id], set()).add(r.shard)
        by_shard.setdefault(r.shard, []).append((r.slot, r.size))
    assert all(len(s) == 1 for s in by_text.values())
    assert set(by_shard) <= set(range(40))
    assert all(sorted(s for s, _ in rows) == list(range(len(rows))) for rows in by_shard.values())


def test_op4(spark):
    labels = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect())
    found = result(spark, "op4_language_id", "doc_id", "held_out", "lang_pred", "score")
    assert sorted(r[0] for r in found) == sorted(labels)
    held_out = [lang == labels[d] for d, out, lang, _ in found if out]
    assert np.mean(held_out) > 0.9
    assert all(0 <= score <= 1 for *_, score in found)


def test_op5(spark, docs):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(result(spark, "op5_suffix_array_dedup", *columns)) == sorted(reference.suffix_dedup(docs))


def test_op6(spark, docs):
    prints = [reference.fingerprint(t) for _, t in docs]
    roots = reference.components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (d, _), root in zip(docs, roots, strict=True):
        least[root] = min(least.get(root, d), d)
    expected = [(d, f"{f:016x}", least[root]) for (d, _), f, root in zip(docs, prints, roots, strict=True)]
    assert sorted(result(spark, "op6_simhash_near_dedup", "doc_id", "fingerprint", "component_id")) == sorted(expected)


def test_op7(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    found = result(spark, "op7_url_filter", "page_id", "host", "path", "rule", "verdict")
    assert sorted(r[0] for r in found) == sorted(pages)
    for page, host, path, rule, verdict in found:
        rest = pages[page].split("://", 1)[1]
        cut = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
        assert host == rest[:cut].lower()
        end = min([len(rest), *(rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0)])
        assert path == rest[cut:end]
        fits = [
            (h + p, v)
            for h, p, v in url_filter.LIST_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        if fits:
            assert (rule, verdict) == max(fits, key=lambda x: len(x[0]))
        else:
            assert rule is None and verdict in ("allow", "block")


def test_op8(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def words(text):
        return decontamination.word_hashes((text or "").encode()).tolist()

    # Word by word only where a document shares five words in a row or a long item.
    exact = {(d, i) for d, t in docs for i, other in items if t and other in t}
    found = result(spark, "op8_benchmark_decontamination", "doc_id", "item_id", "similarity")
    assert exact <= {(d, i) for d, i, _ in found}
    hit = sorted({d for d, _, _ in found})
    texts = dict(docs)
    near = [(d, texts[d]) for d in hit] + [(d, t) for d, t in docs if d not in hit and len(t or "") < 800][:10]
    assert reference.decontaminate(near, items, words) == {(d, i) for d, i, _ in found}


def test_held_out_is_a_checksum(spark, rows):
    df = rows("doc_id long", (3,), (None,)).select("doc_id", language_id.held_out(F.col("doc_id")).alias("h"))
    import zlib

    assert {r.doc_id: r.h for r in df.collect()} == {3: zlib.crc32(b"3") % 5 == 0, None: False}
