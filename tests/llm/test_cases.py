"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, crowded groups."""

import dataclasses
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillworks.llm import (
    components,
    decontamination,
    language_id,
    line_dedup,
    sentencepiece_codec,
    sharding,
    simhash,
    substring_dedup,
    suffix_array_dedup,
    url_filter,
    voronoi_topk,
)
from quillworks.llm.common import with_row_number
from quillworks.llm.queries import PIECE_MODEL
from quillworks.llm.repeated_windows import judged_texts
from tests.llm import reference

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text): copies, shared passages, blanks, nulls, one long text."""
    rng = random.Random(5)
    passage = words(rng, 70)
    out = [(None, passage), (1, None), (2, ""), (3, " \t\n "), (4, words(rng, 3000)), (5, passage.upper())]
    for i in range(6, 30):
        out.append((i, f"{words(rng, 30)}\n{passage}\n{words(rng, rng.randrange(60))}"))
    out += [(30, out[4][1]), (31, "ab " * 400), (32, "ab " * 200 + "c"), (33, "é" * 150 + passage[:120])]
    return out


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame([(d, t, "en", "s", None) for d, t in texts], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is not None, x) for x in r])


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("crowd", [4000, 1])
def test_substring_dedup(table, texts, crowd):
    frame = dataclasses.replace(substring_dedup.FRAME, crowd=crowd)
    found = judged_texts(table, frame, substring_dedup._finish, "n_words long, n_removed long, kept_sha256 string")
    assert plain(found, "doc_id", "n_words", "n_removed", "kept_sha256") == ordered(reference.substring_dedup(texts))


@pytest.mark.parametrize("crowd", [4000, 1])
def test_suffix_dedup(table, texts, crowd):
    frame = dataclasses.replace(suffix_array_dedup.FRAME, crowd=crowd)
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    found = judged_texts(table, frame, suffix_array_dedup._finish, schema)
    expected = reference.suffix_dedup(texts)
    assert plain(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == ordered(expected)


def test_repeated_rows_are_no_copies_of_each_other(spark):
    text = " ".join(map(str, range(200)))
    df = spark.createDataFrame([(7, text), (7, text), (8, text)], "doc_id long, text string")
    assert plain(substring_dedup.digest(df), "doc_id", "n_removed") == [(7, 0), (7, 0), (8, 200)]
    assert plain(suffix_array_dedup.digest(df), "doc_id", "n_removed") == [(7, 0), (7, 0), (8, len(text))]


def test_cleaned_texts(spark):
    text = " ".join(map(str, range(100)))
    df = spark.createDataFrame([(1, text), (2, f"x {text} y")], "doc_id long, text string")
    assert plain(substring_dedup.cleaned(df), "doc_id", "kept") == [(1, text), (2, "x y")]
    kept = dict(plain(suffix_array_dedup.cleaned(df), "doc_id", "kept"))
    assert bytes(kept[2]) == b"x  y" and bytes(kept[1]) == text.encode()


def test_line_dedup(table, texts):
    expected = [(d, n, m, t) for d, n, m, t in reference.line_dedup(texts)]
    found = line_dedup.drop_repeated_lines(table)
    assert plain(found, "row.doc_id", "n_lines", "n_dropped", "kept") == ordered(expected)
    assert any(m for _, _, m, _ in expected)
    one_batch = line_dedup.drop_repeated_lines(table, batches=1)
    assert plain(one_batch, "row.doc_id", "kept") == plain(found, "row.doc_id", "kept")


def test_line_keys_lower_only_ascii(spark):
    line = "Ééé " + "a" * 30
    rows = [(i, t) for i, t in enumerate([line, f"  {line}\t", line.replace("É", "é"), line.upper().replace("É", "É")])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = ordered(reference.line_dedup(rows, min_docs=2))
    assert plain(line_dedup.drop_repeated_lines(df, min_docs=2), "row.doc_id", "n_lines", "n_dropped", "kept") == expected


def test_simhash(table, texts):
    prints = [reference.fingerprint(t) for _, t in texts]
    roots = reference.components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (d, _), root in zip(texts, roots, strict=True):
        least[root] = min(least.get(root, 2**63), reference.order(d))
    named = {k: None if v == -(2**63) else v for k, v in least.items()}
    expected = [(d, f"{f:016x}", named[r]) for (d, _), f, r in zip(texts, prints, roots, strict=True)]
    assert plain(simhash.near_duplicates(table), "doc_id", "fingerprint", "component_id") == ordered(expected)


@pytest.mark.parametrize("block_rows", [2048, 7])
def test_simhash_links_span_the_components(spark, block_rows):
    rng = random.Random(3)
    values = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        values |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(8)}
    values = sorted(values)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in signed], "f long")
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(nodes, block_rows).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    expected = reference.components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    linked = {frozenset(p) for p in found}
    assert reference.components(values, lambda a, b: frozenset((a, b)) in linked) == expected


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    roots = {r.node: r.root for r in found.collect()}
    assert roots == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}


def test_simhash_clean_keeps_one_row_of_a_group(spark):
    rows = [(3, "a b c d"), (2, "A B C D"), (2, "A B C D"), (9, None), (8, ""), (None, "z y x w")]
    df = spark.createDataFrame([(d, t, "f", "g") for d, t in rows], "doc_id long, text string, f string, d string")
    kept = simhash.clean(df)
    assert kept.columns == df.columns
    assert plain(kept, "doc_id", "text") == [(None, "z y x w"), (2, "A B C D"), (8, "")]


def test_simhash_clean_keeps_a_row_of_each_component_with_one_id(spark):
    rng = random.Random(11)
    a, b, c, e, f = (words(rng, 60) for _ in range(5))
    # Two null ids and one doc_id (4), each in two components; 7 and 8 are copies of such rows.
    rows = [(None, a), (None, b), (7, b), (4, c), (4, e), (8, e), (8, e), (9, f), (4, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [reference.fingerprint(t) for t in (a, b, c, e, f)]
    assert all((x ^ y).bit_count() > 3 for i, x in enumerate(prints) for y in prints[:i])
    expected = [(None, a), (None, b), (4, c), (4, e), (9, f)]
    assert plain(simhash.clean(df), "doc_id", "text") == ordered(expected)


def test_sharding(spark, table, texts):
    found = sharding.shard_documents(table, shards=5).collect()
    assert len(found) == len(texts)
    shards = {}
    for r in found:
        shards.setdefault(r.shard, []).append(r)
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))


@pytest.mark.parametrize("seed", range(20))
def test_minimax_cuts(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.choice([1, 2, 3, 7, 40, 200]) for _ in range(rng.randrange(1, 12))), reverse=True)
    shards = rng.randrange(1, 6)
    runs = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
    cuts = [0, *sharding.minimax_cuts(runs, shards), len(sizes)]
    assert cuts == sorted(cuts) and len(cuts) <= shards + 1

    def best(rest, k):
        if k == 1 or not rest:
            return sum(rest)
        return min(max(sum(rest[:i]), best(rest[i:], k - 1)) for i in range(len(rest) + 1))

    assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) == best(sizes, shards)


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    found = with_row_number(df, [F.desc("v")], "n", "test-numbers").collect()
    assert all(r.n == 999 - r.v for r in found)


def test_language_id(spark, empty):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 3, "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "123 !?", "de"), (102, "the the", None), (None, "und die", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df).collect()}
    assert found[100] == found[101] == ("und", 0.0)
    assert all(found[i][0] == ("en" if i % 2 else "de") for i in range(60))
    assert found[102][0] == "en" and found[None][0] == "de"
    assert language_id.identify(empty).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_language_sample_holds_distinct_texts(spark):
    rng = random.Random(6)
    own = {lang: [f"{lang}{x}" for x in range(60)] for lang in ("en", "de")}
    rows = [(i, " ".join(rng.choices(own[lang], k=12)), lang) for i, lang in enumerate(["en", "de"] * 60)]
    hashes = spark.createDataFrame(rows, "doc_id long, text string, lang string").select(
        "text", F.xxhash64("text").alias("h")
    )
    low = hashes.filter("text like 'en%'").orderBy("h").first()["text"]
    # A third of the English rows are copies of the text that comes first.
    rows += [(1000 + i, low, "en") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id._sample(df, F.lit(True), 20).collect()
    expected = {
        lang: [r.text for r in hashes.filter(F.col("text").startswith(lang)).distinct().orderBy("h").limit(20).collect()]
        for lang in own
    }
    assert {lang: [r.text for r in sorted(sample, key=lambda r: r.n) if r.lang == lang] for lang in own} == expected
    model = language_id.fit(df, F.lit(True), per_language=20, landmarks=16)
    assert len(np.unique(model.landmarks, axis=0)) == len(model.landmarks) == 16


def test_language_with_one_text_teaches(spark):
    rows = [(i, "uno dos tres cuatro", "es") for i in range(9)] + [(20 + i, f"one two three {i}", "en") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.lit(True))
    asked = spark.createDataFrame([(1, "cuatro tres"), (2, "two three")], "doc_id long, text string")
    assert plain(language_id.predict(asked, model), "row.doc_id", "lang_pred") == [(1, "es"), (2, "en")]


def test_language_of_the_columns_is_no_input(spark):
    rows = [(i, ("one two three " if i % 2 else "uno dos tres ") * 4, "en" if i % 2 else "es") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.lit(True))
    other = df.select(F.col("doc_id") + 1000, "text", F.lit("zz").alias("lang")).toDF("doc_id", "text", "lang")
    same = [r["lang_pred"] for r in language_id.predict(other, model).orderBy("row.doc_id").collect()]
    assert same == [lang for _, _, lang in rows]


def test_url_filter(spark):
    urls = [
        "http://Example.ORG/es/x", "http://example.org/en/1?x", "http://a.example.org/en/2", "https://x.com/fr/", None,
        "https://x.com/de", "no scheme.org/", "http://evilexample.org/es/", "ftp://org", "http://org/", "http://b.net#org/",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    assert found[0] == ("example.org", "/es/x", "example.org/es/", "block")
    assert found[1][2:] == ("example.org/en/1", "block")
    assert found[2][2:] == ("org/", "allow")
    assert found[3][2:] == ("com/fr/", "allow")
    assert found[4] == found[6] == ("", "", None, "allow")
    assert found[5] == ("x.com", "/de", None, "allow")
    assert found[7][2:] == ("org/", "allow")
    assert found[8] == ("org", "", None, "allow")
    assert found[9][2:] == ("org/", "allow")
    assert found[10] == ("b.net", "", None, "allow")


def test_mined_rules(spark):
    urls = [(i, f"http://{'spam' if i % 3 else 'good'}.net/{'casino' if i % 2 else 'news'}/{i}") for i in range(120)]
    bad = [i for i, u in urls if "spam" in u and "casino" in u]
    pages = spark.createDataFrame([*urls, (500, "http://spam.net/casino/new"), (501, "http://good.net/casino/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i in bad)) for i, _ in urls], "doc_id long, quality int, toxic int")
    found = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, min_confidence=0.9).collect()}
    assert {i for i, v in found.items() if v == "block"} == {*bad, 500}


def topk_by_hand(rows, k):
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in usable:
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(a) == len(b))
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("block_rows", [4096, 20])
def test_topk(spark, block_rows):
    rng = random.Random(1)
    rows = [(i * 10, [rng.choice([0.5, -0.25, rng.gauss(0, 1)]) for _ in range(4)]) for i in range(120)]
    rows += [(7, None), (8, [1.0, None, 0.0, 0.0]), (9, [float("nan")] * 4), (11, [float("inf")] * 4), (100 * 50, [1.0, 2.0])]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(2001, 2080)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found = voronoi_topk.top_k(df.filter("vec_id % 100 = 0"), df, k=10, n_pivots=6, block_rows=block_rows, run_rows=block_rows)
    assert {tuple(r) for r in found.collect()} == topk_by_hand(rows, 10)


@pytest.mark.parametrize("block_rows", [4096, 40, 20])
def test_topk_of_an_id_that_many_rows_share(spark, block_rows):
    rng = random.Random(4)
    # Rows of the asked ids lie together, far from all others.
    rows = [(100, [8.0 + i / 64, 8.0]) for i in range(20)] + [(200, [-8.0, 8.0 + i / 64]) for i in range(15)]
    rows += [(2 * i + 1, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.filter("vec_id % 100 = 0").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    found = voronoi_topk.top_k(asked, df, k=10, n_pivots=32, block_rows=block_rows)
    first = {r.vec_id: list(r.embedding) for r in asked.collect()}
    expected = set()
    for q, a in first.items():
        a = [int(np.floor(1024 * x)) for x in a]
        scores = sorted(
            (-sum(x * int(np.floor(1024 * y)) for x, y in zip(a, np.float32(v).tolist(), strict=True)), i)
            for i, v in rows
            if i != q
        )
        expected |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:10], 1)}
    assert len(expected) == 20
    assert {tuple(r) for r in found.collect()} == expected


def test_topk_leaves_out_own_rows_before_the_cut():
    ids, scores = np.array([5, 5, 1, 2, 3]), np.array([9, 8, 1, 2, 3])
    assert voronoi_topk._best(scores, ids, 5, 4).tolist() == [4, 3, 2]


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(1, words(rng, 40)), (2, words(rng, 7)), (3, "too short"), (4, None), (5, words(rng, 40))]
    changed = items[0][1].split()
    for i in range(0, 40, 5):
        changed[i] = "other"
    docs = [
        (1, f"{words(rng, 50, 9)} {' '.join(changed)} {words(rng, 20, 9)}"),
        (2, f"x y {items[1][1].upper()} z"), (3, "too short"), (4, None), (5, ""), (6, words(rng, 900)),
        (7, " ".join(items[4][1].split()[:20])), (8, f"{items[4][1]} . " * 300), (None, items[1][1]),
    ]
    table = spark.createDataFrame([(d, t, 0, 0) for d, t in docs], "doc_id long, text string, t int, item int")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def split(text):
        return decontamination.word_hashes((text or "").encode()).tolist()

    expected = reference.decontaminate([d for d in docs if d[0] != 8], items, split) | {(8, 5)}
    found = decontamination.contaminated(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected == {(1, 1), (2, 2), (7, 5), (8, 5), (None, 2)}
    assert plain(decontamination.clean(table, bench), "doc_id") == [(3,), (4,), (5,), (6,)]
    assert decontamination.contaminated(table, bench.limit(0)).count() == 0


@pytest.mark.parametrize("size", range(5, 17))
def test_seeds_survive_every_substitution_that_counts(size):
    item = np.arange(1, size + 1, dtype=np.uint64)
    short = decontamination.is_short(item)
    own = decontamination.seeds(item, short)
    for gone in itertools.combinations(range(size), size - -(-4 * size // 5)):
        changed = item.copy()
        changed[list(gone)] += np.uint64(1000)
        found = decontamination.seeds(changed, short)
        assert any((a == b).any() for a, b in zip(own, found, strict=True)), gone


@pytest.mark.parametrize("sizes", [range(1, 17), range(8, 17)])
def test_decontamination_of_short_items(spark, sizes):
    rng = random.Random(8)
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in sizes]
    docs = [(0, words(rng, 40))]
    for n, text in items:
        for gone in [*([x] for x in range(n)), [0, n - 1], [n // 2, n // 2 - 1]]:
            w = text.split()
            for x in gone:
                w[x] = "other"
            docs.append((len(docs), f"{words(rng, 6)} {' '.join(w)} {words(rng, 6)}"))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def split(text):
        return decontamination.word_hashes(text.encode()).tolist()

    expected = reference.decontaminate(docs, items, split)
    # Every single substitution counts, in items of five words or more.
    assert len(expected) >= sum(n for n in sizes if n >= 5)
    found = decontamination.contaminated(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    assert decontamination.clean(table, bench).count() == len(docs) - len({d for d, _ in expected})


def test_codec_matches_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = ["a  b\n c", " a ", "", None, "x　ｱ 日本語 \t\r\n{}\r\n z", "a" * 2000, "   ", "naïve 🙂 <s> <0x0A>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for units in (0, 1000):
        found = sentencepiece_codec.round_trip(df, sentencepiece_codec.load(PIECE_MODEL), dictionary_units=units)
        assert {r.doc_id: (list(r.ids), r.restored) for r in found.collect()} == {
            i: (library.encode(t or ""), True) for i, t in enumerate(texts)
        }


def test_unigram_folds_agree(spark):
    scores = {c: -5.0 for c in "▁abc"} | {"ab": -6.0, "bc": -5.5, "▁ab": -7.0, "abc": -13.0, "▁a": -8.0}
    pieces = sentencepiece_codec.Pieces(dict(zip(scores, range(9), strict=True)), scores, {}, 99, "unigram")
    texts = ["abc", "ab cab", "ccc bcbc", "abcabc ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def best(unit):
        if not unit:
            return 0.0
        return max((scores[unit[:n]] + best(unit[n:]) for n in range(1, 4) if unit[:n] in scores), default=-1e9)

    known = sentencepiece_codec.dictionary(df, pieces, 100, 24, min_count=1)
    by_id = {i: s for s, i in pieces.ids.items()}
    assert set(known) == {"▁abc", "▁ab", "▁cab", "▁ccc", "▁bcbc", "▁abcabc"}
    for unit, ids in known.items():
        assert "".join(by_id[i] for i in ids) == unit
        assert sum(scores[by_id[i]] for i in ids) == pytest.approx(best(unit))
        here = sentencepiece_codec.fold_unit(unit, pieces, 3)
        assert sum(scores[by_id[i]] for i in here) == pytest.approx(best(unit))


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        substring_dedup.digest(empty), suffix_array_dedup.digest(empty), line_dedup.digest(empty),
        simhash.near_duplicates(empty), simhash.clean(empty), sharding.shard_documents(empty),
        decontamination.contaminated(empty, bench), decontamination.clean(empty, bench),
        voronoi_topk.top_k(vectors, vectors), url_filter.judge(pages, labels),
        sentencepiece_codec.round_trip(empty, sentencepiece_codec.load(PIECE_MODEL)),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark, tmp_path, texts):
    """Each stage on odd rows and columns that bear the names that operators use inside."""
    clash = ["row", "d", "t", "f", "ids", "kept", "n", "lines", "score", "lang_pred"]
    df = spark.createDataFrame([(d, t, None if d == 6 else "en", "s", 1) for d, t in texts], DOCS)
    df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])
    spark.createDataFrame([(1, texts[4][1][:300])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, counts = df, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        counts.append(docs.count())
    # Null, empty and blank go; copies go (4 and 30 are one group, so are texts that lose their lines);
    # the long text holds the benchmark passage.
    assert counts[0] == counts[1] == len(texts) - 3
    assert counts[2] < counts[1]
    left = {r.doc_id for r in docs.collect()}
    assert not left & {1, 2, 3, 4, 30}
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in encoded} == left and all(r.restored for r in encoded)
