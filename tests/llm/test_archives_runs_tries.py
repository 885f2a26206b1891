"""WARC archives, periodic runs and prefix tries against brute force, and their edge cases."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quillworks.llm import periodic_runs, prefix_trie, queries, warc_zstd

PAGES = "page_id long, url string, html string"
TURNS = "conv_id long, turn long, role string, text string"


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is not None, x) for x in r])


# Periodic runs


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            begin = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - begin + q
            if length >= max(6, 4 * q) and i > begin:
                found.setdefault((begin, length), q)
            i = max(i, begin + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng, size):
    """Blocks of all lengths, repeated and nested, over a few letters."""
    out = []
    while len(out) < size:
        block = [f"w{rng.randrange(rng.choice([2, 3, 200]))}" for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 13, 16, 17, 33, 64, 100]))]
        if rng.random() < 0.3:
            block = block * rng.randrange(1, 6) + block[: rng.randrange(len(block))]
        out += block * rng.choice([1, 1, 3, 4, 5]) + block[: rng.randrange(len(block))]
    return out


def test_runs_equal_brute_force(rows):
    rng = random.Random(3)
    texts = [repetitive(rng, rng.choice([5, 20, 60, 300, 900])) for _ in range(80)]
    texts += [["a"] * n for n in (5, 6, 7, 200)] + [list("ab" * 40 + "c" + "ab" * 40)]
    table = rows("doc_id long, text string", *((i, " \t".join(words)) for i, words in enumerate(texts)))
    found = {r.doc_id: r for r in periodic_runs.find_runs(table).collect()}
    assert len(found) == len(texts)
    long_periods = 0
    for i, words in enumerate(texts):
        expected = brute_runs(words)
        long_periods += sum(q > periodic_runs.SHORT for _, _, q in expected)
        assert [tuple(r) for r in found[i].runs] == expected, i
        assert found[i].collapsed == brute_collapsed(words, expected)
        assert found[i].n_words == len(words)
    assert long_periods > 50


def test_every_period_is_found_at_its_least_length():
    rng = np.random.default_rng(1)
    for q in [*range(1, 70), 127, 128, 129, 200]:
        block = rng.integers(10, 10_000, q)
        length = max(6, 4 * q)
        inside = np.resize(block, length)
        for before in (0, 1, 5, 37):
            ids = np.concatenate([rng.integers(10**6, 10**7, before), inside, rng.integers(10**8, 10**9, 41)])
            assert (before, length, q) in [tuple(r) for r in periodic_runs.runs_of(ids, len(ids)).tolist()]


def test_runs_edge_cases(rows, spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK_WORDS", 50)
    long = " ".join(["x", "y", "z"] * 30_000)
    table = rows(
        "doc_id long, text string, runs string, n_words int",
        (1, None, "a", 1),
        (2, "", "a", 1),
        (3, " \t\n\x0b\f\r ", "a", 1),
        (None, "a " * 8, "a", 1),
        (4, "a " * 8, "a", 1),
        (4, "a " * 8, "a", 1),
        (5, long, "a", 1),
        (6, "  é é é é é é é", "a", 1),
    )
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(table).collect()]
    expected = [
        (1, 0, [], ""),
        (2, 0, [], ""),
        (3, 0, [], ""),
        (None, 8, [(0, 8, 1)], "a"),
        (4, 8, [(0, 8, 1)], "a"),
        (4, 8, [(0, 8, 1)], "a"),
        (5, 90_000, [(0, 90_000, 3)], "x y z"),
        (6, 7, [], "  é é é é é é é"),
    ]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert periodic_runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_planted_text_repeats_the_end(rows):
    texts = [(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(400)] + [(None, "a b"), (7, None)]
    table = rows("doc_id long, text string", *texts)
    got = {r.doc_id: r.text for r in table.select("doc_id", queries.planted_text().alias("text")).collect() if r.doc_id != 7}
    planted = 0
    for doc_id, text in texts:
        if doc_id in (None, 7):
            continue
        words, h = text.split(), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
            planted += 1
        assert got[doc_id] == text
    assert planted > 10 and got[None] == "a b"


# WARC archives


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(8)
    def html():
        return "<html><body class='main'>" + " ".join(f"<p>word{rng.randrange(300)}</p>" for _ in range(80)) + "</body></html>"

    rows = [(i, f"http://host.example/{i}", html()) for i in range(300)]
    common = html()
    rows += [(i, f"http://copy.example/{i}", common) for i in range(1000, 1200)]
    rows += [(2000, None, None), (2001, "http://e.example/", ""), (2002, "a\r\nWARC-Type: b c", "x\r\n\r\nWARC/1.1\r\n")]
    rows += [(None, "http://n.example/", common), (None, None, "only without an id"), (None, None, "only without an id")]
    rows += [(1000, "http://again.example/", common), (3000, "é", "é" * 100_000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, PAGES), rows


def brute_records(rows, min_bytes=0):
    first = {}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        known = first.get(payload)
        first[payload] = page_id if known is None else known if page_id is None else min(known, page_id)
    for page_id, url, html in rows:
        payload = (html or "").encode()
        revisit = len(payload) >= min_bytes and first[payload] != page_id
        kind = "revisit" if revisit else "response"
        yield page_id, len(payload), warc_zstd.payload_digest(payload), kind, first[payload] if revisit else None


@pytest.mark.parametrize("min_bytes", [0, 50, 3000])
def test_archives_read_back_what_was_written(pages, min_bytes):
    table, rows = pages
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    got = plain(warc_zstd.round_trip(table, min_bytes), *columns)
    assert got == sorted(brute_records(rows, min_bytes), key=lambda r: [(x is not None, x) for x in r])


@pytest.fixture(scope="module")
def archives(spark, pages, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc") / "out")
    warc_zstd.write_archives(pages[0].coalesce(2), folder, archive_bytes=200_000, dictionary_bytes=4096)
    return folder


def test_payloads_urls_and_frames(spark, pages, archives):
    read = warc_zstd.read_archives(spark, archives).collect()
    assert len(read) == len(pages[1]) and not any(r.problem for r in read)
    responses = {(r.page_id, bytes(r.payload)) for r in read if r.record_type == "response"}
    for page_id, url, html in pages[1]:
        payload = (html or "").encode()
        copies = {p for p in responses if p[1] == payload}
        assert len(copies) == 1
    assert {r.target_uri for r in read if r.page_id == 2002} == {"a%0D%0AWARC-Type:%20b%20c"}
    assert {r.target_uri for r in read if r.page_id == 2000} == {None}
    files = spark.read.format("binaryFile").load(archives).collect()
    assert len(files) > 2
    with_dictionary = 0
    for file in files:
        content = bytes(file.content)
        dictionary, at = warc_zstd.leading_dictionary(memoryview(content))
        with_dictionary += dictionary is not None
        found = [at for at, _ in warc_zstd.parse_archive(content)]
        assert len(found) == sum(r.archive == file.path for r in read)
        if dictionary is not None:
            # The dictionary is needed, and each frame stands alone.
            last = memoryview(content)[found[-1] : warc_zstd.frame_end(memoryview(content), found[-1])]
            with pytest.raises(zstandard.ZstdError):
                zstandard.ZstdDecompressor().decompress(last)
            whole = zstandard.ZstdDecompressor(dict_data=dictionary).decompress(last)
            assert whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")
    assert with_dictionary > 1


def record(**changes):
    text = warc_zstd.build_record(5, "http://a.example/", b"<p>payload</p>", None, "2020-01-01T00:00:00Z")
    for old, new in changes.values():
        assert old in text
        text = text.replace(old, new)
    return text


@pytest.mark.parametrize(
    ("old", "new", "reason"),
    [
        (b"WARC/1.1", b"WARC/9.9", "version"),
        (b"WARC-Type: response\r\n", b"", "WARC-Type missing"),
        (b"WARC-Date: 2020-01-01T00:00:00Z\r\n", b"", "WARC-Date missing"),
        (b"msgtype=response\r\nContent-Length: 9", b"msgtype=response\r\nContent-Length: 8", "block of another length"),
        (b"msgtype=response\r\nContent-Length: 9", b"msgtype=response\r\nContent-Length: x", "no number"),
        (b"<p>payload</p>", b"<p>pay1oad</p>", "WARC-Block-Digest"),
        (b"WARC-Record-ID:", b"WARC-Type: x\r\nWARC-Record-ID:", "twice"),
        (b"WARC-Target-URI: ", b"nothing ", "without a header"),
        (b"</p>\r\n\r\n", b"</p>\r\n", "block of another length"),
    ],
)
def test_broken_records_are_named(old, new, reason):
    with pytest.raises(warc_zstd.Damaged, match=reason):
        warc_zstd.parse_record(record(x=(old, new)))


def test_http_lengths_and_payload_digest_are_checked():
    def with_block(block, kind="response", extra=""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Date: d\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    sound = warc_zstd.parse_record(with_block(b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc", extra="X-Long: a\r\n b\r\n"))
    assert (sound["page_id"], sound["payload_bytes"], sound["payload"]) == (None, 3, b"abc")
    assert warc_zstd.parse_record(with_block(b"anything", "warcinfo"))["record_type"] == "warcinfo"
    for block, kind, extra, reason in [
        (b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nabc", "response", "", "payload of another length"),
        (b"abc", "response", "", "no HTTP header"),
        (b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc", "revisit", "", "revisit with a payload"),
        (b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n", "revisit", "", "Refers-To missing"),
        (b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc", "response", "WARC-Payload-Digest: sha1:AAAA\r\n", "Payload-Digest"),
    ]:
        with pytest.raises(warc_zstd.Damaged, match=reason):
            warc_zstd.parse_record(with_block(block, kind, extra))


def test_damage_stays_in_its_record():
    records = [
        warc_zstd.build_record(i, None, f"{i} {'page of a site ' * 40}{i * 7919}".encode() * 3, None, "d") for i in range(200)
    ]
    archive = warc_zstd.build_archive(records, 1024)
    assert int.from_bytes(archive[:4], "little") == warc_zstd.DICTIONARY_FRAME
    places = [at for at, fields in warc_zstd.parse_archive(archive)]
    assert len(places) == 200
    # A wrong byte inside a frame, found by its checksum or its digests.
    spoilt = bytearray(archive)
    spoilt[places[50] - 3] ^= 255
    fields = [f for _, f in warc_zstd.parse_archive(bytes(spoilt))]
    assert len(fields) == 200 and [i for i, f in enumerate(fields) if f.get("problem")] == [49]
    # Cut short: the last one is named.
    fields = [f for _, f in warc_zstd.parse_archive(archive[: places[120] + 9])]
    assert len(fields) == 121 and "cut short" in fields[-1]["problem"]
    # Other skippable frames are passed over; a packed dictionary is unpacked; no dictionary at all is allowed.
    skipped = archive[: places[0]] + struct.pack("<II", 0x184D2A55, 3) + b"abc" + archive[places[0] :]
    assert [f["page_id"] for _, f in warc_zstd.parse_archive(skipped)] == list(range(200))
    raw = archive[8 : places[0]]
    packed = zstandard.ZstdCompressor().compress(raw)
    again = struct.pack("<II", warc_zstd.DICTIONARY_FRAME, len(packed)) + packed + archive[places[0] :]
    assert [f["page_id"] for _, f in warc_zstd.parse_archive(again)] == list(range(200))
    few = warc_zstd.build_archive(records[:2])
    assert int.from_bytes(few[:4], "little") == warc_zstd.ZSTD_FRAME
    assert [f["page_id"] for _, f in warc_zstd.parse_archive(few)] == [0, 1]
    # Another dictionary than the one it was packed with.
    wrong = struct.pack("<II", warc_zstd.DICTIONARY_FRAME, 5) + b"abcde" + archive[places[0] :]
    assert all(f.get("problem") for _, f in warc_zstd.parse_archive(wrong))
    # A frame with two records.
    two = zstandard.ZstdCompressor().compress(records[0] + records[1])
    assert [f["problem"] for _, f in warc_zstd.parse_archive(two)] == ["block of another length than Content-Length"]
    # A frame that does not tell its size.
    stream = zstandard.ZstdCompressor().compressobj()
    unsized = stream.compress(records[3]) + stream.flush()
    assert [f["page_id"] for _, f in warc_zstd.parse_archive(unsized)] == [3]
    assert list(warc_zstd.parse_archive(b"")) == []
    assert "no frame" in next(warc_zstd.parse_archive(b"plain text of no format"))[1]["problem"]


def test_a_damaged_archive_stops_the_round_trip_but_not_the_reader(spark, archives, tmp_path):
    first = spark.read.format("binaryFile").load(archives).orderBy("path").first()
    content = bytearray(first.content)
    content[len(content) // 2] ^= 255
    folder = tmp_path / "spoilt"
    folder.mkdir()
    (folder / "part-0").write_bytes(bytes(content))
    (folder / "_SUCCESS").write_bytes(b"")
    read = warc_zstd.read_archives(spark, str(folder)).collect()
    assert sum(r.problem is not None for r in read) >= 1 and sum(r.problem is None for r in read) > 5


def test_warc_edge_cases(spark, rows):
    assert warc_zstd.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    clashing = "page_id long, url string, html string, digest string, first long, n int, revisit string, problem string"
    table = rows(clashing, (1, "u", "a", "d", 4, 1, "r", "p"), (2, "u", "a", "d", 4, 1, "r", "p"))
    got = plain(warc_zstd.round_trip(table), "page_id", "record_type", "refers_to")
    assert got == [(1, "response", None), (2, "revisit", 1)]


# Prefix tries


def brute_trie(conversations):
    """Rows of the contract for {conv_id: [(role, text), …]}."""
    members = {}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[c] for c in below) if below else 1
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        saved[path] = own + sum(saved[c] for c in below)
    for path, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(conversations[c]) == len(path))))
        yield (
            min(convs),
            len(path),
            min(members[path[:-1]]) if path else None,
            len(convs),
            len(children.get(path, [])),
            leaves[path],
            saved[path],
            hashlib.sha256(ends.encode()).hexdigest(),
        )


def in_order(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


def conversation_rows(conversations):
    return [(c, i, role, text) for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]


@pytest.fixture(scope="module")
def branching():
    """Long shared spines, copies by the hundred, prefixes of others, singles."""
    rng = random.Random(12)
    stem = [("user" if i % 2 else "system", f"stem {i}" * (i % 3)) for i in range(60)]
    found = {}
    for c in range(-30, 900):
        kind = rng.randrange(6)
        if kind == 0:
            turns = stem[: rng.randrange(1, 60)]
        elif kind == 1:
            turns = stem[:7]
        elif kind == 2:
            turns = [("user", f"q{rng.randrange(4)}") for _ in range(rng.randrange(1, 6))]
        elif kind == 3:
            turns = stem[: rng.randrange(60)] + [("user", f"end {rng.randrange(3)}")]
        elif kind == 4:
            turns = [("user", f"single {c}"), ("assistant", "é" * (c % 5 + 1))]
        else:
            turns = [("user", "hello"), ("assistant", "hi")]
        found[c] = turns or [("", "")]
    return found


@pytest.mark.parametrize(("block_turns", "fan_in"), [(10**5, 256), (40, 2), (300, 3)])
def test_trie_equals_brute_force(spark, branching, block_turns, fan_in):
    table = spark.createDataFrame(conversation_rows(branching), TURNS)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.build(prefix_trie.turn_paths(table), block_turns, fan_in).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert in_order(map(tuple, got)) == in_order(brute_trie(branching))


def test_chunks_of_identifiers_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    conversations = {c: [("user", "same"), ("assistant", "same")][: 1 + (c % 9 > 0)] for c in range(-200, 2000)}
    table = spark.createDataFrame(conversation_rows(conversations), TURNS)
    got = prefix_trie.build(prefix_trie.turn_paths(table), 50).collect()
    assert in_order(map(tuple, got)) == in_order(brute_trie(conversations))


def test_parentheses_against_a_stack():
    rng = random.Random(2)
    for _ in range(200):
        opens, depth, left = [True], 1, rng.randrange(1, 120)
        while depth:
            if left and rng.random() < rng.choice([0.3, 0.5, 0.9]):
                opens.append(True)
                depth, left = depth + 1, left - 1
            else:
                opens.append(False)
                depth -= 1
        stack, close, leaves = [], {}, []
        for at, is_open in enumerate(opens):
            if is_open:
                stack.append(at)
            else:
                close[stack.pop()] = at
        for at in close:
            leaves.append(sum(opens[i] and not opens[i + 1] for i in range(at, close[at])))
        excess = prefix_trie.Excess(np.array(opens))
        starts = np.array([*close])
        assert excess.find_close(starts).tolist() == [close[s] for s in starts.tolist()]
        assert excess.leaf_rank(starts, np.array([*close.values()])).tolist() == leaves


def test_trie_edge_cases(spark, rows):
    assert prefix_trie.build(prefix_trie.turn_paths(spark.createDataFrame([], TURNS))).count() == 0
    clashing = "conv_id long, turn long, role string, text string, depth int, path string, kind string, n_convs int"
    extra = (1, "p", "k", 5)
    table = rows(
        clashing,
        (1, None, None, "first", *extra),
        (1, 0, "user", None, *extra),
        (1, 0, "user", None, *extra),  # a repeated row is a turn
        (1, 0, "assistant", "tie", *extra),
        (2, 3, "", "first", *extra),
        (2, 9, "assistant", "tie", *extra),
        (None, 0, "user", "nobody's", *extra),
        (3, 0, "user", "long " * 100_000, *extra),
    )
    expected = {
        1: [("", "first"), ("assistant", "tie"), ("user", ""), ("user", "")],
        2: [("", "first"), ("assistant", "tie")],
        3: [("user", "long " * 100_000)],
    }
    got = prefix_trie.build(prefix_trie.turn_paths(table)).collect()
    assert in_order(map(tuple, got)) == in_order(brute_trie(expected))


def test_shared_heads_and_turnless_conversations(spark, rows):
    """The registered query on ids around a hundred, with absent bases."""
    rng = random.Random(4)
    conversations = {}
    for c in [*range(0, 12), *range(95, 130), *range(401, 420), -5, -101, -203]:
        turns = [("user", f"t{rng.randrange(3)}") for _ in range(rng.randrange(1, 8))]
        conversations[c] = turns
    rebuilt = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        rebuilt[c] = conversations.get(base, [])[:h] + turns[h:]
    assert any(not turns for turns in rebuilt.values())
    table = rows(TURNS, *conversation_rows(conversations))
    paths = prefix_trie.turn_paths(table)
    heads = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % 100
    joined = prefix_trie.with_shared_heads(paths, heads, base, F.col("conv_id") % 100 == 0, most=5)
    assert in_order(map(tuple, prefix_trie.build(joined).collect())) == in_order(brute_trie(rebuilt))
