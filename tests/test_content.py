"""Prompts, answers, outcome folding, rule scan and recommendation texts."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillworks.functions import fixed_values as fv
from quillworks.operators import content as g

GOOD = {"repurposed_content": " Body text ", "caption": "cap", "hashtags": "#a #b"}
PLAIN = json.dumps(GOOD)

ANSWERS = {
    "plain": (PLAIN, "Body text"),
    "fenced": (f"```json\n{PLAIN}\n```", "Body text"),
    "fenced without language": (f"```\n{PLAIN}\n```  ", "Body text"),
    "text around": (f"Sure! {PLAIN} Anything else?", "Body text"),
    "nested braces": (json.dumps({**GOOD, "repurposed_content": "a {b} c"}), "a {b} c"),
    "line breaks": (json.dumps({**GOOD, "repurposed_content": "a\nb"}, indent=2), "a\nb"),
    "missing key": (json.dumps({"caption": "only"}), ""),
    "extra key": (json.dumps({**GOOD, "more": [1, {"x": None}]}), "Body text"),
    "null value": (json.dumps({**GOOD, "caption": None}), None),
    "number": (json.dumps({**GOOD, "caption": 3}), None),
    "list value": (json.dumps({**GOOD, "hashtags": ["#a"]}), None),
    "cut off": (PLAIN[:-5], None),
    "no JSON": ("I cannot do that.", None),
    "list": ("[1, 2]", None),
    "two objects": (f"{PLAIN} and {PLAIN}", None),
    "two objects in a row": (f"{PLAIN}, {PLAIN}", None),
    "stray bracket": (f"{PLAIN}], [{PLAIN}", None),
    "raw line break in a text": ('{"caption": "a\nb"}', None),
    "unquoted key": ("{caption: 1}", None),
    "single quotes": ("{'caption': 'x'}", None),
    "trailing comma": ('{"caption": "x",}', None),
    "escapes": ('{"caption": "\\u00e9 \\"q\\" \\n"}', ""),
    "empty": ("", None),
    "nothing": (None, None),
}


def reference_parse(answer):
    """The same steps with Python's own tools; None for a failed answer."""
    try:
        text = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", (answer or "").strip())).strip()
        found = re.search(r"\{.*\}", text, re.DOTALL)
        data = json.loads(found.group(0) if found else text)
        return [data.get(k, "").strip() for k in ("repurposed_content", "caption", "hashtags")]
    except Exception:
        return None


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(name, answer) for name, (answer, _) in ANSWERS.items()]
    df = g.parse_answers(spark.createDataFrame(rows, "name string, answer string"))
    return {r.name: r for r in df.collect()}


@pytest.mark.parametrize("name", ANSWERS)
def test_answer(parsed, name):
    answer, body = ANSWERS[name]
    row, want = parsed[name], reference_parse(answer)
    assert row.success == (body is not None) == (want is not None)
    assert [row.repurposed_content, row.caption, row.hashtags] == (want or ["", "", ""])
    assert (row.error is None) == row.success


def test_prompt_text(spark):
    drafts = spark.createDataFrame([("d1", "c1", "T", "C"), ("d2", "c9", "T2", "C2")], "draft_id string, client_id string, draft_title string, draft_content string")
    contexts = spark.createDataFrame(
        [("c1", "Acme", None, "calm", "", "slang", {"twitter": "@acme"})],
        "client_id string, brand_name string, industry string, brand_voice string, target_audience string,"
        " do_not_use string, social_handles map<string,string>",
    )
    requests = spark.createDataFrame([(1, "d1", "twitter, tiktok"), (2, "d2", "linkedin")], "request_id int, draft_id string, platforms string")
    rows = {(r.request_id, r.platform): r.prompt for r in g.prompts(requests, drafts, contexts).collect()}
    twitter = rows[1, "twitter"]
    assert "BRAND CONTEXT:\nBRAND NAME: Acme\nBRAND VOICE & TONE: calm\nAVOID THESE: slang\nTWITTER HANDLE: @acme\n\nORIGINAL TITLE: T\n" in twitter
    assert "PLATFORM INSTRUCTIONS: PLATFORM: TWITTER\nTONE: Sharp, direct" in twitter
    assert twitter.endswith('  "hashtags": "space-separated hashtags starting with #"\n}')
    tiktok = rows[1, "tiktok"]
    assert "PLATFORM: TIKTOK\nTONE: Warm, personal, and real" in tiktok and "HANDLE" not in tiktok
    assert "BRAND CONTEXT" not in rows[2, "linkedin"]
    assert fv.PROMPT_WRITING_RULES in twitter


def test_expand_keeps_order_and_repeats(rows):
    df = rows("request_id int, platforms string", (1, "a, b,,a"), (2, " , "))
    got = [(r.request_id, r.position, r.platform) for r in g.expand_platforms(df).collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "a")]


def test_outcomes(rows):
    results = rows(
        "request_id int, draft_id string, position int, success boolean, error string",
        (1, "d1", 0, True, None),
        (1, "d1", 1, False, "late"),
        (2, "d2", 1, False, None),
        (2, "d2", 0, False, "first"),
        (3, "d2", 0, False, "x"),
    )
    got = {r.request_id: r for r in g.fold_outcomes(results).collect()}
    assert (got[1].saved_posts, got[1].new_draft_status, got[1].error) == (1, "repurposed", None)
    assert (got[2].saved_posts, got[2].new_draft_status, got[2].error) == (0, None, "first; unknown error")
    drafts = rows("draft_id string, draft_status string", ("d1", "draft"), ("d2", "submitted"))
    after = {r.draft_id: r.draft_status for r in g.repurposed_drafts(drafts, g.fold_outcomes(results)).collect()}
    assert after == {"d1": "repurposed", "d2": "submitted"}


@pytest.mark.parametrize(
    ("text", "used"),
    [
        ("We leverage it.", "leverage"),
        ("Leveraged buyouts", ""),
        ("A Game-Changer!", "game-changer"),
        ("It’s no\n secret", "it's no secret"),
        ("dive\tdeep; at the end of the day", "dive deep; at the end of the day"),
        ("the end of day at the", ""),
        ("non-robust", ""),
        ("delve", "delve"),
        ("", ""),
    ],
)
def test_banned_phrases(rows, text, used):
    df = rows("platform string, generated_text string", ("youtube", text))
    assert g.house_rule_scan(df).first().banned_phrases == used


@pytest.mark.parametrize(
    ("platform", "text", "ok"),
    [
        ("facebook", "w " * 99, False),
        ("facebook", "w " * 100, True),
        ("facebook", "w " * 151, False),
        ("twitter", "x" * 239, True),
        ("twitter", "x" * 240, False),
        ("youtube", "", True),
    ],
)
def test_length_limits(rows, platform, text, ok):
    row = g.house_rule_scan(rows("platform string, generated_text string", (platform, text))).first()
    assert row.length_ok is ok
    assert row.words == len(text.split())


def test_hashtag_in_body(rows):
    df = rows("platform string, generated_text string", ("youtube", "a #b"), ("youtube", "a b"))
    assert [r.has_hashtag for r in g.house_rule_scan(df).collect()] == [True, False]


def test_recommendation_texts(rows):
    users = rows("user_id string", ("u1",), ("u2",))
    overview = rows("user_id string, total_posts long", ("u1", 3), ("u2", 0))
    platforms = rows(
        "user_id string, platform string, post_count long, likes long, comments long, shares long,"
        " avg_rate double, total long, mean_rate double",
        ("u1", "twitter", 2, 10, 1, 0, 4.5, 11, 4.5),
        ("u1", "linkedin", 1, 7, 0, 0, 5.0, 7, 5.0),
    )
    got = {r.user_id: r for r in g.recommendation_inputs(users, overview, platforms).collect()}
    assert got["u1"].best_platform == "linkedin"
    assert got["u1"].summary == (
        "- Linkedin: 1 posts, 5.0% avg engagement, 7 likes, 0 comments\n"
        "- Twitter: 2 posts, 4.5% avg engagement, 10 likes, 1 comments"
    )
    assert got["u1"].fallback_text.startswith("Focus on Linkedin next week")
    assert (got["u2"].best_platform, got["u2"].summary) == ("instagram", None)
    assert got["u2"].fallback_text == fv.STARTER_RECOMMENDATION


def test_rules_of_unknown_platform_are_the_default(rows):
    df = g.with_rules(rows("platform string", ("facebook",), ("youtube",), (None,)))
    got = [r.hashtag_count for r in df.orderBy(F.col("platform").asc_nulls_last()).collect()]
    assert got == ["3-4 broad hashtags", "8-10 relevant hashtags", "8-10 relevant hashtags"]


def test_answers_as_the_application_reads_them(spark):
    body = '"repurposed_content": "%s", "caption": "c", "hashtags": "h"'
    rows = [
        ("equal keys", '{"caption": "old", ' + body % "a" + "}"),
        ("NaN", '{"score": NaN, "more": [-Infinity, Infinity], ' + body % "a NaN, Infinity" + "}"),
        ("NaN as text", '{"repurposed_content": NaN}'),
        ("nested equal keys", '{"x": {"a": 1, "a": 2}, ' + body % "{b}" + "}"),
    ]
    got = {r.name: r for r in g.parse_answers(spark.createDataFrame(rows, "name string, answer string")).collect()}
    assert got["equal keys"].success and got["equal keys"].caption == "c"
    assert got["NaN"].success and got["NaN"].repurposed_content == "a NaN, Infinity"
    assert not got["NaN as text"].success
    assert got["nested equal keys"].success and got["nested equal keys"].repurposed_content == "{b}"


def test_phrases_do_not_cross_sentences(spark):
    texts = ["We will dive. Deep water", "Dive  deep - a game changer", "It’s no secret", None]
    df = spark.createDataFrame([(t, "linkedin") for t in texts], "generated_text string, platform string")
    found = [r.banned_phrases for r in g.house_rule_scan(df).collect()]
    assert found == ["", "game-changer; dive deep", "it's no secret", ""]


def test_refused_generation_requests(spark):
    rows = [(1, "u", "d", "twitter"), (2, "u", "d", " , "), (3, "u", "x", "twitter"), (4, "v", "d", "twitter"), (5, "u", "d", None)]
    requests = spark.createDataFrame(rows, "request_id long, user_id string, draft_id string, platforms string")
    drafts = spark.createDataFrame([("d", "u")], "draft_id string, created_by string")
    decided = g.generation_requests(requests, drafts).decided
    assert {r.request_id: r.reason for r in decided.collect()} == {
        1: None, 2: "no_platform", 3: "not_found", 4: "forbidden", 5: "no_platform",
    }


LETTERS = set("abcdefghijklmnopqrstuvwxyz0123456789'-")
GAPS = set(" \t\n\x0b\f\r-")


def phrases_letter_by_letter(text):
    """Phrases of a text, found without patterns: word after word from every place."""
    text = text.lower().replace("\u2019", "'")
    found = []
    for phrase in fv.BANNED_PHRASES:
        words = phrase.replace("-", " ").split(" ")
        for start in range(len(text)):
            at, ok = start, start == 0 or text[start - 1] not in LETTERS
            for i, word in enumerate(words):
                if i:
                    begin = at
                    while at < len(text) and text[at] in GAPS:
                        at += 1
                    ok = ok and at > begin
                ok = ok and text.startswith(word, at)
                at += len(word)
            if ok and (at >= len(text) or text[at] not in LETTERS):
                found.append(phrase)
                break
    return "; ".join(found)


def test_phrases_found_through_the_word_index(rows):
    rng = random.Random(11)
    words = sorted({w for p in fv.BANNED_PHRASES for w in p.replace("-", " ").split(" ")})
    texts = [""]
    for _ in range(600):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            kind = rng.random()
            part = rng.choice(fv.BANNED_PHRASES) if kind < 0.5 else rng.choice(words) if kind < 0.8 else rng.choice(["é", "x", "Robust", "IT\u2019S"])
            part = part.replace(" ", rng.choice([" ", "  ", "-", " - ", "\n", ", "]))
            parts.append(rng.choice([part, part, part.upper(), part + "s", "re" + part]))
        texts.append("".join(p + rng.choice([" ", " ", ". ", "-", "'", "", "é", "\t"]) for p in parts))
    table = rows("id int, platform string, generated_text string", *((i, "x", t) for i, t in enumerate(texts)))
    got = {r.id: r.banned_phrases for r in g.house_rule_scan(table).collect()}
    assert got == {i: phrases_letter_by_letter(t) for i, t in enumerate(texts)}
    assert sum(used != "" for used in got.values()) > 200


def test_a_generation_run_from_request_to_draft(rows):
    drafts = rows("draft_id int, created_by int, draft_status string", (1, 7, "draft"), (2, 7, "draft"), (3, 8, "submitted"))
    requests = rows(
        "request_id int, user_id int, draft_id int, platforms string",
        (10, 7, 1, "instagram, twitter"), (11, 7, 2, "tiktok,instagram"), (12, 7, 3, "instagram"), (13, 8, 3, " , "),
    )
    good = json.dumps({"repurposed_content": " text ", "caption": "c", "hashtags": "#a"})
    answers = rows(
        "draft_id int, platform string, answer string",
        (1, "instagram", good), (1, "twitter", "no json"), (2, "tiktok", '{"caption": 5}'), (3, "instagram", good),
    )
    decided, texts, outcomes, after = g.generation_run(requests, drafts, answers)
    assert {r.request_id: r.reason for r in decided.collect()} == {10: None, 11: None, 12: "forbidden", 13: "no_platform"}
    assert {(r.draft_id, r.platform): r.repurposed_content for r in texts.filter("success").collect()} == {(1, "instagram"): "text"}
    errors = {r.request_id: (r.saved_posts, r.error) for r in outcomes.collect()}
    assert errors == {10: (1, None), 11: (0, "not a text: caption; no answer for instagram")}
    assert {r.draft_id: r.draft_status for r in after.collect()} == {1: "repurposed", 2: "draft", 3: "submitted"}
