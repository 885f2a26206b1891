"""Prompt, answer and recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillworks.functions import fixed_values as fv
from quillworks.functions.answers import FIELDS
from quillworks.operators import brands as b
from quillworks.operators import content as g
from quillworks.operators import engagement as e
from quillworks.plans.outcome import written
from quillworks.registry.checks import check, quoted, shown, stripped
from quillworks.registry.engagement_checks import ALL, PLATFORM_ROWS

EXPANDED = """
lists AS (SELECT *, [trim(x) FOR x IN string_split(platforms, ',') IF trim(x) <> ''] AS items
          FROM platform_requests),
expanded AS (SELECT request_id, draft_id, user_id, unnest(items) AS platform,
                    unnest(range(len(items))) AS position FROM lists)
"""


@check(
    "j13_platform_expansion",
    "platform_requests",
    sql=f"WITH {EXPANDED} SELECT * FROM expanded",
)
def j13(t):
    return g.expand_platforms(t.platform_requests)


RULES_SQL = (
    "rules(platform, tone, format, storytelling, hashtag_count) AS (VALUES "
    + ", ".join(
        "(" + ", ".join(quoted(x) for x in (name, r["tone"], r["format"], r["storytelling"], r["hashtag_count"])) + ")"
        for name, r in fv.PLATFORM_RULES.items()
    )
    + ")"
)
RULED = f"""
{RULES_SQL},
ruled AS (
  SELECT e.*, COALESCE(r.tone, d.tone) AS tone, COALESCE(r.format, d.format) AS format,
         COALESCE(r.storytelling, d.storytelling) AS storytelling,
         COALESCE(r.hashtag_count, d.hashtag_count) AS hashtag_count
  FROM expanded e LEFT JOIN rules r ON r.platform = e.platform
  JOIN rules d ON d.platform = 'instagram')
"""


@check("j14_rule_lookup", "platform_requests", sql=f"WITH {EXPANDED}, {RULED} SELECT * FROM ruled")
def j14(t):
    return g.with_rules(g.expand_platforms(t.platform_requests))


HANDLES = """
handles AS (
  SELECT client_id, string_agg(concat(platform, '=', account_name), '; ' ORDER BY platform) AS handles
  FROM social_accounts WHERE connected_status = 1 GROUP BY client_id)
"""


@check(
    "g2_brand_context",
    "clients",
    "social_accounts",
    sql=f"""
WITH {HANDLES}
SELECT c.client_id, c.client_name AS brand_name, c.industry, c.brand_voice, c.target_audience, c.do_not_use,
       COALESCE(h.handles, '') AS handles
FROM clients c LEFT JOIN handles h ON h.client_id = c.client_id""",
)
def g2(t):
    context = b.brand_context(t.clients, t.social_accounts)
    return context.withColumn("handles", b.handle_text(F.col("social_handles"))).drop("social_handles")


def _line(label: str, column: str) -> str:
    return f"CASE WHEN {column} <> '' THEN concat('{label}: ', {column}) END"


@check(
    "g1_prompts",
    "platform_requests",
    "content_drafts",
    "clients",
    "social_accounts",
    sql=f"""
WITH {EXPANDED}, {RULED},
branded AS (
  SELECT r.*, cd.draft_title, cd.draft_content, concat_ws(chr(10),
           {_line("BRAND NAME", "c.client_name")}, {_line("INDUSTRY", "c.industry")},
           {_line("BRAND VOICE & TONE", "c.brand_voice")}, {_line("TARGET AUDIENCE", "c.target_audience")},
           {_line("AVOID THESE", "c.do_not_use")},
           CASE WHEN a.account_name <> '' THEN concat(upper(r.platform), ' HANDLE: ', a.account_name) END) AS lines
  FROM ruled r JOIN content_drafts cd ON cd.draft_id = r.draft_id
  LEFT JOIN clients c ON c.client_id = cd.client_id
  LEFT JOIN social_accounts a ON a.client_id = cd.client_id AND a.platform = r.platform AND a.connected_status = 1)
SELECT request_id, draft_id, position, platform, concat(
  {quoted(fv.PROMPT_OPENING)}, CASE WHEN lines = '' THEN '' ELSE concat('BRAND CONTEXT:', chr(10), lines, chr(10), chr(10)) END,
  'ORIGINAL TITLE: ', draft_title, chr(10), 'ORIGINAL CONTENT: ', draft_content, chr(10), chr(10),
  'PLATFORM INSTRUCTIONS: PLATFORM: ', upper(platform), chr(10), 'TONE: ', tone, chr(10), 'FORMAT: ', format, chr(10),
  'STORYTELLING: ', storytelling, chr(10), 'HASHTAGS: Generate exactly ', hashtag_count,
  ' — put them ONLY in the hashtags field, never in the post body.', chr(10), chr(10), chr(10),
  {quoted(fv.PROMPT_WRITING_RULES)}, chr(10), chr(10), {quoted(fv.PROMPT_CLOSING)}) AS prompt
FROM branded""",
)
def g1(t):
    context = b.brand_context(t.clients, t.social_accounts)
    return g.prompts(t.platform_requests, t.content_drafts, context)


def answers(t):
    """Answers of every kind made from whole conversation turns; all need parsing."""
    fields = F.to_json(
        F.struct(
            F.col("text").alias("repurposed_content"),
            F.lit(" first line ").alias("caption"),
            F.lit("#one #two").alias("hashtags"),
        )
    )
    kind = (F.col("conv_id") + F.col("turn")) % 6
    answer = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), fields, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("Here it is: "), fields, F.lit(" Enjoy.")))
        .when(kind == 2, F.concat(F.lit("  "), F.to_json(F.struct(F.col("text").alias("caption"))), F.lit("\n")))
        # A number where a text should be, and an answer that breaks off.
        .when(
            kind == 3,
            F.to_json(
                F.struct(
                    F.char_length("text").alias("repurposed_content"),
                    F.col("text").alias("caption"),
                    F.col("role").alias("hashtags"),
                )
            ),
        )
        .when(kind == 4, F.substring(fields, F.lit(1), F.char_length(fields) - 25))
        .otherwise(F.col("text"))
    )
    return t.source("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        F.lit(0).alias("position"),
        F.col("conv_id").alias("draft_id"),
        F.lit("instagram").alias("platform"),
        answer.alias("answer"),
    )


def _json_field(name: str) -> str:
    return f"CASE WHEN error IS NULL THEN COALESCE({stripped(f"json_extract_string(part, '$.{name}')")}, '') ELSE '' END AS {name}"


# The same answers, read with the JSON functions of the other engine.
PARSED = f"""
fields AS (
  SELECT *, (conv_id + turn) % 6 AS kind, CAST(to_json(struct_pack(
           repurposed_content := text, caption := ' first line ', hashtags := '#one #two')) AS VARCHAR) AS fields
  FROM conversations),
answers AS (
  SELECT conv_id * 1000 + turn AS request_id, conv_id AS draft_id,
         CASE kind WHEN 0 THEN concat('```json', chr(10), fields, chr(10), '```')
                   WHEN 1 THEN concat('Here it is: ', fields, ' Enjoy.')
                   WHEN 2 THEN concat('  ', CAST(to_json(struct_pack(caption := text)) AS VARCHAR), chr(10))
                   WHEN 3 THEN CAST(to_json(struct_pack(repurposed_content := length(text), caption := text, hashtags := role)) AS VARCHAR)
                   WHEN 4 THEN substring(fields, 1, length(fields) - 25) ELSE text END AS answer
  FROM fields),
bared AS (
  SELECT *, {stripped("regexp_replace(regexp_replace(" + stripped("answer") + ", '^```(?:json)?', ''), '```$', '')")} AS bare FROM answers),
cut AS (SELECT *, COALESCE(NULLIF(regexp_extract(bare, '(?s)\\{{.*\\}}'), ''), bare) AS part FROM bared),
typed AS (SELECT *, json_valid(part) AS valid FROM cut),
judged AS (
  SELECT * REPLACE (CASE WHEN valid THEN part END AS part),
         concat_ws(', ', {", ".join(f"CASE WHEN json_type(CASE WHEN valid THEN part END, '$.{f}') <> 'VARCHAR' THEN '{f}' END" for f in FIELDS)}) AS wrong
  FROM typed),
failed AS (
  SELECT *, CASE WHEN NOT valid THEN 'answer is not valid JSON' WHEN json_type(part) <> 'OBJECT' THEN 'answer is not a JSON object'
                 WHEN wrong <> '' THEN concat('not a text: ', wrong) END AS error
  FROM judged),
parsed AS (
  SELECT request_id, 0 AS position, draft_id, 'instagram' AS platform, {", ".join(map(_json_field, FIELDS))},
         error IS NULL AS success, error
  FROM failed)
"""


@check("g3_parsed_answers", sql=f"WITH {PARSED} SELECT * FROM parsed")
def g3(t):
    return g.parse_answers(answers(t))


def results(t):
    """Outcome of every requested platform; whole requests fail for some drafts."""
    rows = g.expand_platforms(t.platform_requests)
    failed = (F.col("draft_id") % 3 == 0) | ((F.col("draft_id") + F.col("position")) % 4 == 0)
    error = F.when(
        failed & (F.col("position") != 1), F.concat(F.lit("no answer for "), F.col("platform"))
    )
    return rows.withColumns({"success": ~failed, "error": error})


OUTCOMES = f"""
{EXPANDED},
results AS (
  SELECT *, NOT (draft_id % 3 = 0 OR (draft_id + position) % 4 = 0) AS success,
         CASE WHEN position <> 1 THEN concat('no answer for ', platform) ELSE 'unknown error' END AS error
  FROM expanded),
outcomes AS (
  SELECT request_id, draft_id, count(*) FILTER (success) AS saved_posts,
         CASE WHEN count(*) FILTER (success) > 0 THEN 'repurposed' END AS new_draft_status,
         CASE WHEN count(*) FILTER (success) = 0
              THEN string_agg(error, '; ' ORDER BY position) FILTER (NOT success) END AS error
  FROM results GROUP BY request_id, draft_id)
"""


@check("g4_outcome_fold", "platform_requests", sql=f"WITH {OUTCOMES} SELECT * FROM outcomes")
def g4(t):
    return g.fold_outcomes(results(t))


@check(
    "g4_repurposed_drafts",
    "platform_requests",
    "content_drafts",
    sql=f"""
WITH {OUTCOMES}
SELECT draft_id, client_id, created_by, draft_title, draft_content,
       CASE WHEN draft_id IN (SELECT draft_id FROM outcomes WHERE saved_posts > 0) THEN 'repurposed'
            ELSE draft_status END AS draft_status, CAST(created_at AS VARCHAR) AS created_at
FROM content_drafts""",
)
def g4_drafts(t):
    return g.repurposed_drafts(t.content_drafts, g.fold_outcomes(results(t)))


def _run(t):
    # Whose answer is asked for by platform: a turn is the answer for one.
    names = ["instagram", "linkedin", "facebook", "twitter", "tiktok", "youtube"]
    turns = t.source("conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"))
    number = F.col("turn").cast("int")
    platform = F.coalesce(F.get(F.array(*map(F.lit, names)), number), F.concat(F.lit("channel "), F.col("turn").cast("string")))
    given = answers(t).select("request_id", "draft_id", "answer").join(turns.select("request_id", platform.alias("platform")), "request_id")
    requests = t.platform_requests
    return g.generation_run(requests, t.content_drafts, given.drop("request_id"), stage=written)


RUN = f"""
{EXPANDED}, {PARSED},
given AS (
  SELECT draft_id, COALESCE(['instagram', 'linkedin', 'facebook', 'twitter', 'tiktok', 'youtube'][1 + request_id % 1000],
         concat('channel ', request_id % 1000)) AS platform, success, error FROM parsed),
results AS (
  SELECT e.request_id, e.draft_id, e.position, e.platform, COALESCE(a.success, false) AS success,
         CASE WHEN a.draft_id IS NULL THEN concat('no answer for ', e.platform) ELSE a.error END AS error
  FROM expanded e JOIN content_drafts cd ON cd.draft_id = e.draft_id AND cd.created_by = e.user_id
  LEFT JOIN given a ON a.draft_id = e.draft_id AND a.platform = e.platform),
outcomes AS (
  SELECT request_id, draft_id, count(*) FILTER (success) AS saved_posts,
         CASE WHEN count(*) FILTER (success) > 0 THEN 'repurposed' END AS new_draft_status,
         CASE WHEN count(*) FILTER (success) = 0
              THEN string_agg(error, '; ' ORDER BY position) FILTER (NOT success) END AS error
  FROM results GROUP BY request_id, draft_id)
"""


@check("g4_generation_run", "platform_requests", "content_drafts", sql=f"WITH {RUN} SELECT * FROM outcomes")
def g4_run(t):
    return _run(t)[2]


@check(
    "g4_drafts_after_generation_run",
    "platform_requests",
    "content_drafts",
    sql=f"""
WITH {RUN}
SELECT draft_id, client_id, created_by, draft_title, draft_content,
       CASE WHEN draft_id IN (SELECT draft_id FROM outcomes WHERE saved_posts > 0) THEN 'repurposed'
            ELSE draft_status END AS draft_status, CAST(created_at AS VARCHAR) AS created_at
FROM content_drafts""",
)
def g4_run_drafts(t):
    return _run(t)[3]


def _phrases(text: str) -> str:
    words = f"lower(replace({text}, '’', ''''))"
    edge, gap = "[^a-z0-9''-]", "[\\s-]+"
    hits = ", ".join(
        f"CASE WHEN regexp_matches(w, '(^|{edge}){gap.join(quoted(p)[1:-1].replace('-', ' ').split(' '))}($|{edge})')"
        f" THEN {quoted(p)} END"
        for p in fv.BANNED_PHRASES
    )
    return f"(SELECT concat_ws('; ', {hits}) FROM (SELECT {words} AS w) ww)"


SCAN = f"""
measured AS (
  SELECT *, {_phrases("body")} AS banned_phrases, contains(body, '#') AS has_hashtag,
         CASE WHEN {stripped("body")} = '' THEN 0 ELSE len(regexp_split_to_array({stripped("body")}, '\\s+')) END AS words,
         length(body) AS characters
  FROM scanned)
SELECT * EXCLUDE (body), CASE platform WHEN 'instagram' THEN words BETWEEN 150 AND 200
         WHEN 'linkedin' THEN words BETWEEN 200 AND 300 WHEN 'facebook' THEN words BETWEEN 100 AND 150
         WHEN 'twitter' THEN characters < 240 ELSE true END AS length_ok
FROM measured
"""


@check(
    "g1_request_outcomes",
    "platform_requests",
    "content_drafts",
    sql="""
SELECT r.request_id, r.draft_id, r.user_id,
       CASE WHEN trim(replace(r.platforms, ',', '')) = '' THEN 'no_platform' WHEN cd.draft_id IS NULL THEN 'not_found'
            WHEN cd.created_by <> r.user_id THEN 'forbidden' END AS reason
FROM (SELECT request_id, CASE WHEN request_id % 13 = 0 THEN -1 - draft_id ELSE draft_id END AS draft_id,
             user_id + CASE WHEN request_id % 5 = 0 THEN 1 ELSE 0 END AS user_id, platforms FROM platform_requests) r
LEFT JOIN content_drafts cd ON cd.draft_id = r.draft_id""",
)
def g1_outcomes(t):
    # Some requests name a draft that does not exist, some come from somebody else.
    number = F.col("request_id")
    requests = t.platform_requests.withColumns(
        {
            "draft_id": F.when(number % 13 == 0, -1 - F.col("draft_id")).otherwise(F.col("draft_id")),
            "user_id": F.col("user_id") + F.when(number % 5 == 0, 1).otherwise(0),
        }
    )
    return g.generation_requests(requests, t.content_drafts).decided.drop("platforms")


@check(
    "g5_house_rule_scan",
    "ai_generations",
    sql=f"WITH scanned AS (SELECT generation_id, draft_id, platform, generated_text AS body FROM ai_generations), {SCAN}",
)
def g5(t):
    return g.house_rule_scan(t.ai_generations)


@check(
    "g5_house_rule_scan_recommendations",
    "content_recommendations",
    sql="""
WITH scanned AS (SELECT recommendation_id, best_platform AS platform,
       concat(recommendation_text, ' ', CASE client_id WHEN 1 THEN 'Delve into this game-changer.'
              WHEN 2 THEN 'It’s no secret: unlocked.' ELSE '' END) AS body FROM content_recommendations), """
    + SCAN,
)
def g5_recommendations(t):
    # Two brands get a sentence with phrases to find, as the given prose has none.
    extra = (
        F.when(F.col("client_id") == 1, "Delve into this game-changer.")
        .when(F.col("client_id") == 2, "It’s no secret: unlocked.")
        .otherwise("")
    )
    texts = t.content_recommendations.select(
        "recommendation_id",
        F.col("best_platform").alias("platform"),
        F.concat("recommendation_text", F.lit(" "), extra).alias("body"),
    )
    return g.house_rule_scan(texts, "body")


TITLE = "concat(upper(substring({0}, 1, 1)), substring({0}, 2))"
INPUTS = f"""
{PLATFORM_ROWS},
lines AS (
  SELECT user_id, string_agg(concat('- ', {TITLE.format("platform")}, ': ', post_count, ' posts, ', {shown("mean")},
           '% avg engagement, ', likes, ' likes, ', comments, ' comments'), chr(10) ORDER BY mean DESC, platform) AS summary,
         arg_min(platform, row(-mean, platform)) AS best
  FROM platform_rows GROUP BY user_id),
inputs AS (
  SELECT u.user_id, COALESCE(l.best, 'instagram') AS best_platform, l.summary,
         CASE WHEN l.summary IS NOT NULL THEN concat({quoted(fv.SUMMARY_PROMPT_OPENING)}, l.summary,
              {quoted(fv.SUMMARY_PROMPT_CLOSING)}) END AS prompt,
         CASE WHEN l.best IS NULL THEN {quoted(fv.STARTER_RECOMMENDATION)} ELSE
              concat({quoted(fv.FALLBACK_BEFORE_PLATFORM)}, {TITLE.format("l.best")},
                     {quoted(fv.FALLBACK_AFTER_PLATFORM)}) END AS fallback_text
  FROM users u LEFT JOIN lines l ON l.user_id = u.user_id)
"""


def recommendation_inputs(t):
    totals = e.author_platform_totals(t.posts, t.content_drafts, t.analytics_logs)
    return g.recommendation_inputs(t.users, e.overview(t.users, totals), e.by_platform(totals))


@check("g6_recommendation_inputs", *ALL, sql=f"WITH {INPUTS} SELECT * FROM inputs")
def g6(t):
    return recommendation_inputs(t)
