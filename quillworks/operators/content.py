"""Jobs around the text model: prompts before it, answers and rule checks after it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.functions.answers import parse_answer
from quillworks.functions.fixed_values import (
    BANNED_PHRASES,
    CHARACTER_LIMITS,
    DEFAULT_RULES_PLATFORM,
    FALLBACK_AFTER_PLATFORM,
    FALLBACK_BEFORE_PLATFORM,
    PLATFORM_RULES,
    PROMPT_CLOSING,
    PROMPT_OPENING,
    PROMPT_WRITING_RULES,
    STARTER_PLATFORM,
    STARTER_RECOMMENDATION,
    SUMMARY_PROMPT_CLOSING,
    SUMMARY_PROMPT_OPENING,
    WORD_LIMITS,
)
from quillworks.functions.scalars import comma_list, strip, title_case
from quillworks.operators.skew import salted_join
from quillworks.plans.outcome import Outcome, Stage, first_reason, unstaged


def expand_platforms(requests: DataFrame, column: str = "platforms") -> DataFrame:
    """One row per platform of a comma-separated list, with its position; repeats kept."""
    return requests.select("*", F.posexplode(comma_list(F.col(column))).alias("position", "platform")).drop(
        column
    )


def rule_text(platform: Column, part: str) -> Column:
    """Writing rule of a platform; a platform without rules uses the default platform's."""
    texts = F.create_map(
        *[F.lit(x) for name, rules in PLATFORM_RULES.items() for x in (name, rules[part])]
    )
    return F.coalesce(F.try_element_at(texts, platform), F.lit(PLATFORM_RULES[DEFAULT_RULES_PLATFORM][part]))


def with_rules(df: DataFrame) -> DataFrame:
    """Rows (…, platform) with the four writing rules of the platform."""
    return df.withColumns(
        {part: rule_text(F.col("platform"), part) for part in ("tone", "format", "storytelling", "hashtag_count")}
    )


def brand_section(platform: Column, handles: Column) -> Column:
    """Brand lines of a prompt: only the fields that have a value, in fixed order."""

    def line(label: str, column: str) -> Column:
        value = F.nullif(F.col(column), F.lit(""))
        return F.when(value.isNotNull(), F.concat(F.lit(f"{label}: "), value))

    account = F.nullif(F.try_element_at(handles, platform), F.lit(""))
    lines = F.concat_ws(
        "\n",
        line("BRAND NAME", "brand_name"),
        line("INDUSTRY", "industry"),
        line("BRAND VOICE & TONE", "brand_voice"),
        line("TARGET AUDIENCE", "target_audience"),
        line("AVOID THESE", "do_not_use"),
        F.when(account.isNotNull(), F.concat(F.upper(platform), F.lit(" HANDLE: "), account)),
    )
    return F.when(lines == "", "").otherwise(F.concat(F.lit("BRAND CONTEXT:\n"), lines, F.lit("\n\n")))


def prompt_text(platform: Column) -> Column:
    """Prompt of one (draft, platform) row that carries rules and brand context."""
    instructions = F.concat(
        F.lit("PLATFORM: "), F.upper(platform),
        F.lit("\nTONE: "), F.col("tone"),
        F.lit("\nFORMAT: "), F.col("format"),
        F.lit("\nSTORYTELLING: "), F.col("storytelling"),
        F.lit("\nHASHTAGS: Generate exactly "), F.col("hashtag_count"),
        F.lit(" — put them ONLY in the hashtags field, never in the post body.\n"),
    )
    return F.concat(
        F.lit(PROMPT_OPENING),
        brand_section(platform, F.col("social_handles")),
        F.lit("ORIGINAL TITLE: "), F.col("draft_title"),
        F.lit("\nORIGINAL CONTENT: "), F.col("draft_content"),
        F.lit("\n\nPLATFORM INSTRUCTIONS: "), instructions,
        F.lit("\n\n" + PROMPT_WRITING_RULES + "\n\n" + PROMPT_CLOSING),
    )


def generation_requests(requests: DataFrame, drafts: DataFrame) -> Outcome:
    """Requests (request_id, user_id, draft_id, platforms) with the reason of a refusal.

    A request needs a platform, a known draft, and its author. Feed the accepted ones to
    :func:`prompts`.
    """
    owners = drafts.select("draft_id", "created_by")
    listed = F.exists(F.split(F.coalesce("platforms", F.lit("")), ","), lambda p: strip(p) != "")
    author = F.coalesce(F.col("created_by") == F.col("user_id"), F.lit(False))
    decided = (
        requests.join(owners.withColumn("known", F.lit(True)), "draft_id", "left")
        .withColumn(
            "reason",
            first_reason(
                (~listed, "no_platform"), (F.col("known").isNull(), "not_found"), (~author, "forbidden")
            ),
        )
        .drop("known", "created_by")
    )
    return Outcome(decided)


def prompts(requests: DataFrame, drafts: DataFrame, contexts: DataFrame) -> DataFrame:
    """Prompt for every (draft, platform) of accepted requests, see :func:`generation_requests`.

    ``requests`` holds request_id, draft_id and a platform list; ``contexts``
    comes from ``brands.brand_context``. Brands are joined to drafts, and drafts
    to requests, before the platform lists are unrolled.
    """
    texts = drafts.select("draft_id", "client_id", "draft_title", "draft_content")
    branded = salted_join(texts, contexts, ["client_id"], "left", ["draft_id"])
    rows = with_rules(expand_platforms(requests.join(branded, "draft_id")))
    return rows.select(
        "request_id", "draft_id", "position", "platform", prompt_text(F.col("platform")).alias("prompt")
    )


@contextmanager
def last_key_wins(spark: SparkSession) -> Iterator[None]:
    """Within it, JSON expressions are resolved to keep the last of equal keys."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parse_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Rows with the three texts of the answer, a success flag and the error.

    A failed answer has empty texts. Text around the JSON object and code fences
    are ignored; of equal keys the last counts. Stage the result (``plans.outcome``) when
    several tables are written from it, so that answers are parsed once.
    """
    with last_key_wins(answers.sparkSession):
        parsed = answers.withColumn("parsed_answer", parse_answer(F.col(column))).drop(column)
    return parsed.select("*", "parsed_answer.*").drop("parsed_answer")


def fold_outcomes(results: DataFrame) -> DataFrame:
    """Outcome of every generation request.

    One request unrolls one platform list, so the errors collected for it were
    all named in a single input cell; a draft with many requests is not one group.
    """
    failed = F.when(~F.col("success"), F.struct("position", F.coalesce("error", F.lit("unknown error")).alias("error")))
    return (
        results.groupBy("request_id", "draft_id")
        .agg(F.count_if(F.col("success")).alias("saved_posts"), F.array_sort(F.collect_list(failed)).alias("errors"))
        .select(
            "request_id",
            "draft_id",
            "saved_posts",
            F.when(F.col("saved_posts") > 0, "repurposed").alias("new_draft_status"),
            F.when(F.col("saved_posts") == 0, F.array_join("errors.error", "; ")).alias("error"),
        )
    )


def generation_run(
    requests: DataFrame, drafts: DataFrame, answers: DataFrame, stage: Stage = unstaged
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A batch of generation requests from its check to the status of its drafts.

    Requests (request_id, user_id, draft_id, platforms) are checked, the platform lists of accepted ones
    unrolled and joined to the ``answers`` (draft_id, platform, answer) of the text model, at most one per draft and
    platform; answers are read and folded per request. Returns the checked requests, the texts per request and platform, the
    outcome per request, and the drafts afterwards. ``stage`` writes the read answers once.
    """
    decided = generation_requests(requests, drafts).decided
    asked = expand_platforms(decided.filter(F.col("reason").isNull()).drop("reason", "user_id"))
    asked = asked.join(answers.select("draft_id", "platform", "answer"), ["draft_id", "platform"], "left")
    read = parse_answers(asked.withColumn("missing", F.col("answer").isNull()))
    error = F.when(F.col("missing"), F.concat(F.lit("no answer for "), F.col("platform"))).otherwise(F.col("error"))
    texts = stage(read.withColumn("error", error).drop("missing"))
    outcomes = fold_outcomes(texts)
    return decided, texts, outcomes, repurposed_drafts(drafts, outcomes)


def repurposed_drafts(drafts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Drafts with status ``repurposed`` where a request saved at least one post."""
    done = outcomes.filter(F.col("saved_posts") > 0).select("draft_id").distinct()
    return drafts.join(done.withColumn("done", F.lit(True)), "draft_id", "left").withColumn(
        "draft_status", F.when(F.col("done"), "repurposed").otherwise(F.col("draft_status"))
    ).drop("done")


# Characters of a word; everything else separates words.
WORD_CHARACTERS = "a-z0-9'-"
# Between the entries of the word index. A hyphen separates here, so both parts of a hyphenated word are entries.
NO_ENTRY = "[^a-z0-9']+"


# Between the words of a phrase: blanks and hyphens, but no other punctuation.
BETWEEN_WORDS = r"[\s-]+"


def banned_phrase_pattern() -> str:
    """One pattern for all banned phrases, as whole words. No two of them can overlap in a text."""
    phrases = [BETWEEN_WORDS.join(re.split("[ -]", p)) for p in BANNED_PHRASES]
    return f"(?<![{WORD_CHARACTERS}])(?:{'|'.join(phrases)})(?![{WORD_CHARACTERS}])"


def index_words() -> list[str]:
    """The longest word of each phrase: a text without any of them uses no phrase."""
    return sorted({max(re.split("[ -]", p), key=len) for p in BANNED_PHRASES})


def used_phrases(lowered: Column) -> Column:
    """Banned phrases that a lower-case text uses, in the order of the rules.

    The words of the text are looked up in the index of the phrases; only texts with an entry are searched
    for the phrases themselves.
    """
    entries = F.array(*map(F.lit, index_words()))
    candidate = F.arrays_overlap(F.split(lowered, NO_ENTRY), entries)
    return F.when(candidate, _phrases_in(lowered)).otherwise("")


def _phrases_in(lowered: Column) -> Column:
    found = F.transform(
        F.regexp_extract_all(lowered, F.lit(banned_phrase_pattern()), F.lit(0)),
        lambda hit: F.regexp_replace(hit, BETWEEN_WORDS, " "),
    )
    named = F.filter(
        F.array(*[F.when(F.array_contains(found, p.replace("-", " ")), F.lit(p)) for p in BANNED_PHRASES]),
        lambda p: p.isNotNull(),
    )
    return F.when(found.isNull() | (F.size(found) == 0), "").otherwise(F.array_join(named, "; "))


def house_rule_scan(texts: DataFrame, column: str = "generated_text") -> DataFrame:
    """Writing rules that a generated text breaks: phrases, hashtags in the body, length."""
    text, lowered = F.col(column), F.col("lowered_text")
    used = used_phrases(lowered)
    platform, count = F.col("platform"), F.col("words")
    in_limits = F.lit(True)
    for name, (low, high) in WORD_LIMITS.items():
        in_limits = F.when(platform == name, count.between(low, high)).otherwise(in_limits)
    for name, limit in CHARACTER_LIMITS.items():
        in_limits = F.when(platform == name, F.col("characters") < limit).otherwise(in_limits)
    return (
        texts.withColumn("lowered_text", F.lower(F.replace(text, F.lit("’"), F.lit("'"))))
        .withColumns(
            {
                "banned_phrases": used,
                "has_hashtag": F.contains(text, F.lit("#")),
                "words": F.regexp_count(text, F.lit(r"\S+")),
                "characters": F.char_length(text),
            }
        )
        .withColumn("length_ok", in_limits)
        .drop(column, "lowered_text")
    )


def recommendation_inputs(users: DataFrame, overview: DataFrame, platforms: DataFrame) -> DataFrame:
    """Summary lines, best platform, prompt and deterministic text for every user.

    A user has at most one line per platform.
    """
    line = F.concat(
        F.lit("- "), title_case(F.col("platform")), F.lit(": "),
        F.col("post_count").cast("string"), F.lit(" posts, "),
        F.col("avg_rate").cast("string"), F.lit("% avg engagement, "),
        F.col("likes").cast("string"), F.lit(" likes, "),
        F.col("comments").cast("string"), F.lit(" comments"),
    )
    lines = platforms.groupBy("user_id").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("mean_rate")).alias("order"), "platform", line.alias("line")))
        ).alias("lines")
    )
    has_posts = F.col("lines").isNotNull() & (F.col("total_posts") > 0)
    best = F.col("lines")[0]["platform"]
    summary = F.array_join("lines.line", "\n")
    return (
        users.select("user_id")
        .join(overview.select("user_id", "total_posts"), "user_id", "left")
        .join(lines, "user_id", "left")
        .select(
            "user_id",
            F.when(has_posts, best).otherwise(F.lit(STARTER_PLATFORM)).alias("best_platform"),
            F.when(has_posts, summary).alias("summary"),
            F.when(
                has_posts, F.concat(F.lit(SUMMARY_PROMPT_OPENING), summary, F.lit(SUMMARY_PROMPT_CLOSING))
            ).alias("prompt"),
            F.when(
                has_posts,
                F.concat(F.lit(FALLBACK_BEFORE_PLATFORM), title_case(best), F.lit(FALLBACK_AFTER_PLATFORM)),
            )
            .otherwise(F.lit(STARTER_RECOMMENDATION))
            .alias("fallback_text"),
        )
    )
