"""New drafts, users, recommendations and generated posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillworks.functions.fixed_values import (
    EMAIL_LIKE,
    MIN_CONTENT_CHARACTERS,
    MIN_TITLE_CHARACTERS,
    USER_ROLES,
)
from quillworks.functions.scalars import collated, stable_id, strip, week_end
from quillworks.operators.brands import first_brand_of_authors
from quillworks.operators.skew import salted_join
from quillworks.plans.outcome import Outcome, Stage, first_reason, order, unstaged


def _new_id(kind: str) -> Column:
    return stable_id(F.lit(kind), F.col("request_id").cast("string"))


def _shorter(column: str, characters: int) -> Column:
    """Whether a text is too short; a missing one is."""
    return F.coalesce(F.char_length(column) < characters, F.lit(True))


def intake_drafts(requests: DataFrame) -> Outcome:
    """Requests (request_id, request_time, user_id, client_id, draft_title, draft_content)."""
    title, content = strip(F.col("draft_title")), strip(F.col("draft_content"))
    decided = requests.withColumns({"draft_title": title, "draft_content": content}).withColumn(
        "reason",
        first_reason(
            (_shorter("draft_title", MIN_TITLE_CHARACTERS), "title_too_short"),
            (_shorter("draft_content", MIN_CONTENT_CHARACTERS), "content_too_short"),
        ),
    )
    rows = decided.filter(F.col("reason").isNull()).select(
        _new_id("draft").alias("draft_id"),
        "client_id",
        F.col("user_id").alias("created_by"),
        "draft_title",
        "draft_content",
        F.lit("draft").alias("draft_status"),
        F.col("request_time").alias("created_at"),
    )
    return Outcome(decided, appended={"content_drafts": rows})


def intake_users(requests: DataFrame, users: DataFrame, stage: Stage = unstaged) -> Outcome:
    """Requests (request_id, request_time, full_name, email, password_hash, role).

    An e-mail is taken when a user or an earlier accepted request has it, without
    regard to case. Roles are accepted in any case and stored in lower case.
    """
    asked = requests.withColumns(
        {"email_key": collated(F.col("email")), "role": F.lower("role")}
    ).withColumn(
        "fault",
        first_reason(
            (~F.coalesce(F.col("role").isin(*USER_ROLES), F.lit(False)), "invalid_role"),
            (~F.coalesce(F.col("email").like(EMAIL_LIKE), F.lit(False)), "invalid_email"),
        ),
    )
    first = asked.filter(F.col("fault").isNull()).groupBy("email_key").agg(F.min(order()).alias("winner"))
    taken = users.select(collated(F.col("email")).alias("email_key"), F.lit(True).alias("taken")).distinct()
    facts = taken.join(first, "email_key", "full")
    decided = stage(
        salted_join(asked, facts, ["email_key"], "left", ["request_id"])
        .withColumn(
            "reason",
            first_reason(
                (F.col("taken"), "email_taken"),
                (order() > F.col("winner"), "email_taken"),
                (F.col("fault").isNotNull(), F.col("fault")),
            ),
        )
        .drop("email_key", "taken", "winner", "fault")
    )
    rows = decided.filter(F.col("reason").isNull()).select(
        _new_id("user").alias("user_id"),
        "full_name",
        "email",
        "password_hash",
        "role",
        F.col("request_time").alias("created_at"),
    )
    return Outcome(decided, appended={"users": rows})


def intake_recommendations(
    requests: DataFrame,
    drafts: DataFrame,
    recommendations: DataFrame,
    texts: DataFrame,
    run_date: Column,
    stage: Stage = unstaged,
) -> Outcome:
    """Requests (request_id, request_time, user_id); texts (user_id, best_platform, recommendation_text).

    The recommendation is for the author's first brand and the week that starts
    on the run date; a brand gets one per week, the first request of a user with a
    text wins. A user without a text is refused.
    """
    offered = texts.groupBy("user_id").agg(
        F.min(F.struct("best_platform", "recommendation_text")).alias("offer")
    )
    brand = first_brand_of_authors(drafts)
    first = (
        requests.groupBy("user_id")
        .agg(F.min(order()).alias("winner"))
        .join(offered.select("user_id"), "user_id", "left_semi")
        .join(brand, "user_id")
        .groupBy("client_id")
        .agg(F.min("winner").alias("winner"))
    )
    taken = (
        recommendations.filter(F.col("week_start_date") == run_date)
        .select("client_id", F.lit(True).alias("taken"))
        .distinct()
    )
    decided = stage(
        requests.join(
            brand.join(first, "client_id", "left").join(taken, "client_id", "left"), "user_id", "left"
        )
        .join(offered, "user_id", "left")
        .withColumn(
            "reason",
            first_reason(
                (F.col("client_id").isNull(), "no_draft"),
                (F.col("offer").isNull(), "no_text"),
                (F.col("taken") | (order() > F.col("winner")), "duplicate_week"),
            ),
        )
        .drop("winner", "taken")
    )
    rows = decided.filter(F.col("reason").isNull()).select(
        _new_id("recommendation").alias("recommendation_id"),
        "client_id",
        run_date.alias("week_start_date"),
        week_end(run_date).alias("week_end_date"),
        "offer.best_platform",
        "offer.recommendation_text",
        F.col("request_time").alias("created_at"),
    )
    return Outcome(decided.drop("offer"), appended={"content_recommendations": rows})


def intake_generations(results: DataFrame, created_at: Column) -> dict[str, DataFrame]:
    """One generation record and one pending post for every successful result.

    ``results`` holds request_id, position, draft_id, platform, prompt and the
    parsed answer.
    """
    done = results.filter(F.col("success"))
    parts = [F.col("request_id").cast("string"), F.col("position").cast("string")]
    generations = done.select(
        stable_id(F.lit("generation"), *parts).alias("generation_id"),
        "draft_id",
        "platform",
        "prompt",
        F.col("repurposed_content").alias("generated_text"),
        created_at.alias("generated_at"),
    )
    posts = done.select(
        stable_id(F.lit("post"), *parts).alias("post_id"),
        "draft_id",
        "platform",
        "repurposed_content",
        "caption",
        "hashtags",
        F.lit("pending_approval").alias("status"),
        created_at.alias("created_at"),
    )
    return {"ai_generations": generations, "posts": posts}
