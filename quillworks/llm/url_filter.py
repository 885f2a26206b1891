"""URL filter: list rules first, then association rules mined from labelled urls.

A list rule is a host and the beginning of a path; it fits the host and all its
subdomains, and the longest one that fits decides. For all other urls, Spark's FP-growth mines
combinations of url tokens together with the label "block"; rules ``tokens -> block`` below
``min_support`` (share of the labelled urls with the tokens and the label; ``min_rows`` of
them at least) or ``min_confidence`` are pruned, and so is a rule with a shorter rule inside it that is as sure.
Matching uses an inverted index: a rule is listed under its rarest token, so a url meets
only the rules of its own tokens, and the other tokens of the rule are checked there.

Defined cases: a null url or one without ``://`` has an empty host and path, no tokens and the verdict
allow; labels without a page, and pages with several labels (one block label is enough),
are defined by the join on the identifiers; with no labelled urls there are no mined rules;
repeated pages are judged each by itself; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillworks.llm.common import staged
from quillworks.llm.line_dedup import LOWER, UPPER

#: The label as an item; no url token has this form.
BLOCK = "#block"
#: Fixed values of the contract: host and path, then the verdict.
LIST_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def list_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null without one."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule_host, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(start)
        hit = F.struct(F.lit(rule_host + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit).otherwise(found)
    return found


def tokens_of(url: Column) -> Column:
    """Distinct tokens: labels of the host, words of the path, names and values of the query."""
    parts = [
        (F.regexp_extract(url, r"(?s)^(.*?)://", 1), "s:"),
        (host_of(url), "h:"),
        (path_of(url), "p:"),
        (F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "q:"),
    ]
    lists = [
        F.transform(
            F.filter(F.split(F.coalesce(part, F.lit("")), r"[^\p{L}\p{N}_-]+"), lambda x: x != ""),
            lambda x, mark=mark: F.concat(F.lit(mark), x),
        )
        for part, mark in parts
    ]
    return F.when(url.contains("://"), F.array_distinct(F.concat(*lists))).otherwise(F.array().cast("array<string>"))


def mined_rules(
    labelled: DataFrame, min_support: float, min_confidence: float, min_rows: int
) -> DataFrame:
    """Rules ``tokens -> block`` from rows (tokens, blocked): tokens and confidence."""
    spark = labelled.sparkSession
    schema = T.StructType(
        [T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType())]
    )
    items = F.when(F.col("blocked"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens"))
    baskets = staged(labelled.select(items.alias("items")), "url-baskets")
    rows = baskets.count()
    if rows < min_rows:
        return spark.createDataFrame([], schema)
    support = max(min_support, min_rows / rows)
    mining = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence)
    rules = mining.fit(baskets).associationRules
    rules = staged(
        rules.filter((F.col("consequent")[0] == BLOCK) & (F.size("antecedent") > 0)).select(
            F.array_sort("antecedent").alias("tokens"), "confidence"
        ),
        "url-rules",
    )
    # A rule is idle if leaving out one of its tokens gives a rule that is as sure.
    shorter = (
        rules.withColumn("left_out", F.explode("tokens"))
        .withColumn("part", F.array_remove("tokens", F.col("left_out")))
        .join(rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure")), "part")
        .filter(F.col("sure") >= F.col("confidence"))
        .select("tokens")
        .distinct()
    )
    return rules.join(shorter, "tokens", "left_anti")


def blocked_by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls (column url, with tokens) that hold all tokens of a rule."""
    frequency = (
        urls.select(F.explode("tokens").alias("token"))
        .join(rules.select(F.explode("tokens").alias("token")).distinct(), "token")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    index = (
        rules.withColumn("token", F.explode("tokens"))
        .join(frequency, "token", "left")
        .groupBy("tokens")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    index = staged(index.select("token", F.col("tokens").alias("needed")), "url-index")
    return (
        urls.withColumn("token", F.explode("tokens"))
        .join(index, "token")
        .filter(F.size(F.array_except("needed", "tokens")) == 0)
        .select("url")
        .distinct()
    )


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str, str]] = LIST_RULES,
    min_support: float = 0.002,
    min_confidence: float = 0.6,
    min_rows: int = 10,
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``labels`` covers identifiers (doc_id) of which some are pages; toxic = 1 means block.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy(F.col("doc_id").alias("page_id")).agg((F.max("toxic") == 1).alias("blocked"))
    labelled = page.join(marks, "page_id").select(tokens_of(F.col("url")).alias("tokens"), "blocked")
    mined = mined_rules(labelled, min_support, min_confidence, min_rows)
    urls = page.filter(F.col("url").isNotNull()).select("url").distinct()
    urls = urls.withColumn("tokens", tokens_of(F.col("url")))
    blocked = staged(blocked_by_rules(urls, mined), "url-blocked").withColumn("mined", F.lit(True))
    url = F.col("url")
    listed = list_rule(host_of(url), path_of(url), rules)
    return (
        page.join(blocked, "url", "left")
        .withColumn("listed", listed)
        .select(
            "page_id",
            host_of(url).alias("host"),
            path_of(url).alias("path"),
            F.col("listed.rule").alias("rule"),
            F.coalesce("listed.verdict", F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"),
        )
    )
