"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.llm import (
    decontamination,
    language_id,
    line_dedup,
    oracle_sql,
    periodic_runs,
    prefix_trie,
    sentencepiece_codec,
    sharding,
    simhash,
    substring_dedup,
    suffix_array_dedup,
    url_filter,
    voronoi_topk,
    warc_zstd,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_substring_dedup", oracle_sql.OP1)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digest(table(spark, folder, "documents"))


#: Public model file; only the driver reads it.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    pieces = sentencepiece_codec.load(PIECE_MODEL)
    return sentencepiece_codec.round_trip(table(spark, folder, "documents"), pieces)


@query("op3_sharding")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"), shards=40)


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs)
    held_out = language_id.held_out(F.col("row.doc_id")).alias("held_out")
    return found.select("row.doc_id", held_out, "lang_pred", "score")


@query("op5_suffix_array_dedup", oracle_sql.OP5)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_array_dedup.digest(table(spark, folder, "documents"))


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, max_bits=3)


@query("op7_url_filter")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), table(spark, folder, "labels"))


@query("op8_benchmark_decontamination")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("t")


OP9 = """
WITH usable AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
         list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op9_voronoi_topk", OP9)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return voronoi_topk.top_k(vectors.filter(F.col("vec_id") % 100 == 0), vectors, k=10)


OP10 = """
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)),
frequent AS (
  SELECT k, max(doc_id) AS newest FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, pos, line, newest IS NOT NULL AND newest <> doc_id AS gone
  FROM lines LEFT JOIN frequent USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op10_line_dedup", OP10)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digest(table(spark, folder, "documents"))


def planted_text() -> F.Column:
    """The text, of one document in ten with its end replaced by a repeated block of its words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % F.greatest(n, F.lit(1))
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(words, (a + 1).cast("int"), p)
    copies = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
    first, rest = F.slice(words, F.lit(1), a.cast("int")), F.slice(copies, F.lit(1), (n - a).cast("int"))
    whole = F.array_join(F.concat(first, rest), " ")
    return F.when((h % 10 == 0) & (n > 0), whole).otherwise(F.col("text"))


@query("op12_periodic_runs", oracle_sql.OP12)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", planted_text().alias("text"))
    found = periodic_runs.find_runs(docs)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    run = "struct<start:long,length:long,period:long>"
    # Exact comparison; runs come by start and period, so the first of equals stays.
    best = F.aggregate(
        "runs",
        F.lit(None).cast(run),
        lambda kept, r: F.when(
            kept.isNull() | (r["length"] * kept["period"] > kept["length"] * r["period"]), r
        ).otherwise(kept),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP11 = """
WITH payload AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (
  SELECT page_id, html, octet_length(encode(html)) AS size, sha1(html) || '0' AS hex FROM payload),
grouped AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM hashed)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (((strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 1 AS BIGINT), 1)) - 1) * 16
             + strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 2 AS BIGINT), 1)) - 1)
            >> (3 - i % 4)) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM grouped
"""


@query("op11_warc", OP11)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return warc_zstd.round_trip(table(spark, folder, "pages"), min_bytes=0)


@query("op13_prefix_trie", oracle_sql.OP13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    paths = prefix_trie.turn_paths(table(spark, folder, "conversations"))
    heads = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % 100
    rebuilt = prefix_trie.with_shared_heads(paths, heads, base, F.col("conv_id") % 100 == 0, most=5)
    return prefix_trie.build(rebuilt)
