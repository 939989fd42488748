"""The tables of a run as this engine's inputs: articles, past events, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first 60 characters are the title, all others the body."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("ord"),
        F.substring("text", 1, 60).alias("title"),
        F.expr("substring(text, 61)").alias("body"),
        "source",
        F.col("lang").alias("keyword"),
        F.col("lang").alias("section"),
        (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") % 1440).cast("int"))).alias("published"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/a/"), F.col("doc_id").cast("string")).alias("url"),
    )


ARTICLES_SQL = """(SELECT doc_id AS ord, substr(text, 1, 60) AS title, substr(text, 61) AS body, source, lang AS keyword, lang AS section,
 TIMESTAMP '2024-01-31 00:00:00' - to_minutes(CAST(doc_id % 1440 AS INTEGER)) AS published, 'https://' || source || '.example.com/a/' || doc_id AS url FROM documents)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as articles; a conversation is a section, so sections are bounded, and the role a source."""
    ident = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("ord"),
        F.substring("text", 1, 60).alias("title"),
        F.expr("substring(text, 61)").alias("body"),
        F.col("role").alias("source"),
        F.col("role").alias("keyword"),
        F.col("conv_id").cast("string").alias("section"),
        (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn").cast("int"))).alias("published"),
        F.concat(F.lit("https://"), "role", F.lit(".example.com/c/"), ident).alias("url"),
    )


TURNS_SQL = """(SELECT conv_id * 100000 + turn AS ord, substr(text, 1, 60) AS title, substr(text, 61) AS body, role AS source, role AS keyword, CAST(conv_id AS VARCHAR) AS section,
 TIMESTAMP '2024-01-31 00:00:00' - to_minutes(CAST(turn AS INTEGER)) AS published, 'https://' || role || '.example.com/c/' || conv_id || '/' || turn AS url FROM conversations)"""


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as delivered events, in their order."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.substring("text", 1, 60).alias("title"), F.expr("substring(text, 61)").alias("body"), F.concat(F.lit("https://x.example.com/b/"), F.col("item_id").cast("string")).alias("url"))


DELIVERED_SQL = "(SELECT item_id AS ord, substr(text, 1, 60) AS title, substr(text, 61) AS body, 'https://x.example.com/b/' || item_id AS url FROM benchmark)"

PRICES = [("m-large", 5.0, 0.5, 15.0), ("m-small-2024-01-31", 0.25, 0.025, 2.0), ("m-small", 0.2, 0.02, 1.6)]


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_price double, cached_price double, output_price double")


PRICES_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for m, a, b, c in PRICES) + ") v(model, input_price, cached_price, output_price))"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as calls; lengths stand in for tokens."""
    n = F.length("text").cast("bigint")
    model = F.element_at(F.array(*map(F.lit, ("m-large", "m-small-2024-01-31", "m-small-2023-12-01", "m-none"))), (F.col("conv_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", model.alias("model"), F.when(F.col("role") == "user", n).otherwise(0).alias("prompt_tokens"), F.when(F.col("role") == "user", F.floor(n / 3)).otherwise(0).cast("bigint").alias("cached_tokens"), F.when(F.col("role") == "user", 0).otherwise(n).cast("bigint").alias("completion_tokens"))


USAGE_SQL = """(SELECT conv_id, turn, (['m-large', 'm-small-2024-01-31', 'm-small-2023-12-01', 'm-none'])[CAST(conv_id % 4 + 1 AS INTEGER)] AS model,
 CASE WHEN role = 'user' THEN length(text) ELSE 0 END AS prompt_tokens, CASE WHEN role = 'user' THEN length(text) // 3 ELSE 0 END AS cached_tokens,
 CASE WHEN role = 'user' THEN 0 ELSE length(text) END AS completion_tokens FROM conversations)"""

DOMAINS = [("example.com", "Example", 1), ("thth.example.com", "Hidden child", 2), ("example.net", "Network", 3), ("shtion.example.org", "Single", 4)]


def domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOMAINS, "domain string, name string, ord int")


DOMAINS_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{n}', {o})" for d, n, o in DOMAINS) + ") v(domain, name, ord))"
