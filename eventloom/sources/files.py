"""Sources and sinks: landed search results, configuration, history, pages, mail rows."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..functions import text as tx

ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "description", "link", "originallink", "pubDate")])
REQUIRED = ("briefing_name", "subject_prefix", "receiver_env", "sections")
REQUIRED_SECTION = ("section_name", "keywords", "topic_description")
#: The search interface counts from 1 and gives no result beyond this.
LAST_START = 1000


def scan_plan(spark: SparkSession, keywords: list[str], sorts: list[str], pages: int, display: int) -> DataFrame:
    """One row for each request, from three short lists; requests beyond the last start are left out."""
    display = max(1, min(100, display))
    k = spark.createDataFrame([(i, x) for i, x in enumerate(keywords)], "keyword_ord int, keyword string")
    s = spark.createDataFrame([(i, x) for i, x in enumerate(sorts)], "sort_ord int, sort string")
    rows = k.join(s, F.lit(True)).withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)))) if pages > 0 else k.join(s, F.lit(True)).withColumn("page", F.lit(0)).limit(0)
    return rows.withColumn("start", F.col("page") * display + 1).where(F.col("start") <= LAST_START).withColumn("display", F.lit(display))


def landed_items(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines of the search interface as article rows; a broken line is a null row and goes."""
    raw = spark.read.schema(T.StructType([*ITEM.fields, T.StructField("keyword", T.StringType()), T.StructField("sort", T.StringType()), T.StructField("scraped_at", T.StringType())])).json(path)
    return raw.where(F.coalesce("title", "link", "originallink").isNotNull()).select(tx.remove_tags(F.col("title")).alias("title"), tx.remove_tags(F.col("description")).alias("body"), F.col("link").alias("url"), "originallink", F.col("pubDate").alias("published_at"), dates.parse_mail_date(F.col("pubDate")).alias("published"), "keyword", "sort", "scraped_at")


def load_config(path: str) -> dict:
    """S3: raises if the file or a required key is missing."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    missing = [k for k in REQUIRED if not config.get(k)]
    for i, section in enumerate(config.get("sections") or []):
        missing += [f"sections[{i}].{k}" for k in REQUIRED_SECTION if not section.get(k)]
    if missing:
        raise ValueError("missing in the configuration: " + ", ".join(missing))
    return config


def resolved(section: Column, config: Column, default) -> Column:
    """The section's value, else the configuration's, else the default."""
    return F.coalesce(section, config, F.lit(default))


def load_history(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored events; an absent path is an empty history, a broken record is left out."""
    return _history(spark, path, schema).where("__broken is null").drop("__broken")


def _history(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    at, fs = _path(spark, path)
    every = T.StructType([*schema.fields, T.StructField("__broken", T.StringType())])
    if not fs.exists(at):
        return spark.createDataFrame([], every)
    return spark.read.schema(every).option("columnNameOfCorruptRecord", "__broken").json(path)


def broken_history(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines that load_history leaves out."""
    every = T.StructType([*schema.fields, T.StructField("__broken", T.StringType())])
    at, fs = _path(spark, path)
    lines = spark.read.text(path, recursiveFileLookup=True) if fs.exists(at) else spark.createDataFrame([], "value string")
    return lines.select(F.from_json("value", every, {"columnNameOfCorruptRecord": "__broken"})["__broken"].alias("line")).where("line is not null")


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def rewrite_history(df: DataFrame, path: str, day: str = "saved_date") -> None:
    """K2: the whole history anew: written beside the old one, which it then replaces by renames; a failed write leaves the old one."""
    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    df.repartition(day).write.mode("overwrite").partitionBy(day).json(new)
    (at, fs), (fresh, _), (spare, _) = (_path(spark, x) for x in (path, new, old))
    fs.delete(spare, True)
    if fs.exists(at):
        fs.rename(at, spare)
    if not fs.rename(fresh, at):
        raise OSError(f"{new} could not be renamed")
    fs.delete(spare, True)


STATE = "updated_at string, total_count int, current_run_count int, new_count int, domains array<string>"


def stored_domains(spark: SparkSession, path: str) -> DataFrame:
    """The domains of the state files under a path; none if there is no file or it can't be read."""
    at, fs = _path(spark, path)
    raw = spark.read.schema(STATE).option("multiLine", True).json(path) if fs.exists(at) else spark.createDataFrame([], STATE)
    return raw.select(F.explode("domains").alias("domain")).where(tx.strip(F.col("domain")) != "").distinct()


def publisher_table(spark: SparkSession, path: str) -> DataFrame:
    """(domain, name, ord) from CSV lines domain,name; their order in the file is that of the lookup, so it is one file."""
    raw = spark.read.schema("domain string, name string").option("multiLine", True).csv(path).coalesce(1)
    return raw.select("domain", "name", F.monotonically_increasing_id().cast("int").alias("ord"))


def page_time(name: Column, modified: Column) -> Column:
    """The time in a page's name, else when the file was changed."""
    return F.coalesce(F.try_to_timestamp(F.regexp_extract(name, r"^([0-9]{4}-[0-9]{2}-[0-9]{2}-[0-9]{6})\.html$", 1), F.lit("yyyy-MM-dd-HHmmss")).cast("timestamp_ntz"), modified)


def expired_pages(files: DataFrame, name: str, modified: str, now: Column, keep_days: int) -> DataFrame:
    """K8: pages older than the days that they are kept, one at least; other files stay."""
    at = page_time(F.col(name), F.col(modified))
    return files.where(F.col(name).endswith(".html") & (at < now - F.expr(f"INTERVAL {max(keep_days, 1)} DAYS")))


def pages_url(configured: Column, given: Column, repository: Column) -> Column:
    """L4: the configured address, else the given one, else that of owner/name; the empty text without any."""
    bare = lambda c: F.regexp_replace(tx.strip(c), "/+$", "")
    owner, name = (tx.strip(F.regexp_extract(F.coalesce(repository, F.lit("")), "^([^/]*)/(.*)$", i)) for i in (1, 2))
    hosted = F.when((owner != "") & (name != ""), bare(F.concat(F.lit("https://"), owner, F.lit(".github.io/"), name)))
    return F.coalesce(F.nullif(bare(configured), F.lit("")), F.nullif(bare(given), F.lit("")), hosted, F.lit(""))


def state_paths(slug: str, root: str = "data/state") -> dict[str, str]:
    """P20: where a configuration's state lies; nothing is created."""
    return {"history": f"{root}/{slug}/history", "domains": f"{root}/{slug}/domains"}


def word_list(c: Column) -> Column:
    """Comma-separated words as a list without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), tx.strip), lambda x: x != "")


def sorts(values: Column, default: tuple[str, ...] = ("sim",)) -> Column:
    """A list of sorts without blanks, else the default."""
    kept = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), tx.strip), lambda x: x != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(*map(F.lit, default)))


def merged(left: Column, right: Column) -> Column:
    """Both maps' counters; the right one's go before."""
    keep = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(keep, right)


def json_list(reply: Column, schema: str) -> Column:
    """The list in a model's reply; null if it can't be read."""
    inner = F.regexp_extract(F.regexp_replace(reply, "```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    return F.from_json(F.nullif(inner, F.lit("")), f"array<{schema}>")


def append_history(df: DataFrame, path: str, day: str = "saved_date") -> None:
    """K1, K2: appended by day, so a reader prunes days, and old days are dropped as directories."""
    df.repartition(day).write.mode("append").partitionBy(day).json(path)


def receivers(setting: Column) -> Column:
    """``name|mail,...`` as structs; without a name the part before the @ is one; entries without a mail go."""
    parts = F.transform(F.split(F.coalesce(setting, F.lit("")), ","), tx.strip)
    pair = lambda p: F.when(F.contains(p, F.lit("|")), F.struct(tx.strip(F.split_part(p, F.lit("|"), F.lit(1))).alias("name"), tx.strip(F.split_part(p, F.lit("|"), F.lit(2))).alias("mail"))).otherwise(F.struct(F.split_part(p, F.lit("@"), F.lit(1)).alias("name"), p.alias("mail")))
    return F.filter(F.transform(parts, pair), lambda x: F.contains(x["mail"], F.lit("@")))


def send_mode(c: Column) -> Column:
    """N6."""
    t = F.lower(tx.strip(c))
    return F.when(t.isin("individual", "single", "each", "one_by_one", "separate"), "individual").otherwise("bulk")


def boolean(c: Column, default: bool) -> Column:
    """Text as a flag."""
    t = F.lower(tx.strip(c.cast("string")))
    return F.when(t.isin("1", "true", "yes", "y", "on"), True).when(t.isin("0", "false", "no", "n", "off"), False).otherwise(default)


def json_object(reply: Column, schema: str) -> Column:
    """The object in a model's reply, in a code fence or between the outermost braces; null if it can't be read."""
    inner = F.regexp_extract(F.regexp_replace(reply, "```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return F.from_json(F.nullif(inner, F.lit("")), schema)


def related_cards(df: DataFrame, by: list[str], order: str, title: str, url: str, source: str) -> DataFrame:
    """An HTML list for each group, in order; numbered before rows without a link are left out."""
    items = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, F.col(title).alias("t"), F.col(url).alias("u"), F.col(source).alias("s")))).alias("items"))
    row = lambda x, i: F.when((tx.strip(x["u"]) != "") & (x["u"] != "#"), F.concat(F.lit('<li id="news-'), (i + 1).cast("string"), F.lit('"><a href="'), tx.escape_html(x["u"]), F.lit('">'), tx.escape_html(x["t"]), F.lit("</a> "), tx.escape_html(x["s"]), F.lit("</li>")))
    # A group without any link has no page.
    return items.where(F.exists("items", lambda x: (tx.strip(x["u"]) != "") & (x["u"] != "#"))).select(*by, F.concat(F.lit("<ul>"), F.array_join(F.array_compact(F.transform("items", row)), ""), F.lit("</ul>")).alias("html"))


def section_mail(cards: DataFrame, section: str, html: str, subject: str) -> DataFrame:
    """K6: one HTML mail of all sections, in their order."""
    body = F.array_sort(F.collect_list(F.struct(F.col(section).alias("s"), F.col(html).alias("h"))))
    parts = F.transform(body, lambda x: F.concat(F.lit("<h2>"), tx.escape_html(x["s"]), F.lit("</h2>"), x["h"]))
    return cards.agg(F.concat(F.lit(f"<html><head><title>{subject}</title></head><body>"), F.array_join(parts, ""), F.lit("</body></html>")).alias("html"))


def mail_rows(cards: DataFrame, to: Iterable[str], mode: str, *by: str) -> DataFrame:
    """K5, K6: what a mail adapter sends: one row for all receivers, or one for each; nothing is sent here."""
    rows = list(to)
    target = F.array(F.concat_ws(",", *map(F.lit, rows))) if mode == "bulk" else F.array(*map(F.lit, rows))
    return cards.select(*by, "html", F.explode(target).alias("receiver"))
