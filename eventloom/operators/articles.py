"""Filters, lookups and joins on article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, urls
from ..functions import lexicon as lx
from ..functions import text as tx


def recent(df: DataFrame, ts: str, now: Column, hours: int) -> DataFrame:
    """Unparsed dates and rows outside the closed interval go."""
    return df.where(F.col(ts).isNotNull() & dates.within_hours(F.col(ts), now, hours))


def without_keywords(df: DataFrame, keywords: list[str], *cols: str) -> DataFrame:
    """rows whose columns, joined by spaces, contain a keyword in any case go."""
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)))
    wanted = [k.strip().lower() for k in keywords if k and k.strip()]
    if not wanted:
        return df
    return df.where(~F.exists(F.array(*map(F.lit, wanted)), lambda k: F.contains(hay, k)))


def photo_like(title: Column, url: Column) -> Column:
    return F.exists(F.array(*map(F.lit, lx.PHOTO_URLS)), lambda p: F.contains(url, p)) | F.exists(F.array(*map(F.lit, lx.PHOTO_TITLES)), lambda p: F.contains(title, p))


def breaking_like(title: Column) -> Column:
    return F.exists(F.array(*map(F.lit, lx.BREAKING_TITLES)), lambda p: F.contains(title, p))


def publishers(df: DataFrame, url: str, names: DataFrame, *, longest: bool = False) -> DataFrame:
    """Adds publisher and unmapped from names (domain, name, ord).

    A host and its suffixes meet the domains by equality; the first listed domain
    that fits wins, or with ``longest`` the most specific one.  Distinct hosts are
    looked up, not rows, and the small side is left to the optimiser to broadcast.
    """
    hosts = df.select(urls.bare_host(F.col(url)).alias("__host")).distinct()
    parts = hosts.where("__host <> ''").select("__host", F.explode(urls.host_suffixes(F.col("__host"))).alias("domain"))
    rank = F.struct(-F.length("domain"), "ord") if longest else F.struct("ord")
    found = parts.join(names, "domain").groupBy("__host").agg(F.min_by("name", rank).alias("__name"))
    looked = hosts.join(found, "__host", "left")
    out = df.withColumn("__host", urls.bare_host(F.col(url))).join(looked, "__host", "left")
    name = F.when(F.col("__host") == "", lx.UNKNOWN_PUBLISHER).otherwise(F.coalesce("__name", urls.publisher_code(F.col("__host"))))
    return out.withColumn("publisher", name).withColumn("unmapped", (F.col("__host") != "") & F.col("__name").isNull()).drop("__host", "__name")


def unmapped_domains(current: DataFrame, known: DataFrame) -> DataFrame:
    """Union of both domain sets with a flag for those that are new."""
    both = current.select("domain", F.lit(1).alias("now"), F.lit(0).alias("old")).union(known.select("domain", F.lit(0), F.lit(1)))
    return both.where("domain <> ''").groupBy("domain").agg((F.max("old") == 0).alias("is_new"), (F.max("now") == 1).alias("in_current"))


def domain_counts(domains: DataFrame) -> DataFrame:
    """Of unmapped_domains' rows, all, those of this run, and the new ones."""
    return domains.agg(F.count(F.lit(1)).alias("total"), F.count_if("in_current").alias("in_run"), F.count_if(F.col("is_new")).alias("added"))


def seen_before(candidates: DataFrame, past: DataFrame, *, url: str = "url", past_urls: str = "urls", past_title: str = "title", past_ord: str = "ord") -> DataFrame:
    """Candidates with the title of the first past row that has their url among its own; null where none has."""
    probes = past.select(F.explode(past_urls).alias("__key"), F.struct(past_ord, past_title).alias("s")).where("__key <> ''").groupBy("__key").agg(F.min("s").alias("s"))
    probes = probes.select("__key", F.col("s")[past_title].alias("matched_title"))
    return candidates.withColumn("__key", urls.article_key(F.col(url))).join(probes, "__key", "left").drop("__key")


def first_of_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """D1 with one key: the first row of each key; rows with an empty key stay.

    The first is found by an aggregate, so a hot key is reduced before the shuffle.
    """
    keyed = df.withColumn("__key", key)
    first = keyed.where("__key <> ''").groupBy("__key").agg(F.min(order).alias("__first"))
    some = keyed.join(first, "__key").where(F.col(order) == F.col("__first")).drop("__key", "__first")
    return some.unionByName(keyed.where("__key = '' or __key is null").drop("__key"))


def append_new(records: DataFrame, stored: DataFrame, keys: dict[str, Column], *, scope: str, ident: str, order: str) -> DataFrame:
    """Records of which no scoped key (url, title, event key, id) is stored, once for each id."""
    def exploded(df: DataFrame, *cols: str) -> DataFrame:
        kinds = F.explode(F.flatten(F.array(*(F.transform(v, lambda x, k=k: F.struct(F.lit(k).alias("kind"), x.alias("key"))) for k, v in keys.items())))).alias("e")
        return df.select(scope, *cols, kinds).select(scope, *cols, "e.kind", "e.key").where("key <> ''")

    known = exploded(records, ident).join(exploded(stored).distinct(), [scope, "kind", "key"], "left_semi").select(ident).distinct()
    fresh = records.join(known, ident, "left_anti")
    first = fresh.groupBy(ident).agg(F.min(order).alias("__first"))
    return fresh.join(first, ident).where(F.col(order) == F.col("__first")).drop("__first")


def zipped_related(titles: Column, links: Column, sources: Column) -> Column:
    """Related articles by position, as far as titles and links both go, without empty ones."""
    n = F.least(F.size(titles), F.size(links))
    rows = F.transform(F.slice(F.arrays_zip(titles.alias("title"), links.alias("url"), sources.alias("source")), F.lit(1), n), lambda x: F.struct(tx.strip(x["title"]).alias("title"), tx.strip(x["url"]).alias("url"), F.coalesce(x["source"], F.lit("")).alias("source")))
    return F.filter(rows, lambda x: (x["title"] != "") & (x["url"] != "") & (x["url"] != "#"))


def retained(df: DataFrame, saved: Column, today: Column, days: int) -> DataFrame:
    """saved today or up to days - 1 days before; without a date, or later, out."""
    return df.where(F.datediff(today, saved).between(0, days - 1))


def history_scope(mode: str, briefing: Column, receiver: Column, section: Column) -> Column:
    """M16."""
    t = [tx.strip(c) for c in (briefing, receiver, section)]
    return t[1] if mode == "receiver" else F.concat_ws("|", *t) if mode == "section" else F.concat_ws("|", *t[:2])


def issue_id(scope: Column, url: Column, title_key: Column, fingerprint: Column, body: Column) -> Column:
    """M15."""
    key = urls.article_key(url)
    by_text = F.concat_ws("|", F.lit("text"), scope, title_key, fingerprint, F.substring(body, 1, 160))
    return F.sha2(F.when(key != "", F.concat_ws("|", F.lit("url"), scope, key)).otherwise(by_text), 256)


def positions(df: DataFrame, by: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """1-based places."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
