"""Rows that the steps hand on: event signatures, history records, nested groups, summary rows, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions import urls
from . import articles as ar

#: Articles of a group that go on with its representative.
RELATED = 12


def alias_titles(title: Column, group_titles: Column) -> Column:
    """Own title and the group's, distinct, 16 at most."""
    return tx.unique(F.concat(F.array(title), F.coalesce(group_titles, F.array().cast("array<string>"))), 16)


def alias_urls(url: Column, group_urls: Column) -> Column:
    """Keys of the own url and the group's."""
    every = F.concat(F.array(url), F.coalesce(group_urls, F.array().cast("array<string>")))
    return tx.unique(F.transform(every, urls.article_key), 16)


def compare_text(summary: Column, description: Column, content: Column, group_keywords: Column, keyword: Column) -> Column:
    """The distinct parts that aren't blank, in this order."""
    parts = F.concat(F.array(summary, description, content), F.coalesce(group_keywords, F.array().cast("array<string>")), F.array(keyword))
    return F.array_join(tx.unique(parts), " ")


def stored_or_made(made: Column, *stored: Column) -> Column:
    """The first stored value that is there and not empty, else the one made now."""
    return F.coalesce(*(F.when(F.size(c) > 0, c) for c in stored), made)


def issue_records(df: DataFrame, *, briefing: str, subject: str, receiver: str, section: Column, saved_at: Column, mode_scope: str = "briefing") -> DataFrame:
    """History records from rows with title, summary, description, compare_text, source, url, published_at, importance_score, alias_titles, alias_urls, payload.

    The issue id stands on scope and url, without url on the text.
    """
    p = F.col("payload")
    scope = ar.history_scope(mode_scope, F.lit(briefing), F.lit(receiver), section)
    title_key = tx.normalize_title(F.col("title"))
    return df.select(
        ar.issue_id(scope, F.col("url"), title_key, p["fingerprint"], F.col("compare_text")).alias("issue_id"),
        saved_at.alias("saved_at"),
        F.to_date(saved_at).alias("saved_date"),
        F.lit(3).alias("event_signature_version"),
        F.lit(briefing).alias("briefing_name"),
        F.lit(subject).alias("subject_prefix"),
        F.lit(receiver).alias("receiver_env"),
        section.alias("section_name"),
        *(tx.strip(F.col(c)).alias(c) for c in ("title", "summary", "description")),
        F.substring("compare_text", 1, 1000).alias("compare_text"),
        tx.strip(F.col("source")).alias("source"),
        tx.strip(F.col("url")).alias("url"),
        urls.article_key(F.col("url")).alias("normalized_url"),
        "alias_urls",
        "alias_titles",
        title_key.alias("normalized_title"),
        p["fingerprint"].alias("event_fingerprint"),
        p["tokens"].alias("event_tokens"),
        p["title_tokens"].alias("event_title_tokens"),
        p["numbers"].alias("event_number_tokens"),
        p["actions"].alias("event_action_tokens"),
        p["event_key"].alias("event_key"),
        tx.strip(F.col("published_at")).alias("published_at"),
        "importance_score",
        F.substring(tx.strip(F.col("title")), 1, 80).alias("issue_label"),
    )


def updated_history(stored: DataFrame, records: DataFrame, keys: dict[str, Column], *, scope: str, ident: str, order: str, saved: str, today: Column, days: int) -> DataFrame:
    """The stored records of the last days, and the new ones of which no key is stored."""
    kept = ar.retained(stored, F.col(saved), today, days)
    return kept.unionByName(ar.append_new(records, kept, keys, scope=scope, ident=ident, order=order))


def in_scope(history: DataFrame, scope: Column, target: Column, saved: Column, today: Column, days: int) -> DataFrame:
    """the records of a scope and the last days."""
    return ar.retained(history.where(scope == target), saved, today, days)


def nested_groups(members: DataFrame, summary: DataFrame, by: list[str], *, order: str, title: str, source: str, keyword: str, published: str, url: str) -> DataFrame:
    """A summary row with its articles nested in the order in which they were added, each with its reason."""
    key = [*by, "group_id"]
    item = F.struct(F.col(order).alias("index"), F.col(title).alias("title"), F.col(source).alias("source"), F.col(keyword).alias("keyword"), F.col(published).alias("published_at_kst"), F.col(url).alias("url"), F.col("method").alias("match_method"))
    nested = members.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("articles"))
    return summary.join(nested, key)


def representative_rows(groups: DataFrame) -> DataFrame:
    """A group's representative as a row, with titles, urls and sources of those of its first articles that have both."""
    first = F.filter(F.slice("articles", 1, RELATED), lambda x: (tx.strip(x["title"]) != "") & (tx.strip(x["url"]) != ""))
    plural = {"title": "titles", "url": "urls", "source": "sources"}
    out = groups.withColumn("__a", first)
    out = out.withColumns({f"group_article_{p}": F.transform(F.col(f"__a.{c}"), tx.strip) for c, p in plural.items()})
    return out.withColumns({"description": F.coalesce("rep_body", F.lit("")), "content": F.coalesce("rep_body", F.lit("")), "published_at": F.col("rep_published"), "published_at_kst": F.col("rep_published")}).drop("__a")


def summary_source(*cols: Column) -> Column:
    """P10: the first of source, press, publisher and media that isn't blank, else the unknown publisher."""
    return F.coalesce(*(F.nullif(tx.strip(c), F.lit("")) for c in cols), F.lit(lx.UNKNOWN_PUBLISHER))


def summarised(articles: DataFrame, replies: DataFrame, by: list[str], *, position: str, text: Column, index: str, summary: str, reply_order: str, limit: int = 220) -> DataFrame:
    """Each article with the last reply to its position; without one, or with a blank one, its own text clipped, and an error."""
    said = replies.where(tx.strip(F.col(summary)) != "").groupBy(*by, F.col(index).alias(position)).agg(F.max_by(tx.strip(F.col(summary)), reply_order).alias("__s"))
    out = articles.join(said, [*by, position], "left")
    return out.withColumns({"summary": F.coalesce("__s", tx.clip(text, limit, rstrip=False)), "error": F.when(F.col("__s").isNull(), F.lit("index missing, fallback used"))}).drop("__s")


def excluded_rows(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Audit rows; token lists are cut to 12, 8 and 8."""
    p = F.col(payload)
    return df.select("index", *(tx.strip(F.col(c)).alias(c) for c in ("title", "source", "url", "method", "reason", "matched_title", "detail")), p["event_key"].alias("event_key"), F.slice(p["strong"], 1, 12).alias("anchor_tokens"), F.slice(p["actions"], 1, 8).alias("action_tokens"), F.slice(p["numbers"], 1, 8).alias("number_tokens"))


def candidate_line(place: Column, group: Column, n: Column, sources_n: Column, score: Column, flags: Column, sources: Column, source: Column, keywords: Column, title: Column, description: Column, *, detailed: int = 12, title_chars: int = 90, description_chars: int = 110, list_chars: int = 80) -> Column:
    """What a selector reads of a group, in one line; descriptions only for the first ones."""
    head = lambda arr: F.substring(F.array_join(arr, ", "), 1, list_chars)
    text = tx.clip(tx.strip(description), description_chars)
    shown = F.when((place <= detailed) & (text != ""), F.concat(F.lit(" | desc="), text)).otherwise("")
    press = F.coalesce(F.nullif(head(sources), F.lit("")), tx.clip(tx.strip(source), 30))
    parts = ["[", place, "] id=", group, " | n=", n, " src=", sources_n, " score=", score, " flags=", F.coalesce(F.nullif(F.array_join(flags, ","), F.lit("")), F.lit("-")), " | press=", press, " | kw=", head(keywords), " | title=", tx.clip(tx.strip(title), title_chars), shown]
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def as_sections(df: DataFrame, name: str = "뉴스 섹션") -> DataFrame:
    """Bare summaries are one section."""
    return df if "section_name" in df.columns else df.withColumn("section_name", F.lit(name))


def first_of_run(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first rows of each section."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).where(F.col("place") <= limit)
