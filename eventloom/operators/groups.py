"""Aggregates, scores and rankings of event groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import articles


def representative_score(title: Column, body: Column, has_url: Column, has_source: Column, sources: Column, n_articles: Column, n_tokens: Column, photo: Column, breaking: Column) -> Column:
    """M8: struct (score, flags) of a candidate for its group's representative."""
    tl, bl = F.length(F.coalesce(title, F.lit(""))), F.length(F.coalesce(body, F.lit("")))
    flag = lambda c, name: F.when(c, F.lit(name))
    score = (
        F.least(tl, F.lit(70)) / 10.0
        + F.least(bl, F.lit(220)) / 35.0
        + F.when(has_url, 1.0).otherwise(0.0)
        + F.when(has_source, 0.5).otherwise(0.0)
        + F.least(sources, F.lit(6)) * 0.4
        + F.least(n_articles, F.lit(8)) * 0.2
        - F.when(photo, 6.0).otherwise(0.0)
        - F.when(breaking, 2.0).otherwise(0.0)
        - F.when(bl == 0, 3.0).when(bl < 40, 1.5).otherwise(0.0)
        - F.when(tl < 16, 2.0).otherwise(0.0)
        - F.when(n_tokens < 5, 1.5).otherwise(0.0)
    )
    flags = F.array_compact(F.array(flag(photo, "photo_like"), flag(breaking, "breaking_like"), flag(bl == 0, "empty_description"), flag((bl > 0) & (bl < 40), "short_description"), flag(tl < 16, "short_title"), flag(n_tokens < 5, "few_tokens")))
    return F.struct(score.alias("score"), flags.alias("flags"))


def quality_flags(methods: Column, n_articles: Column, n_sources: Column, span_hours: Column, rep_score: Column, rep_flags: Column) -> Column:
    """Five rules; methods maps a match method to its number."""
    share = F.coalesce(F.try_element_at(methods, F.lit("token_overlap")), F.lit(0)) / F.greatest(n_articles - 1, F.lit(1))
    flag = lambda c, name: F.when(c, F.lit(name))
    return F.array_compact(F.array(flag((share >= 0.6) & (span_hours >= 6), "overgroup_risk_token_time_span"), flag((share >= 0.75) & (n_articles >= 5), "overgroup_risk_token_dominant"), flag(rep_score < 2.0, "low_representative_score"), flag(F.array_contains(rep_flags, "photo_like"), "photo_like_representative"), flag((n_articles >= 5) & (n_sources <= 2), "many_articles_few_sources")))


def priority(n_sources: Column, n_articles: Column, rep_score: Column, flags: Column) -> Column:
    """M9."""
    less = lambda name, x: F.when(F.array_contains(flags, name), x).otherwise(0.0)
    score = (
        F.least(n_sources, F.lit(8)) * 2.2
        + F.least(n_articles, F.lit(10)) * 0.9
        + rep_score * 0.8
        + F.when(n_sources >= 4, 2.0).otherwise(0.0)
        + F.when(n_articles >= 4, 1.0).otherwise(0.0)
        - less("many_articles_few_sources", 2.5)
        - less("photo_like_representative", 4.0)
        - less("overgroup_risk_token_dominant", 2.0)
        - less("overgroup_risk_token_time_span", 6.0)
        - less("low_representative_score", 5.0)
    )
    return F.round(score, 3)


def low_quality(flags: Column, rep_score: Column, n_sources: Column) -> Column:
    """F5."""
    risky = F.arrays_overlap(flags, F.array(*map(F.lit, ("overgroup_risk_token_time_span", "overgroup_risk_token_dominant", "low_representative_score"))))
    return risky | (rep_score < 2) | (F.array_contains(flags, "photo_like_representative") & (n_sources <= 2))


def importance(score: Column, n_articles: Column, n_sources: Column, flags: Column) -> Column:
    """2 to 5."""
    weak = F.arrays_overlap(flags, F.array(F.lit("low_representative_score"), F.lit("photo_like_representative")))
    return F.when(weak, 2).when((score >= 24) | ((n_sources >= 5) & (n_articles >= 8)), 5).when((n_sources >= 3) | (n_articles >= 4) | (score >= 13), 4).when(score < 4, 2).otherwise(3)


def topic_bonus(title: Column, body: Column, keywords: Column) -> Column:
    """6 for a keyword's word in the title, 2 for one in the body; keywords after the first that hit the title aren't read, nor is the body for words in the title."""
    t, b = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    words = lambda k: F.filter(F.split(F.lower(k), r"(?U)\s+"), lambda w: F.length(w) >= 2)

    def step(a: Column, k: Column) -> Column:
        in_title = F.exists(words(k), lambda w: F.contains(t, w))
        in_body = F.exists(words(k), lambda w: ~F.contains(t, w) & F.contains(b, w))
        return F.when(a["t"], a).otherwise(F.struct((a["t"] | in_title).alias("t"), (a["b"] | in_body).alias("b")))

    got = F.aggregate(keywords, F.struct(F.lit(False).alias("t"), F.lit(False).alias("b")), step)
    return F.when((t == "") & (b == ""), 0.0).otherwise(F.when(got["t"], 6.0).otherwise(0.0) + F.when(got["b"], 2.0).otherwise(0.0))


def clamp_score(c: Column, default: int = 3, low: int = 1, high: int = 5) -> Column:
    """M12, P18."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.try_to_number(F.trim(c.cast("string")), F.lit("999999")).cast("int"), F.lit(default))))


def summarise(members: DataFrame, by: list[str], *, order: str, title: str, body: str, url: str, source: str, keyword: str, published: str, tokens: str) -> DataFrame:
    """A row for each group from its members (with group_id and method)."""
    key = [*by, "group_id"]
    stats = members.groupBy(*key).agg(
        F.count(F.lit(1)).alias("article_count"),
        F.count_distinct(F.nullif(F.col(source), F.lit(""))).alias("source_count"),
        F.array_sort(F.collect_set(F.nullif(F.col(source), F.lit("")))).alias("sources"),
        F.array_sort(F.collect_set(F.nullif(F.col(keyword), F.lit("")))).alias("keywords"),
        F.when(F.count(published) >= 2, F.timestamp_diff("SECOND", F.min(published), F.max(published)) / 3600.0).otherwise(0.0).alias("time_span_hours"),
    )
    methods = members.groupBy(*key, "method").agg(F.count(F.lit(1)).cast("int").alias("n")).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "n")))).alias("methods"))
    scored = members.join(stats, key)
    s = representative_score(F.col(title), F.col(body), F.col(url) != "", F.col(source) != "", F.col("source_count"), F.col("article_count"), F.size(tokens), articles.photo_like(F.col(title), F.col(url)), articles.breaking_like(F.col(title)))
    # The best score, then the latest, then the first added; an aggregate, not a sort of each group.
    scored = scored.withColumn("s", s)
    best = F.struct(F.col("s.score").alias("a"), F.col(published).alias("b"), (-F.col(order)).alias("c"))
    rep = scored.groupBy(*key).agg(F.max_by(F.struct(F.col(order).alias("id"), F.col(title).alias("title"), F.col(body).alias("description"), F.col(published).alias("published"), "s"), best).alias("r"))
    out = stats.join(methods, key).join(rep, key)
    out = out.withColumns({"rep_id": F.col("r.id"), "rep_title": F.col("r.title"), "rep_body": F.col("r.description"), "rep_published": F.col("r.published"), "rep_score": F.col("r.s.score"), "rep_flags": F.col("r.s.flags")}).drop("r")
    out = out.withColumn("flags", quality_flags(F.col("methods"), F.col("article_count"), F.col("source_count"), F.col("time_span_hours"), F.col("rep_score"), F.col("rep_flags")))
    out = out.withColumn("priority", priority(F.col("source_count"), F.col("article_count"), F.col("rep_score"), F.col("flags")))
    return out.withColumn("low_quality", low_quality(F.col("flags"), F.col("rep_score"), F.col("source_count")))


def top_groups(df: DataFrame, by: list[str], limit: int, *, exclude_low_quality: bool = True) -> DataFrame:
    """The best groups of each section by priority, sources, articles and time."""
    kept = df.where(~F.col("low_quality")) if exclude_low_quality else df
    order = Window.partitionBy(*by).orderBy(F.desc("priority"), F.desc("source_count"), F.desc("article_count"), F.desc("rep_published"), "group_id")
    return kept.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= limit)


def run_totals(df: DataFrame) -> DataFrame:
    """A7."""
    n = F.col("article_count")
    return df.agg(F.count(F.lit(1)).alias("groups"), F.count_if(n > 1).alias("multi_article_groups"), F.count_if("low_quality").alias("low_quality_groups"), F.sum(F.when(F.col("low_quality"), n).otherwise(0)).alias("low_quality_articles"), F.sum(F.greatest(n - 1, F.lit(0))).alias("duplicates"))
