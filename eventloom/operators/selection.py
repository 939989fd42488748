"""Selection of groups by replies of a model, with the decisions where replies are missing or bad; budgets and texts around it.

No model is called here.  A reply is a column of text; what it falls back to is the ranked selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import files

REPLY = "selected array<struct<group_id:string,importance_score:string>>"


def topic_order(df: DataFrame, by: list[str], bonus: Column) -> DataFrame:
    """Place of each group by priority and topic bonus, sources, articles and time."""
    rank = Window.partitionBy(*by).orderBy((F.col("priority") + bonus).desc(), F.desc("source_count"), F.desc("article_count"), F.desc("rep_published"), "group_id")
    return df.withColumn("place", F.row_number().over(rank).cast("bigint"))


def size_order(df: DataFrame, by: list[str]) -> DataFrame:
    """O2: place of each group by articles, sources and time."""
    rank = Window.partitionBy(*by).orderBy(F.desc("article_count"), F.desc("source_count"), F.desc("rep_published"), "group_id")
    return df.withColumn("place", F.row_number().over(rank).cast("bigint"))


def _score(c: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(c.try_cast("int"), F.lit(3))))


def chosen_groups(groups: DataFrame, replies: DataFrame, by: list[str], *, limit: int, least: int = 3) -> DataFrame:
    """A section's groups as its reply selects them, or as they are ranked.

    ``groups`` has by, group_id, place and importance; ``replies`` by and reply.
    Returns by, group_id, importance_score, place and decision:

    * ``model``: entries of the reply with a group that exists, the first of each, in
      the reply's order, importance at least ``least``, ``limit`` of them;
    * ``ranked``: where there is no reply, it can't be read, it selects nothing, or only
      groups that don't exist: the best by place with their own importance.

    A section whose valid entries are all below ``least`` has no rows at all.
    """
    parsed = replies.select(*by, files.json_object(F.col("reply"), REPLY)["selected"].alias("selected"))
    entries = parsed.select(*by, F.posexplode("selected").alias("pos", "e")).select(*by, "pos", tx.strip(F.col("e.group_id")).alias("group_id"), _score(F.col("e.importance_score")).alias("importance_score"))
    valid = entries.where("group_id <> ''").join(groups.select(*by, "group_id"), [*by, "group_id"], "left_semi")
    # An entry below the bound doesn't use its group up.
    high = valid.where(F.col("importance_score") >= least).groupBy(*by, "group_id").agg(F.min(F.struct("pos", "importance_score")).alias("e"))
    model = high.select(*by, "group_id", F.col("e.importance_score").alias("importance_score"), F.row_number().over(Window.partitionBy(*by).orderBy("e.pos")).cast("bigint").alias("place")).where(F.col("place") <= limit)
    ranked = groups.join(valid.select(*by).distinct(), by, "left_anti").where(F.col("place") <= limit)
    return model.withColumn("decision", F.lit("model")).unionByName(ranked.select(*by, "group_id", F.col("importance").cast("int").alias("importance_score"), "place").withColumn("decision", F.lit("ranked")))


def supplement_pool(*pools: DataFrame) -> DataFrame:
    """Candidate pools one behind the other; pool tells them apart."""
    out = None
    for i, p in enumerate(pools):
        p = p.withColumn("pool", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def importance_of_news(given: Column, estimate: Column) -> Column:
    """A row's own score where it has one, else what its group's figures say."""
    return F.when(F.coalesce(tx.strip(given.cast("string")), F.lit("")) != "", _score(given.cast("string"))).otherwise(estimate)


def summary_length(limit: Column) -> Column:
    """The least length of a summary that may have ``limit`` characters."""
    most = F.greatest(F.coalesce(limit, F.lit(220)), F.lit(80))
    return F.least(F.greatest(F.floor(most * 0.6).cast("int"), F.lit(120)), most)


def batch_budgets(articles: Column, limit: Column, *, cap: int = 8000, reasoning: bool = True) -> Column:
    """Tokens for the first try and, where that is more, the second."""
    n, most = F.greatest(articles, F.lit(1)), F.greatest(limit, F.lit(80))
    each = F.greatest(F.lit(300), F.least(most + 260, F.lit(760)))
    first = F.greatest(F.lit(1600), 700 + n * each)
    if not reasoning:
        return F.array(F.least(first, F.lit(cap)))
    first = F.least(F.greatest(first, F.lit(min(cap, 5200))), F.lit(cap))
    retry = F.least(F.greatest(first + 1200, 600 + n * 600), F.greatest(F.lit(cap + 1600), first))
    return F.when(retry > first, F.array(first, retry)).otherwise(F.array(first))


def insight_lines(text: Column) -> Column:
    """the first three lines that say something, numbered; none if there are fewer."""
    line = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(tx.strip(x), r"(?U)^\s*[0-9]+[.)．、:]\s*", ""), r"(?U)\s+", " "), r"^[ \-–—•·.]+|[ \-–—•·.]+$", "")
    told = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line), lambda x: F.length(F.regexp_replace(x, "[^0-9a-zA-Z가-힣]", "")) >= 8)
    first = F.slice(told, 1, 3)
    return F.when(F.size(first) == 3, F.transform(first, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))).otherwise(F.array().cast("array<string>"))


def top_lines(df: DataFrame, by: list[str], order: str, score: Column, summary: Column, title: Column, limit: int = 3) -> DataFrame:
    """Lines of the most important rows, in place of a model's insight."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(score.desc(), order))
    text = F.coalesce(F.nullif(tx.strip(summary), F.lit("")), tx.strip(title))
    top = df.withColumn("__i", rank).where(F.col("__i") <= limit).select(*by, "__i", text.alias("__t"))
    lines = F.array_sort(F.collect_list(F.when(F.col("__t") != "", F.struct("__i", "__t"))))
    return top.groupBy(*by).agg(F.transform(lines, lambda x: F.concat(x["__i"].cast("string"), F.lit(". "), x["__t"])).alias("lines"))


def rule_based(metrics: DataFrame) -> Column:
    """A10: what the rules excluded, over a section's metrics as columns."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in ("duplicate_count", "exclude_keyword_excluded_count", "grouping_duplicate_excluded_count", "grouping_low_quality_article_count")), F.lit(0))


def dashboard(metrics: DataFrame) -> DataFrame:
    """The figures of a section's dashboard; older runs lack some, which others make up for."""
    older = F.when(F.col("code_rule_excluded_count").isNotNull(), F.greatest(F.lit(0), F.col("code_rule_excluded_count") - F.coalesce("issue_filter_excluded_count", F.lit(0))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return metrics.select("section_name", zero("total_seen_count").alias("seen"), zero("old_news_count").alias("old"), zero("issue_filter_excluded_count").alias("history_excluded"), F.coalesce("rule_based_excluded_count", older, rule_based(metrics)).alias("rule_excluded"), zero("selected_count").alias("selected"))
