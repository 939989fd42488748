"""Model usage and cost, and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

MEASURES = ("prompt_tokens", "cached_tokens", "completion_tokens")


def cost(prompt: Column, cached: Column, completion: Column, p_in: Column, p_cached: Column, p_out: Column) -> Column:
    """Cached tokens are part of the prompt's, and no more than these."""
    prompt = F.greatest(F.coalesce(prompt, F.lit(0)), F.lit(0))
    cached = F.least(F.greatest(F.coalesce(cached, F.lit(0)), F.lit(0)), prompt)
    return (prompt - cached) / 1e6 * p_in + cached / 1e6 * p_cached + F.coalesce(completion, F.lit(0)) / 1e6 * p_out


def priced(events: DataFrame, prices: DataFrame, *, overrides: DataFrame | None = None, default: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Each price from the overrides of the model, else of its base name, else from the table for the model, the base name, else the default.

    Overrides have the same columns as prices, and may lack some of a model's.
    """
    cols = ("input_price", "cached_price", "output_price")
    out = events.withColumn("base_model", tx.model_base(F.col("model")))
    levels = []
    for name, prices_of in (("over", overrides), ("table", prices)):
        if prices_of is not None:
            for key in ("model", "base_model"):
                own = prices_of.select(F.col("model").alias(key), F.struct(*cols).alias(f"__{name}_{key}"))
                out = out.join(own, key, "left")
                levels.append(f"__{name}_{key}")
    # The table's row of the model, not single prices of it, goes before that of the base name.
    table = F.coalesce("__table_model", "__table_base_model", F.struct(*(F.lit(float(v)).alias(c) for c, v in zip(cols, default))))
    price = lambda c: F.coalesce(*(F.col(x)[c] for x in levels if x.startswith("__over")), table[c])
    return out.select(*events.columns, *(price(c).alias(c) for c in cols))


def totals(events: DataFrame) -> DataFrame:
    """Sums for each model and, with a null model, for all."""
    c = cost(*(F.col(x) for x in MEASURES), F.col("input_price"), F.col("cached_price"), F.col("output_price"))
    return events.withColumn("cost", c).rollup("model").agg(F.count(F.lit(1)).alias("calls"), *(F.sum(x).alias(x) for x in MEASURES), F.sum("cost").alias("cost"))


def metric_totals(metrics: DataFrame) -> DataFrame:
    """Sums of the long metrics table (section, metric, value), with a null section for the run."""
    return metrics.groupBy("metric", "section").agg(F.sum("value").alias("value")).unionByName(metrics.groupBy("metric").agg(F.sum("value").alias("value")).withColumn("section", F.lit(None).cast("string")))


METHOD_CLASSES = {"url": "^url", "title": "^title", "text": "^text", "token_overlap": "^token_overlap", "simhash": "^simhash", "anchor": "^(anchor|distinctive)", "event_key": "^event_key"}


def exclusions(df: DataFrame, method: str = "method") -> DataFrame:
    """Exclusions for each class of methods; all classes count."""
    return df.agg(*(F.count_if(F.col(method).rlike(p)).alias(k) for k, p in METHOD_CLASSES.items()), F.count(method).alias("total"))


def funnel(df: DataFrame, status: str, stages: list[str], by: list[str]) -> DataFrame:
    """Rows that reached each stage, from the stage at which each row ended."""
    at = F.array_position(F.array(*map(F.lit, stages)), F.col(status))
    return df.groupBy(*by).agg(*(F.count_if(at >= i).alias(s) for i, s in enumerate(stages, 1)))
