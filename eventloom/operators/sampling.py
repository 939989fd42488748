"""Proportional samples of time buckets, by windows over a handful of bucket rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates


def bucket_quotas(sizes: DataFrame, most: int, least: int) -> DataFrame:
    """(bucket, size) -> (bucket, size, quota) by largest remainders; ties go to the newest bucket (the least number).

    There are as many rows as buckets, so the unpartitioned windows see tens of rows.
    """
    newest = Window.orderBy("bucket")
    whole = Window.partitionBy()
    df = sizes.withColumn("sure", F.least("size", F.lit(least)))
    df = df.withColumns({"total": F.sum("size").over(whole), "sure_total": F.sum("sure").over(whole), "sure_before": F.sum("sure").over(newest.rowsBetween(Window.unboundedPreceding, -1))})
    df = df.withColumn("room", F.col("size") - F.col("sure")).withColumn("room_total", F.sum("room").over(whole))
    slots = F.lit(most) - F.col("sure_total")
    df = df.withColumn("exact", F.when(F.col("room_total") > 0, slots * F.col("room") / F.col("room_total")).otherwise(0.0))
    df = df.withColumn("extra", F.least(F.floor("exact"), F.col("room")).cast("bigint")).withColumn("left", slots - F.sum("extra").over(whole))
    ranked = Window.orderBy((F.col("extra") >= F.col("room")).cast("int"), F.desc(F.col("exact") - F.floor("exact")), "bucket")
    df = df.withColumn("more", ((F.row_number().over(ranked) <= F.col("left")) & (F.col("extra") < F.col("room"))).cast("bigint"))
    short = F.least("sure", F.greatest(F.lit(0), F.lit(most) - F.coalesce("sure_before", F.lit(0))))
    quota = F.when(F.col("total") <= most, F.col("size")).when(F.col("sure_total") >= most, short).otherwise(F.col("sure") + F.col("extra") + F.col("more"))
    return df.select("bucket", "size", quota.cast("bigint").alias("quota"))


def sample_buckets(df: DataFrame, ts: str, order: list[Column], now: Column, *, bucket_hours: int = 4, max_total: int = 100, min_per_bucket: int = 0, recent_hours: int = 24) -> DataFrame:
    """First rows of each bucket up to its quota, with bucket and place; rows outside the interval are out."""
    if bucket_hours <= 0 or max_total <= 0:
        return df.withColumns({"bucket": F.lit(None).cast("bigint"), "place": F.lit(None).cast("bigint")})
    rows = df.where(F.col(ts).isNotNull() & dates.within_hours(F.col(ts), now, recent_hours)).withColumn("bucket", dates.age_bucket(F.col(ts), now, bucket_hours))
    quotas = bucket_quotas(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), max_total, min_per_bucket)
    # A rank is only followed as far as the limit, so the window keeps that many rows a bucket.
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)).cast("bigint")).where(F.col("place") <= max_total)
    return placed.join(quotas.select("bucket", "quota"), "bucket").where(F.col("place") <= F.col("quota")).drop("quota")


def split_remainder(total: Column, by: list[str], order: list[Column]) -> Column:
    """Equal whole parts for a group's rows, the remainder to the first."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    return (F.floor(total / n) + F.when(first, total % n).otherwise(0)).cast("bigint")
