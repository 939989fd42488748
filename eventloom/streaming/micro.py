"""Structured Streaming forms of the stateful steps; each gives what the batch form gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import dates, urls


def recent_only(stream: DataFrame, ts: str, now: Column, hours: int) -> DataFrame:
    """An explicit bound on age; a watermark alone only permits dropping."""
    return stream.where(F.col(ts).isNotNull() & dates.within_hours(F.col(ts), now, hours))


def first_by_url(stream: DataFrame, ts: str, url: str, delay: str) -> DataFrame:
    """One row for each url key within the watermark, in bounded state."""
    return stream.withColumn("url_key", urls.page_key(F.col(url))).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["url_key"])


def counts_by_window(stream: DataFrame, ts: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Tumbling counts; these windows stand on the epoch, not on the present as the batch buckets do."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def drop_delivered(stream: DataFrame, scope: str, key: str, day: str, days: int) -> DataFrame:
    """R2: rows whose key was not seen in its scope in the ``days`` days before; state older than that is dropped.

    ``day`` is the row's day number.  Rows of a batch count in order of day and key.
    """
    def run(scope_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values([day, key], kind="stable")
        keep = []
        for k, d in zip(rows[key], rows[day]):
            last = seen.get(k)
            fresh = last is None or not 0 <= d - last < days
            keep.append(fresh)
            if fresh:
                seen[k] = int(d)
        newest = int(rows[day].max())
        seen = {k: d for k, d in seen.items() if newest - d < days}
        state.update((list(seen), list(seen.values())))
        yield rows[keep]

    return stream.groupBy(scope).applyInPandasWithState(run, stream.schema, "keys array<string>, days array<bigint>", "append", GroupStateTimeout.NoTimeout)


def deliver_then_store(stream: DataFrame, deliver: Callable[[DataFrame, int], bool], store: Callable[[DataFrame, int], None], checkpoint: str):
    """Each batch is stored only after it was delivered, at least once; a failed delivery fails the batch."""
    def batch(df: DataFrame, epoch: int) -> None:
        df.persist()
        try:
            if not deliver(df, epoch):
                raise RuntimeError(f"batch {epoch} was not delivered")
            store(df, epoch)
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
