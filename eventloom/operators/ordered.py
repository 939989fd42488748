"""Operators whose result depends on the order of rows, one group in one task.

They are defined as a pass over a section's rows, so a section is a task; a section
of a run is bounded by what its source returns.  On other data choose group columns
that bound a group, and say so.
"""

from __future__ import annotations

from collections.abc import Callable
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import CLUSTER, ClusterThresholds
from ..functions import similarity as sim

#: Members of a group, after its representative, that a row is compared with.
COMPARED_MEMBERS = 5


def _apply(df: DataFrame, by: list[str], schema, run: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    return df.groupBy(*by).applyInPandas(run, schema)


def _table(out: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*out) if out else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, schema)], schema=schema)


def _apply_rows(df: DataFrame, by: list[str], schema: str, run: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """A group's rows as dicts: most groups are few rows, and as data frames with structs these cost more than the judge."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    return df.groupBy(*by).applyInArrow(lambda t: _table(run(t.to_pylist()), arrow), schema)


def _sorted(rows: list[dict], *by: str) -> list[dict]:
    """In order, nulls last."""
    return sorted(rows, key=lambda r: [(r[c] is None, r[c]) for c in by])


def _kind(df: DataFrame, c: str) -> str:
    return f"`{c}` {df.schema[c].dataType.simpleString()}"


def drop_seen_links(df: DataFrame, by: list[str], order: str, first: str, second: str) -> DataFrame:
    """A row goes if one of its two keys is a kept row's; a dropped row's keys aren't kept.

    So of A(u1, u2), B(u2, u3), C(u3, u4) A and C stay.  Rows without keys stay.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        keep = []
        for a, b in rows.sort_values(order, kind="stable")[[first, second]].fillna("").itertuples(index=False):
            own = {k for k in (a, b) if k}
            keep.append(not own & seen)
            if keep[-1]:
                seen |= own
        return rows.sort_values(order, kind="stable")[keep]

    return _apply(df, by, df.schema, run)


def drop_repeats(df: DataFrame, by: list[str], order: str, payload: str, kind: str) -> DataFrame:
    """Each row against those kept before it; adds duplicate_of, method and score, null where it is kept."""
    rule, read = sim.JUDGES[kind], sim.READS[kind]
    id_kind = df.schema[order].dataType.simpleString()

    own = itemgetter(*by, order)

    def run(rows: list[dict]) -> list[tuple]:
        kept: list[tuple] = []
        out = []
        for r in _sorted(rows, order):
            p = read(r[payload])
            hit = next(((k, *v[1:]) for k, q in kept if (v := rule(p, q))[0]), None)
            if hit is None:
                kept.append((r[order], p))
            out.append((*own(r), *(hit or (None, None, None))))
        return out

    schema = ", ".join([*(_kind(df, c) for c in by), _kind(df, order), f"duplicate_of {id_kind}", "method string", "score double"])
    return _apply_rows(df.select(*by, order, payload), by, schema, run)


def cluster(df: DataFrame, by: list[str], order: str, published: str, payload: str, thresholds: ClusterThresholds = CLUSTER) -> DataFrame:
    """Newest first, each row joins the group with the best score among its representative and first members, or opens one.

    Returns by, order, group_id, method and score; the methods' scores are compared as they are.
    """
    own = itemgetter(*by, order)

    def run(rows: list[dict]) -> list[tuple]:
        rows = sorted(_sorted(rows, order), key=lambda r: (r[published] is not None, r[published]), reverse=True)
        groups: list[list[dict]] = []
        out = []
        for r in rows:
            p = r[payload]
            best, at = sim.NO, -1
            for g, members in enumerate(groups):
                for q in members[:COMPARED_MEMBERS]:
                    v = sim.judge_cluster(p, q, thresholds)
                    if v[0] and v[2] > best[2]:
                        best, at = v, g
            if at < 0:
                groups.append([p])
                out.append((*own(r), f"G{len(groups):03d}", "seed", 1.0))
            else:
                groups[at].append(p)
                out.append((*own(r), f"G{at + 1:03d}", best[1], best[2]))
        return out

    schema = ", ".join([*(_kind(df, c) for c in by), _kind(df, order), "group_id string", "method string", "score double"])
    return _apply_rows(df.select(*by, order, published, payload), by, schema, run)


def past_match(candidates: DataFrame, past: DataFrame, *, ident: str, payload: str, past_order: str, past_payload: str, by: list[str], spread: int = 64) -> DataFrame:
    """The first past row, in stored order, that the history judge takes for the same event; no row without one.

    A candidate is read against its scope's past in order up to the first match, as
    no later one counts.  Candidates don't depend on each other, so a scope's are
    dealt over ``spread`` tasks, each with a copy of the scope's past, which the days
    that a history is kept bound.
    """
    left = candidates.select(*by, ident, F.col(payload).alias("payload")).withColumn("salt", F.pmod(F.xxhash64(ident), F.lit(spread)).cast("int"))
    right = past.select(*by, F.col(past_order).alias("past"), F.col(past_payload).alias("payload")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))

    own = itemgetter(*by, ident)

    def run(mine: pa.Table, stored: pa.Table) -> pa.Table:
        known = [(r["past"], sim.history(r["payload"])) for r in _sorted(stored.to_pylist(), "past")]
        out = []
        for at in range(0, len(mine) if known else 0, 500):
            for r in mine.slice(at, 500).to_pylist():
                c = sim.history(r["payload"])
                hit = next(((o, v[1]) for o, p in known if (v := sim.judge_history(c, p))[0]), None)
                if hit:
                    out.append((*own(r), *hit))
        return _table(out, arrow)

    schema = ", ".join([*(_kind(candidates, c) for c in by), _kind(candidates, ident), f"matched_order {past.schema[past_order].dataType.simpleString()}", "method string"])
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    key = [*by, "salt"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def drop_repeats_of_run(df: DataFrame, by: list[str], section: str, order: str, url_key: str, payload: str) -> DataFrame:
    """All sections of a run in order; a row goes if a kept row has its url, or else is the same event; a dropped row's url isn't kept.

    A run is one task: it holds the few rows that were selected.  Adds duplicate_of,
    method and score, null where the row is kept.
    """
    own = itemgetter(*by, section, order)

    def run(rows: list[dict]) -> list[tuple]:
        urls: dict[str, object] = {}
        kept: list[tuple] = []
        out = []
        for r in _sorted(rows, section, order):
            key, url = r[order], r[url_key]
            if url and url in urls:
                out.append((*own(r), urls[url], "final_internal_url", 1.0))
                continue
            p = sim.history(r[payload])
            hit = next(((k, f"final_{v[1]}", v[2]) for k, q in kept if (v := sim.judge_history(p, q))[0]), None)
            out.append((*own(r), *(hit or (None, None, None))))
            if hit is None:
                kept.append((key, p))
                if url:
                    urls[url] = key
        return out

    schema = ", ".join([*(_kind(df, c) for c in (*by, section, order)), f"duplicate_of {df.schema[order].dataType.simpleString()}", "method string", "score double"])
    return _apply_rows(df.select(*by, section, order, url_key, payload), by, schema, run)


def shortlist(df: DataFrame, by: list[str], *, group: str, keywords: str, rank: str, newest: str, final_limit: int, target: int) -> DataFrame:
    """Best groups, then a quota for each keyword in order, then the newest, then fill; the quota counts newly added groups."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        best = rows.sort_values(rank, kind="stable")
        taken: dict[str, None] = {}

        def add(ids, most: int) -> None:
            added = 0
            for g in ids:
                if added >= most or len(taken) >= target:
                    return
                if g not in taken:
                    taken[g] = None
                    added += 1

        add(best[group].head(max(3 * final_limit, target // 2)), target)
        for k in sorted({k for ks in rows[keywords] for k in ks}):
            add(best[[k in list(ks) for ks in best[keywords]]][group], max(2, final_limit // 2))
        add(rows.sort_values(newest, kind="stable")[group].head(max(2 * final_limit, 10)), target)
        add(best[group], target)
        out = pd.DataFrame({group: list(taken), "place": range(1, len(taken) + 1)})
        for c in by:
            out[c] = rows[c].iloc[0]
        return out[[*by, group, "place"]]

    schema = ", ".join([*(_kind(df, c) for c in by), _kind(df, group), "place bigint"])
    return _apply(df, by, schema, run)


def pick_with_supplement(df: DataFrame, by: list[str], order: str, payload: str, limit: int, *, supplement: bool = True) -> DataFrame:
    """The first ``limit`` rows without repeats among them; with ``supplement`` later rows fill what repeats left free."""
    own = itemgetter(*by, order)

    def run(rows: list[dict]) -> list[tuple]:
        kept: list[tuple] = []
        for i, r in enumerate(_sorted(rows, order)):
            if len(kept) >= limit or (i >= limit and not supplement):
                break
            if not any(sim.judge_final(r[payload], q)[0] for _, q in kept):
                kept.append((own(r), r[payload]))
        return [(*k, place) for place, (k, _) in enumerate(kept, 1)]

    schema = ", ".join([*(_kind(df, c) for c in by), _kind(df, order), "place bigint"])
    return _apply_rows(df.select(*by, order, payload), by, schema, run)
