"""Operators against hand-checked results, and the catalogue against DuckDB."""

import datetime as dt
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from eventloom.functions import plain
from eventloom.functions import similarity as sim
from eventloom.functions import text as tx
from eventloom.operators import articles as ar
from eventloom.operators import groups as gr
from eventloom.operators import ordered, sampling
from eventloom.operators import selection as sel
from eventloom.operators import usage as us
from eventloom.plans import queries, views
from eventloom.plans.queries import QUERIES, SQL
from eventloom.sources import files
from eventloom.streaming import micro

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_catalogue(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    text = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).astype(str).to_numpy()))
    assert text(got) == text(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_catalogue_without_sql_is_stable(spark, name):
    first, second = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first and first == second


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sample_quotas(spark):
    sizes = spark.createDataFrame([(0, 5), (1, 3), (2, 2)], "bucket long, size long")
    assert [r[2] for r in rows(sampling.bucket_quotas(sizes, 5, 0))] == [3, 1, 1]
    for most in (1, 4, 7, 10, 20):
        for least in (0, 1, 3):
            q = rows(sampling.bucket_quotas(sizes, most, least))
            assert sum(x[2] for x in q) == min(10, most) and all(x[2] <= x[1] for x in q)


def test_split_remainder(spark):
    df = spark.createDataFrame([("a", i, 10) for i in range(3)], "g string, i int, t long")
    assert rows(df.select("i", sampling.split_remainder(F.col("t"), ["g"], [F.asc("i")]))) == [(0, 4), (1, 3), (2, 3)]


def test_two_key_dedup_is_no_closure(spark):
    df = spark.createDataFrame([("s", 1, "u1", "u2"), ("s", 2, "u2", "u3"), ("s", 3, "u3", "u4"), ("s", 4, None, None), ("s", 5, "", "")], "g string, o int, a string, b string")
    assert [r[1] for r in rows(ordered.drop_seen_links(df, ["g"], "o", "a", "b"))] == [1, 3, 4, 5]


def test_publishers_shadowing(spark):
    names = spark.createDataFrame([("a.kr", "Parent", 1), ("b.a.kr", "Child", 2)], "domain string, name string, ord int")
    df = spark.createDataFrame([("http://www.b.a.kr:80/x",), ("http://m.some-site.co.kr/",), (None,)], "url string")
    first = {r["url"]: r["publisher"] for r in ar.publishers(df, "url", names).collect()}
    assert first == {"http://www.b.a.kr:80/x": "Parent", "http://m.some-site.co.kr/": "m.some-site", None: "언론사 미상"}
    assert {r["publisher"] for r in ar.publishers(df, "url", names, longest=True).collect()} == {"Child", "m.some-site", "언론사 미상"}


def test_retention(spark):
    df = spark.createDataFrame([(0, "2024-01-10"), (2, "2024-01-08"), (3, "2024-01-07"), (-1, "2024-01-11"), (9, None)], "age int, d string")
    kept = ar.retained(df, F.to_date("d"), F.lit("2024-01-10").cast("date"), 3)
    assert [r[0] for r in rows(kept.select("age"))] == [0, 2]


def test_append_keeps_rows_of_one_run(spark):
    schema = "scope string, ord int, id string, url array<string>, title array<string>"
    new = spark.createDataFrame([("s", 1, "i1", ["u1"], ["t"]), ("s", 2, "i2", ["u2"], ["t"]), ("s", 3, "i3", ["u9"], ["x"])], schema)
    old = spark.createDataFrame([("s", 0, "i0", ["u9"], ["y"])], schema)
    got = ar.append_new(new, old, {"url": F.col("url"), "title": F.col("title")}, scope="scope", ident="id", order="ord")
    assert [r["id"] for r in got.orderBy("id").collect()] == ["i1", "i2"]


def test_importance(spark):
    df = spark.createDataFrame([(24.0,), (13.0,), (5.0,), (3.9,)], "p double")
    got = [r[1] for r in df.select("p", gr.importance(F.col("p"), F.lit(1), F.lit(1), F.array().cast("array<string>"))).collect()]
    assert got == [5, 4, 3, 2]


def test_cost(spark):
    c = us.cost(F.lit(1000), F.lit(200), F.lit(500), F.lit(0.05), F.lit(0.005), F.lit(0.40))
    assert spark.range(1).select(c).first()[0] == pytest.approx(0.000241)


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"briefing_name": "b", "subject_prefix": "p", "receiver_env": "E", "sections": [{"section_name": "s"}]}')
    with pytest.raises(ValueError, match="keywords"):
        files.load_config(str(tmp_path / "c.json"))


def test_history_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1)), ("b", dt.date(2024, 1, 2))], "id string, saved_date date")
    path = f"file://{tmp_path}/h"
    assert files.load_history(spark, path, df.schema).count() == 0
    files.append_history(df, path)
    assert rows(files.load_history(spark, path, df.schema).select("id")) == [("a",), ("b",)]


def test_streams_match_batches(spark, tmp_path):
    schema = "scope string, key string, day long"
    data = [[("s", "a", 1), ("s", "b", 1)], [("s", "a", 2), ("s", "c", 2)], [("s", "a", 5)]]
    for i, part in enumerate(data):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    got: list[tuple] = []
    for i in range(3):
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / str(i)))
        q = micro.drop_delivered(src, "scope", "key", "day", 3).writeStream.outputMode("append").format("memory").queryName(f"m{i}").start()
        q.processAllAvailable()
        q.stop()
        got += [tuple(r) for r in spark.table(f"m{i}").collect()]
    assert sorted(got) == sorted(r for p in data for r in p)

    def fails(df, epoch):
        return False

    q = micro.deliver_then_store(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "0")), fails, lambda d, e: None, str(tmp_path / "cp"))
    with pytest.raises(Exception, match="not delivered"):
        q.processAllAvailable()
    q.stop()


def test_stream_counts(spark, tmp_path):
    spark.createDataFrame([("x", "2024-01-01 00:10:00"), ("x", "2024-01-01 03:00:00"), ("x", "2024-01-01 05:00:00")], "k string, t string").select("k", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / "e"))
    src = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "e"))
    q = micro.counts_by_window(src, "t", "4 hours", "1 hour", "k").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [1, 2]


def test_repeats_are_found_in_a_section(spark, tmp_path):
    """Copies of a text by another source are repeats; another conversation is another section, but not another history."""
    text = "Harbour bridge opens after nine years of repairs in the old northern port of the island " * 4
    other = "Quiet museum garden wins award for rare alpine flowers " * 6
    turns = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "user", other), (2, 0, "user", text), (2, 1, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, "Nothing like it at all"), (8, text), (9, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c, d, e = 100_000, 100_001, 100_002, 200_000, 200_001
    for name in ("history_repeats", "final_repeats"):
        assert {r["ord"]: r["duplicate_of"] for r in QUERIES[name](spark, str(tmp_path)).collect()} == {a: None, b: a, c: None, d: None, e: None}
    # Sections of a run go by name: the assistant's turn is first.
    assert {r["ord"]: r["duplicate_of"] for r in QUERIES["run_repeats"](spark, str(tmp_path)).collect()} == {b: None, a: b, c: None, d: None, e: None}
    groups = {r["ord"]: (r["section"], r["group_id"]) for r in QUERIES["event_clusters"](spark, str(tmp_path)).collect()}
    assert groups[a] == groups[b] and len(set(groups.values())) == 4
    assert {r["ord"] for r in QUERIES["final_selection"](spark, str(tmp_path)).collect()} == {a, c, d, e}
    assert {r["ord"]: r["matched_order"] for r in QUERIES["past_events"](spark, str(tmp_path)).collect()} == {a: 8, b: 8, d: 8}


def plain_cluster(payloads):
    """The clustering pass without Spark: rows in order, each with the best of its groups' first five members."""
    groups, out = [], []
    for p in payloads:
        verdicts = [(v[2], -g, v[1]) for g, m in enumerate(groups) for q in m[:5] if (v := sim.judge_cluster(p, q))[0]]
        if verdicts:
            score, g, _ = max(verdicts, key=lambda x: (x[0], x[1]))
            groups[-g].append(p)
            out.append((f"G{1 - g:03d}", score))
        else:
            groups.append([p])
            out.append((f"G{len(groups):03d}", 1.0))
    return out


def test_clusters_are_the_plain_pass(spark, tmp_path):
    r = random.Random(3)
    vocabulary = ["harbour", "bridge", "museum", "garden", "rain", "market", "school", "train", "forest", "engine", "light", "river"]
    turns = []
    for i in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randint(3, 40))]
        for k in range(r.randint(1, 2)):
            turns.append((i % 3, len(turns), "user", " ".join(w)))
            w[r.randrange(len(w))] = r.choice(vocabulary)
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    p = queries._payload(views.turns(spark, str(tmp_path)), "cluster").collect()
    got = {x["ord"]: (x["group_id"], x["score"]) for x in QUERIES["event_clusters"](spark, str(tmp_path)).collect()}
    for section in {x["section"] for x in p}:
        own = sorted((x for x in p if x["section"] == section), key=lambda x: (-x["published"].timestamp(), x["ord"]))
        assert [got[x["ord"]] for x in own] == plain_cluster([x["payload"].asDict() for x in own])


KOREAN = ["[속보] 삼성전자, AI·클라우드 협력 계약 체결(종합) 2.5%", "<b>오픈AI</b>와 SK C&C, 3월 15일 공급 계약을 &amp; 발표…", "경기도의 풍수해대책 2026년 5월 7일 점검, 美·中 정상회담으로부터", "은는 이가 12 345 기자 뉴스 시장에서는", "", None, "롯데 홈쇼핑 영업이익 실적이 3.5% 증가했다 (사진)", "Ｆｕｌｌ width\u00a0spaces\u3000and　İ mixed"]


def test_payloads_are_those_of_the_column_rules(spark):
    df = spark.createDataFrame([(a, b) for a in KOREAN for b in KOREAN], "title string, body string").unionByName(views.turns(spark, SF).select("title", "body").limit(40))
    args = (F.col("title"), F.col("body"))
    for kind, column in (("cluster", sim.cluster_payload(*args, F.lit("k"))), ("history", sim.history_payload(*args)), ("final", sim.final_payload(*args))):
        got = df.select(plain.payload(kind, *args, *([F.lit("k")] if kind == "cluster" else [])).alias("a"), column.alias("b")).collect()
        for r in got:
            assert r["a"].asDict() == r["b"].asDict()


def test_alias_titles_reach_the_judge():
    a = plain.history_payload("Museum opens a new wing", "In the old town", ["Harbour bridge is closed for repairs", " "])
    b = plain.history_payload("Harbour bridge is closed for repairs", "Nothing else")
    assert sim.judge_history(a, b)[:2] == (True, "event_key") or sim.judge_history(a, b)[1] == "title_exact"
    assert sim.judge_history(plain.history_payload("Museum opens a new wing", "In the old town"), b) == sim.NO
    assert len(plain.history_payload("t", "b", [f"alias title number {i}" for i in range(40)])["titles"]) == 16


def test_bounded_ratio_and_soft_matches_are_the_plain_ones():
    from difflib import SequenceMatcher

    r = random.Random(6)
    word = lambda n: "".join(r.choice("aabbccdeé") for _ in range(n))
    for _ in range(400):
        a = word(r.randint(1, 320))
        b = r.choice([word(r.randint(1, 320)), a[: r.randint(0, 300)] + word(r.randint(1, 40)), "xyz" + a])
        exact = SequenceMatcher(None, a, b).ratio()
        for least in (0.0, 0.7, 0.82):
            assert sim.ratio(a, b, least) == exact or exact < least and sim.ratio(a, b, least) < least
    token = lambda: r.choice(["ab", "abc", "abca", "bbca", "cabca", "abcab", "ccccc", "aabbc", "a", ""])

    def plain_related(a, b):
        a, b = plain.strip_particle(a), plain.strip_particle(b)
        short, long = sorted((a, b), key=len)
        return bool(a and b) and (a == b or (len(short) >= 3 and short in long) or (len(short) >= 4 and SequenceMatcher(None, a, b).ratio() >= 0.82))

    for _ in range(400):
        left, right = ([token() for _ in range(r.randint(0, 6))] for _ in range(2))
        free, out = [t for t in right if t], []
        for a in filter(None, left):
            b = next((x for x in free if plain_related(a, x)), None)
            if b is not None:
                free.remove(b)
                out.append(a if len(a) <= len(b) else b)
        assert sim.soft_common(left, right) == list(dict.fromkeys(out))


def test_selection_decisions(spark):
    groups = spark.createDataFrame([(s, f"G{i}", i, 3) for s in ("none", "bad", "low", "unknown", "good") for i in (1, 2, 3)], "section string, group_id string, place long, importance int")
    reply = lambda *e: '```json\n{"selected": [' + ", ".join(f'{{"group_id": "{g}", "importance_score": {n}}}' for g, n in e) + "]}```"
    replies = spark.createDataFrame([("bad", "{]"), ("low", reply(("G1", 2), ("G2", 1))), ("unknown", reply(("X", 5))), ("good", reply(("G3", 1), ("G3", 4), ("G3", 5), ("X", 5), ("G1", 9)))], "section string, reply string")
    got = [tuple(r) for r in sel.chosen_groups(groups, replies, ["section"], limit=2).select("section", "place", "group_id", "importance_score", "decision").orderBy("section", "place").collect()]
    ranked = [(s, i, f"G{i}", 3, "ranked") for s in ("bad", "none", "unknown") for i in (1, 2)]
    assert got == sorted([*ranked, ("good", 1, "G3", 4, "model"), ("good", 2, "G1", 5, "model")])


def test_state_and_history_files(spark, tmp_path):
    (tmp_path / "state.json").write_text('{"updated_at": "x", "total_count": 2,\n "domains": ["a.kr", " ", "b.kr"]}')
    assert rows(files.stored_domains(spark, f"file://{tmp_path}/state.json")) == [("a.kr",), ("b.kr",)]
    assert files.stored_domains(spark, f"file://{tmp_path}/none.json").count() == 0
    (tmp_path / "p.csv").write_text("b.kr,Two\na.kr,One\n")
    assert [tuple(r) for r in files.publisher_table(spark, f"file://{tmp_path}/p.csv").orderBy("ord").collect()] == [("b.kr", "Two", 0), ("a.kr", "One", 1)]
    schema = "id string, saved_date string"
    path = f"file://{tmp_path}/h"
    for ids in (["a", "b"], ["c"]):
        files.rewrite_history(spark.createDataFrame([(i, "2024-01-01") for i in ids], schema), path)
        assert [r[0] for r in rows(files.load_history(spark, path, spark.createDataFrame([], schema).schema).select("id"))] == ids
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("h")) == ["h"]
    (tmp_path / "h" / "saved_date=2024-01-01" / "broken.json").write_text('{"id": 1\n{"id": "d"}\n')
    parsed = spark.createDataFrame([], schema).schema
    assert [r[0] for r in rows(files.load_history(spark, path, parsed).select("id"))] == ["c", "d"]
    assert files.broken_history(spark, path, parsed).count() == 1


def test_cards_and_mail(spark):
    df = spark.createDataFrame([("s", 1, "A<b", "http://x", "P"), ("s", 2, "B", "#", "P"), ("t", 1, "C", " ", "P")], "section string, o int, title string, url string, source string")
    cards = files.related_cards(df, ["section"], "o", "title", "url", "source")
    assert [r["section"] for r in cards.collect()] == ["s"]
    mail = files.section_mail(cards, "section", "html", "News").first()["html"]
    assert "<h2>s</h2>" in mail and "A&lt;b" in mail and 'id="news-1"' in mail and "news-2" not in mail
    assert [r["receiver"] for r in files.mail_rows(cards, ["a@x", "b@x"], "bulk").collect()] == ["a@x,b@x"]


def test_streams_keep_state_across_batches(spark, tmp_path):
    """One query reads a file a batch; what one batch delivered is known in the next."""
    schema = "scope string, key string, day long"
    data = [[("s", "a", 1), ("s", "b", 1)], [("s", "a", 2), ("s", "c", 2), ("t", "a", 2)], [("s", "a", 5)]]
    for i, part in enumerate(data):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.utime(next(p for p in sorted((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime, reverse=True)), (1_700_000_000 + i, 1_700_000_000 + i))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = micro.drop_delivered(src, "scope", "key", "day", 3).writeStream.outputMode("append").format("memory").queryName("state").start()
    q.processAllAvailable()
    batches = len([p for p in q.recentProgress if p["numInputRows"]])
    q.stop()
    assert batches == 3 and rows(spark.table("state")) == sorted([("s", "a", 1), ("s", "b", 1), ("s", "c", 2), ("t", "a", 2), ("s", "a", 5)])
    news = [[("http://www.a.kr/1", "2024-01-30 10:00:00"), ("http://a.kr/1?x", "2024-01-30 11:00:00")], [("https://m.a.kr/1", "2024-01-30 12:00:00"), ("http://a.kr/1/", "2024-01-30 12:30:00"), ("http://a.kr/2", "2024-01-20 12:00:00"), (None, None)]]
    for i, part in enumerate(news):
        spark.createDataFrame(part, "url string, t string").select("url", F.to_timestamp("t").alias("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "news"))
    src = spark.readStream.schema("url string, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "news"))
    recent = micro.recent_only(src, "t", F.lit("2024-01-31 00:00:00").cast("timestamp"), 24)
    q = micro.first_by_url(recent, "t", "url", "1 day").writeStream.outputMode("append").format("memory").queryName("first").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["url_key"] for r in spark.table("first").collect()) == ["a.kr/1", "m.a.kr/1"]


def test_unlike_texts_are_not_compared_letter_by_letter(monkeypatch):
    """Bodies of the same letters in another order: the bounds alone tell that they are unlike, at each place of the text."""
    r = random.Random(8)
    syllables = ["the", "on", "er", "ti", "an", "es", "wh", "ha", "re", "in"]
    bodies = ["".join(r.choice(syllables) for _ in range(70)) for _ in range(12)]
    full = []
    plain_matcher = sim.SequenceMatcher
    monkeypatch.setattr(sim, "SequenceMatcher", lambda *a: full.append(a) or plain_matcher(*a))
    for a in bodies:
        for b in bodies:
            least = plain_matcher(None, a, b).ratio()
            assert sim.ratio(a, b, 0.9) == (1.0 if a == b else 0.0) or least >= 0.9
            assert sim.ratio(a, b, least) == least
    full.clear()
    assert [sim.ratio(a[:150], b[:150], 0.9) for a in bodies for b in bodies if a != b] == [0.0] * 132 and not full


@pytest.mark.parametrize("name", ["text_keys", "cluster_tokens", "fingerprints", "neighbour_overlap", "anchors_and_numbers"])
def test_texts_are_read_once_in_one_pass(spark, name):
    """A text's rules run once for a row, and not token by token as nested columns."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Scan parquet") == 1 and plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan and "regexp_replace" not in plan


def test_text_rules_in_one_pass_are_those_of_the_columns(spark):
    odd = ["a\x1cb \x1d c", "\x85x  y　", "a [b] 【c】 (d) … 2024년 1월 2일 e-f", "<i>x</i> < y &lt;b&gt; &#39;", "x" * 300 + " 가나에서 12 345.6 AI의"]
    df = spark.createDataFrame([(a, b) for a in KOREAN + odd for b in KOREAN + odd], "title string, body string")
    t, b = F.col("title"), F.col("body")
    whole = F.concat_ws(" ", t, b)
    rules = {
        plain.text_keys: {"x": tx.normalize_title(t), "y": tx.normalize_compare(b), "z": tx.compact(b, True)},
        plain.joined_tokens: {"x": F.array_join(tx.cluster_tokens(whole), " ")},
        plain.fingerprint: {"x": sim.simhash(tx.cluster_tokens(whole))},
        plain.tokens_and_hash: {"x": F.array_join(tx.cluster_tokens(whole), " "), "y": F.substring(F.md5(F.array_join(tx.cluster_tokens(whole), " ").cast("binary")), 1, 16)},
        plain.anchors_and_numbers: {"x": F.array_join(tx.history_anchors(tx.history_tokens(whole)), " "), "y": F.array_join(tx.numbers(whole), " ")},
    }
    for rule, columns in rules.items():
        for r in df.select(t, b, *(c.alias(k) for k, c in columns.items())).collect():
            got = [" ".join(x) if isinstance(x, list) else x for x in rule(r["title"], r["body"]) if not isinstance(x, int)]
            assert got == list(r)[2:], rule


def test_neighbours_are_all_pairs_of_places(spark, tmp_path):
    """Gaps have no pair, and a place that is taken twice has one for each text, as in the join."""
    rows_ = [(1, "alpha beta gamma"), (2, "alpha beta delta"), (2, "gamma"), (4, "alpha"), (5, None)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows_], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r[:2] for r in rows(QUERIES["neighbour_overlap"](spark, str(tmp_path)))] == [(1, 1), (1, 2), (4, 0)]


def test_rows_of_a_group_come_in_order_without_frames(spark):
    """Nulls are last, newest first; and no group becomes a data frame."""
    p = "named_struct('title_key', t, 'body_key', t, 'title_tokens', split(t, ' '), 'tokens', split(t, ' '), 'anchors', split(t, ' '), 'numbers', array(''), 'fingerprint', '', 'url_key', t)"
    df = spark.createDataFrame([("a", 2, None, "one"), ("a", 1, None, "two"), ("a", 3, dt.datetime(2024, 1, 2), "one"), ("a", 4, dt.datetime(2024, 1, 3), "three"), ("b", 5, None, "one")], "s string, o long, at timestamp_ntz, t string").withColumn("p", F.expr(p))
    found = ordered.cluster(df, ["s"], "o", "at", "p")
    assert rows(found.select("s", "o", "group_id")) == [("a", 1, "G003"), ("a", 2, "G002"), ("a", 3, "G002"), ("a", 4, "G001"), ("b", 5, "G001")]
    kept = ordered.drop_repeats(df, ["s"], "o", "p", "final")
    assert [r[:3] for r in rows(kept.select("s", "o", F.coalesce("duplicate_of", F.lit(0))))] == [("a", 1, 0), ("a", 2, 0), ("a", 3, 2), ("a", 4, 0), ("b", 5, 0)]
    picked = ordered.pick_with_supplement(df, ["s"], "o", "p", 2)
    assert rows(picked) == [("a", 1, 1), ("a", 2, 2), ("b", 5, 1)]
    for x in (found, kept, picked):
        assert "InPandas" not in x._jdf.queryExecution().executedPlan().toString()


def test_what_a_worker_keeps_of_tokens_is_bounded():
    """Ever new tokens of many texts don't fill a worker's memory."""
    for i in range(3 * plain._KNOWN):
        plain.strip_particle(f"t{i}")
    caches = [f.cache_info() for f in vars(plain).values() if hasattr(f, "cache_info")]
    assert len(caches) >= 5 and max(c.currsize for c in caches) <= 1 << 15 and sum(c.maxsize for c in caches) <= 1 << 18


def test_soft_matches_stop_where_a_share_is_out_of_reach(spark):
    """The judge's verdict doesn't depend on it: fewer matches are only left out where the share is too small anyway."""
    left, right = sim.Side([f"alpha{c}x" for c in "abcdefghij"]), sim.Side([f"alpha{c}x" for c in "hij"] + ["omega"] * 7)
    every = sim._soft(left, right)
    for least in range(12):
        found = sim._soft(left, right, least)
        assert found == every if least <= len(every) else len(found) < least
    past = spark.createDataFrame([(i, f"title number {i} " + " ".join(f"word{i}x{k}" for k in range(9)), None) for i in (2, 1, 3)], "past_ord long, title string, body string")
    pay = lambda d: d.withColumn("p", plain.payload("history", F.col("title"), F.col("body"))).withColumn("s", F.lit("all"))
    mine = past.select((F.col("past_ord") + 10).alias("o"), "title", "body").union(spark.createDataFrame([(20, "quiet garden", None)], "o long, title string, body string"))
    found = ordered.past_match(pay(mine), pay(past).withColumnRenamed("p", "q"), ident="o", payload="p", past_order="past_ord", past_payload="q", by=["s"])
    known = sorted(past.collect(), key=lambda r: r["past_ord"])
    payloads = [(r["past_ord"], plain.history_payload(r["title"], r["body"])) for r in known]
    expected = [("all", r["o"], *next((k, v[1]) for k, p in payloads if (v := sim.judge_history(plain.history_payload(r["title"], r["body"]), p))[0])) for r in mine.collect() if r["o"] < 20]
    assert rows(found) == sorted(expected)
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
