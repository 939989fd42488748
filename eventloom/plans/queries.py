"""The catalogue: each query in Spark and, where SQL can say it, in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, plain, urls
from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import articles as ar
from ..operators import groups as gr
from ..operators import ordered, sampling
from ..operators import usage as us
from ..sources import files
from . import duck as dk
from .views import ARTICLES_SQL, DELIVERED_SQL, DOMAINS_SQL, NOW, PRICES_SQL, TURNS_SQL, USAGE_SQL, articles, delivered, domains, prices, table, turns, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_now = lambda: F.lit(NOW).cast("timestamp_ntz")


@query("SELECT event_id, event_type, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-30 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'")
def recent_events(spark, sf):
    return ar.recent(table(spark, sf, "events"), "ts", _now(), 24).select("event_id", "event_type", "ts")


@query("SELECT floor(floor(datediff_s / 3600) / 4)::BIGINT AS bucket, event_type, count(*) AS n FROM (SELECT event_type, floor(epoch(TIMESTAMP '2024-01-31' - ts)) AS datediff_s FROM events WHERE ts <= TIMESTAMP '2024-01-31') GROUP BY ALL")
def time_buckets(spark, sf):
    e = table(spark, sf, "events").where(F.col("ts") <= _now())
    return e.withColumn("bucket", dates.age_bucket(F.col("ts"), _now(), 4)).groupBy("bucket", "event_type").agg(F.count(F.lit(1)).alias("n"))


def _sample_sql(most: int, least: int) -> str:
    return f"""WITH r AS (SELECT event_id, ts, floor(floor(epoch(TIMESTAMP '2024-01-31' - ts) / 3600) / 4)::BIGINT AS bucket FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-30' AND TIMESTAMP '2024-01-31'),
 z AS (SELECT bucket, count(*) AS size FROM r GROUP BY 1), t AS (SELECT *, least(size, {least}) AS sure, size - least(size, {least}) AS room FROM z),
 u AS (SELECT *, sum(size) OVER () AS total, sum(sure) OVER () AS st, sum(room) OVER () AS rt, coalesce(sum(sure) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb FROM t),
 v AS (SELECT *, CASE WHEN rt > 0 THEN CAST({most} - st AS DOUBLE) * room / rt ELSE 0.0 END AS exact FROM u), w AS (SELECT *, least(floor(exact), room) AS extra FROM v),
 x AS (SELECT *, {most} - st - sum(extra) OVER () AS lft, row_number() OVER (ORDER BY (extra >= room)::INT, exact - floor(exact) DESC, bucket) AS rn FROM w),
 y AS (SELECT bucket, CASE WHEN total <= {most} THEN size WHEN st >= {most} THEN least(sure, greatest(0, {most} - sb)) ELSE sure + extra + (CASE WHEN rn <= lft AND extra < room THEN 1 ELSE 0 END) END AS quota FROM x)
 SELECT event_id, r.bucket, row_number() OVER (PARTITION BY r.bucket ORDER BY ts DESC, event_id) AS place FROM r JOIN y USING (bucket) QUALIFY place <= quota"""


@query(_sample_sql(20, 0))
def bucket_sample(spark, sf):
    return sampling.sample_buckets(table(spark, sf, "events"), "ts", [F.desc("ts"), F.asc("event_id")], _now(), max_total=20).select("event_id", "bucket", "place")


@query(_sample_sql(40, 3))
def bucket_sample_with_minimum(spark, sf):
    return sampling.sample_buckets(table(spark, sf, "events"), "ts", [F.desc("ts"), F.asc("event_id")], _now(), max_total=40, min_per_bucket=3).select("event_id", "bucket", "place")


@query(f"SELECT ord, section FROM {ARTICLES_SQL} WHERE NOT (contains(lower(concat_ws(' ', title, body, source, keyword)), 'thing') OR contains(lower(concat_ws(' ', title, body, source, keyword)), 'src3'))")
def keyword_filter(spark, sf):
    return ar.without_keywords(articles(spark, sf), ["Thing", " SRC3 "], "title", "body", "source", "keyword").select("ord", "section")


@query(f"SELECT page_id, {dk.remove_tags('html')} AS plain, {dk.strip_entities('html')} AS spaced FROM pages")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.remove_tags(F.col("html")).alias("plain"), tx.strip_entities(F.col("html")).alias("spaced"))


@query(f"SELECT ord, {dk.normalize_title('title')} AS title_key, {dk.normalize_compare('body')} AS compare_text, {dk.gsub(dk.normalize_compare('body', True), dk.SPACES + '+', '')} AS compact_text FROM {ARTICLES_SQL}")
def text_keys(spark, sf):
    keys = plain.one_pass(plain.text_keys, {"title_key": "string", "compare_text": "string", "compact_text": "string"}, F.col("title"), F.col("body"))
    return articles(spark, sf).select("ord", keys.alias("k")).select("ord", "k.*")


def _tokens_sql(text: str, stopwords, limit: int, actions: bool = False) -> str:
    t = f"list_transform({dk.raw_tokens(text)}, lambda t: {dk.normalize_token('t')})"
    keep = f"t NOT IN {dk.any_of(stopwords)}" + (f" OR {dk.action_of(dk.normalize_token('t'))} <> ''" if actions else "")
    return f"list_filter({t}, lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+') AND ({keep}))"


_TOKENS = f"(SELECT *, {dk.ordered_distinct('raw')}[1:80] AS tokens FROM (SELECT *, {_tokens_sql(dk.normalize_compare(chr(39) + chr(39) + ' || title || ' + chr(39) + ' ' + chr(39) + ' || body'), tx.lx.CLUSTER_STOPWORDS, 80)} AS raw FROM {ARTICLES_SQL}))"


@query(f"SELECT ord, array_to_string(tokens, ' ') AS tokens, len(tokens) AS n FROM {_TOKENS}")
def cluster_tokens(spark, sf):
    found = plain.one_pass(plain.joined_tokens, {"tokens": "string", "n": "bigint"}, F.col("title"), F.col("body"))
    return articles(spark, sf).select("ord", found.alias("t")).select("ord", "t.*")


@query(f"SELECT ord, {dk.simhash('tokens')} AS fingerprint FROM {_TOKENS}")
def fingerprints(spark, sf):
    found = plain.one_pass(plain.fingerprint, {"fingerprint": "string"}, F.col("title"), F.col("body"))
    return articles(spark, sf).select("ord", found["fingerprint"].alias("fingerprint"))


@query(f"""WITH t AS (SELECT ord, tokens, md5(coalesce(array_to_string(tokens, ' '), ''))[1:16] AS h FROM {_TOKENS})
 SELECT a.ord AS ord, len(list_intersect(a.tokens, b.tokens)) AS common, round(CASE WHEN least(len(a.tokens), len(b.tokens)) > 0 THEN len(list_intersect(a.tokens, b.tokens)) / least(len(a.tokens), len(b.tokens)) ELSE 0.0 END, 6) AS overlap,
 bit_count(xor(('0x' || a.h)::UBIGINT, ('0x' || b.h)::UBIGINT))::BIGINT AS distance FROM t a JOIN t b ON b.ord = a.ord + 1""")
def neighbour_overlap(spark, sf):
    # A text's tokens are found once: they go to its own place and, as the next text's, to the one before.
    t = articles(spark, sf).select("ord", plain.one_pass(plain.tokens_and_hash, {"t": "array<string>", "h": "string"}, F.col("title"), F.col("body")).alias("x"))
    places = F.explode(F.array(F.struct("ord", F.lit(0).alias("side")), F.struct((F.col("ord") - 1).alias("ord"), F.lit(1).alias("side"))))
    t = t.select("x", places.alias("p")).groupBy("p.ord").agg(*(F.collect_list(F.when(F.col("p.side") == i, F.col("x"))).alias(s) for i, s in enumerate("ab")))
    t = t.where((F.size("a") > 0) & (F.size("b") > 0)).select("ord", F.explode("a").alias("a"), "b").select("ord", "a", F.explode("b").alias("b"))
    t = t.select("ord", "a.t", "a.h", F.col("b.t").alias("t2"), F.col("b.h").alias("h2"))
    return t.select("ord", sim.common(F.col("t"), F.col("t2")).alias("common"), F.round(sim.overlap(F.col("t"), F.col("t2")), 6).alias("overlap"), sim.hamming(F.col("h"), F.col("h2")).alias("distance"))


_HIST = f"""(SELECT *, {dk.ordered_distinct('raw')}[1:80] AS tokens FROM (SELECT *, {_tokens_sql(dk.normalize_compare("title || ' ' || body", True), tx.lx.HISTORY_STOPWORDS, 80, True)} AS raw FROM {ARTICLES_SQL}))"""
_ANCHOR = f"list_filter(list_transform(tokens, lambda t: {dk.normalize_token('t')}), lambda t: t <> '' AND t NOT IN {dk.any_of(tx.lx.ANCHOR_STOPWORDS)} AND (regexp_matches(t, '[a-zA-Z]') OR (regexp_matches(t, '[가-힣]') AND length(t) >= 3) OR length(t) >= 4))"


@query(f"""WITH h AS (SELECT ord, tokens, {_ANCHOR} AS a, title || ' ' || body AS txt FROM {_HIST})
 SELECT ord, array_to_string({dk.ordered_distinct('a')}[1:20], ' ') AS anchors, array_to_string(list_sort(list_distinct(regexp_extract_all(txt, '[0-9]+(?:\\.[0-9]+)?'))), ' ') AS numbers FROM h""")
def anchors_and_numbers(spark, sf):
    found = plain.one_pass(plain.anchors_and_numbers, {"anchors": "string", "numbers": "string"}, F.col("title"), F.col("body"))
    return articles(spark, sf).select("ord", found.alias("x")).select("ord", "x.*")


@query(f"SELECT page_id, {dk.page_key('url')} AS page_key, {dk.link_key('url')} AS link_key, {dk.host('url')} AS host FROM pages")
def url_keys(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.page_key(u).alias("page_key"), urls.link_key(u).alias("link_key"), urls.host(u).alias("host"))


@query(f"SELECT page_id, {dk.article_key('url')} AS article_key FROM pages")
def article_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.article_key(F.col("url")).alias("article_key"))


_BARE = "regexp_replace(split_part(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':', 1), '^www\\.', '')"


@query(f"""WITH p AS (SELECT page_id, {_BARE} AS h FROM pages), m AS (SELECT h, arg_min(name, ord) AS name FROM (SELECT DISTINCT h FROM p) JOIN {DOMAINS_SQL} d ON h = domain OR ends_with(h, '.' || domain) GROUP BY h)
 SELECT page_id, CASE WHEN h = '' THEN '언론사 미상' ELSE coalesce(name, regexp_replace(h, '(\\.co\\.kr|\\.or\\.kr|\\.go\\.kr|\\.ac\\.kr|\\.com|\\.net|\\.org|\\.kr)$', '')) END AS publisher, h <> '' AND name IS NULL AS unmapped FROM p LEFT JOIN m USING (h)""")
def publishers(spark, sf):
    return ar.publishers(table(spark, sf, "pages").select("page_id", "url"), "url", domains(spark)).select("page_id", "publisher", "unmapped")


_KNOWN = "(SELECT DISTINCT lower(source) || '.example.com' AS domain FROM documents WHERE source IS NOT NULL UNION SELECT 'old.example.org')"


def _known(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").where("source is not null").select(F.concat(F.lower("source"), F.lit(".example.com")).alias("domain")).distinct().union(spark.createDataFrame([("old.example.org",)], "domain string"))


@query(f"""WITH c AS (SELECT DISTINCT {_BARE} AS domain FROM pages), k AS {_KNOWN}
 SELECT domain, k.domain IS NULL AS is_new, c.domain IS NOT NULL AS in_current FROM c FULL JOIN k USING (domain) WHERE domain <> ''""")
def unmapped_domains(spark, sf):
    return ar.unmapped_domains(table(spark, sf, "pages").select(urls.bare_host(F.col("url")).alias("domain")), _known(spark, sf))


@query(f"SELECT page_id FROM pages QUALIFY row_number() OVER (PARTITION BY {dk.page_key('url')} ORDER BY page_id) = 1 OR {dk.page_key('url')} = ''")
def first_of_url(spark, sf):
    return ar.first_of_key(table(spark, sf, "pages"), urls.page_key(F.col("url")), "page_id").select("page_id")


@query(f"""WITH k AS (SELECT {dk.article_key('url')} AS key, arg_min(substr(html, 1, 40), page_id) AS t FROM pages GROUP BY 1)
 SELECT p.page_id AS ord, k.t AS matched_title FROM pages p LEFT JOIN k ON k.key <> '' AND {dk.article_key("'http://' || regexp_replace(p.url, '^https?://', '')")} = k.key""")
def seen_by_url(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("ord"), "url", F.substring("html", 1, 40).alias("title"))
    past = p.select("ord", "title", F.array(urls.article_key(F.col("url"))).alias("urls"))
    return ar.seen_before(p.select("ord", F.concat(F.lit("http://"), F.regexp_replace("url", "^https?://", "")).alias("url")), past).select("ord", "matched_title")


@query(f"""WITH n AS (SELECT ord, md5(title) AS id, {dk.page_key('url')} AS u, {dk.normalize_title('title')} AS t FROM {ARTICLES_SQL}), s AS (SELECT {dk.page_key('url')} AS u, {dk.normalize_title('title')} AS t FROM {DELIVERED_SQL}),
 x AS (SELECT id FROM n WHERE u IN (SELECT u FROM s WHERE u <> '') OR t IN (SELECT t FROM s WHERE t <> ''))
 SELECT min(ord) AS ord, id FROM n WHERE id NOT IN (SELECT id FROM x) GROUP BY id""")
def append_new_events(spark, sf):
    keyed = lambda d: d.select("ord", F.lit("all").alias("scope"), F.md5(F.col("title").cast("binary")).alias("id"), F.array(urls.page_key(F.col("url"))).alias("u"), F.array(tx.normalize_title(F.col("title"))).alias("t"))
    return ar.append_new(keyed(articles(spark, sf)), keyed(delivered(spark, sf)), {"url": F.col("u"), "title": F.col("t")}, scope="scope", ident="id", order="ord").select("ord", "id")


@query("""SELECT conv_id, array_to_string(list_transform(list_filter(list_zip(t[1:least(len(t), len(u))], u[1:least(len(t), len(u))]), lambda x: trim(x[1]) <> '' AND x[2] <> '#'), lambda x: x[2]), ' ') AS links FROM
 (SELECT conv_id, list(regexp_replace(text, '\\s+', ' ', 'g') ORDER BY turn) AS t, list(CASE WHEN turn % 3 = 1 THEN '#' ELSE 'u' || turn END ORDER BY turn) AS u FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)""")
def related_by_position(spark, sf):
    c = table(spark, sf, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("a"))
    c = c.select("conv_id", F.transform("a", lambda x: x["text"]).alias("t"), F.transform("a", lambda x: F.when(x["turn"] % 3 == 1, F.lit("#")).otherwise(F.concat(F.lit("u"), x["turn"].cast("string")))).alias("u"))
    rows = ar.zipped_related(F.col("t"), F.col("u"), F.transform("u", lambda _: F.lit("")))
    return c.select("conv_id", F.array_join(F.transform(rows, lambda x: x["url"]), " ").alias("links"))


def _members(spark, sf) -> DataFrame:
    method = F.element_at(F.array(*map(F.lit, ("seed", "token_overlap", "url"))), (F.col("ord") % 3 + 1).cast("int"))
    return articles(spark, sf).withColumns({"group_id": F.concat(F.lit("G"), (F.col("ord") % 37).cast("string")), "method": method, "tokens": F.split(F.col("body"), " ")})


_FLAGS = {"overgroup_risk_token_time_span": "share >= 0.6 AND span >= 6", "overgroup_risk_token_dominant": "share >= 0.75 AND n >= 5", "low_representative_score": "rs < 2.0", "photo_like_representative": "FALSE", "many_articles_few_sources": "n >= 5 AND ns <= 2"}
_GROUPS = f"""WITH m AS (SELECT *, ord % 37 AS g, (['seed', 'token_overlap', 'url'])[CAST(ord % 3 + 1 AS INTEGER)] AS method FROM {ARTICLES_SQL}),
 s AS (SELECT section, g, count(*) AS n, count(DISTINCT source) AS ns, array_to_string(list_sort(list_distinct(list(source))), ' ') AS sources, CASE WHEN count(published) >= 2 THEN date_diff('second', min(published), max(published)) / 3600.0 ELSE 0.0 END AS span, count(*) FILTER (method = 'token_overlap') / greatest(count(*) - 1, 1) AS share FROM m GROUP BY ALL),
 c AS (SELECT m.*, least(length(title), 70) / 10.0 + least(length(body), 220) / 35.0 + 1.0 + 0.5 + least(ns, 6) * 0.4 + least(n, 8) * 0.2 - CASE WHEN length(body) = 0 THEN 3.0 WHEN length(body) < 40 THEN 1.5 ELSE 0.0 END - CASE WHEN length(title) < 16 THEN 2.0 ELSE 0.0 END - CASE WHEN len(string_split(body, ' ')) < 5 THEN 1.5 ELSE 0.0 END AS score FROM m JOIN s USING (section, g)),
 r AS (SELECT section, g, ord AS rep_id, score::DOUBLE AS rs, published AS rp FROM c QUALIFY row_number() OVER (PARTITION BY section, g ORDER BY round(score, 9) DESC, published DESC, ord) = 1),
 f AS (SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _FLAGS.items())}], lambda x: x IS NOT NULL), ' ') AS flags FROM s JOIN r USING (section, g)),
 p AS (SELECT *, least(ns, 8) * 2.2 + least(n, 10) * 0.9 + rs * 0.8 + CASE WHEN ns >= 4 THEN 2.0 ELSE 0 END + CASE WHEN n >= 4 THEN 1.0 ELSE 0 END - CASE WHEN contains(flags, 'many_articles') THEN 2.5 ELSE 0 END - CASE WHEN contains(flags, 'token_dominant') THEN 2.0 ELSE 0 END - CASE WHEN contains(flags, 'time_span') THEN 6.0 ELSE 0 END - CASE WHEN contains(flags, 'low_repr') THEN 5.0 ELSE 0 END AS pr,
 contains(flags, 'overgroup') OR contains(flags, 'low_repr') OR rs < 2 AS low FROM f)"""


def _summary(spark, sf) -> DataFrame:
    return gr.summarise(_members(spark, sf), ["section"], order="ord", title="title", body="body", url="url", source="source", keyword="keyword", published="published", tokens="tokens")


@query(_GROUPS + " SELECT section, 'G' || g AS group_id, n AS article_count, ns AS source_count, sources, round(span::DOUBLE, 4) AS time_span_hours, rep_id, round(rs, 4) AS rep_score, flags, round(pr::DOUBLE, 2) AS priority, low AS low_quality FROM p")
def group_summary(spark, sf):
    s = _summary(spark, sf)
    return s.select("section", "group_id", "article_count", "source_count", F.array_join("sources", " ").alias("sources"), F.round("time_span_hours", 4).alias("time_span_hours"), "rep_id", F.round("rep_score", 4).alias("rep_score"), F.array_join("flags", " ").alias("flags"), F.round("priority", 2).alias("priority"), "low_quality")


@query(_GROUPS + " SELECT count(*) AS groups, count_if(n > 1)::BIGINT AS multi_article_groups, count_if(low)::BIGINT AS low_quality_groups, sum(CASE WHEN low THEN n ELSE 0 END)::BIGINT AS low_quality_articles, sum(greatest(n - 1, 0))::BIGINT AS duplicates FROM p")
def group_totals(spark, sf):
    return gr.run_totals(_summary(spark, sf))


@query(_GROUPS + " SELECT section, 'G' || g AS group_id, row_number() OVER (PARTITION BY section ORDER BY round(pr::DOUBLE, 3) DESC, ns DESC, n DESC, rp DESC, 'G' || g) AS place FROM p WHERE NOT low QUALIFY place <= 10")
def top_groups(spark, sf):
    return gr.top_groups(_summary(spark, sf), ["section"], 10).select("section", "group_id", "place")


@query(_GROUPS + " SELECT section, 'G' || g AS group_id, CASE WHEN contains(flags, 'low_repr') THEN 2 WHEN pr >= 24 OR (ns >= 5 AND n >= 8) THEN 5 WHEN ns >= 3 OR n >= 4 OR pr >= 13 THEN 4 WHEN pr < 4 THEN 2 ELSE 3 END AS importance FROM p")
def group_importance(spark, sf):
    return _summary(spark, sf).select("section", "group_id", gr.importance(F.col("priority"), F.col("article_count"), F.col("source_count"), F.col("flags")).alias("importance"))


@query(f"SELECT ord, CASE WHEN contains(lower(title), 'the') THEN 6.0 ELSE 0.0 END + CASE WHEN NOT contains(lower(title), 'the') AND contains(lower(body), 'the') OR NOT contains(lower(title), 'und') AND contains(lower(body), 'und') THEN 2.0 ELSE 0.0 END + CASE WHEN NOT contains(lower(title), 'the') AND contains(lower(title), 'und') THEN 6.0 ELSE 0.0 END AS bonus FROM {ARTICLES_SQL}")
def topic_bonus(spark, sf):
    return articles(spark, sf).select("ord", gr.topic_bonus(F.col("title"), F.col("body"), F.array(F.lit("the und x"))).alias("bonus"))


@query(f"SELECT ord, CASE WHEN length(body) > 80 THEN regexp_replace(substr(body, 1, 80), '{dk.SPACES}+$', '') || '...' ELSE body END AS clipped, CASE WHEN length(body) > 80 THEN substr(body, 1, 80) || '...' ELSE body END AS cut, regexp_replace(regexp_replace({dk.strip('title')}, '[^0-9A-Za-z가-힣_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM {ARTICLES_SQL}")
def clipped_texts(spark, sf):
    return articles(spark, sf).select("ord", tx.clip(F.col("body"), 80).alias("clipped"), tx.clip(F.col("body"), 80, rstrip=False).alias("cut"), tx.slug(F.col("title")).alias("slug"))


@query("SELECT event_id, strftime(ts - INTERVAL 9 HOURS, '%Y-%m-%d %H:%M:%S') AS parsed, strftime(ts, '%Y년 %m월 %d일 (') || (['월','화','수','목','금','토','일'])[isodow(ts)] || ') ' || CASE WHEN hour(ts) < 12 THEN '오전' ELSE '오후' END || ' ' || (CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END) || ':' || strftime(ts, '%M') AS korean FROM events")
def mail_dates(spark, sf):
    e = table(spark, sf, "events")
    mail = F.concat(F.lit("Tue, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" +0900"))
    # The offset is part of the text, so the instant doesn't depend on the session's zone; it is shown in UTC.
    shown = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), dates.parse_mail_date(mail).cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", shown.alias("parsed"), dates.korean_date(F.col("ts")).alias("korean"))


@query("SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY event_type")
def date_range(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id FROM events WHERE date_diff('day', ts::DATE, DATE '2024-01-30') BETWEEN 0 AND 2")
def retained_history(spark, sf):
    return ar.retained(table(spark, sf, "events"), F.to_date("ts"), F.lit("2024-01-30").cast("date"), 3).select("event_id", "user_id")


@query(f"SELECT ord, sha256('url|b|r|' || section || '|' || {dk.page_key('url')}) AS issue_id FROM {ARTICLES_SQL}")
def issue_ids(spark, sf):
    a = articles(spark, sf)
    scope = ar.history_scope("section", F.lit(" b "), F.lit("r"), F.col("section"))
    return a.select("ord", ar.issue_id(scope, F.col("url"), F.lit(""), F.lit(""), F.col("body")).alias("issue_id"))


_COST = "(prompt_tokens - cached_tokens) / 1e6 * coalesce(o.input_price, b.input_price, 0) + cached_tokens / 1e6 * coalesce(o.cached_price, b.cached_price, 0) + completion_tokens / 1e6 * coalesce(o.output_price, b.output_price, 0)"


@query(f"""SELECT u.model AS model, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(cached_tokens)::BIGINT AS cached_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, round(sum({_COST}), 6) AS cost
 FROM {USAGE_SQL} u LEFT JOIN {PRICES_SQL} o ON o.model = u.model LEFT JOIN {PRICES_SQL} b ON b.model = regexp_replace(u.model, '-[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$', '') GROUP BY ROLLUP (u.model)""")
def usage_totals(spark, sf):
    return us.totals(us.priced(usage(spark, sf), prices(spark))).withColumn("cost", F.round("cost", 6))


@query(f"""WITH m AS (SELECT conv_id % 5 AS s, prompt_tokens, completion_tokens FROM {USAGE_SQL}), l AS (SELECT 'S' || s AS section, 'prompt' AS metric, prompt_tokens AS value FROM m UNION ALL SELECT 'S' || s, 'completion', completion_tokens FROM m)
 SELECT metric, section, sum(value)::BIGINT AS value FROM l GROUP BY GROUPING SETS ((metric, section), (metric))""")
def metric_totals(spark, sf):
    u = usage(spark, sf).select(F.concat(F.lit("S"), (F.col("conv_id") % 5).cast("string")).alias("section"), F.explode(F.create_map(F.lit("prompt"), "prompt_tokens", F.lit("completion"), "completion_tokens")).alias("metric", "value"))
    return us.metric_totals(u)


_STAGES = ["seen", "recent", "unique", "kept", "grouped", "selected"]


@query("WITH e AS (SELECT event_type, event_id % 6 + 1 AS st FROM events) SELECT event_type, " + ", ".join(f"count_if(st >= {i})::BIGINT AS {s}" for i, s in enumerate(_STAGES, 1)) + " FROM e GROUP BY event_type")
def funnel(spark, sf):
    e = table(spark, sf, "events").withColumn("status", F.element_at(F.array(*map(F.lit, _STAGES)), (F.col("event_id") % 6 + 1).cast("int")))
    return us.funnel(e, "status", _STAGES, ["event_type"])


_METHODS = ["url", "title_exact", "text_similarity", "token_overlap", "simhash", "anchor_bundle", "event_key", "distinctive_anchor_pair"]


@query("WITH e AS (SELECT event_id % 9 AS k FROM events) SELECT count_if(k = 0)::BIGINT AS url, count_if(k = 1)::BIGINT AS title, count_if(k = 2)::BIGINT AS text, count_if(k = 3)::BIGINT AS token_overlap, count_if(k = 4)::BIGINT AS simhash, count_if(k IN (5, 7))::BIGINT AS anchor, count_if(k = 6)::BIGINT AS event_key, count_if(k < 8)::BIGINT AS total FROM e")
def exclusion_methods(spark, sf):
    e = table(spark, sf, "events").select(F.try_element_at(F.array(*map(F.lit, _METHODS)), (F.col("event_id") % 9 + 1).cast("int")).alias("method"))
    return us.exclusions(e)


@query(f"SELECT conv_id, turn, (t // n + CASE WHEN rn = 1 THEN t % n ELSE 0 END)::BIGINT AS tokens FROM (SELECT conv_id, turn, sum(prompt_tokens + completion_tokens) OVER (PARTITION BY conv_id) AS t, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM {USAGE_SQL})")
def split_tokens(spark, sf):
    u = usage(spark, sf)
    total = F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).over(sampling.Window.partitionBy("conv_id"))
    return u.withColumn("total", total).select("conv_id", "turn", sampling.split_remainder(F.col("total"), ["conv_id"], [F.asc("turn")]).alias("tokens"))


@query("SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_replies(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", files.json_object(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), "k bigint")["k"].alias("k"))


@query("SELECT k || '/' || s AS request, p * 100 + 1 AS start FROM (VALUES ('a'), ('b'), ('c')) x(k), (VALUES ('date'), ('sim')) y(s), range(0, 12) z(p) WHERE p * 100 + 1 <= 1000")
def scan_plan(spark, sf):
    return files.scan_plan(spark, ["a", "b", "c"], ["date", "sim"], 12, 100).select(F.concat_ws("/", "keyword", "sort").alias("request"), F.col("start").cast("bigint").alias("start"))


@query("SELECT c_custkey, c_name || '@x.org' AS mail, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name || '@x.org', 'N' || c_custkey FROM customer WHERE c_custkey % 2 = 1")
def receivers(spark, sf):
    c = table(spark, sf, "customer")
    setting = F.concat(F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit(" N"), F.col("c_custkey").cast("string"), F.lit("|"))).otherwise(""), F.col("c_name"), F.lit("@x.org , broken"))
    return c.select("c_custkey", F.explode(files.receivers(setting)).alias("r")).select("c_custkey", "r.mail", "r.name")


@query(f"SELECT section, ord, row_number() OVER (PARTITION BY section ORDER BY published DESC, ord) AS position FROM {ARTICLES_SQL}")
def ordinals(spark, sf):
    return ar.positions(articles(spark, sf).select("section", "ord", "published"), ["section"], [F.desc("published"), F.asc("ord")]).select("section", "ord", "position")


def _payload(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("payload", plain.payload(kind, F.col("title"), F.col("body"), *([urls.page_key(F.col("url"))] if kind == "cluster" else [])))


@query()
def event_clusters(spark, sf):
    """Sections are conversations."""
    return ordered.cluster(_payload(turns(spark, sf), "cluster"), ["section"], "ord", "published", "payload")


@query()
def past_events(spark, sf):
    """All turns against all delivered items."""
    p = _payload(turns(spark, sf), "history").withColumn("scope", F.lit("all"))
    past = _payload(delivered(spark, sf), "history").select(F.lit("all").alias("scope"), F.col("ord").alias("past_ord"), F.col("payload").alias("past_payload"))
    return ordered.past_match(p, past, ident="ord", payload="payload", past_order="past_ord", past_payload="past_payload", by=["scope"])


@query()
def history_repeats(spark, sf):
    return ordered.drop_repeats(_payload(turns(spark, sf), "history"), ["section"], "ord", "payload", "history")


@query()
def run_repeats(spark, sf):
    """A conversation is a run, its roles are the sections."""
    p = _payload(turns(spark, sf), "history").withColumn("url_key", urls.article_key(F.col("url")))
    return ordered.drop_repeats_of_run(p, ["section"], "source", "ord", "url_key", "payload")


@query()
def final_repeats(spark, sf):
    return ordered.drop_repeats(_payload(turns(spark, sf), "final"), ["section"], "ord", "payload", "final")


@query()
def final_selection(spark, sf):
    return ordered.pick_with_supplement(_payload(turns(spark, sf), "final"), ["section"], "ord", "payload", 10)


@query()
def two_key_links(spark, sf):
    p = table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.page_key(F.col("url")).alias("a"), F.concat(urls.host(F.col("url")), F.lit("/"), (F.col("page_id") % 500).cast("string")).alias("b"))
    return ordered.drop_seen_links(p, ["host"], "page_id", "a", "b")


@query()
def group_shortlist(spark, sf):
    s = _summary(spark, sf).select("section", "group_id", "keywords", "priority", "rep_published")
    w = sampling.Window.partitionBy("section")
    s = s.withColumn("rank", F.row_number().over(w.orderBy(F.desc("priority"), "group_id"))).withColumn("newest", F.row_number().over(w.orderBy(F.desc("rep_published"), "group_id")))
    return ordered.shortlist(s, ["section"], group="group_id", keywords="keywords", rank="rank", newest="newest", final_limit=10, target=35)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of articles, summarised, scored and ranked in each section."""
    t = turns(spark, sf)
    found = ordered.cluster(_payload(t, "cluster"), ["section"], "ord", "published", "payload").select("ord", "group_id", "method")
    members = t.join(found, "ord").withColumn("tokens", tx.cluster_tokens(F.concat_ws(" ", "title", "body")))
    s = gr.summarise(members, ["section"], order="ord", title="title", body="body", url="url", source="source", keyword="keyword", published="published", tokens="tokens")
    return gr.top_groups(s, ["section"], 10).select("section", "place", "group_id", "article_count", "source_count", "rep_title", "priority")


# The rest of the catalogue uses what is defined above.
from . import records  # noqa: E402, F401
