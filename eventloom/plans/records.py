"""More of the catalogue: records, selection, metrics and the texts around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, plain, urls
from ..functions import text as tx
from ..operators import articles as ar
from ..operators import groups as gr
from ..operators import records as rec
from ..operators import selection as sel
from ..operators import usage as us
from ..sources import files
from . import duck as dk
from .queries import _BARE, _GROUPS, _KNOWN, _known, _members, _now, _summary, query
from .views import ARTICLES_SQL, DELIVERED_SQL, PRICES_SQL, TURNS_SQL, USAGE_SQL, articles, delivered, prices, table, turns, usage

_DISTINCT = dk.ordered_distinct


def _unique(items: str, limit: int | None = None) -> str:
    kept = f"list_filter(list_transform({items}, lambda u: {dk.strip('u')}), lambda u: u <> '')"
    return f"list_filter({kept}, lambda u, i: list_position({kept}, u) = i)" + (f"[1:{limit}]" if limit else "")


_CONVERSATIONS = f"(SELECT section, list(title ORDER BY ord) AS titles, list(url ORDER BY ord) AS links, arg_min(title, ord) AS title, arg_min(url, ord) AS url, arg_min(body, ord) AS body FROM {TURNS_SQL} GROUP BY section)"


def _conversations(spark, sf) -> DataFrame:
    """A conversation as a group whose first turn stands for it."""
    each = turns(spark, sf).groupBy("section").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "url", "body"))).alias("t"))
    return each.select("section", *(F.col(f"t.{c}").alias(p) for c, p in (("title", "titles"), ("url", "links"))), *(F.col("t")[0][c].alias(c) for c in ("title", "url", "body")))


@query(f"SELECT section, array_to_string({_unique('list_concat([title], titles)', 16)}, '|') AS alias_titles, array_to_string({_unique('list_transform(list_concat([url], links), lambda l: ' + dk.article_key('l') + ')', 16)}, '|') AS alias_urls FROM {_CONVERSATIONS} WHERE title IS NOT NULL")
def aliases(spark, sf):
    c = _conversations(spark, sf).where("title is not null")
    return c.select("section", F.array_join(rec.alias_titles(F.col("title"), F.col("titles")), "|").alias("alias_titles"), F.array_join(rec.alias_urls(F.col("url"), F.col("links")), "|").alias("alias_urls"))


@query()
def event_signatures(spark, sf):
    """P4; the payload is compared with its column form in tests."""
    c = _conversations(spark, sf).withColumn("p", plain.payload("history", F.col("title"), F.col("body"), F.col("titles")))
    return c.select("section", "p.event_key", "p.fingerprint", F.array_join("p.title_tokens", " ").alias("title_tokens"), F.array_join("p.titles", " ").alias("titles"))


@query(f"SELECT ord, array_to_string({_unique('[title, body, title, keyword, source, keyword]')}, ' ') AS compare_text FROM {TURNS_SQL}")
def compare_texts(spark, sf):
    c = [F.col(x) for x in ("title", "body", "title", "keyword", "source")]
    return turns(spark, sf).select("ord", rec.compare_text(c[0], c[1], c[2], F.array(c[3], c[4]), c[3]).alias("compare_text"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'old' ELSE 'made' END AS value FROM events")
def stored_signatures(spark, sf):
    has = lambda k, v: F.when(F.col("event_id") % 3 == k, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "events").select("event_id", rec.stored_or_made(F.array(F.lit("made")), has(0, "new"), F.when(F.col("event_id") % 3 == 1, F.array(F.lit("old"))))[0].alias("value"))


def _record_rows(spark, sf) -> DataFrame:
    t = turns(spark, sf).withColumns({"summary": F.col("body"), "description": F.col("body"), "published_at": F.date_format("published", "yyyy-MM-dd"), "importance_score": F.lit(3)})
    t = t.withColumn("compare_text", rec.compare_text(F.col("summary"), F.col("description"), F.lit(""), F.array().cast("array<string>"), F.col("keyword")))
    return t.withColumns({"alias_titles": rec.alias_titles(F.col("title"), _none()), "alias_urls": rec.alias_urls(F.col("url"), _none()), "payload": plain.payload("history", F.col("title"), F.col("body"))})


def _none():
    return F.lit(None).cast("array<string>")


@query(f"""SELECT sha256('url|b|r|' || {dk.article_key('url')}) AS issue_id, '2024-01-31' AS saved_date, section AS section_name, {dk.strip('title')} AS title, substr(array_to_string({_unique('[body, keyword]')}, ' '), 1, 1000) AS compare_text,
 {dk.article_key('url')} AS normalized_url, {dk.normalize_title('title')} AS normalized_title, substr({dk.strip('title')}, 1, 80) AS issue_label, strftime(published, '%Y-%m-%d') AS published_at FROM {TURNS_SQL}""")
def issue_records(spark, sf):
    out = rec.issue_records(_record_rows(spark, sf), briefing="b", subject="s", receiver="r", section=F.col("section"), saved_at=_now())
    return out.select("issue_id", F.col("saved_date").cast("string").alias("saved_date"), "section_name", "title", "compare_text", "normalized_url", "normalized_title", "issue_label", "published_at")


@query(f"""WITH n AS (SELECT ord, 'n' || ord AS id, DATE '2024-01-30' AS saved, {dk.normalize_title('title')} AS t FROM {TURNS_SQL}), s AS (SELECT ord, 'b' || ord AS id, DATE '2024-01-31' - CAST(ord % 5 AS INTEGER) AS saved, {dk.normalize_title('title')} AS t FROM {DELIVERED_SQL}),
 k AS (SELECT * FROM s WHERE saved >= DATE '2024-01-29') SELECT id, strftime(saved, '%Y-%m-%d') AS saved FROM k UNION ALL SELECT id, strftime(saved, '%Y-%m-%d') FROM n WHERE t = '' OR t NOT IN (SELECT t FROM k)""")
def updated_history(spark, sf):
    rows = lambda d, p, saved: d.select("ord", F.lit("all").alias("scope"), F.concat(F.lit(p), F.col("ord").cast("string")).alias("id"), saved.alias("saved"), F.array(tx.normalize_title(F.col("title"))).alias("t"))
    today = F.lit("2024-01-31").cast("date")
    stored = rows(delivered(spark, sf), "b", F.date_sub(today, (F.col("ord") % 5).cast("int")))
    new = rows(turns(spark, sf), "n", F.lit("2024-01-30").cast("date"))
    return rec.updated_history(stored, new, {"title": F.col("t")}, scope="scope", ident="id", order="ord", saved="saved", today=today, days=3).select("id", F.col("saved").cast("string").alias("saved"))


@query("SELECT event_id FROM events WHERE event_type || '|' || user_id % 3 = 'click|1' AND date_diff('day', ts::DATE, DATE '2024-01-30') BETWEEN 0 AND 6")
def scoped_history(spark, sf):
    e = table(spark, sf, "events")
    scope = ar.history_scope("briefing", F.col("event_type"), (F.col("user_id") % 3).cast("string"), F.lit(""))
    return rec.in_scope(e, scope, F.lit("click|1"), F.to_date("ts"), F.lit("2024-01-30").cast("date"), 7).select("event_id")


@query(_GROUPS + """, a AS (SELECT section, g, list(ord ORDER BY ord) AS ids, list(source ORDER BY ord) AS srcs, count_if(method = 'url')::BIGINT AS by_url, count_if(method = 'token_overlap')::BIGINT AS by_token FROM m GROUP BY ALL)
 SELECT section, 'G' || g AS group_id, array_to_string(ids, ' ') AS articles, by_url, by_token, array_to_string(srcs[1:12], ' ') AS related_sources, rep_id FROM p JOIN a USING (section, g)""")
def nested_groups(spark, sf):
    n = rec.nested_groups(_members(spark, sf), _summary(spark, sf), ["section"], order="ord", title="title", source="source", keyword="keyword", published="published", url="url")
    of = lambda k: F.coalesce(F.try_element_at("methods", F.lit(k)), F.lit(0)).cast("bigint")
    return rec.representative_rows(n).select("section", "group_id", F.array_join(F.transform("articles", lambda x: x["index"].cast("string")), " ").alias("articles"), of("url").alias("by_url"), of("token_overlap").alias("by_token"), F.array_join("group_article_sources", " ").alias("related_sources"), "rep_id")


_LINES = "'[' || place || '] id=G' || g || ' | n=' || n || ' src=' || ns || ' flags=' || CASE WHEN flags = '' THEN '-' ELSE replace(flags, ' ', ',') END"


@query(_GROUPS + f", q AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, ns DESC, rp DESC, 'G' || g) AS place FROM p) SELECT section, place, {_LINES} AS line FROM q")
def candidate_lines(spark, sf):
    s = sel.size_order(_summary(spark, sf), ["section"])
    c = [F.col(x) for x in ("place", "group_id", "article_count", "source_count", "priority", "flags", "sources", "sources", "keywords", "rep_title", "rep_body")]
    c[7] = F.lit("")
    line = rec.candidate_line(*c)
    # Scores and texts are cut out: their printed form is the engine's own.
    return s.select("section", "place", F.regexp_replace(line, r"(?s) score=[^ ]*( flags=[^ ]*).*$", "$1").alias("line"))


_WITH_BONUS = _GROUPS + ", t AS (SELECT p.*, m.title AS title, m.body AS body, round(pr::DOUBLE, 3) + CASE WHEN contains(lower(m.title), 'the') THEN 6.0 ELSE 0.0 END + CASE WHEN NOT contains(lower(m.title), 'the') AND contains(lower(m.body), 'the') THEN 2.0 ELSE 0.0 END AS total FROM p JOIN m ON m.ord = p.rep_id AND m.section IS NOT DISTINCT FROM p.section)"


@query(_WITH_BONUS + " SELECT section, 'G' || g AS group_id, row_number() OVER (PARTITION BY section ORDER BY total DESC, ns DESC, n DESC, rp DESC, 'G' || g) AS place FROM t")
def topic_order(spark, sf):
    bonus = gr.topic_bonus(F.col("rep_title"), F.col("rep_body"), F.array(F.lit("the")))
    return sel.topic_order(_summary(spark, sf), ["section"], bonus).select("section", "group_id", "place")


_REPLY = """CASE section WHEN 'de' THEN 'no json' WHEN 'fr' THEN '{"selected": [{"group_id": "G1", "importance_score": 1}]}'
 ELSE '{"selected": [{"group_id": "G3", "importance_score": "9"}, {"group_id": "G99"}, {"group_id": "G3", "importance_score": 1}, {"group_id": "", "importance_score": 5}, {"group_id": "G5", "importance_score": 2}, {"group_id": "G7"}, {"group_id": "G2", "importance_score": 4}]}' END"""


@query(_GROUPS + """, k AS (SELECT section, g, row_number() OVER (PARTITION BY section ORDER BY round(pr::DOUBLE, 3) DESC, ns DESC, n DESC, rp DESC, 'G' || g) AS rk, CASE WHEN contains(flags, 'low_repr') THEN 2 WHEN pr >= 24 OR (ns >= 5 AND n >= 8) THEN 5 WHEN ns >= 3 OR n >= 4 OR pr >= 13 THEN 4 WHEN pr < 4 THEN 2 ELSE 3 END AS imp FROM p),
 e AS (SELECT section, e.g, e.s, e.o FROM (SELECT DISTINCT section FROM p WHERE section NOT IN ('de', 'fr')), (VALUES (3, 5, 1), (7, 3, 6), (2, 4, 7)) e(g, s, o))
 SELECT section, 'G' || g AS group_id, s AS importance_score, row_number() OVER (PARTITION BY section ORDER BY o) AS place, 'model' AS decision FROM e JOIN k USING (section, g)
 UNION ALL SELECT section, 'G' || g, imp, rk, 'ranked' FROM k WHERE rk <= 5 AND (section = 'de' OR section = 'fr' AND NOT EXISTS (SELECT 1 FROM k x WHERE x.section = 'fr' AND x.g = 1))""")
def chosen_groups(spark, sf):
    s = sel.topic_order(_summary(spark, sf), ["section"], F.lit(0.0))
    s = s.withColumn("importance", gr.importance(F.col("priority"), F.col("article_count"), F.col("source_count"), F.col("flags")))
    replies = s.select("section").distinct().withColumn("reply", F.expr(_REPLY))
    return sel.chosen_groups(s, replies, ["section"], limit=5)


@query("""WITH a AS (SELECT conv_id, (turn // 2 + 1)::BIGINT AS position, turn, text FROM conversations WHERE turn % 2 = 0), r AS (SELECT conv_id, (turn // 2 + 1)::BIGINT AS position, trim(text, E' \\t\\n\\r') AS s FROM conversations WHERE turn % 2 = 1 AND turn % 4 = 1)
 SELECT a.conv_id, a.position, coalesce(nullif(r.s, ''), CASE WHEN length(text) > 220 THEN substr(text, 1, 220) || '...' ELSE coalesce(text, '') END) AS summary, nullif(r.s, '') IS NULL AS fallback FROM a LEFT JOIN r USING (conv_id, position)""")
def summarised(spark, sf):
    c = table(spark, sf, "conversations").withColumn("position", F.floor(F.col("turn") / 2) + 1)
    replies = c.where("turn % 4 = 1").select("conv_id", F.col("position").alias("index"), "turn", "text")
    out = rec.summarised(c.where("turn % 2 = 0"), replies, ["conv_id"], position="position", text=F.col("text"), index="index", summary="text", reply_order="turn")
    return out.select("conv_id", "position", "summary", F.col("error").isNotNull().alias("fallback"))


@query(f"SELECT ord, CASE WHEN ord % 3 = 0 THEN source WHEN ord % 3 = 1 THEN keyword ELSE '언론사 미상' END AS source FROM {TURNS_SQL}")
def summary_sources(spark, sf):
    k = F.col("ord") % 3
    return turns(spark, sf).select("ord", rec.summary_source(F.when(k == 0, F.col("source")), F.lit(" "), F.when(k == 1, F.col("keyword"))).alias("source"))


@query("SELECT section, array_to_string(list(i || '. ' || t ORDER BY i), '|') AS lines FROM (SELECT conv_id AS section, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 5 DESC, turn) AS i, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations WHERE text IS NOT NULL) WHERE i <= 3 AND t <> '' GROUP BY section")
def top_lines(spark, sf):
    c = table(spark, sf, "conversations").where("text is not null").withColumn("section", F.col("conv_id"))
    out = sel.top_lines(c, ["section"], "turn", F.length("text") % 5, F.lit(""), F.col("text"))
    return out.select("section", F.array_join("lines", "|").alias("lines")).where("lines <> ''")


_LINE = f"regexp_replace(regexp_replace(regexp_replace({dk.strip('x')}, '^[ ]*[0-9]+[.)．、:][ ]*', ''), '{dk.SPACES}+', ' ', 'g'), '^[ \\-–—•·.]+|[ \\-–—•·.]+$', '', 'g')"


@query(f"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_LINE}), lambda x: length(regexp_replace(x, '[^0-9a-zA-Z가-힣]', '', 'g')) >= 8)[1:3] AS t FROM conversations WHERE text IS NOT NULL)
 SELECT conv_id, turn, '1. ' || t[1] || '|2. ' || t[2] || '|3. ' || t[3] AS lines FROM l WHERE len(t) = 3""")
def insight_lines(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(sel.insight_lines(F.col("text")), "|").alias("lines")).where("lines <> ''")


@query("SELECT l_quantity::INT AS q, greatest(l_quantity::INT * 10, 80) AS most, least(greatest(floor(greatest(l_quantity::INT * 10, 80) * 0.6)::INT, 120), greatest(l_quantity::INT * 10, 80)) AS least, least(greatest(greatest(1600, 700 + l_quantity::INT * greatest(300, least(greatest(l_quantity::INT * 10, 80) + 260, 760))), 5200), 8000) AS budget FROM lineitem")
def summary_budgets(spark, sf):
    q = F.col("l_quantity").cast("int")
    return table(spark, sf, "lineitem").select(q.alias("q"), F.greatest(q * 10, F.lit(80)).alias("most"), sel.summary_length(q * 10).alias("least"), sel.batch_budgets(q, q * 10)[0].alias("budget"))


_METRICS = ("total_seen_count", "old_news_count", "issue_filter_excluded_count", "duplicate_count", "exclude_keyword_excluded_count", "grouping_duplicate_excluded_count", "grouping_low_quality_article_count", "selected_count")


def _section_metrics(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").withColumn("m", F.element_at(F.array(*map(F.lit, _METRICS)), (F.col("event_id") % len(_METRICS) + 1).cast("int")))
    wide = e.groupBy(F.col("event_type").alias("section_name")).agg(*(F.count_if(F.col("m") == m).alias(m) for m in _METRICS))
    code = F.when(F.col("section_name") == "click", F.lit(5000).cast("bigint"))
    return wide.withColumn("code_rule_excluded_count", code).withColumn("rule_based_excluded_count", F.when(F.col("section_name") == "view", F.lit(7).cast("bigint")))


_COUNTS = "SELECT event_type AS section_name, " + ", ".join(f"count_if(event_id % {len(_METRICS)} = {i})::BIGINT AS {m}" for i, m in enumerate(_METRICS)) + " FROM events GROUP BY 1"
_RULES = "duplicate_count + exclude_keyword_excluded_count + grouping_duplicate_excluded_count + grouping_low_quality_article_count"


@query(f"WITH w AS ({_COUNTS}) SELECT section_name, ({_RULES})::BIGINT AS excluded FROM w")
def rule_excluded(spark, sf):
    m = _section_metrics(spark, sf)
    return m.select("section_name", sel.rule_based(m).cast("bigint").alias("excluded"))


@query(f"WITH w AS ({_COUNTS}) SELECT section_name, total_seen_count AS seen, old_news_count AS old, issue_filter_excluded_count AS history_excluded, CASE section_name WHEN 'view' THEN 7 WHEN 'click' THEN greatest(0, 5000 - issue_filter_excluded_count) ELSE {_RULES} END::BIGINT AS rule_excluded, selected_count AS selected FROM w")
def dashboard(spark, sf):
    return sel.dashboard(_section_metrics(spark, sf)).withColumn("rule_excluded", F.col("rule_excluded").cast("bigint"))


@query(f"WITH c AS (SELECT DISTINCT {_BARE} AS domain FROM pages), k AS {_KNOWN}, b AS (SELECT domain, k.domain IS NULL AS n, c.domain IS NOT NULL AS i FROM c FULL JOIN k USING (domain) WHERE domain <> '') SELECT count(*) AS total, count_if(i)::BIGINT AS in_run, count_if(n)::BIGINT AS added FROM b")
def domain_counts(spark, sf):
    return ar.domain_counts(ar.unmapped_domains(table(spark, sf, "pages").select(urls.bare_host(F.col("url")).alias("domain")), _known(spark, sf)))


@query("SELECT event_id FROM events WHERE event_id % 5 <> 4 AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAYS")
def expired_pages(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id") % 5
    name = F.when(k == 4, "index.txt").when(k == 3, "page.html").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd-HHmmss"), F.lit(".html")))
    e = e.withColumns({"name": name, "modified": F.when(k == 3, F.col("ts")).otherwise(_now())})
    # A name has whole seconds; rows in the second of the bound are few and told apart by the same rule.
    return files.expired_pages(e, "name", "modified", _now(), 7).select("event_id")


@query(f"""WITH o AS (SELECT * FROM (VALUES ('m-large', 9.0, NULL, 1.0), ('m-small', 8.0, 7.0, NULL)) v(model, i, c, o)), u AS (SELECT *, regexp_replace(model, '-[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$', '') AS base FROM {USAGE_SQL}),
 t AS (SELECT u.*, coalesce(a.i, b.i, p.input_price, q.input_price, 3) AS pi, coalesce(a.c, b.c, p.cached_price, q.cached_price, 2) AS pc, coalesce(a.o, b.o, p.output_price, q.output_price, 1) AS po FROM u LEFT JOIN o a ON a.model = u.model LEFT JOIN o b ON b.model = u.base LEFT JOIN {PRICES_SQL} p ON p.model = u.model LEFT JOIN {PRICES_SQL} q ON q.model = u.base)
 SELECT model, round(sum((prompt_tokens - cached_tokens) / 1e6 * pi + cached_tokens / 1e6 * pc + completion_tokens / 1e6 * po), 6) AS cost FROM t GROUP BY model""")
def usage_with_overrides(spark, sf):
    over = spark.createDataFrame([("m-large", 9.0, None, 1.0), ("m-small", 8.0, 7.0, None)], "model string, input_price double, cached_price double, output_price double")
    out = us.totals(us.priced(usage(spark, sf), prices(spark), overrides=over, default=(3.0, 2.0, 1.0)))
    return out.where("model is not null").select("model", F.round("cost", 6).alias("cost"))


@query("SELECT event_type, strftime(min(d), '%Y-%m-%d %H:%M') AS oldest, '최근 ' || strftime(max(d), '%Y-%m-%d %H:%M') || ' / 가장 오래됨 ' || strftime(min(d), '%Y-%m-%d %H:%M') AS text FROM (SELECT event_type, CASE WHEN event_id % 3 = 2 THEN ts - INTERVAL 9 HOURS ELSE date_trunc('second', ts) END AS d FROM events) GROUP BY event_type")
def date_ranges(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id") % 3
    utc = lambda c: F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
    iso = F.when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    mail = F.when(k == 2, F.concat(F.lit("Tue, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" +0900")))
    parsed = F.when(k == 0, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")).cast("timestamp"))
    e = e.withColumn("d", utc(dates.best_date(parsed, iso, mail)))
    g = e.groupBy("event_type").agg(F.max("d").alias("b"), F.min("d").alias("a"))
    return g.select("event_type", F.date_format("a", "yyyy-MM-dd HH:mm").alias("oldest"), dates.range_text(F.col("b"), F.col("a")).alias("text"))


@query("SELECT c_custkey, replace(c_name, '#', ',') AS words, CASE WHEN c_custkey % 3 = 0 THEN 'date' ELSE 'sim' END AS sorts, 1 + c_custkey % 2 AS counter, CASE WHEN c_custkey % 4 = 0 THEN 'https://own.org' WHEN c_custkey % 4 = 1 THEN 'https://env.org' WHEN c_custkey % 4 = 2 THEN 'https://o.github.io/r' ELSE '' END AS base FROM customer")
def configuration(spark, sf):
    k = F.col("c_custkey")
    words = F.array_join(files.word_list(F.regexp_replace("c_name", "#", " , ,")), ",")
    counters = files.merged(F.create_map(F.lit("a"), F.lit(0).cast("bigint"), F.lit("b"), k), F.create_map(F.lit("a"), 1 + k % 2))
    base = files.pages_url(F.when(k % 4 == 0, " https://own.org/ "), F.when(k % 4 == 1, "https://env.org//"), F.when(k % 4 == 2, " o / r").otherwise("none"))
    return table(spark, sf, "customer").select("c_custkey", words.alias("words"), F.array_join(files.sorts(F.when(k % 3 == 0, F.array(F.lit(" date"), F.lit(" ")))), ",").alias("sorts"), F.element_at(counters, F.lit("a")).alias("counter"), base.alias("base"))


@query("SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_lists(spark, sf):
    reply = F.concat(F.lit("here: ```json\n["), "props", F.lit(", {}]\n```"))
    return table(spark, sf, "events").select("event_id", files.json_list(reply, "struct<k:bigint>")[0]["k"].alias("k"))


@query("SELECT event_id, '{\"id\":' || event_id || ',\"name\":\"가\"}' AS dump FROM events")
def json_dumps(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.lit("가").alias("name"))).alias("dump"))


@query(f"SELECT ord, {dk.swap('coalesce(body, chr(32))', (('&', '&amp;'), ('<', '&lt;'), ('>', '&gt;'), (chr(34), '&quot;'), (chr(39), '&#x27;')))} AS safe, CASE WHEN ord % 2 = 0 THEN '#' ELSE replace(url, '&', '&amp;') END AS link FROM {TURNS_SQL}")
def escaped_texts(spark, sf):
    return turns(spark, sf).select("ord", tx.escape_html(F.coalesce("body", F.lit(" "))).alias("safe"), tx.escape_url(F.when(F.col("ord") % 2 == 0, "  ").otherwise(F.col("url"))).alias("link"))


@query(f"SELECT ord, ord % 4 IN (0, 1) AS photo, ord % 4 = 2 AS breaking FROM {ARTICLES_SQL}")
def photo_and_breaking(spark, sf):
    k = F.col("ord") % 4
    title = F.concat(F.when(k == 1, "기념촬영 ").when(k == 2, "[속보] ").otherwise(""), F.coalesce("title", F.lit("")))
    url = F.concat("url", F.when(k == 0, "/photos/1").otherwise(""))
    return articles(spark, sf).select("ord", ar.photo_like(title, url).alias("photo"), ar.breaking_like(title).alias("breaking"))


@query(f"SELECT ord, CASE WHEN trim(coalesce(title, '')) <> '' THEN {dk.strip('title')} ELSE {dk.strip('body')} END AS text, (CASE WHEN ord % 7 = 0 THEN 3 ELSE greatest(1, least(5, ord % 7)) END)::INT AS score FROM {TURNS_SQL}")
def resolved_fields(spark, sf):
    k = F.col("ord") % 7
    return turns(spark, sf).select("ord", tx.first_text(F.col("title"), F.col("body")).alias("text"), gr.clamp_score(F.when(k == 0, "none").otherwise(k.cast("string"))).alias("score"))


@query(f"SELECT ord, pool, position FROM (SELECT ord, 0 AS pool, row_number() OVER (PARTITION BY section ORDER BY ord) AS position FROM {TURNS_SQL} UNION ALL SELECT ord, 1, row_number() OVER (ORDER BY ord) FROM {DELIVERED_SQL}) WHERE position <= 3")
def supplement_pool(spark, sf):
    a = rec.first_of_run(turns(spark, sf).select("ord", "section"), ["section"], [F.asc("ord")], 3)
    b = rec.first_of_run(delivered(spark, sf).select("ord", F.lit("all").alias("section")), ["section"], [F.asc("ord")], 3)
    return sel.supplement_pool(a, b).select("ord", "pool", F.col("place").alias("position"))


@query(f"SELECT ord AS index, 'url' AS method, {dk.strip('title')} AS title, 'matched' AS matched_title FROM {TURNS_SQL}")
def excluded_rows(spark, sf):
    t = turns(spark, sf).select(F.col("ord").alias("index"), "title", "source", "url", F.lit(" url ").alias("method"), F.lit("r").alias("reason"), F.lit("matched").alias("matched_title"), F.lit(None).cast("string").alias("detail"), plain.payload("history", F.col("title"), F.col("body")).alias("payload"))
    return rec.excluded_rows(t).select("index", "method", "title", "matched_title")
