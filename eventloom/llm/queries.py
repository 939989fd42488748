"""The queries of the operators for training data, with production parameters."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, hmm, mixing, multimatch, neighbours, phrases, quality_rules, style_tree, toxicity, url_filter
from .url_filter import Rule

URL_RULES = [Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(_table(spark, sf_dir, "pages"))


def op3_multimatch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multimatch.link(_table(spark, sf_dir, "documents"), width=3, num=90, den=100).drop("class_id")


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


def op8_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprint_successors(_table(spark, sf_dir, "documents"))


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_style_tree, op3_multimatch_join, op4_toxicity_grammar, op5_source_mix, op6_bpe, op7_hidden_markov, op8_phrase_fingerprints, op9_weak_supervision, op10_nearest_neighbours)} | {"pipeline": corpus_pipeline.run}
_VALUE = r"""\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))"""


def _attr(tag: str, name: str) -> str:
    return "(" + " || ".join(f"regexp_extract({tag}, '(?is)\\b{name}{_VALUE}', {k})" for k in (1, 2, 3)) + ")"


def _host(u: str) -> str:
    return f"translate(coalesce(regexp_extract({u}, '^[\\s\\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(u: str) -> str:
    return f"coalesce(regexp_extract({u}, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '')"


def _node(u: str) -> str:
    return f"(CASE WHEN {_host(u)} <> '' THEN {_host(u)} || {_path(u)} || regexp_extract({u}, '^[^?#]*(\\?[^#]*)', 1) END)"


_RULES = "(VALUES " + ", ".join(f"('{r.host}', '{r.path}', '{r.action}')" for r in URL_RULES) + ") r(rh, rp, act)"
_FITS = "(host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)"
URL_SQL = f"""WITH RECURSIVE p AS (SELECT row_number() OVER () AS i, page_id, url, html, {_host('url')} AS host, {_path('url')} AS path, {_node('url')} AS node FROM pages),
 k AS (SELECT url, unnest(list_concat(list_transform(list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*>'), lambda t: list_contains(regexp_split_to_array(lower({_attr('t', 'rel')}), '\\s+'), 'canonical')), lambda t: {_attr('t', 'href')}),
  list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\\b[^>]*>'), lambda t: lower({_attr('t', 'http-equiv')}) = 'refresh'), lambda t: regexp_extract({_attr('t', 'content')}, '(?i)url\\s*=\\s*[''"]?([^''"]*)', 1)))) AS raw FROM p),
 l AS (SELECT url, trim(replace(raw, '&amp;', '&')) AS link, regexp_extract(url, '^([\\s\\S]*?://[^/?#]*)', 1) AS origin, regexp_extract(url, '^([\\s\\S]*?://[^/?#]*(?:[^?#]*/)?)', 1) AS folder FROM k),
 a AS (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN starts_with(link, '//') THEN 'http:' || link WHEN starts_with(link, '/') THEN origin || link WHEN starts_with(link, '?') THEN origin || {_path('url')} || link
  ELSE folder || CASE WHEN ends_with(folder, '/') THEN '' ELSE '/' END || link END AS target FROM l WHERE link <> ''),
 e AS (SELECT {_node('url')} AS x, {_node('target')} AS y FROM a), b AS (SELECT x, y FROM e WHERE x <> y UNION SELECT y, x FROM e WHERE x <> y),
 c(x, y) AS (SELECT x, y FROM b UNION SELECT c.x, b.y FROM c JOIN b ON c.y = b.x),
 n AS (SELECT DISTINCT y AS node, regexp_extract(y, '^([^/?]*)', 1) AS host, regexp_extract(y, '^[^/?]*([^?]*)', 1) AS path FROM c),
 na AS (SELECT node, act FROM n JOIN {_RULES} ON {_FITS} QUALIFY row_number() OVER (PARTITION BY node ORDER BY length(rh || rp) DESC, rh DESC, rp DESC, act DESC) = 1),
 s AS (SELECT c.x AS node, min(act) AS shared FROM c JOIN na ON na.node = c.y GROUP BY c.x),
 o AS (SELECT i, rh || rp AS rule, act FROM p JOIN {_RULES} ON {_FITS} QUALIFY row_number() OVER (PARTITION BY i ORDER BY length(rh || rp) DESC, rh DESC, rp DESC, act DESC) = 1)
 SELECT page_id, host, path, rule, coalesce(act, shared, 'allow') AS verdict FROM p LEFT JOIN o USING (i) LEFT JOIN s USING (node)"""

ORACLE_SQL: dict[str, str] = {"op1_url_filter": URL_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
