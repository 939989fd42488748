"""Hand-checked values of the text, url, date and similarity rules."""

import pytest
from pyspark.sql import functions as F

from eventloom.functions import dates, urls
from eventloom.functions import similarity as sim
from eventloom.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("rule", "given", "expected"),
    [
        (tx.remove_tags, "<b>A</b>&amp;B", "A&B"),
        (tx.strip_entities, "<b>A</b>&amp;B", "A &B"),
        (tx.remove_tags, "&amp;lt;", "<"),
        (tx.remove_tags, None, ""),
        (tx.normalize_title, "[속보] AI·클라우드(종합) 2.5%", "ai클라우드25"),
        (tx.normalize_token, "서울에서는", "서울"),
        (tx.normalize_token, "기업은", "기업"),
        (tx.normalize_token, "은는", "은는"),
        (tx.action_of, "파트너십을", "협력"),
        (tx.action_of, "xyz", ""),
        (urls.page_key, "http://www.A.com:80/News/1/?no=3#x", "a.com:80/News/1"),
        (urls.article_key, "http://www.A.com:80/News/1/?no=3#x", "a.com:80/News/1?no=3"),
        (urls.link_key, "http://www.A.com:80/News/1/?no=3#x", "a.com:80/news/1/?no=3#x"),
        (urls.publisher_code, "m.some-site.co.kr", "m.some-site"),
        (tx.model_base, "m-2024-01-31", "m"),
        (tx.clip, None, ""),
    ],
)
def test_rules(spark, rule, given, expected):
    assert value(spark, rule(F.lit(given).cast("string"))) == expected


def test_numbers_and_fingerprints(spark):
    assert value(spark, tx.numbers(F.lit("3.5% 12월 3.5"))) == ["12", "3.5"]
    words = lambda *w: F.array(*map(F.lit, w))
    assert value(spark, sim.simhash(words("a"))) == "0cc175b9c0f1b6a8"
    assert value(spark, sim.simhash(words("a", "b"))) == "9eeb7fffe6ffbfec"
    assert value(spark, sim.simhash(F.array().cast("array<string>"))) == ""
    assert value(spark, sim.overlap(words("a", "b", "c"), words("b", "c"))) == 1.0
    assert value(spark, sim.hamming(F.lit("8000000000000000"), F.lit("0000000000000001"))) == 2
    assert value(spark, sim.hamming(F.lit(""), F.lit("00"))) is None


def test_ratio_keeps_the_order_of_its_arguments():
    assert (sim.ratio("tide", "diet"), sim.ratio("diet", "tide")) == (0.25, 0.5)


def test_dates(spark):
    t = value(spark, dates.parse_mail_date(F.lit("Tue, 07 May 2026 14:20:00 +0900")))
    assert t.isoformat() == "2026-05-07T05:20:00"
    assert value(spark, dates.parse_mail_date(F.lit("no date"))) is None
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    assert value(spark, dates.age_bucket(F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), now, 4)) == 6


BASE = {"url_key": "", "title_key": "", "body_key": "", "title_tokens": [], "tokens": [], "fingerprint": ""}


@pytest.mark.parametrize(
    ("change", "method"),
    [
        (({"url_key": "a"}, {"url_key": "a"}), "url"),
        (({"title_key": "abc"}, {"title_key": "abc"}), "title_exact"),
        (({"title_key": "abcdefghij"}, {"title_key": "xxabcdefghijyyyyyyyyyyyyyyyyyyyyyy"}), "title_contains"),
        (({"title_key": "abcdefgh12"}, {"title_key": "abcdefgh34"}), "title_similarity"),
        (({"title_tokens": ["a", "b", "c", "d"]}, {"title_tokens": ["a", "b", "c", "x"]}), "title_token_overlap"),
        (({"body_key": "abcdefgh1"}, {"body_key": "abcdefgh2"}), "text_similarity"),
        (({"tokens": list("abcdef")}, {"tokens": list("abcdex")}), "token_overlap"),
        (({"tokens": list("abcdefgh"), "fingerprint": "0" * 16}, {"tokens": list("abcdstuv"), "fingerprint": "0" * 15 + "7"}), "simhash"),
        (({"tokens": list("abcdefgh"), "fingerprint": "0" * 16}, {"tokens": list("abcdstuv"), "fingerprint": "0" * 14 + "7f"}), ""),
        (({"title_key": "abcdefgh12"}, {"title_key": "abcdeXYZ34"}), ""),
    ],
)
def test_cluster_rules(change, method):
    found = sim.judge_cluster(BASE | change[0], BASE | change[1])
    assert found[1] == method and found[0] == bool(method)


HISTORY = {"titles": [], "body_key": "", "title_tokens": [], "tokens": [], "strong": [], "numbers": [], "actions": [], "fingerprint": "", "event_key": ""}


@pytest.mark.parametrize(
    ("both", "left", "right", "method"),
    [
        ({"event_key": "a|b"}, {}, {}, "event_key"),
        ({"event_key": "a|b"}, {"numbers": ["1"]}, {"numbers": ["2"]}, ""),
        ({"titles": ["x"]}, {"numbers": ["1"]}, {"numbers": ["2"]}, "title_exact"),
        ({}, {"titles": ["abcdefghijklmnopqrst"]}, {"titles": ["abcdefghijklmnopqrsu"]}, "title_similarity"),
        ({"strong": ["k1", "k2", "k3", "k4"], "title_tokens": ["alpha", "beta"]}, {}, {}, "anchor_bundle"),
        ({"strong": ["k1", "k2", "k3"], "title_tokens": ["alpha", "beta"], "actions": ["인수"]}, {}, {}, "anchor_action"),
        ({"strong": ["k1", "k2", "k3"], "title_tokens": ["alpha", "beta", "gamma"]}, {}, {}, "distinctive_anchor_pair"),
        ({"strong": ["k1"], "title_tokens": ["alpha", "beta", "gamma", "delta"]}, {}, {}, "title_token_overlap"),
        ({"strong": ["k1"], "tokens": ["alpha", "beta", "gamma", "delta"], "body_key": "abcdefgh"}, {}, {}, "text_similarity"),
        ({"strong": ["k1", "k2"], "tokens": ["alpha", "beta", "gamma", "delta", "omega"]}, {}, {}, "token_overlap"),
        ({"tokens": ["alpha", "beta", "gamma", "delta", "omega"]}, {}, {}, ""),
    ],
)
def test_history_rules(both, left, right, method):
    assert sim.judge_history(HISTORY | both | left, HISTORY | both | right)[1] == method


FINAL = {"title_key": "", "body_key": "", "title_tokens": [], "tokens": [], "anchors": [], "numbers": [], "fingerprint": ""}


@pytest.mark.parametrize(
    ("both", "left", "right", "method"),
    [
        ({"title_key": "a"}, {"numbers": ["1"]}, {"numbers": ["2"]}, "title_exact"),
        ({"title_tokens": ["a", "b", "c"]}, {"numbers": ["1"]}, {"numbers": ["1", "2"]}, ""),
        ({"title_tokens": ["a", "b", "c"]}, {}, {}, "title_token_overlap_common_3"),
        ({}, {"title_key": "abcdefghij"}, {"title_key": "abcdefghijk"}, "title_contains"),
        ({"anchors": ["k"], "tokens": list("abcd"), "body_key": "abcdefghijk"}, {}, {"body_key": "abcdefghxyz"}, "text_similarity_anchor_common_4"),
        ({"anchors": ["k"]}, {"tokens": list("abcdefgh")}, {"tokens": list("abcdwxyz")}, "token_overlap_common_4"),
    ],
)
def test_final_rules(both, left, right, method):
    assert sim.judge_final(FINAL | both | left, FINAL | both | right)[1] == method
