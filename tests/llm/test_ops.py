"""The operators for training data against brute force, on small fixtures with awkward rows."""

import collections
import hashlib
import html as html_lib
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Reference

from eventloom.llm import bpe, hmm, mixing, multimatch, neighbours, phrases, quality_rules, style_tree, textarrays, toxicity, url_filter
from eventloom.llm.components import connected_components
from eventloom.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
PATH = public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return WORD.findall(text or "")


def make_texts(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["th", "er", "on", "an", "re", "é"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 5):  # copies, near copies, and copies in upper case
        texts.append(texts[i])
        w = texts[i].split()
        w[r.randrange(len(w))] = "Edited"
        texts.append(" ".join(w))
        texts.append(texts[i].upper().replace("É", "é"))
    return [*texts, None, "", "  \n\t ", "one", "one two", "One  TWO", "x" * 70_000, "w " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["a", "b", None][i % 3], f"clash{i}", len(t or "")) for i, t in enumerate(make_texts())]
    rows += [rows[0], (None, "null id text here", "a", "x", 3), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, n_chars long").repartition(3)


def plain(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(140)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and {a for a, _ in edges if a is not None} <= set(got)


def test_url_filter(spark):
    rows = [
        (1, "http://a.com/x", '<link rel="canonical" href="http://b.org/es/1">'),
        (2, "http://a.com/y", '<meta http-equiv="refresh" content="0; url=/x">'),
        (3, "HTTP://B.ORG/es/1?q#z", ""),
        (4, None, None),
        (5, "nourl", "<link rel=canonical href=x>"),
        (6, "http://example.com/en/7", "<link rel=canonical href='//b.org/es/2'>"),
        (7, "http://www.example.com/en/8#x", None),
        (8, "http://notexample.net/de/8", None),
        (8, "http://notexample.net/de/8", None),
        (9, "http://m.example.net/de/81?x", None),
        (10, "http://z.io/", "<LINK HREF=http://b.org/es/2 REL='Canonical'>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, URL_RULES).collect())
    assert [(g[0], g[3], g[4]) for g in got] == [(1, None, "block"), (2, None, "block"), (3, "org/es/", "block"), (4, None, "allow"), (5, None, "allow"), (6, "example.com/en/7", "allow"), (7, "com/en/", "block"), (8, "net/de/", "allow"), (8, "net/de/", "allow"), (9, "example.net/de/8", "block"), (10, None, "allow")]
    assert got[2][1:3] == ("b.org", "/es/1") and got[3][1:3] == ("", "")
    redirects = spark.createDataFrame([("http://q.io/1", "http://b.org/es/9")], "from_url string, to_url string")
    one = spark.createDataFrame([(1, "http://q.io/1", None)], "page_id long, url string, html string")
    assert url_filter.judge(one, URL_RULES, redirects).first()["verdict"] == "block"
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site head</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy &amp; save %d</div>
<div id="sidebar-2">side</div><form>name<input></form><div class="cookie-notice">We use cookies</div>
<article><h1>Title %d &lt;x&gt;</h1><p>First <b>bold</b>&nbsp;para %d.<br>line<p>Second  one\n%d<div class="comments"><p>nice!</p></div></article>
<aside>more</aside><footer>&copy; x</footer></body></html>"""


def test_style_tree(spark):
    rows = [(i, f"http://h{i % 2}.com/{i}", PAGE % (i, i, i, i)) for i in range(12)] + [(90, "http://lone.com/", PAGE % (9, 9, 9, 9)), (91, None, None), (92, "http://h1.com/z", ""), (93, "x", "just <b>text</b> &am"), (94, "http://h0.com/c", "<article><p>cut off &amp here"), (94, "http://h0.com/c", "<article><p>cut off &amp here")]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect())
    for k, text, n in got:
        if k < 91:
            i = 9 if k == 90 else k
            assert text == f"Title {i} <x> First bold para {i}. line Second one {i}"
        assert n == len(text)
    assert [g[1] for g in got if g[0] >= 91] == ["", "", "just text &am", "cut off & here", "cut off & here"]


def test_style_tree_removes_what_repeats_without_a_name(spark):
    page = "<body><div><span>Always the same words</span></div><section><p>Only here %d</p></section></body>"
    rows = [(i, "http://s.com/", page % i) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Only here {i}" for i in range(30)}


def test_style_tree_counts_copies_of_a_page_once(spark):
    text = {i: f"<main><h2>Title {i}</h2><p>Words of page {i}</p></main><footer>foot</footer>" for i in range(4)}
    rows = [(1, "http://two.com/a", text[0])] * 2 + [(2, f"http://many.com/{i}", text[1]) for i in range(30)] + [(3, "http://many.com/x", text[2]), (4, "http://many.com/y", text[3])]
    got = sorted((r["page_id"], r["text"]) for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == sorted((k, f"Title {k - 1} Words of page {k - 1}") for k, _, _ in rows)


def brute_extract(rows):
    """The style tree in plain dictionaries: texts of all pages in their order."""
    host = lambda u: (re.search(r"^.*?://([^/?#]*)", u or "") or [None, ""])[1].lower()
    out = []
    for url, page in rows:
        own = {p for u, p in rows if p and host(u) == host(url)}
        m, contents, styles, size, linked, nodes = len(own), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.Counter(), collections.Counter(), {}
        most = {}
        for p in own:
            seen, texts = collections.Counter(), {}
            for node, t, links in style_tree.blocks(p, seen):
                texts[node, t] = links
                nodes[node.path] = node
            for (node, t), links in texts.items():
                contents[node.path][t] += 1
                most[node.path, t] = max(most.get((node.path, t), 0), links)
            for node, style in seen:
                styles[node.path][style] += 1
        for path, c in contents.items():
            for t, k in c.items():
                size[path] += k * len(t)
                linked[path] += k * len(t) * most[path, t]
        whole = sum(size.values())
        branch = collections.Counter()
        for path, n in size.items():
            branch[nodes[path].outer] += n
        says = {p: n.inner if n.outer and branch[n.outer] >= style_tree.WRAPPER * whole else n.kind for p, n in nodes.items()}
        marked = sum(size[p] for p in nodes if says[p] == style_tree.MAIN) >= style_tree.MARKED * whole
        entropy = lambda c: sum(k * math.log(k) for k in c.values()) / max(1, sum(c.values()))

        def keeps(path):
            log_m = math.log(max(m, 2))
            content = 1 - min(1.0, entropy(contents[path]) / log_m)
            n = sum(styles[path].values())
            style = max(0.0, math.log(n) - entropy(styles[path])) / log_m if n else 0.0
            names = style_tree.NAMES[says[path]]
            if says[path] == style_tree.PLAIN and marked and not nodes[path].heading:
                names = style_tree.OUTSIDE
            return style_tree.odds(content, style, linked[path] / max(size[path], 1), names) >= 0

        out.append(" ".join(t for node, t, _ in style_tree.blocks(page or "") if keeps(node.path)))
    return out


def test_style_tree_is_the_plain_one(spark):
    """Random sites of templates with named and nameless parts, some of which repeat."""
    r = random.Random(8)
    line = lambda: " ".join(r.choice("ab cd ef gh ij kl mn".split()) for _ in range(r.randint(1, 9)))
    fixed = [line() for _ in range(6)]
    parts = ["<nav><a href=/>%s</a></nav>", "<div class=x1><a href=/>%s</a></div>", "<div class=x2>%s</div>", "<p>%s</p>", "<article><h1>%s</h1><p>%s", "<div class='comments'>%s</div>", "<h1>%s</h1>", "<form><div id=main>%s</div><section>%s</section></form>", "<footer>%s</footer>"]
    rows = []
    for h in range(8):
        mine = r.sample(parts, 5)
        for i in range(r.randint(1, 7)):
            page = "".join(p.replace("%s", r.choice([line(), line(), r.choice(fixed)])) for p in mine if r.random() < 0.9)
            rows.append((f"http://h{h}.org/{i}", page))
    rows += [*rows[:3], (None, rows[0][1]), ("http://h0.org/null", None), ("http://h1.org/deep", "<div>" * 3000 + "<p>deep text")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in style_tree.extract(df).collect()}
    expected = brute_extract(rows)
    assert [got[i] for i in range(len(rows))] == expected
    assert sum(map(bool, expected)) > len(rows) / 2


def test_style_tree_outweighs_names(spark):
    """Parts under names that no list knows, and names that say something else."""
    unique = lambda i, n=12: " ".join(f"w{i}x{k}" for k in range(n))
    inside = "<h1>T%d</h1><p>%s</p><p>%s</p>"
    rows = []
    for i in range(20):
        body = inside % (i, unique(i, 60), unique(100 + i, 60))
        # An article that is marked; a sidebar, an advert and reader comments under unknown names, a repeated list of links in the article.
        rows.append((i, f"http://marked.com/{i}", f"<div class=q1><a href=/>same</a> <a href=/>links</a></div><article>{body}<div class=q9><a href=/1>More here</a></div></article><div class=q2>{unique(200 + i)}</div><section class=q3><p>{unique(300 + i)}</p></section>"))
        # The whole page in a form; its menu has no name but links.
        rows.append((100 + i, f"http://form.com/{i}", f"<form class=f><div class=z><a href=/>{unique(i, 2)}</a></div><div class=y>{body}</div></form>"))
    got = {x["page_id"]: x["text"] for x in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        text = f"T{i} {unique(i, 60)} {unique(100 + i, 60)}"
        assert got[i] == text and got[100 + i] == text


def test_style_tree_of_a_very_long_page(spark):
    page = "<article>" + "".join(f"<p>line {i} of many" for i in range(60_000)) + "</article><footer>f</footer>"
    text = style_tree.extract(spark.createDataFrame([(1, "http://l.com/", page)], "page_id long, url string, html string")).first()["text"]
    assert text == " ".join(f"line {i} of many" for i in range(60_000))


def brute_links(rows, width, num, den):
    sets = []
    for key, text, _ in rows:
        w = words((text or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return collections.Counter((key, len(sets[i]), least.get(find(i))) for i, (key, _, _) in enumerate(rows))


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 8, 10), (2, 1, 2)])
def test_multimatch_join(spark, docs, width, num, den):
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in multimatch.link(docs, width=width, num=num, den=den).collect())
    assert got == brute_links(plain(docs), width, num, den)
    assert multimatch.link(docs.limit(0), width=width).count() == 0


def test_multimatch_join_in_long_lists(spark, monkeypatch):
    """Near copies of one text, most of which link over others only, by the join on differences."""
    monkeypatch.setattr(multimatch, "LIGHT", 2)
    r = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"e{r.randrange(15)}"
        rows.append((i, " ".join(w), None))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for num, den in ((90, 100), (93, 100), (8, 10)):
        got = collections.Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in multimatch.link(df, width=3, num=num, den=den).collect())
        assert got == brute_links(rows, 3, num, den)


def test_multimatch_join_of_many_copies_with_longer_texts(spark):
    """A class of many copies takes a long prefix; texts of one word more, whose own token comes first, a short one."""
    base = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(base), None) for i in range(1000)] + [(1000 + i, " ".join([*base, f"end{i}"]), None) for i in range(3)]
    rows += [(2000 + i, " ".join([f"start{i}", *base]), None) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = collections.Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in multimatch.link(df, width=3, num=90, den=100).collect())
    assert got == brute_links(rows, 3, 90, 100) and {c for _, _, c in got} == {0}


def shared_passages(seed, n=1000):
    """Random texts with shared passages, every third followed by an edited copy."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    passages = [[r.choice(vocabulary) for _ in range(40)] for _ in range(8)]
    texts = []
    while len(texts) < n:
        w = [r.choice(vocabulary) for _ in range(r.randint(2, 40))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passages)
        texts.append(w)
        if len(texts) % 3 == 0:
            w = list(w)
            for _ in range(r.randint(1, 3)):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randint(0, 1)] = [r.choice(vocabulary)][: r.randint(0, 1)]
            texts.append(w or ["left"])
    return [(i, " ".join(w), None) for i, w in enumerate(texts)]


def indexed_links(rows, width, num, den):
    """brute_links over the pairs that share a shingle."""
    sets = []
    for _, text, _ in rows:
        w = words((text or "").translate(LOW))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root, lists = list(range(len(rows))), collections.defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = collections.Counter(j for t in s for j in lists[t])
        for j, n in common.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
        for t in s:
            lists[t].append(i)
    return collections.Counter((k, len(sets[i]), find(i)) for i, (k, _, _) in enumerate(rows))


@pytest.mark.parametrize(("width", "num", "den", "light"), [(3, 90, 100, 24), (5, 8, 10, 2)])
def test_multimatch_join_of_shared_passages(spark, monkeypatch, width, num, den, light):
    """Sizes at which classes of different k meet, by short and by long lists."""
    monkeypatch.setattr(multimatch, "LIGHT", light)
    rows = shared_passages(width + light)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = collections.Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in multimatch.link(df, width=width, num=num, den=den).collect())
    assert got == indexed_links(rows, width, num, den)


def test_ranks_are_whole_numbers_and_one_order(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdef") for _ in range(r.randint(0, 30))) for _ in range(50)]
    rarity = multimatch.measure_rarity(spark.createDataFrame([(t,) for t in texts], "text string"), 3)
    assert {rarity.excess.dtype, rarity.words.dtype} == {np.dtype("int32")} and isinstance(rarity.total, int)
    import pyarrow as pa

    seen = {}
    for _, _, sets, ranks in multimatch._ordered(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), 0, 3, rarity):
        for keys, rank in zip(sets, ranks):
            assert list(zip(rank, keys)) == sorted(zip(rank, keys))
            for k, x in zip(keys, rank):
                assert seen.setdefault(k, x) == x


def test_toxicity(spark):
    r = random.Random(3)
    clean = lambda: " ".join(r.choice(["the", "house", "is", "green", "and", "water", "runs"]) for _ in range(30)) + "."
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((i, clean() + (" You are such an Idiot*** today. " if bad else " ") + clean(), "en"))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, None), (901, "", "x"), (902, "w" * 50_000 + " idiot!", "x"), (None, "you idiot", "x"), (903, "not labelled, fine", "x"), (903, "not labelled, fine", "x")]
    D = spark.createDataFrame(rows, "doc_id long, text string, label string")
    L = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(D, L).collect()
    assert len(got) == len(rows)
    for x in got:
        k = x["doc_id"]
        assert x["held_out"] == (k is not None and zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= x["score"] <= 1
        assert x["predicted"] == int(x["score"] >= 0.5)
        if k is not None and k < 300:
            assert x["predicted"] == int(k % 4 == 0)
        if k in (900, 901, 903):
            assert x["predicted"] == 0
    kept = toxicity.classify(D, L, carry=True)
    assert kept.columns == D.columns and kept.count() == sum(1 - x["predicted"] for x in got)
    assert toxicity.classify(D, L.limit(0)).agg(F.max("score")).first()[0] < 0.5
    assert toxicity.classify(D.limit(0), L).count() == 0


def test_grammar_scales():
    g = toxicity.Grammar({"idio": 4.0}, {"target": 1.5, "negation": 0.2, "reported": 0.5})
    weight = lambda t: sum(w for w, _ in g.matches(t))
    assert weight("an idiot came") == 4.0
    assert weight("You idiot") == 6.0
    assert weight("never an idiot") == pytest.approx(0.8)
    assert weight("Tom said idiot") == 2.0
    assert weight("never. An idiot") == 4.0
    assert weight("videoidiot") == 0
    assert weight("I will surely kill you") > 0 and weight("the kill was quick") == 0


def test_adjacent_clauses_score_as_alone():
    g = toxicity.Grammar({"moron": 4.0, "idiot": 3.0}, {"target": 1.5, "negation": 0.2, "reported": 0.5})
    for parts in (["you moron", "an idiot"], ["he said moron", "not plain", "idiot"], ["moron", "never an idiot", "they moron"]):
        alone = [w for p in parts for w, _ in g.matches(p)]
        for gap in (". ", ".", "?! ", "\n"):
            assert [w for w, _ in g.matches(gap.join(parts))] == alone


def test_sainte_lague_by_quotients():
    r = random.Random(4)
    for _ in range(200):
        votes = [r.choice([0, r.random() * 10, r.randint(1, 1000)]) for _ in range(r.randint(1, 8))]
        seats = r.randint(0, 60)
        caps = [r.randint(0, 40) for _ in votes] if r.random() < 0.5 else [seats] * len(votes)
        out = [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i in range(len(votes)) if votes[i] > 0 and out[i] < caps[i]]
            if not open_:
                break
            out[max(open_, key=lambda i: (votes[i] / (2 * out[i] + 1), -i))] += 1
        assert mixing.sainte_lague(votes, seats, caps) == out


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    again = collections.Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    assert collections.Counter(map(tuple, got)) == again and len(got) == docs.count()
    rows = plain(docs)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = dict(zip(order, mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    assert sum(aims.values()) == pytest.approx(1.5 * sum(sizes.values()))
    taken = collections.Counter()
    by_target = {(sizes[s], aims[s]): s for s in order}
    for x in got:
        assert 0 <= x["taken"] <= 2 * x["size"]
        taken[by_target[x["source_size"], x["target"]]] += x["taken"]
    for s in order:
        assert abs(taken[s] - aims[s]) <= 4 * mixing.BLOCK
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    found = collections.Counter()
    for x in mixed.collect():
        found[x["source"]] += len(words(x["text"]))
    assert found == collections.Counter({s: n for s, n in taken.items() if n})
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(x["target"] == 0 for x in mixing.mix(docs.where("text is null")).collect())


def test_mixing_splits_only_texts_that_the_run_cuts(spark):
    """A whole document's words are joined as text, as by a split: all white space inside is one space, other blanks stay."""
    texts = ["a", " a ", "a\t\n b", "\x0ba\x0c\rb  c", "a\u00a0b\u2003c d", "\x1ca b", "é  ü\n"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    mixed = mixing.apply_mix(df, share=2.0)
    for r in mixed.collect():
        assert r["text"] in (texts[r["doc_id"]], " ".join(words(texts[r["doc_id"]])))
    assert "regexp_replace" in mixed._jdf.queryExecution().optimizedPlan().toString()


def test_bpe(spark, docs):
    ref = Reference.from_file(PATH)
    for x in bpe.encode_decode(docs, PATH, ids=True).collect():
        assert x["n_tokens"] == len(x["token_ids"])
    texts = collections.defaultdict(list)
    for k, t, _ in plain(docs):
        ids = ref.encode(t or "", add_special_tokens=False).ids
        texts[k].append((len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = collections.defaultdict(list)
    for x in bpe.encode_decode(docs, PATH).collect():
        got[x["doc_id"]].append((x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


_TOK = bpe.Tokenizer(bpe.vocabulary(PATH))
_REF = Reference.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aabe -='\n\x1c²ß")), max_size=80), st.sampled_from(["", "<|endoftext|>", "a" * 3000, "-=" * 2500]))
def test_bpe_any_text(text, more):
    given_text = text + more + text
    ids = _REF.encode(given_text, add_special_tokens=False).ids
    assert _TOK.encode_ids(given_text) == ids
    for part in (ids, ids[1::2], ids[::-1]):
        assert _TOK.decode(part) == _REF.decode(part, skip_special_tokens=False)


def test_mixing_starts_no_python_workers(spark, docs):
    plan = mixing.apply_mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"LocalTableScan \[[^\]]*shard_size", plan)
    assert not re.search(r"Scan ExistingRDD\[[^\]]*(shards|shard_size)", plan)


def test_bpe_state_of_a_worker_is_bounded_and_goes_with_the_next_operator():
    tok = bpe.tokenizer(bpe.vocabulary(PATH))
    assert tok is bpe.tokenizer(bpe.vocabulary(PATH)) and textarrays.kept
    for a in range(300):
        for b in range(300):
            tok.merges.stable(a, b)
    assert len(tok.merges.known_stable) <= 1 << 16
    textarrays.only_now()
    assert not textarrays.kept


def test_bpe_streams_in_bounded_memory():
    data = ("ab" * 40_000 + "thing" * 9000).encode()
    e = bpe.Encoder(_TOK.merges)
    out, most = [], 0
    for i in range(0, len(data), 1000):
        out += e.feed(data[i : i + 1000])
        most = max(most, len(e.held))
    assert most <= 3 * _TOK.merges.lookahead + 1000
    assert out + e.finish() == _REF.encode(data.decode(), add_special_tokens=False).ids


def test_hidden_markov(spark, docs):
    got = hmm.score(docs).collect()
    rows = plain(docs)
    tokens = lambda t: [*words((t or "").translate(LOW)), None]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 10 == 0
    c = collections.Counter(w for k, t, _ in rows if not held(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    expected = collections.defaultdict(list)
    for k, t, _ in rows:
        w = tokens(t)
        expected[k].append((held(k), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    assert len(got) == len(rows)
    for x in got:
        assert any((x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == e[:4] and x["base_score"] == pytest.approx(e[4], rel=1e-9) for e in expected[x["doc_id"]])
        assert x["score"] < 0
    train = [x for x in got if not x["held_out"]]
    assert sum(x["score"] for x in train) > sum(x["base_score"] for x in train)
    assert hmm.score(docs.limit(0)).count() == 0
    only = docs.where("doc_id = 1")
    assert hmm.score(only).count() == 1


def random_model(seed):
    r = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Model(norm(r.random(hmm.STATES)), norm(r.random((hmm.STATES, hmm.STATES))), norm(r.random((hmm.STATES, hmm.SYMBOLS)) ** 8))


def test_hidden_markov_scores_are_those_of_any_blocks(spark, docs):
    """Many blocks, some in one task, give what one block does."""
    kept = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).localCheckpoint()
    one, many = ({r["doc_id"]: r for r in hmm.score(kept.repartition(n), rounds=1).collect()} for n in (1, 9))
    assert one.keys() == many.keys()
    for k, r in one.items():
        assert r[:5] == many[k][:5] and r[5] == pytest.approx(many[k][5], rel=1e-9) and r[6] == pytest.approx(many[k][6], rel=1e-4)


def test_forward_recursion_is_exact():
    m, r = random_model(0), np.random.default_rng(1)
    lens = np.array([3, 1, 0, 7, 40])
    symbols = r.integers(0, hmm.SYMBOLS, lens.sum()).astype(np.uint16)
    got, at = hmm.log_likelihoods(m, symbols, lens), 0
    for n, x in zip(lens, got):
        a = None
        for s in symbols[at : at + n]:
            a = (m.start if a is None else a @ m.move) * m.emit[:, s]
        at += n
        assert x == pytest.approx(math.log(a.sum()) if a is not None else 0.0)


def test_baum_welch_counts():
    m, r = random_model(2), np.random.default_rng(3)
    lens = np.array([5, 3, 1])
    symbols = r.integers(0, hmm.SYMBOLS, lens.sum())
    start, move, emit, total = hmm.expected_counts(m, symbols, hmm.Windows.of(lens), width=2)
    s2, m2, e2, t2, at = np.zeros_like(start), np.zeros_like(move), np.zeros_like(emit), 0.0, 0
    for n in lens:
        x = symbols[at : at + n]
        at += n
        paths = np.array(np.meshgrid(*[range(hmm.STATES)] * n)).reshape(n, -1).T
        p = m.start[paths[:, 0]] * m.emit[paths[:, 0], x[0]]
        for i in range(1, n):
            p = p * m.move[paths[:, i - 1], paths[:, i]] * m.emit[paths[:, i], x[i]]
        t2 += math.log(p.sum())
        p /= p.sum()
        np.add.at(s2, paths[:, 0], p)
        for i in range(n):
            np.add.at(e2, (paths[:, i], x[i]), p)
            if i:
                np.add.at(m2, (paths[:, i - 1], paths[:, i]), p)
    assert np.allclose(start, s2) and np.allclose(move, m2) and np.allclose(emit, e2) and total == pytest.approx(t2)


def test_pack():
    x = np.random.default_rng(0).integers(0, 1 << 23, 1000).astype(np.int32)
    assert (hmm.unpack(hmm.pack(x)) == x).all()


def test_windows_count_each_token_of_long_texts_once(monkeypatch):
    """Texts of many windows: all tokens and moves are counted, near what whole texts give, and exactly where a window holds a text."""
    m = random_model(3)
    lens = np.array([1, 5, 700, 30, 2000])
    symbols = np.random.default_rng(4).integers(0, hmm.SYMBOLS, lens.sum())
    monkeypatch.setattr(hmm, "CORE", 100_000)
    whole = hmm.expected_counts(m, symbols, hmm.Windows.of(lens))
    monkeypatch.setattr(hmm, "CORE", 100)
    cut = hmm.expected_counts(m, symbols, hmm.Windows.of(lens))
    assert cut[0].sum() == pytest.approx(len(lens)) and cut[1].sum() == pytest.approx((lens - 1).sum()) and cut[2].sum() == pytest.approx(lens.sum())
    for x, y in zip(whole, cut):
        np.testing.assert_allclose(x, y, rtol=1e-3, atol=1e-3)
    own, windows = hmm.Windows.of(lens).take(np.array([3, 8])).alone(symbols)
    assert len(own) == windows.size.sum() and (own[: windows.size[0]] == symbols[hmm.Windows.of(lens).first[3] :][: windows.size[0]]).all()


def test_baum_welch_reads_all_training_texts_in_every_round(spark):
    """Texts of more tokens than any bounded sample: the rounds are those of a plain loop over all of them, from the guess."""
    r = np.random.default_rng(5)
    blocks, unigram = [], np.full(hmm.SYMBOLS, 1 / hmm.SYMBOLS)
    for k in range(3):
        lens = r.integers(0, 900, 500).astype(np.int32)
        symbols = r.integers(0, 300, lens.sum()) + 150 * k
        blocks.append(([int(x) for x in range(500 * k, 500 * k + 500)], r.random(500) < 0.9, lens, symbols))
    total = int(sum((lens + 1)[train].sum() for _, train, lens, _ in blocks))
    assert total > 500_000
    rows = [(ids, bytearray(train.tobytes()), bytearray(lens.tobytes()), bytearray(hmm.pack(symbols.astype(np.int32))), total) for ids, train, lens, symbols in blocks]
    got = hmm._train(spark.createDataFrame(rows, "ids array<bigint>, train binary, lens binary, symbols binary, n_train bigint"), unigram, 2)
    texts = [(x, train[i]) for _, train, lens, symbols in blocks for i, x in enumerate(np.split(symbols, np.cumsum(lens)[:-1]))]
    mine = [np.append(x, hmm.END) for x, used in texts if used]
    model = hmm.Model.guess(unigram)
    for _ in range(2):
        model = hmm.Model.from_counts(*hmm.expected_counts(model, np.concatenate(mine), hmm.Windows.of(np.array([len(x) for x in mine])))[:3], unigram)
    for name in ("start", "move", "emit"):
        np.testing.assert_allclose(getattr(got, name), getattr(model, name), rtol=1e-3, atol=1e-9)


def test_hidden_markov_gains_over_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    scored = hmm.score(docs.union(more))
    first, second = ([r["score"] for r in df.orderBy("doc_id").collect()] for df in (scored, hmm.score(docs.union(more))))
    assert first == pytest.approx(second, rel=1e-6)
    r = scored.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r["s"] / r["n"] > r["b"] / r["n"] + 0.2


def test_phrases_share_interiors():
    r = random.Random(6)
    body = "".join(r.choice("abcdefgh ") for _ in range(4000))
    names = lambda t: [set(x.tolist()) for x, _ in phrases.parse(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))]
    one, two = names("x" * 17 + body), names(body + "tail é" * 3)
    for level in range(3):
        assert len(one[level] & two[level]) >= 0.9 * min(len(one[level]), len(two[level]))
    runs = names("a" * 1000)
    assert all(len(x) == 1 for x in runs)


def test_phrase_fingerprints(spark, docs):
    rows = sorted(plain(docs), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t, _ in rows]
    expected = []
    prints = phrases.fingerprints([t.encode() for t in texts])
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        e = phrases.fingerprints([edited.encode()])[0]
        expected.append((str(rows[i][0]), len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[i], e, phrases.likeness(prints[i], e), phrases.likeness(prints[i], prints[(i + 1) % len(texts)])))
    got = [(str(r[0]), *r[1:]) for r in phrases.fingerprint_successors(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert phrases.fingerprint_successors(docs.limit(0)).count() == 0


def test_quality_rules(spark, docs):
    r = random.Random(8)
    window = " ".join(f"w{i}" for i in range(9))
    more = [(2000 + i, t, "a", "k", 1) for i, t in enumerate([f"{window} x {window}", f"{window}\n{window}\n \n{window}", "a|b $$$ *** <x>", "same line\nsame line\nother", " ".join(["dup"] * 40)])]
    more += [(3000 + i, " ".join(f"{r.choice(['tree', 'house', 'green', 'river'])}{i}" + ("***" if i % 7 == 0 else "") for i in range(i % 50 + 30)), "a", "k", 1) for i in range(50)]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    expected = collections.defaultdict(list)
    for k, t, _ in plain(df):
        t = t or ""
        w = words(t)
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        expected[k].append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed))
    got = quality_rules.judge(df).collect()
    assert len(got) == df.count()
    for x in got:
        assert tuple(x)[1:7] in expected[x["doc_id"]]
        assert not (x["base_failed"] and x["kept"])
        assert x["kept"] == (not x["base_failed"] and x["posterior"] >= 0.5)
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_weak_supervision_matches_plain_em(spark):
    r = random.Random(9)
    names = ["a", "b", "c"]
    rows = []
    for _ in range(400):
        good = r.random() < 0.8
        rows.append(tuple(0 if r.random() < 0.2 else (1 if r.random() < (0.97 if good else 0.3) else -1) for _ in names))
    p = quality_rules.fit(spark.createDataFrame(rows, "a int, b int, c int"), names, rounds=3)
    q = {"prior": quality_rules.FIRST_PRIOR} | {f"good_{x}": quality_rules.FIRST_GOOD for x in names} | {f"bad_{x}": quality_rules.FIRST_BAD for x in names}
    for _ in range(3):
        w = []
        for row in rows:
            g, b = q["prior"], 1 - q["prior"]
            for x, v in zip(names, row):
                if v:
                    g *= q[f"good_{x}"] if v == 1 else 1 - q[f"good_{x}"]
                    b *= q[f"bad_{x}"] if v == -1 else 1 - q[f"bad_{x}"]
            w.append(g / (g + b))
        n = len(rows)
        q = {"prior": (sum(w) + 1) / (n + 2)}
        for i, x in enumerate(names):
            ratio = lambda hit, all_, mean: (hit + mean * quality_rules.PRIOR_VOTES) / (all_ + quality_rules.PRIOR_VOTES)
            q[f"good_{x}"] = ratio(sum(g for g, v in zip(w, rows) if v[i] == 1), sum(g for g, v in zip(w, rows) if v[i]), quality_rules.FIRST_GOOD)
            q[f"bad_{x}"] = ratio(sum(1 - g for g, v in zip(w, rows) if v[i] == -1), sum(1 - g for g, v in zip(w, rows) if v[i]), quality_rules.FIRST_BAD)
    assert p == pytest.approx(q)


def test_a_rule_that_votes_at_random_loses_its_say(spark):
    """Three rules see bad texts; a fourth calls every third text bad, whatever it is."""
    rows = [(*((-1 if r == i % 3 or i % 2 == 0 else 1) if i % 5 == 0 else 1 for r in range(3)), -1 if i % 3 == 0 else 1) for i in range(3000)]
    names = ["a", "b", "c", "wild"]
    p = quality_rules.fit(spark.createDataFrame(rows, "a int, b int, c int, wild int"), names)
    assert p["good_wild"] < 0.75 and min(p[f"good_{x}"] for x in "abc") > 0.95
    good = spark.createDataFrame([(1, 1, 1, -1)], "a int, b int, c int, wild int").select(quality_rules.posterior(p, names).alias("p")).first()["p"]
    assert good > 0.9


def test_repeated_ids_count_once_in_the_fit(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other"), (3, None)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    got = neighbours.fitting_rows(docs, labels, "quality", key="doc_id", text="text", folds=5, limit=10)
    assert sorted(map(tuple, got.collect())) == sorted([(k, t, y) for k, t, y in ((1, "text 0", 1), (2, "other", 0), (3, None, 1)) if zlib.crc32(str(k).encode()) % 5])


def test_equal_cosines_all_vote():
    counts = np.zeros((40, neighbours.WIDTH), np.float32)
    counts[:, 3], counts[30:, 5] = 1, 1
    s = neighbours.Space(counts, np.arange(40) % 2)
    # 30 texts are the same: all of them vote, more than NEIGHBOURS, half of them 1.
    assert s.score(counts[:1])[0] == pytest.approx(0.5) and len(set(np.round(s.score(counts[:30]), 9))) == 1


def test_neighbours(spark):
    r = random.Random(10)
    good = lambda: " ".join(r.choice(["meadow", "river", "stone", "garden", "window"]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["XX!!", "$$$", "BUY!!", "@@@"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), "x") for i in range(240)] + [(900, None, "x"), (901, "", "x"), (902, "z" * 60_000, "x"), (None, good(), "x"), (903, good(), "x"), (903, good(), "x")]
    D = spark.createDataFrame(rows, "doc_id long, text string, label string")
    L = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    got = neighbours.classify(D, L).collect()
    assert len(got) == len(rows)
    for x in got:
        k = x["doc_id"]
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3)
        assert x["held_out"] == (k is not None and zlib.crc32(str(k).encode()) % 5 == 0)
        if k is not None and k < 240:
            assert x["predicted"] == int(k % 3 > 0)
    assert {round(x["score"], 6) for x in neighbours.classify(D, L.limit(0)).collect()} == {0.5}
    assert neighbours.classify(D.limit(0), L).count() == 0


def test_cosines_are_exact():
    r = np.random.default_rng(0)
    counts, labels = r.integers(0, 3, (50, neighbours.WIDTH)).astype(np.float32), r.integers(0, 2, 50)
    s = neighbours.Space(counts, labels)
    q = r.integers(0, 3, (7, neighbours.WIDTH)).astype(np.float32)
    u = s.unit(neighbours.weighed(q, s.idf))
    for x, score in zip(u, s.score(q)):
        c = sorted(((float(x @ y), int(v)) for y, v in zip(s.units, labels)), reverse=True)[: neighbours.NEIGHBOURS]
        w = [max(a, 1e-3) ** neighbours.SHARPNESS for a, _ in c]
        assert score == pytest.approx(sum(a * b for a, (_, b) in zip(w, c)) / sum(w), rel=1e-4)


def test_unescape_is_that_of_html():
    assert html_lib.unescape("&am &amp &copy;") == "&am & ©"
