"""Search, URL rules, archives, page text, decontamination and the pipeline against brute force."""

import gzip
import hashlib
import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import decontam, html_text, queries, topk, url_filter, warc
from tesserae.llm.common import components, new_path

from ..conftest import SMALL

PAGES = "page_id long, url string, html string, rule string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], PAGES)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7), (None, 3), (4, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bounds_hold_and_best_is_exact():
    rnd = np.random.default_rng(3)
    x = rnd.integers(-300, 300, (400, 37))
    x[50:60] = x[49]
    ids = rnd.permutation(400).astype(np.int64)
    for n in topk.LEVELS:
        s = topk.segments(x.astype(float), n)
        assert (s @ s.T >= x @ x.T - 1e-6).all()
    best = topk.Best(ids[:30], x[:30], 5)
    scored = sum(best.take(ids[lo : lo + 64], x[lo : lo + 64]) for lo in range(0, 400, 64))
    assert scored <= 30 * 399
    got = list(zip(*(c.tolist() for c in best.rows()), strict=True))
    want = []
    for q in range(30):
        order = sorted((-int(x[q] @ x[c]), int(ids[c])) for c in range(400) if ids[c] != ids[q])[:5]
        want += [(int(ids[q]), i, -s) for s, i in order]
    assert got == want


def test_topk_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.001, -0.001]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, None), (7, []), (8, [1.0]), (100, [3.0]), (None, [1.0, 2.0]), (9, [1e300, 1.0]), (150, [nan, 0.0]), (2, [1.0, 2.0]), (200, [-1.0, -1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = topk.topk(df).collect()
    assert sorted(got) == sorted(topk.topk(df.repartition(1), hold=1).collect())

    def ints(v):
        from fractions import Fraction

        return [int(Fraction(c) * 256 // 1) for c in v] if v and all(c is not None and np.isfinite(c) for c in v) else None

    want = []
    for q, v in rows:
        if q is not None and q % 50 == 0 and ints(v):
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ints(v), ints(w), strict=True)))), c) for c, w in rows if c is not None and c != q and ints(w) and len(w) == len(v))
            want += [(q, r, c, -s) for r, (s, c) in enumerate(scores[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    bad = [(50, [1.0, None]), (50, [2.0, 3.0]), (1, [1.0, 1.0]), (100, None), (100, [float("nan"), 0.0])]  # a query's vectors that take no part don't answer for it
    assert [tuple(r) for r in topk.topk(spark.createDataFrame(bad, "vec_id long, embedding array<double>")).collect()] == [(50, 1, 1, 327680)]


def test_bounds_spare_most_pairs(spark):
    assert topk.exact_share(spark.read.parquet(f"{SMALL}/../sf0.1/embeddings.parquet").coalesce(1)) < 0.3


def test_url_rules(spark):
    rows = [
        (1, "http://a.net/x", "block", "net/"), (2, "http://A.Example.NET/en/9?q#f", "allow", "example.net/en/"), (3, "https://example.com/de/", "block", "example.com/de/"), (4, "http://b.org/fr/1", "allow", "org/fr/"),
        (5, "http://notexample.com/de/", "allow", None), (6, "http://a.net", "allow", None), (7, None, "allow", None), (8, "net/", "allow", None), (9, "x://net/?://b.org/fr/", "block", "net/"), (10, "http://a.net?x/", "allow", None),
    ]
    got = {r.page_id: r for r in url_filter.judged(pages(spark, [(i, u, None) for i, u, _, _ in rows])).collect()}
    for i, url, verdict, rule in rows:
        assert (got[i].verdict, got[i].rule) == (verdict, rule), url
    assert (got[2].host, got[2].path) == ("a.example.net", "/en/9") and (got[7].host, got[7].path) == ("", "")
    assert url_filter.judged(pages(spark, [(1, "u", "h")]).limit(0)).count() == 0


def test_blocks_spread_over_aliases(spark):
    canonical = lambda to: f"<head><link href='{to}' rel=canonical></head>"
    rows = [
        (1, "http://one.com/a", canonical("https://bad.net/x")),
        (2, "http://two.com/b", canonical("http://one.com/a#part")),
        (3, "http://ok.org/fr/c", canonical("http://two.com/b")),  # an allow of its own
        (4, "http://three.com/d/e", '<meta http-equiv="Refresh" content="0; URL=f">'),
        (5, "http://three.com/d/f", canonical("//bad.net/?a=1&amp;b=2")),
        (6, "http://four.com/", canonical("/other")),
        (7, "http://two.com/b", ""),
        (8, "http://five.com/", '<a href="http://bad.net/x">no redirect</a><!-- canonical -->'),
    ]
    got = {r.page_id: (r.verdict, r.rule, r.via_alias) for r in url_filter.judged(pages(spark, rows)).collect()}
    assert got == {1: ("block", None, True), 2: ("block", None, True), 3: ("allow", "org/fr/", False), 4: ("block", None, True), 5: ("block", None, True), 6: ("allow", None, False), 7: ("block", None, True), 8: ("allow", None, False)}
    more = spark.createDataFrame([("http://four.com/other", "ftp://x.bad.net/")], "a string, b string")
    assert {r.page_id: r.verdict for r in url_filter.judged(pages(spark, rows), edges=more).collect()}[6] == "block"


def test_only_links_in_the_head_count(spark):
    bad = "http://bad.net/x"
    link = f'<link rel="canonical" href="{bad}">'
    looks = [
        (f"<!-- {link} -->", 0), (f"<script>s = '{link}'</script>", 0), (f"<title>{link}</title>", 0), (f"<head></head>{link}", 0), (f"<body>{link}", 0), (f"<!-- {link}", 0),
        (f"<link title='rel=canonical' href='{bad}'>", 0), ("<link rel=canonical href='http://['>", 0), ("<link rel=canonical>", 0), ("<meta http-equiv=refresh content=30>", 0), (f"<link rel=nocanonical href='{bad}'>", 0),
        (f"<LINK data-x='a>b' REL='alternate CANONICAL' HREF={bad}>", 1), ("<link rel=canonical href='&#104;ttp://bad.net/x'>", 1), ("<base href='http://bad.net/a/b/'><link rel=canonical href=../../x>", 1),
        (f"<link {'x ' * 500_000}rel=canonical href='{bad}'>", 1), ("<meta " + "y" * 1_000_000, 0), (f"<link {'y' * 1_000_000} rel=canonical href={bad} ", 0), (f"<meta http-equiv=refresh content='5;URL=&quot;{bad}&quot;'>", 1),
    ]
    rows = [(i, f"http://ok{i}.com/", h) for i, (h, _) in enumerate(looks)] + [(99, bad, "")]
    got = {r.page_id: r.verdict for r in url_filter.judged(pages(spark, rows)).collect()}
    assert got == {i: "block" if blocked else "allow" for i, (_, blocked) in enumerate(looks)} | {99: "block"}
    odd = [(1, None, link), (2, "no scheme", link), (3, None, None), (4, "://", link), (4, "://", link)]
    assert sorted(r.page_id for r in url_filter.judged(pages(spark, odd)).collect()) == [1, 2, 3, 4, 4]


def test_archives_round_trip(spark):
    long = "<p>é" + "x" * 200
    rows = [(5, "http://b.com/1", long), (3, "http://a.com/2?q=\t1\n", long), (9, None, long), (7, "http://b.com/1", "short"), (8, "http://b.com/0", "short"), (1, "u", None), (2, "http://a.com/é 漢", ""), (None, "http://n.com/", long), (3, "http://a.com/2?q=\t1\n", long), (11, "http://c.d.e/", "y" * 100), (12, "http://c.d.e/", "y" * 99)]
    df = pages(spark, rows)
    folder = new_path(spark, "warc-test")
    captures = warc.write(df, folder)
    directory = warc.index(captures, folder, lines=2)
    got = sorted(map(tuple, warc.read(warc.find(directory, df.select("url", "page_id"))).collect()), key=repr)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = h == long and i != 3
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want, key=repr)
    found = warc.lookup(directory, [("http://b.com/1", 7), ("http://b.com/1", 5), ("http://nowhere/", 1)]).collect()
    assert sorted((r.page_id, r.record_type, r.payload) for r in found) == [(5, "revisit", None), (7, "response", b"short")]
    c = captures.filter("page_id = 11").first()  # any reader of gzip finds the record
    with open(c.file.removeprefix("file:"), "rb") as f:
        f.seek(c.offset)
        assert b"\r\nWARC-Type: response\r\nWARC-Page-ID: 11\r\n" in gzip.decompress(f.read(c.length))
    files = {c.file.removeprefix("file:") for c in captures.collect()}
    whole = [gzip.decompress(open(f, "rb").read()) for f in files]
    assert all(w.startswith(b"WARC/1.1\r\n") and w.index(b"WARC-Type: warcinfo") < 200 for w in whole)
    every = [i for w in whole for i in re.findall(rb"WARC-Record-ID: (\S+)", w)]
    assert len(every) == len(set(every)) == len(rows) + len(files)
    assert all(b"WARC-Refers-To-Target-URI: http://a.com/2?q=%09" in w for w in whole if b"WARC-Type: revisit" in w)
    huge = pages(spark, [(1, "http://l.com/", "z" * 3_000_000), (2, "http://l.com/" + "p" * 100_000, "z" * 3_000_000)])
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in warc.archived(spark, huge).collect()) == [(1, 3_000_000, None), (2, 3_000_000, 1)]
    assert warc.archived(spark, df.limit(0)).count() == 0


CASES = [
    ("<html><body><header><h1>Site</h1></header><nav><a>x</a></nav><main><article><header><h1>T</h1><span>by me</span></header><p>a<b>b</b> c<p>d&nbsp;e<div class='ad-slot'>AD<p>more</div><ul><li>one<li>two</ul><aside>s</aside><section class='comments'><article class='comment'>hi</article></section></article></main><footer>f</footer>", "T ab c d e one two"),
    ("<div class='content with-sidebar'><p>x</p></div><p class='notice'>cookie<p>y", "x"),
    ("<div class='with-sidebar'><p>x</p></div><p class='notice'>cookie<p>y", "x y"),
    ("<article>a<script>if(a<b){'</p>'}</script>b<!-- x --> c</article", "ab c"),
    ("<p>a &lt;b&gt; 1 < 2 &#233;&eacute</p>", "a <b> 1 < 2 éé"),
    ("<nav><ul><li>m<article>z</article>", "z"),
    ("<main><form>q<input></form><p>k</p></main><p>after</p>", "k"),
    ("<article><p>one <br>two<p class=x-comments>no</p><h2>three</h2></article>", "one two three"),
    ("<article><![CDATA[raw]]><textarea>t</textarea><p>p <style>s", "raw p"),
    ("<div id=content role=main>in<div role=navigation>menu</div></div>out", "in"),
    ("<body><h1>Site</h1><div class='post-content main'><p>text</p><div class=share>no</div></div><p>tail</p>", "text"),
    ("<div class='site-header'>S</div><article><div class='header'>h</div><ol class=commentlist><li>c</ol><div id='respond'>r</div><div class='newsletter-signup'>n</div>t</article>", "h t"),
    ("", ""), (None, ""), ("<", "<"), ("<article><p", ""), ("a" * 100_000, "a" * 100_000),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_main_text(case):
    page, text = CASES[case]
    assert " ".join(html_text.blocks(page)[0]) == text


def test_main_text_of_the_table(spark):
    got = {r.page_id: r for r in html_text.extracted(spark.read.parquet(f"{SMALL}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        body = re.search("<article>(.*?)</article>", r.html, re.DOTALL)[1]
        text = " ".join(html.unescape(re.sub("</?(p|h1|br)[^>]*>", " ", body).replace("<b>", "").replace("</b>", "")).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


def test_suffix_array():
    rnd = random.Random(2)
    for _ in range(50):
        s = [rnd.randrange(3) for _ in range(rnd.randint(1, 40))]
        order, ranks = html_text.suffix_array(np.array(s))
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        shared = [next((k for k, (a, b) in enumerate(zip(s[i:], s[j:], strict=False)) if a != b), min(len(s) - i, len(s) - j)) for i, j in zip(order[:-1], order[1:], strict=True)]
        assert html_text.common_prefixes(order, ranks).tolist() == shared


@pytest.mark.parametrize("chunk", [60, 10**6])
def test_what_most_articles_of_a_host_share_goes(spark, chunk, monkeypatch):
    rnd = random.Random(8)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    boiler, passage, own = words(12), words(30), {}
    rows = []
    for i in range(40):  # in no element and under no name that a list could know
        parts = [words(15), *([passage] if i % 2 else []), *([boiler] if i else []), words(5)]
        own[i] = " ".join(w for p in parts if p is not boiler for w in p)
        rows.append((i, "http://h.com/x", f"<article><div class=zq7><p>{' '.join(w for p in parts for w in p)}</div></article>"))
    for i in range(40, 60):  # another host: nine distinct pages share it, one of them in copies
        parts = [words(10) if i < 48 else ["copy"] * 9, boiler]
        own[i] = " ".join(w for p in parts for w in p)
        rows.append((i, "http://g.com/", f"<main>{own[i]}</main>"))
    rows += [(99, "http://h.com/", rows[3][2]), (98, "http://h.com/", "<article></article>")]
    own |= {99: own[3], 98: ""}
    got = {r.page_id: r.text for r in html_text.extracted(pages(spark, rows), chunk=chunk).collect()}
    assert {i: got[i] for i in own} == own
    monkeypatch.setattr(html_text, "_common", lambda *_: None)  # without the suffix array it stays
    off = {r.page_id: r.text for r in html_text.extracted(pages(spark, rows), chunk=chunk).collect()}
    assert all((off[i] == own[i]) == (i == 0 or i >= 40 and i not in (99,)) for i in own)


@pytest.mark.parametrize("chunk", [10, 10**6])
def test_repeated_runs_of_a_host_go(spark, chunk):
    rnd = random.Random(6)
    boiler = " ".join(f"menu{i}" for i in range(12))
    rows, want = [], {}
    for i in range(12):
        own = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(20))
        host = "h.com" if i < 10 else f"g{i}.com"
        rows.append((i, f"http://{host}/{i}", f"<div>{boiler}</div><p>{own}</p>"))
        want[i] = own if i < 10 else f"{boiler} {own}"
    rows += [(20, "http://g11.com/11", rows[11][2]), (21, None, None), (22, "", "<p>x")]
    want |= {20: want[11], 21: "", 22: "x"}  # a page that is repeated isn't its own boilerplate
    got = {r.page_id: r.text for r in html_text.extracted(pages(spark, rows), chunk=chunk).collect()}
    assert got == want
    assert html_text.extracted(pages(spark, rows).limit(0)).count() == 0


def test_masks_find_a_passage_with_a_replaced_word():
    for x in range(13):
        assert any(all(o + i != x for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for o in range(13 - len(m) + 1))


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", limit)
    item = [f"q{i}" for i in range(20)]
    changed = [w if i % 5 != 2 else "changed" for i, w in enumerate(item)]
    rows = [
        (1, "before it " + " ".join(item) + " after"), (2, "Some, " + ", ".join(changed).upper() + "!"), (3, " ".join(item[:9])), (4, None), (5, ""), (6, "a b c d e f g h i j k l m n o p"), (None, " ".join(item)),
        (7, " ".join(item[10:])), (1, "repeated id"), (8, " ".join(item[:6] + ["extra"] + item[6:])), (9, "x " * 3000 + " ".join(item) * 2),  # the last word and the first become one
    ]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "too short to count"), (None, "x " * 30), (3, None), (0, " ".join(item))], "item_id long, text string")
    got = sorted(map(tuple, decontam.leaks(docs, bench).collect()), key=repr)
    assert [(r[0], r[1], r[3]) for r in got] == [(1, 0, 20), (2, 0, 16), (7, 0, 10), (8, 0, 20), (9, 0, 20), (None, 0, 20)]
    assert {r[0]: r[2] for r in got}[1] == 2 and {r[0]: r[2] for r in got}[7] == -10
    assert sorted(map(tuple, decontam.clean(docs, bench).collect())) == [(1, "repeated id", "z"), *((d, t, "z") for d, t in rows if d in (3, 4, 5, 6))]
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [10**6, 0])
def test_short_items_broken_passages_and_rows_without_id(spark, duck, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", limit)
    item, nine, rnd = [f"q{i}" for i in range(60)], [f"n{i}" for i in range(9)], random.Random(3)
    broken = [*item[:28], "a", "b", *item[28:32], "c", *item[32:]]
    scattered = [w for i in range(0, 60, 6) for w in (*item[i : i + 6], *(f"f{i}_{j}" for j in range(rnd.randrange(1, 9))))]
    shuffled = [w for i in rnd.sample(range(0, 60, 4), 15) for w in item[i : i + 4]]  # no run of five
    docs = [
        (0, broken), (1, scattered), (2, shuffled), (3, ["x", *nine, "y"]), (4, nine[:8]), (5, [*nine[:4], "in", *nine[4:]]), (6, ["one", "word"]), (7, ["two"]), (None, item), (None, ["clean"]), (None, ["clean", "too"]),
        (8, item[:25] + ["gap"] + item[30:33]), (8, item[26:36]), (9, ["x"] * 2000 + item[:7]), (10, [w for i, w in enumerate(item) if i % 6]),
    ]
    docs = [(d, " ".join(w)) for d, w in docs] + [(11, None), (11, "")]
    bench = [(0, " ".join(item)), (1, " ".join(nine)), (2, "word"), (3, ""), (4, "x " * 30), (5, "two two")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    with duck.cursor() as c:
        c.execute("CREATE TEMP TABLE documents (doc_id BIGINT, text VARCHAR)")
        c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
        c.execute("CREATE TEMP TABLE benchmark (item_id BIGINT, text VARCHAR)")
        c.executemany("INSERT INTO benchmark VALUES (?, ?)", bench)
        want = sorted(c.execute(decontam.SQL).fetchall(), key=repr)
    assert {(r[0], r[1]) for r in want} == {(0, 0), (1, 0), (3, 1), (6, 2), (9, 4), (10, 0), (None, 0)}
    assert sorted(map(tuple, decontam.leaks(*frames).collect()), key=repr) == want
    clashing = frames[0].selectExpr("*", "1 AS text_hash", "2 AS bad_id", "3 AS __id", "4 AS item_id")
    left = decontam.clean(clashing, frames[1])
    assert left.columns == clashing.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(d, t) for i, (d, t) in enumerate(docs) if i in (2, 4, 5, 7, 9, 10, 11, 12) or i > 14], key=repr)


def test_names_like_an_articles_are_no_marks(spark):
    boiler = " ".join(f"menu{i}" for i in range(12))
    looks = [
        '<nav id="main-menu">m</nav>', '<header class="main-header">h</header>', '<div class="post-meta"></div>', '<link id="main-css">', '<a class="skip-to-content"></a>', "<!-- <main> -->", "", "<article></article>",
    ]
    rows = [(i, "http://h.com/", f"{x}<div>{boiler}</div><p>own{i} text{i}</p>") for i, x in enumerate(looks)]
    rows += [(20 + i, "http://h.com/", f'<div>{boiler}</div><div class="body">{boiler} in{i}</div>') for i in range(2)]  # these mark it
    want = {i: f"own{i} text{i}" for i in range(len(looks))} | {20 + i: f"{boiler} in{i}" for i in range(2)}
    assert {r.page_id: r.text for r in html_text.extracted(pages(spark, rows)).collect()} == want


@pytest.mark.parametrize(("limit", "share"), [(10**6, 0.5), (0, 0.5), (10**6, 0.25), (10**6, 0.9)])
def test_every_leak_by_share_is_found(spark, duck, monkeypatch, limit, share):
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", limit)
    rnd = random.Random(9)
    bench = [(j, [f"q{rnd.randrange(300)}" if rnd.random() < 0.7 else "the" for _ in range(n)]) for j, n in enumerate([10, 11, 12, 13, 15, 16, 20, 41])]
    docs, filler = [], lambda n: [f"f{rnd.randrange(1000)}" for _ in range(n)]
    for _, item in bench:
        for k in range(2, 7):  # every k-th word replaced, or only every k-th left
            for o in range(k):
                docs.append([f"z{i}" if i % k == o else w for i, w in enumerate(item)])
                docs.append([w if i % k == o else f"z{i}" for i, w in enumerate(item)])
        for part in (0.3, 0.4, 0.5, 0.55):
            docs += [[f"z{i}" if rnd.random() < part else w for i, w in enumerate(item)] for _ in range(10)]
    docs = [(i, " ".join([*filler(rnd.randrange(5)), *d, *filler(3)])) for i, d in enumerate(docs)]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(j, " ".join(w)) for j, w in bench], "item_id long, text string"), share)
    with duck.cursor() as c:
        c.execute("CREATE TEMP TABLE documents (doc_id BIGINT, text VARCHAR)")
        c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
        c.execute("CREATE TEMP TABLE benchmark (item_id BIGINT, text VARCHAR)")
        c.executemany("INSERT INTO benchmark VALUES (?, ?)", [(j, " ".join(w)) for j, w in bench])
        want = c.execute(decontam.SQL.replace("ceil(0.5 * len(w))", f"ceil({share} * len(w))")).fetchall()
    assert len(want) > 5
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_decontamination_has_no_python(spark):
    df = queries.QUERIES["op7_decontam"](spark, SMALL)
    shards = queries.QUERIES["op3_shards"](spark, SMALL)
    for plan in (df, shards):
        assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().toString())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL)
    rows = duck.execute(queries.SQL[name]).fetchall()
    columns = [c[0] for c in duck.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    from .test_text_ops import BPE, brute_groups

    rows = docs.orderBy("doc_id").collect()
    left = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    kept = {g[0] for g in brute_groups([(r.doc_id, r.text) for r in left]) if g[3]}
    after = [r for r in left if r.doc_id in kept]
    items = [re.sub(r"[\W_]+", " ", r.text.lower()).split() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    def leaks(text):
        ws = re.sub(r"[\W_]+", " ", text.lower()).split()
        for item in items:
            for d in range(-len(item) // 2, len(ws)):
                if 2 * sum(0 <= d + i < len(ws) and ws[d + i] == w for i, w in enumerate(item)) >= len(item):
                    return True
        return False

    from tesserae.llm import bpe

    codec = bpe.codec(BPE)
    want = {r.doc_id: len(codec.encode(r.text)) for r in after if not leaks(r.text)}
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want
    kind = "doc_id long, text string, lang string, source string, n_chars long, __x double"
    clash = ", __id long, lang_pred string, score double, LETTERS long, fit string, text_hash string, kept_id long, kept_hash long, bad_id long, bad_hash long, component_id long, kept boolean, cls string, __lang_pred string"
    odd = [(1, None, "en", "s", 0, 1.0), (2, "", None, "s", 0, 1.0), (3, "words here", "en", None, None, None), (None, "words here", "en", None, None, None), (3, "words here", "en", None, None, None), (4, "a " * 200_000, "en", None, None, None)]
    n = clash.count(",")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (odd, []):
            df = spark.createDataFrame([(*r, *[None] * n) for r in rows], kind + clash)
            out = stage(spark, df, SMALL)
            assert out.columns == df.columns
            assert out.count() <= len(rows)


def test_pipeline_rejects_what_is_in_no_language(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    foreign = ["Это русский текст, который не относится ни к одному из выученных языков и должен быть отвергнут", "xkqz vbnmw qqzzx jjkkw pqxz vvbbn mmnnz xxccz qwzxv bnmzx kjqzw", "12345 !!!", "", None]
    more = spark.createDataFrame([(10_000 + i, t, None, "s", 0) for i, t in enumerate(foreign)], "doc_id long, text string, lang string, source string, n_chars long")
    every = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more.select("doc_id", "text", "lang", "source", F.col("n_chars").cast(docs.schema["n_chars"].dataType)))
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, every, SMALL).collect()) == sorted(r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    corpus_pipeline.LANGUAGES = ["de"]
    try:
        left = corpus_pipeline.language_id(spark, every, SMALL).collect()
    finally:
        corpus_pipeline.LANGUAGES = None
    assert left and sum(r.lang == "de" for r in left) >= 0.95 * len(left)
    corpus_pipeline.LEAST_SCORE, held = 1.1, corpus_pipeline.LEAST_SCORE
    try:
        assert corpus_pipeline.language_id(spark, every, SMALL).count() == 0
    finally:
        corpus_pipeline.LEAST_SCORE = held
