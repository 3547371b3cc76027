"""Page operators on hand-made pages and graphs."""

import html
import re
import time

import numpy as np
import pytest

from cytolake.llm import main_text, url_filter
from cytolake.llm.queries import URL_RULES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:y}</style></head><body><header><h1>Site</h1><p>Welcome to our site of all things</p></header>
<dialog><p>We use cookies to give you the best experience on this website and for analytics, so accept them all now.</p></dialog>
<form action=x><label>Name</label><input name=x><button>Go</button></form>
<aside><p>Popular posts about all the things that happened in the last few weeks or months and years</p></aside>
<main><article><h1>Title &amp; more</h1><p>First para with a <a href=x>link</a> in it, b<b>ol</b>d.<!-- <p>gone</p> --><p>Second 1 &lt; 2,
 3 < 4 para&nbsp;x.<ul><li>One item<li>Another</ul>
<section><article><p>I do not agree with anything that was written here at all.</p></article></section></article></main>
<footer>(c) us</footer><script>document.write("<p>no</p>")</script></body></html>"""


def test_main_text_of_a_page():
    assert main_text.main_text(PAGE, main_text.tree()) == "Title & more First para with a link in it, bold. Second 1 < 2, 3 < 4 para x. One item Another"


def read(page):
    """The article of a generated page, by regular expressions."""
    inner = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*?)</article>", page, re.S)[1], flags=re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h1|li|ul)[^>]*>", " ", inner))).split())


def test_names_and_tags_decide_nothing(spark):
    """The given pages; all class, id and role names gone; all containers plain divs."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    nameless = [re.sub(r' (?:class|id|role)="[^"]*"', "", p.html) for p in pages]
    plain = [re.sub(r"(</?)(?:nav|footer|article|aside|header|main)\b", r"\1div", h) for h in nameless]
    for variant in ([p.html for p in pages], nameless, plain):
        assert [main_text.main_text(h, main_text.tree()) for h in variant] == [read(p.html) for p in pages]


def test_names_say_nothing_about_a_paragraph():
    body = "word " * 40
    page = f'<body><p>{body}</p><p class="legal">{body}</p><div class="note-share" id="sidebar"><p>{body}</p></div></body>'
    assert main_text.main_text(page, main_text.tree()).split() == body.split() * 3


def test_controls_without_an_end_tag():
    body = "word " * 40
    for tag in ("button", "object", "svg", "canvas", "select"):
        assert main_text.main_text(f"<p>{body}</p><{tag}><p>{body}</p>", main_text.tree()).split() == body.split() * 2
        assert main_text.main_text(f"<p>{body}</p><{tag}>gone</{tag}><p>{body}</p>", main_text.tree()).split() == body.split() * 2
    assert main_text.main_text(f"<p>{body}</p><script><p>{body}</p>", main_text.tree()).split() == body.split()


@pytest.mark.parametrize("page", ["</b>" * 100000, "<i>" * 100000 + "</b>" * 100000, "<td><div>" + "<i>" * 100000 + "<td></td>" * 50000, "<button>x" * 50000])
def test_stray_tags_take_time_in_proportion(page):
    start = time.process_time()
    main_text.blocks_of(page)
    assert time.process_time() - start < 10


def test_main_text_without_marks_goes_by_neighbours():
    body = "word " * 40
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a></div><div><p>{body}</p><p>short one here</p><p>{body}</p></div></body>"
    assert main_text.main_text(page, main_text.tree()).split() == (body + " short one here " + body).split()


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>", "a<b", "</p></div>", "&bogus; &#x110000; &", "<p>" * 3000, "<div><article></nav>", "<a href='"])
def test_main_text_of_odd_pages(page):
    assert isinstance(main_text.main_text(page, main_text.tree()), str)


def test_tree_learns_its_table():
    rows = np.array([[float(v) for v in line.split()] for line in main_text.LABELLED.strip().split("\n")])
    right = [main_text.judge(main_text.tree(), r[:-1]) == bool(r[-1]) for r in rows]
    assert np.mean(right) > 0.95
    folds = [main_text.judge(main_text.grow(np.delete(rows, i, 0)[:, :-1], np.delete(rows, i, 0)[:, -1].astype(int)), rows[i, :-1]) == bool(rows[i, -1]) for i in range(len(rows))]
    assert np.mean(folds) > 0.8


def test_extraction_keeps_rows(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, 6), (3, "", "", 7), (4, "v", "<article>" + "<p>x y</p>" * 20000 + "</article>", 8)]
    got = main_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and max(r.n_chars for r in got) == 79995     # the last short block, like a footer, is none
    assert main_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_rules(spark):
    urls = {"http://www.Example.com/en/1?x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
            "https://example.com/en": ("example.com", "/en", "com/", "allow"), "x://b.net/es/1#y": ("b.net", "/es/1", "net/es/", "block"), "http://com": ("com", "", None, "allow"),
            "http://notcom/": ("notcom", "/", None, "allow"), "no scheme.com/": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://?q": ("", "", None, "allow"),
            "http://ÄB.NET/fr/": ("Äb.net", "/fr/", "net/fr/", "block")}
    rows = [(i, u, None if i % 2 else "<p>", "extra") for i, u in enumerate(urls)] * 2
    got = url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string, host string"), URL_RULES)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=repr) == sorted(((i, *urls[u]) for i, u, *_ in rows), key=repr)
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_filter.judge(none, URL_RULES).count() == 0 and url_filter.judge(none, []).count() == 0


def brute_rank(edges, seeds, hosts):
    """Every seed starts with 1; the solution of r = s + 0.85 r M."""
    at = {h: i for i, h in enumerate(hosts)}
    m, s = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts))
    for a, b, n in edges:
        m[at[a], at[b]] += n
    for h in seeds:
        s[at[h]] = 1
    total = m.sum(axis=1, keepdims=True)
    m = np.divide(m, total, where=total > 0, out=np.zeros_like(m))
    return np.linalg.solve(np.eye(len(hosts)) - 0.85 * m.T, s)


def test_seeds_without_links_change_no_verdict(spark):
    pages = [(1, "http://good.com/a", "<a href='//middle.org/'>"), (2, "http://middle.org/x", "<a href='//bad.net/'>"), (3, "http://bad.net/es/1", None)]
    more = [(10 + i, f"http://bad{i}.net/es/1" if i % 2 else f"http://fine{i}.com/", None) for i in range(100)]
    few, many = ({r.page_id: (r.verdict, r.trust, r.distrust) for r in url_filter.judge(
        spark.createDataFrame(p, "page_id bigint, url string, html string"), URL_RULES).filter("page_id < 10").collect()} for p in (pages, pages + more))
    assert few == many and few[2][0] == "block"


def test_distrust_runs_against_links(spark):
    link = lambda *to: "".join(f'<A class=x HREF="//{t}/p">t</A>' for t in to)
    pages = [(1, "http://good.com/a", link("friend.org", "friend.org", "GOOD.com")), (2, "http://friend.org/x", link("other.org")), (3, "http://bad.net/es/1", ""),
             (4, "http://farm.org/1", link("bad.net", "other.org")), (5, "http://farm.org/2", link("bad.net")), (6, "http://other.org/z", "<a href='/rel'>"), (7, "http://lonely.org/", None)]
    d = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(d, URL_RULES).collect()}
    assert {i: got[i].verdict for i in got} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow"}
    edges = [(r.src, r.dst, r.n) for r in url_filter.links(d).collect()]
    assert sorted(edges) == [("farm.org", "bad.net", 2), ("farm.org", "other.org", 1), ("friend.org", "other.org", 1), ("good.com", "friend.org", 1)]
    hosts = sorted({h for a, b, _ in edges for h in (a, b)})
    trust, distrust = brute_rank(edges, ["good.com"], hosts), brute_rank([(b, a, n) for a, b, n in edges], ["bad.net"], hosts)
    for r in got.values():
        if r.host in hosts:
            assert r.trust == pytest.approx(trust[hosts.index(r.host)], abs=1e-3) and r.distrust == pytest.approx(distrust[hosts.index(r.host)], abs=1e-3)


def test_distrust_goes_past_the_first_hop_among_many_seeds(spark):
    """One chain of links to one of 20,000 blocked hosts; the others have no links."""
    seeds = [(i, f"http://bad{i}.net/es/1", None) for i in range(20000)]
    chain = [(20001, "http://near.org/x", "<a href='//bad7.net/'>"), (20002, "http://far.org/x", "<a href='//near.org/'>"), (20003, "http://farther.org/x", "<a href='//far.org/'>")]
    d = spark.createDataFrame([*seeds, *chain, (20004, "http://aside.org/", None)], "page_id bigint, url string, html string").repartition(4)
    got = {r.page_id: r for r in url_filter.judge(d, URL_RULES).filter("page_id > 20000").collect()}
    assert [got[i].verdict for i in range(20001, 20005)] == ["block"] * 3 + ["allow"]
    for hops, i in enumerate(range(20001, 20004), 1):
        assert got[i].distrust == pytest.approx(0.85 ** hops, rel=1e-6)


def test_rank_of_cycles_is_the_matrix_solution(spark):
    edges = [("a", "b", 1), ("b", "c", 2), ("c", "a", 1), ("b", "d", 1), ("d", "b", 3), ("e", "a", 1), ("c", "f", 4)]
    seeds = spark.createDataFrame([("a", 1.0), ("x", 1.0)], "host string, share double")
    got = {r.host: r.t for r in url_filter._pagerank(spark.createDataFrame(edges, "src string, dst string, n bigint"), seeds, "t").collect()}
    hosts = ["a", "b", "c", "d", "e", "f", "x"]
    want = dict(zip(hosts, brute_rank(edges, ["a", "x"], hosts)))
    assert set(got) == set(hosts) - {"e"} and all(got[h] == pytest.approx(want[h], rel=2e-3) for h in got)
