import html as entities
import random
import re
import time

import duckdb
import pytest

from prismlake.llm import htmlwrap, queries, urlfilter

SF = "/root/testdata/sf0.001"


def page(title, *paragraphs, nav="Home", tail=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">{nav}</a></li></ul></nav>'
        f'<div class="ad">Buy</div><article><h1>{title}</h1>{body}</article>{tail}<footer>&copy; site</footer></body></html>'
    )


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, paths string")


def test_article_text(spark):
    rows = [(i, f"http://a.org/{i}", page(f"T{i}", f"one &amp; {i}", "two\n  lines<br>more <b>bold")) for i in range(5)]
    rows += [(10, None, page("N", "null url")), (11, "http://a.org/x", None), (12, "http://b.org/", ""), (None, "http://a.org/n", page("No", "id")), (0, rows[0][1], rows[0][2])]
    got = {(r.page_id, r.url): r for r in htmlwrap.extract(pages(spark, rows)).collect()}
    assert got[0, "http://a.org/0"].text == "T0\n\none & 0\n\ntwo lines more bold"
    assert got[10, None].text == "N\n\nnull url" and got[None, "http://a.org/n"].text == "No\n\nid"
    assert got[11, "http://a.org/x"].text == "" and got[12, "http://b.org/"].n_chars == 0
    assert htmlwrap.extract(pages(spark, rows)).count() == len(rows)
    assert htmlwrap.extract(pages(spark, rows[:0])).count() == 0


def test_comments_forms_and_sidebars():
    html = page("T", "text", tail='<section id="comments"><p>me too</p></section><aside>side</aside><form><p>mail</p></form>').replace("</article>", '<div class="share">share</div><form>x</form></article>')
    assert own_text(html) == "T\n\ntext"


def test_wrapper_without_article(spark):
    """Where no element is named article, the slots with most text decide; what is the same on all pages is template."""
    make = lambda i: f"<html><body><div><p>Welcome to the site, the best one there is on all of the web, truly so</p></div><div class=box><h2>Head {i}</h2><p>{'body ' * 20}{i}</p><p>second {i}</p></div></body></html>"
    got = htmlwrap.extract(pages(spark, [(i, f"http://h.net/{i}", make(i)) for i in range(6)])).orderBy("page_id").collect()
    assert got[2].text == f"Head 2\n\n{('body ' * 20).strip()} 2\n\nsecond 2"


def own_text(html):
    return htmlwrap.main_text(htmlwrap.parse(html), set())


def test_class_words_of_layouts():
    """Words of a template's layout don't make the page, its main part or its article boilerplate."""
    text = "<h1>T</h1><p>text</p>"
    for body in ("has-sidebar", "right-sidebar", "banner", "with_comments share"):
        assert own_text(f'<html class="has-menu"><body class="{body}"><div>{text}</div></body></html>') == "T\n\ntext"
        assert own_text(f'<body class="{body}"><main class="{body}"><article class="post has-comments">{text}</article></main></body>') == "T\n\ntext"
    assert own_text(f'<body><div class="no-sidebar"><p>text</p></div><div class="layout-sidebar">{text}</div></body>') == "text\n\nT\n\ntext"
    assert own_text('<body><p>text</p><div class="site-footer">f</div><div id="main-nav">n</div><div class="widget">w</div><div role="banner">b</div></body>') == "text"


def hosted(spark, make):
    return htmlwrap.extract(pages(spark, [(i, f"http://h.net/{i}", make(i)) for i in range(4)])).orderBy("page_id").collect()[2].text


def test_whole_text_without_article(spark):
    """Headline, lead and text in other containers than the largest are main text too."""
    nav = "<nav><p>Home</p></nav><div><p>The same on all pages</p></div>"
    body = "body " * 20
    makers = [
        lambda i: f"<body>{nav}<div class=post><h1>T {i}</h1><div class=entry><p>{body}{i}</p></div></div></body>",
        lambda i: f"<body>{nav}<div id=content><h1>T {i}</h1><section><p>{body}{i}</p></section></div></body>",
        lambda i: f"<body>{nav}<div class=a><h1>T {i}</h1></div><div class=b><div class=c><p>{body}{i}</p></div></div></body>",
        lambda i: f"<body>{nav}<div class=story><h2>T 2</h2><div><p>{body}{i}</p></div></div></body>",
        lambda i: f"<body>{nav}<p>Seen {i} times</p><div role=main><h1>T {i}</h1><div><p>{body}{i}</p></div></div></body>",
    ]
    for make in makers:
        assert hosted(spark, make) == f"T 2\n\n{body}2"


def test_wrapper_expression():
    one = htmlwrap.wrapper(htmlwrap.parse("<div><h1>a</h1><p>x</p><p>y</p></div>"))
    two = htmlwrap.wrapper(htmlwrap.parse("<div><h1>a</h1><table><tr><td>1</td></tr></table><p>z</p></div>"))
    text = htmlwrap.expression(htmlwrap.merge(one, two))
    assert "(<p>#TEXT</p>)+" in text and "(<table>" in text and ")?" in text and text.count("#TEXT") == 1


def test_merge_order_keeps_places():
    rng = random.Random(0)
    whole = [htmlwrap.wrapper(htmlwrap.parse(page(f"T{i}", *["p"] * rng.randint(1, 4)))) for i in range(9)]
    found = set()
    for _ in range(5):
        rng.shuffle(whole)
        w = whole[0]
        for x in whole[1:]:
            w = htmlwrap.merge(w, x)
        found.add(tuple(htmlwrap.template_paths(w)))
    assert len(found) == 1


def article_of(page):
    """Main text of the given tables' pages, by their markup."""
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", re.sub(r"<!--.*?-->", "", page or "", flags=re.S), re.S)
    blocks = re.split(r"</?(?:h1|p)>", inside.group(1)) if inside else []
    blocks = [" ".join(entities.unescape(re.sub(r"</?[a-z][^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_all_given_pages(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op5_html_wrappers(spark, folder).collect()}
    assert got == {i: (u, article_of(h), len(article_of(h))) for i, (u, h) in rows.items()}


def test_headers():
    """A header goes, but not one with the headline or, in an article, with the article's title."""
    assert own_text("<main><header><p>Site</p></header><h1>T</h1><p>text</p></main>") == "T\n\ntext"
    assert own_text("<article><header><h2>T</h2><p>by</p></header><p>text</p></article>") == "T\n\nby\n\ntext"
    assert own_text("<body><header><div><h1>T</h1></div></header><p>text</p></body>") == "T\n\ntext"


HOSTILE = ["<div>", "<a ", "<p>a", "<div><p>", "<h1>", "<li><div>", "<script ", "<", '<a b="<a" ', "<!", "</script", "<!--", "<header>", "&#9", "<table><tr><td>", "</p>", "<nav>"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages(piece):
    """Deep, broken and endless markup is read in linear time, wherever the text is."""
    began = time.time()
    root = htmlwrap.parse(piece * 100_000 + "<div>x</div>")
    htmlwrap.main_text(root, set())
    w = htmlwrap.wrapper(root)
    htmlwrap.template_paths(htmlwrap.pruned(htmlwrap.merge(w, w)))
    assert time.time() - began < 30


def test_deep_and_long_pages(spark):
    """No text is lost by the bounds of wrappers, and boilerplate below them isn't text."""
    deep = lambda i: "<body>" + "<div>" * 20_000 + f"<p>one {i}</p><nav>menu</nav><div><aside><p>aside</p></aside>two</div>" + "</div>" * 20_000 + f"end {i}"
    long = lambda i: "<body>" + "".join(f"<div class=q{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}><h2>{k}</h2></div><p>{i}.{k}</p>" for k in range(900))
    got = htmlwrap.extract(pages(spark, [(i, f"http://d.net/{i}", deep(i)) for i in range(4)] + [(10 + i, f"http://l.net/{i}", long(i)) for i in range(2)])).collect()
    text = {r.page_id: r.text for r in got}
    assert text[3] == "one 3\n\ntwo\n\nend 3"
    assert text[11] == "\n\n".join(f"{k}\n\n1.{k}" for k in range(900))


def test_wrappers_are_bounded(monkeypatch):
    monkeypatch.setattr(htmlwrap, "NODES", 60)
    whole = None
    for i in range(40):
        words = "".join(f"<div class={chr(97 + i % 26)}{chr(97 + k)}><p>{i}</p></div>" for k in range(9))
        w = htmlwrap.wrapper(htmlwrap.parse(f"<body><div class=top><p>Welcome</p></div>{words}</body>"))
        whole = htmlwrap.pruned(w if whole is None else htmlwrap.merge(whole, w))
    nodes = lambda w: 1 + sum(map(nodes, w[htmlwrap.INSIDE]))
    assert nodes(whole) <= 60 and htmlwrap.template_paths(whole) == ["#page>body>div.top", "#page>body>div.top>p"]


def test_wide_hosts_are_whole(spark):
    """Of a host with far more kinds of elements than a wrapper's bound, template is still what half its pages have."""
    name = lambda n: "q" + "".join(chr(97 + n // 26**k % 26) for k in range(4))

    def make(i):
        body = "".join(f"<div class={name(i * 1800 + k)}><p>{i}.{k}</p></div>" for k in range(1800))
        top = "<div class=top><p>Welcome</p></div>" if i else ""
        return f"<body>{top}{body}<div class=note>Same{'<p>Only</p>' if i == 4 else ''}</div><div class=end>End</div></body>"

    rows = [(i, f"http://w.net/{i}", make(i)) for i in range(8)] + [(20 + i, f"http://v.net/{i}", f"<body><div>Hi</div><div class=b><p>{i}</p></div></body>") for i in range(4)]
    got = {r.page_id: r.text for r in htmlwrap.extract(pages(spark, rows).coalesce(1)).collect()}
    for i in range(8):
        assert got[i].split("\n\n") == [f"{i}.{k}" for k in range(1800)] + ["Same"] + ["Only"] * (i == 4)
    assert [got[20 + i] for i in range(4)] == ["0", "1", "2", "3"]


def test_many_hosts_and_levels(spark, monkeypatch):
    monkeypatch.setattr(htmlwrap, "FAN", 2)
    rows = [(i, f"http://{'big' if i % 3 else i}.org/{i}", page(f"T{i}", f"p{i}")) for i in range(40)]
    got = htmlwrap.extract(pages(spark, rows).repartition(12)).collect()
    assert {r.page_id: r.text for r in got} == {i: f"T{i}\n\np{i}" for i in range(40)}


URLS = [
    (1, "http://www.Example.ORG/es/x?y#z"), (2, "https://example.org/en/12"), (3, "http://example.org/en/2"), (4, "http://org/a"), (5, "http://badorg/a"), (6, "http://x.com/fr/"), (7, "http://x.com/de/1"),
    (8, "http://x.com/DE/1"), (9, None), (10, "no scheme/es/"), (11, "http://example.org"), (12, "http://a.b.example.org/es/#/x"), (13, "://example.org/es/"), (14, "http://ÉXAMPLE.org/a/"), (None, "http://q.com/de/"), (1, "http://x.net/"),
]


def test_rules_equal_sql(spark):
    table = spark.createDataFrame([(*r, "h") for r in URLS], "page_id long, url string, host string")
    connection = duckdb.connect()
    connection.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    connection.executemany("INSERT INTO pages VALUES (?, ?)", URLS)
    want = sorted(map(str, connection.execute(queries.ORACLES["op10_url_rules"]).fetchall()))
    assert sorted(str(tuple(r)) for r in urlfilter.filtered(table, queries.URL_RULES).collect()) == want
    rules = spark.createDataFrame(queries.URL_RULES, "verdict string, host string, path string")
    assert sorted(str(tuple(r)) for r in urlfilter.filtered(table, rules).collect()) == want
    by_key = urlfilter._joined(table.select("page_id", "url"), rules, "allow")
    assert sorted(str(tuple(r)) for r in by_key.collect()) == want
    assert {r.verdict for r in urlfilter.filtered(table, []).collect()} == {"allow"}
    assert urlfilter.filtered(table.limit(0), queries.URL_RULES).count() == 0


def test_equal_digests_are_confirmed(monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda s: 7)
    array = urlfilter.DigestArray(["a", "b", "c"])
    assert array.find(["c", "x", "a"]).tolist() == [array.strings.index("c"), -1, array.strings.index("a")]


def test_ties_of_rules(spark):
    """Of rules of one length the longer host wins, in memory and by key."""
    rules = [("allow", "b.com", "/xy/"), ("block", "a.b.com", "/x"), ("allow", "c.com", "/a"), ("block", "com", "/a/b"), ("block", "c.com", "/a"), ("allow", "com", "/a/bc")]
    urls = ["http://a.b.com/xy/z", "http://c.com/a/b", "http://x.c.com/a/bcd", "http://b.com/xy/", "http://a.b.com/xy/z", None, ""]
    table = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    own = sorted(str(tuple(r)) for r in urlfilter.filtered(table, rules).collect())
    by_key = urlfilter._joined(table, spark.createDataFrame(rules, "verdict string, host string, path string"), "allow")
    assert sorted(str(tuple(r)) for r in by_key.collect()) == own
    assert "(0, 'a.b.com', '/xy/z', 'a.b.com/x', 'block')" in own and "(1, 'c.com', '/a/b', 'c.com/a', 'block')" in own and "(2, 'x.c.com', '/a/bcd', 'com/a/bc', 'allow')" in own


def test_both_verdicts_block():
    assert urlfilter.Rules([("block", "A.com", "/"), ("allow", "a.com", "/")]).judge([("a.com", "/x")]) == [("a.com/", "block")]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    connection = duckdb.connect()
    for t in ("pages", "embeddings"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = connection.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, result.fetchall()))
