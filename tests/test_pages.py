"""Small pages whose results were worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quarryweb.html import parse
from quarryweb.html.index import main_text
from quarryweb.plans import Request, extract
from quarryweb.plans.extract import page_index

BASE = "https://example.com/a/b"
ALL = ("all",)
EVERY = Request(text=True, language=True, links=ALL, socials=ALL, videos=ALL, product=ALL, article=ALL)

PAGES = {
    "T1": "<html><body><h1>Hello World</h1></body></html>",
    "T2": "<body><article>short</article><p>tail</p></body>",
    "T3": '<body class="loaded"><div class="shadow">x</div><p>y</p></body>',
    "T4": "<body><p>a<b>b</b>c</p></body>",
    "T5": "<body><p>ñ</p></body>",
    "T7": '<body><div role="banner">x</div><div id="MainMenu">z</div><p>k</p></body>',
    "T8": '<body><div role="main">' + "m" * 60 + "</div><p>out</p></body>",
    "L1": '<a href="../c">t</a><a href="mailto:x@y.z">m</a><a href="https://www.example.com/">w</a>',
    "L5": '<a href="/x"><img></a>',
    "L6": '<a href="#f">t</a>',
    "L7": '<a href="/x">t</a><a href="/x">t</a>',
    "L8": '<a href="https://example.com:8443/z">t</a>',
    "M1": '<meta property="og:title" content=""><title>T</title>',
    "M2": '<meta property="og:title"><meta property="og:title" content="B"><h1>H</h1>',
    "M4": '<meta property="twitter:card" content="x">',
    "M5": '<meta property="video:actor" content="A"><meta property="video:actor" content="B">',
    "P1": '<script type="application/ld+json">{"@type":"Product","name":"W","offers":{"price":"19.99","priceCurrency":"USD"}}</script>',
    "P2": '<script type="application/ld+json">{"offers":{"price":19.99}}</script><span class="price">$19.99</span>',
    "P3": '<script type="application/ld+json">{"offers":[{"price":"5"}]}</script>',
    "P4": '<script type="application/ld+json">{"@graph":[{"headline":"H"}]}</script>',
    "P5": '<script type="application/ld+json">{"brand":{"@type":"Brand","name":"X"}}</script>',
    "P6": '<script type="application/ld+json">{"keywords":["k1","k2"]}</script>',
    "P7": '<script type="application/ld+json">{"@type":"Organization","name":"Org"}</script><h1>P</h1>',
    "P8": '<script type="application/ld+json">{"name": "A \\"q\\" B", bad}</script>',
    "P9": '<div class="rating">4.5 stars</div>',
    "P10": '<b class="price">free</b><b class="price">Now 1,299.00 USD</b>',
    "P11a": '<b class="price">€25,50</b>',
    "P11b": '<b class="price">25,50 €</b>',
    "P11c": '<b class="price">$,</b>',
    "P11d": '<b class="price">free</b>',
    "P13": '<span class="old-price" content="">$9</span>',
    "D1": '<head><meta property="article:published_time" content="2024-01-15"><script type="application/ld+json">{"datePublished":"2024-01-15"}</script></head><body>2024-01-15</body>',
    "D2": '<meta property="article:published_time" content="2024-01-15"><body><script type="application/ld+json">{"datePublished":"2024-01-15"}</script></body>',
    "D3": "<body>2024-01-01 2024-01-02 2024-01-03</body>",
    "D4": '<head><meta property="article:published_time" content="2024-01-15"></head><body>2023-12-31</body>',
    "D5": '<head><script type="application/ld+json">{"datePublished":"2024-01-15T10:00Z"}</script></head>',
    "D6": '<time datetime="2024-02-01"></time>',
    "D7": "<body>1 January 2024 and 2024/01/02</body>",
    "empty": "",
}


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(k, BASE, v) for k, v in PAGES.items()], "name string, url string, html string").repartition(4)
    return {r.name: r for r in extract(df, EVERY, keep=["name"]).collect()}


def test_text(got):
    want = {"T1": "Hello World", "T2": "short tail", "T3": "y", "T4": "a b c", "T5": "ñ", "T7": "k", "T8": "m" * 60, "empty": ""}
    assert {k: got[k].text for k in want} == want
    assert got["T1"].content.text_length == 11 and got["T5"].content.text_length == 2 and got["empty"].content.text_length == 0


def test_links(got):
    x = got["L1"].links
    assert [y.url for y in x.internal] == ["https://example.com/c"] and [y.url for y in x.external] == ["mailto:x@y.z", "https://www.example.com/"]
    assert set(x.by_domain) == {"example.com", "www.example.com"} and tuple(x.summary) == (3, 1, 2, 2)
    assert got["L5"].links.summary.total == 0
    assert [y.url for y in got["L6"].links.internal] == ["https://example.com/a/b#f"]
    assert got["L7"].links.summary.internal_count == 2 and got["L8"].links.summary.internal_count == 1
    assert all(r.links.summary.internal_count + r.links.summary.external_count == r.links.summary.total for r in got.values())


def test_invalid_base_and_filters(spark):
    df = spark.createDataFrame([("not a url", '<a href="/x">t</a>')], "url string, html string")
    x = extract(df, Request(links=ALL)).first().links
    assert [y.url for y in x.external] == ["/x"] and x.by_domain == {} and tuple(x.summary) == (1, 0, 1, 0)
    df = spark.createDataFrame([(BASE, PAGES["L1"])], "url string, html string")
    assert tuple(extract(df, Request(links=("internal",))).first().links.summary) == (1, 1, 0, 1)
    x = extract(df, Request(links=("external",))).first().links
    assert tuple(x.summary) == (2, 0, 2, 1) and set(x.by_domain) == {"www.example.com"}
    assert tuple(extract(df, Request(links=("odd",))).first().links.summary) == (0, 0, 0, 0)


def test_meta(got):
    assert got["M1"].article["title"] == ""
    assert got["M2"].socials["og_title"] == "B" and got["M2"].product["product_title"] == "H"
    assert "twitter_card" not in got["M4"].socials and got["M5"].videos == {"video_actor": "A"}
    assert got["empty"].socials == {} and got["empty"].videos == {}


def test_product(got):
    p = {k: got[k].product for k in PAGES}
    assert (p["P1"]["product_title"], p["P1"]["product_price"], p["P1"]["product_currency"]) == ("W", "19.99", "USD")
    assert p["P2"]["product_price"] == "$19.99" and p["P3"]["product_price"] == "5" and p["P5"]["product_brand"] == "X"
    assert got["P4"].article["title"] == "H" and got["P6"].article["categories"] == "k1"
    assert p["P7"]["product_title"] == "Org" and p["P8"]["product_title"] == "A \\" and p["P9"]["product_rating"] == "4.5 stars"
    assert p["P10"]["product_price"] == "1,299.00 USD"
    assert [p[f"P11{c}"].get("product_price") for c in "abcd"] == ["€25,50", "25,50 €", "$,", None]
    assert p["P13"]["product_original_price"] == ""


def test_dates(got):
    d = {k: [(x["date"], x["confidence"]) for x in json.loads(v)] for k in PAGES if (v := got[k].article.get("publication_date"))}
    assert d["D1"] == d["D2"] == [("2024-01-15", 1.0)]
    assert [c for _, c in d["D3"]] == [0.0625] * 3 and d["D4"] == [("2024-01-15", 0.4347826086956522), ("2023-12-31", 0.08695652173913045)]
    assert d["D5"] == [("2024-01-15T10:00Z", 0.4347826086956522), ("2024-01-15", 0.4347826086956522)] and d["D6"] == [("2024-02-01", 0.5)]
    assert "D7" not in d and "empty" not in d
    for rows in d.values():
        assert all(0 < c <= 1 for _, c in rows) and [c for _, c in rows] == sorted((c for _, c in rows), reverse=True)


def test_requests(spark):
    df = spark.createDataFrame([(BASE, PAGES["P1"] + PAGES["D6"]), (BASE, None)], "url string, html string")
    rows = extract(df, Request(product=("title", "price", "odd", "title"), article=("pub_date", "published_date"))).collect()
    assert rows[0].product == {"product_title": "W", "product_price": "19.99"} and set(rows[0].article) == {"publication_date"}
    assert rows[0].text is None and rows[0].content.text_length == 0 and rows[0].socials is None and rows[1].product is None
    assert extract(df, Request(socials=("og:title",))).first().socials == {}
    assert Request(socials=("og:title",), article=("tag",)).unknown() == ["socials.og:title"]
    none = extract(df, Request())
    assert none.count() == 2 and none.first().article is None
    plan = none._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan
    one = extract(df, Request(text=True))._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("MapInArrow") == 1 and "json_ld" not in one


def test_index_is_null_for_missing_pages(spark):
    df = spark.createDataFrame([(BASE, None), (BASE, "")], "url string, html string")
    assert [r[0] for r in page_index(df, ["text"]).select(F.col("page_index").isNull()).collect()] == [True, False]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<p>b", "a b"), ("<noscript><p>x</p></noscript>y", "y"), ("a<!-- x --!>b", "ab"), ("a<!-->b", "ab"), ("<title>a<b></title>c", "c"), ("x &amp y &copy; &notit; &#65;", "x & y © ¬it; A"),
        ("<table><tr><td>1<td>2<tr><td>3</table>4", "1 2 3 4"), ("<ul><li>1<li>2</ul>", "1 2"), ("a</body>b", "ab"), ("<script>'</p>'</script>z", "z"), ("<script>open", ""), ("<textarea>a<b></textarea>", "a<b>"),
        ("x <3 y", "x <3 y"), ("a<br>b", "a b"), ("<" * 50, "<" * 50), ("<div>" * 4000 + "deep", "deep"), ("a<p x='", "a"),
    ],
)
def test_parser(html, text):
    assert main_text(parse(html)) == text


def test_attributes():
    e = next(x for x in parse('<a HREF="?a=1&copy=2&amp;b" href=no data-x=\'1\' y>t</a>').walk() if x.tag == "a")
    assert e.attrs == {"href": "?a=1&copy=2&b", "data-x": "1", "y": ""}
