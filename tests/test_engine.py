"""URLs, robots rules, fetching, the facade, streams and the registered queries."""

import asyncio
import contextlib
import threading
import time
import warnings
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarryweb import AsyncWebExtractor, Request, WebExtractor, batch_extract, branches, extract
from quarryweb.branches import SENTENCES
from quarryweb.functions.urls import parse
from quarryweb.operators.language import detect
from quarryweb.operators.profiles import ALONE, LATIN, SAMPLES, SHARED
from quarryweb.queries import ORACLE_SQL, QUERIES
from quarryweb.sources import Client, allowed, fetch_pages, spread
from quarryweb.sources.robots import RulesStore, fetch_rules, fresh
from quarryweb.streaming import extract_stream, page_stream

EVERY_SQL = ORACLE_SQL | branches.ORACLE_SQL
PAGE = "<title>T</title><article>" + "The quick brown fox is in the house of the man. " * 3 + "</article>"


@pytest.mark.parametrize(
    ("href", "url"),
    [
        ("../c", "https://example.com/c"), ("", "https://example.com/a/b?q=1"), ("?x=ü y", "https://example.com/a/b?x=%C3%BC%20y"), ("#é", "https://example.com/a/b?q=1#%C3%A9"), ("//h:443/p", "https://h/p"), ("\\\\h\\p", "https://h/p"),
        ("/a b/%2e%2E/c", "https://example.com/c"), (" \thttp://EX ample.com", None), ("HTTP:\\\\User:p@EXAMPLE.com:80", "http://User:p@example.com/"), ("https:rel", "https://example.com/a/rel"), ("mailto:a@b", "mailto:a@b"), ("javascript:x y", "javascript:x y"),
        ("http://0x7f.1/", "http://127.0.0.1/"), ("http://[1:0:0:0:0:0:0:1]/", "http://[1::1]/"), ("http://1.2.3.256", None), ("http://:80/", None), ("http://h:99999/", None), ("http://a_b.example.com/", "http://a_b.example.com/"), ("http://münchen.de", "http://xn--mnchen-3ya.de/"),
        ("file:///C:/x/../y", "file:///C:/y"), ("x:/a/./b", "x:/a/b"), ("./", "https://example.com/a/"), ("..", "https://example.com/"), ("../../..", "https://example.com/"),
    ],
)
def test_urls(href, url):
    base = parse("https://example.com/a/b?q=1")
    if url is None:
        with pytest.raises(ValueError):
            parse(href, base)
    else:
        assert str(parse(href, base)) == url


def test_robots_rules():
    rules = "User-agent: *\nDisallow: /private/\nAllow: /private/open\nDisallow: /*.pdf$\n\nuser-agent: BadBot\nuser-agent: Worse\nDisallow: /\n"
    assert not allowed(rules, "/private/x", "Any") and allowed(rules, "/private/open/x", "Any") and allowed(rules, "/page", "Any")
    assert not allowed(rules, "/a/b.pdf", "Any") and allowed(rules, "/a/b.pdfx", "Any")
    assert not allowed(rules, "/page", "badbot/2.0") and not allowed(rules, "/page", "worse") and allowed("", "/x", "a") and allowed(None, "/x", "a")
    assert allowed("User-agent: *\nDisallow: /p\nAllow: /p", "/p", "a") and allowed("User-agent: *\nDisallow:", "/p", "a")
    assert allowed("Disallow: /\nnonsense", "/x", "a") and allowed("User-agent: *\nDisallow: /p?x=1", "/p", "a")


def test_rules_table(spark):
    pages = spark.createDataFrame([("https://a.example:8443/x",), ("https://a.example/y",), ("https://b.example/",), ("bad",)], "url string")
    known = spark.createDataFrame([("b.example", "")], "host string, robots_txt string")
    got = fetch_rules(pages, Client(fetcher=lambda u, c: f"# {u}"), known).collect()
    assert [(r.host, r.robots_txt) for r in got] == [("a.example", "# https://a.example/robots.txt")]
    old = spark.sql("select 'a' host, '' robots_txt, timestamp'2024-01-01 00:00:00' fetched_at")
    assert fresh(old, 60, "2024-01-01 00:00:59").count() == 1 and fresh(old, 60, "2024-01-01 00:01:01").count() == 0


def test_rules_table_asks_and_tells_a_store(spark, tmp_path):
    class Files:
        """A key-value store in a folder, which tasks share as they would a server."""

        def __init__(self, folder):
            self.folder = Path(folder)

        def get(self, key):
            at = self.folder / key.replace(":", "_")
            return at.read_text() if at.exists() else None

        def setex(self, key, ttl, value):
            (self.folder / key.replace(":", "_")).write_text(value)

    folder = str(tmp_path)
    Files(folder).setex("robots:a.example", 1, "# stored")
    pages = spark.createDataFrame([("https://a.example/x",), ("https://b.example/",), ("https://c.example/",)], "url string")

    def answer(url, client):
        if "c.example" in url:
            raise ConnectionError("no")
        return f"# {url}"

    got = {r.host: r.robots_txt for r in fetch_rules(pages, Client(fetcher=answer), store=lambda: RulesStore(Files(folder), 60)).collect()}
    assert got == {"a.example": "# stored", "b.example": "# https://b.example/robots.txt", "c.example": ""}
    assert Files(folder).get("robots:b.example") == got["b.example"] and Files(folder).get("robots:a.example") == "# stored"


def test_fetch_keeps_errors_and_given_pages(spark):
    def fetcher(url, client):
        if "bad" in url:
            raise TimeoutError("slow")
        return f"<p>{client.headers.get('X')}".encode()

    df = spark.createDataFrame([("https://e/1", None), ("https://e/bad", None), ("nope", None), ("https://e/given", ""), (None, None)], "url string, html string")
    rows = {r.url: r for r in fetch_pages(df, Client(fetcher=fetcher).with_headers({"X": "v"}, keep=True)).collect()}
    assert rows["https://e/1"].html == "<p>v" and rows["https://e/given"].html == "" and rows["https://e/bad"].error.message == "Timeout: slow"
    assert rows["nope"].error.kind == rows[None].error.kind == "InvalidUrl"
    with pytest.raises(RuntimeError, match="HTTP error"):
        Client().with_headers({"bad name": "x"}, keep=True)


def test_facade(spark):
    x = WebExtractor("https://example.com/a", PAGE)
    with pytest.raises(RuntimeError, match="No activities"):
        x.run()
    x.extract_text(language_detection=True)
    x.extract_links(internal=True)
    x.extract_article(["title"])
    with pytest.warns(UserWarning):
        x.extract_video()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        x.extract_socials(["all"])
        x.extract_product(fields=[])
    r = x.run()
    assert r.language == "eng" and 0 <= r.language_confidence <= 1 and r.article == {"title": "T"} and r.videos == {} and r.product is None
    d = r.to_dict()
    assert d["url"] == r.url and d["text"]["text_length"] == len(r.text.encode()) and d["links"]["summary"]["total"] == 0 and "product" not in d
    assert r.result == d and r.grouped_links == r.links and r.content["text_length"] == d["text"]["text_length"] and "example.com" in repr(r)

    y = WebExtractor("https://example.com/", "")
    y.extract_article(fields=[])
    r = y.run()
    assert r.article is None and r.to_dict() == {"url": "https://example.com/", "text": {"text_length": 0}} and r.content == {"text_length": 0}

    z = AsyncWebExtractor("https://example.com/", PAGE)
    z.extract_text()
    assert asyncio.run(z.run()).text.startswith("The quick")


def test_facade_robots():
    x = WebExtractor("https://example.com/private/x?y=1", PAGE)
    x.extract_text()
    assert x.check_robots_allowed()
    for call in (lambda: x.set_robots_txt(""), lambda: x.set_robots_redis_ttl(5), x.remove_robots_from_redis):
        with pytest.raises(RuntimeError, match="Robots checker not enabled"):
            call()
    with x as same:
        same.enable_robots_check()
        same.set_robots_txt("User-agent: *\nDisallow: /private/")
        assert not same.check_robots_allowed()
        with pytest.raises(RuntimeError, match=r"Error: URL https://example.com/private/x\?y=1 is disallowed by robots.txt"):
            same.run()
    assert x._rules == {}
    x.configure_client(lambda url, client: "User-agent: *\nAllow: /")
    assert x.check_robots_allowed() and x._rules["example.com"][0] == "User-agent: *\nAllow: /"

    class Store(dict):
        def setex(self, key, ttl, value):
            self[key] = value

        def delete(self, key):
            self.pop(key, None)

    x._store = RulesStore(Store())
    x.set_robots_txt("User-agent: *\nDisallow: /")
    x.clear_robots_cache()
    assert not x.check_robots_allowed() and x._store.get("example.com")
    x.remove_robots_from_redis()
    assert x._store.get("example.com") is None


def test_client_settings():
    x = WebExtractor("https://e/", "")
    x.set_timeout(0.5)
    x.set_random_user_agent()
    assert x._client.timeout == 0 and x._client.random_agent
    x.set_user_agent("me")
    x.add_header("A", "1")
    x.set_headers({"B": "2"})
    assert x._client.chosen_agent() == "me" and not x._client.random_agent and x._client.headers == {"B": "2"}


def test_batch(spark):
    client = Client(fetcher=lambda u, c: (_ for _ in ()).throw(ConnectionError("no")) if u.endswith("2") else f"<title>{u[-1]}</title>")
    urls = [f"https://e/{i}" for i in (3, 2, 1)]
    got = asyncio.run(batch_extract(urls, extract_text=True, client=client))
    assert [r.url for r in got] == ["https://e/3", "https://e/1"] and [r.article["title"] for r in got] == ["3", "1"] and got[0].links is None and got[0].socials == {}
    assert asyncio.run(batch_extract(urls, client=client, keep_errors=True))[1] == "HTTP error: no"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    request = Request(text=True, links=("all",), article=("title",))
    q = extract_stream(page_stream(spark, str(tmp_path / "in")), request, str(tmp_path / "out"), str(tmp_path / "cp"), keep=["page_id"])
    q.awaitTermination(120)
    flat = lambda df: sorted(tuple(map(str, r)) for r in df.select("page_id", "text", "article", "links").collect())
    assert flat(spark.read.parquet(str(tmp_path / "out"))) == flat(extract(pages, request, keep=["page_id"]))


def test_language(spark):
    assert detect("Это русский текст")[0] == "rus" and detect("日本語のテキスト")[0] == "jpn" and detect("12 34")[0] is None and detect(None) == (None, None)
    # Sentences that the model has not seen, and those that its letters are from: wrong ones are named here.
    wrong = {code for sentences in (SENTENCES, SAMPLES) for code, text in sentences.items() if detect(text)[0] != code}
    assert wrong == set()
    # Danish and Bokmål, Bulgarian and Russian sentences that are told wrong.
    assert detect("De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd.")[0] in ("dan", "nob")
    languages = {*LATIN, *ALONE, *(c for g in SHARED.values() for c in g)}
    assert len(languages) >= 69
    codes = {"en": "eng", "de": "deu", "fr": "fra", "es": "spa"}
    rows = QUERIES["document_language"](spark, "/root/testdata/sf0.01").collect()
    for lang, code in codes.items():
        assert sum(r.n for r in rows if (r.lang, r.language) == (lang, code)) / sum(r.n for r in rows if r.lang == lang) > 0.95  # a few documents are of one word, or of none
    assert sum(r.n for r in rows if codes[r.lang] == r.language) / sum(r.n for r in rows) > 0.99


class Served(BaseHTTPRequestHandler):
    """A small site: pages, a redirect, an error page, a slow one."""

    protocol_version = "HTTP/1.1"
    connections: set = set()

    def do_GET(self):
        Served.connections.add(self.client_address)
        if self.path == "/slow":
            time.sleep(3)
        code, body = (404, b"<title>none</title>") if self.path == "/missing" else (200, f"<title>{self.path} {self.headers['User-Agent']} {self.headers['X-A']} \u00e9</title>".encode("latin-1"))
        self.send_response(302 if self.path == "/moved" else code)
        if self.path == "/moved":
            self.send_header("Location", "/to?x=1")
        self.send_header("Content-Type", "text/html; charset=latin-1")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        with contextlib.suppress(OSError):
            self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_http_over_kept_connections(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Served)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    site = f"http://127.0.0.1:{server.server_address[1]}"
    client = Client(timeout=1, agent="T/1", headers={"X-A": "v"})
    pages = spark.createDataFrame([(f"{site}{p}",) for p in ("/moved", "/missing", "/slow", *(f"/p{i}" for i in range(40)))] + [("http://127.0.0.1:1/",), ("ftp://127.0.0.1/x",)], "url string").coalesce(1)
    got = fetch_pages(pages, client)
    assert got.rdd.getNumPartitions() == 1
    rows = {r.url.removeprefix(site): r for r in got.collect()}
    assert rows["/moved"].html == "<title>/to?x=1 T/1 v é</title>" and rows["/missing"].html == "<title>none</title>" and rows["/p7"].html == "<title>/p7 T/1 v é</title>"
    assert rows["/slow"].error.kind == "Timeout" and rows["http://127.0.0.1:1/"].error.kind == "HttpError" and rows["ftp://127.0.0.1/x"].error.kind == "HttpError"
    assert len(Served.connections) <= 12
    server.shutdown()


def test_robots_escapes_and_memory_ttl(monkeypatch):
    rules = "User-agent: *\nDisallow: /a%3cd\nDisallow: /\u00e9\nDisallow: /x%2Fy\nDisallow: /%7Euser\nDisallow: /s%2a"
    for path in ("/a<d", "/a%3Cd", "/%C3%A9", "/\u00e9t", "/x%2fy", "/~user", "/s*", "/s%2A"):
        assert not allowed(rules, path, "a"), path
    assert allowed(rules, "/x/y", "a") and allowed(rules, "/sz", "a")
    x = WebExtractor("https://e/p", "")
    asked = []
    x.configure_client(lambda url, client: asked.append(url) or "")
    x.enable_robots_check()
    now = [0.0]
    monkeypatch.setattr("quarryweb.api.time.monotonic", lambda: now[0])
    for at, n in ((0, 1), (1799, 1), (1801, 2)):
        now[0] = at
        assert x.check_robots_allowed() and len(asked) == n
    x.set_robots_redis_ttl(10)
    now[0] = 1801 + 1801
    assert x.check_robots_allowed() and len(asked) == 3
    now[0] += 11
    assert x.check_robots_allowed() and len(asked) == 4


@pytest.mark.parametrize("name", sorted(EVERY_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "pages", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(EVERY_SQL[name])
    names = [d[0] for d in want.description]
    rows = (QUERIES | branches.QUERIES)[name](spark, sf_dir).select(*names).collect()
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scan_reads_only_what_is_asked(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html")
    plan = extract(pages, Request(links=("all",)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    plan = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").where(F.col("page_id") < 5), Request(text=True))._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(page_id,5)" in plan
    assert spread(pages, 1) is pages and spread(pages, 64).rdd.getNumPartitions() == 64
