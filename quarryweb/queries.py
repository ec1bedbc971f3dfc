"""The registered queries of the page-extraction engine and their DuckDB SQL.

Pages come from the table pages, or are written from rows of other tables, so
that SQL over those rows tells what must be found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryweb.operators.fields import ARTICLE, PRODUCT, SOCIALS, VIDEOS
from quarryweb.operators.language import language
from quarryweb.plans import Request, extract
from quarryweb.plans.extract import to_json
from quarryweb.sources import Client, fetch_pages, robots_gate, spread

ALL = ("all",)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _fields(extracted: DataFrame, kind: str, names, *keys: str) -> DataFrame:
    """One column for each field of a map; absent fields are null."""
    return extracted.select(*keys, *[F.try_element_at(kind, F.lit(n)).alias(n) for n in names])


def _s(column: str) -> Column:
    return F.col(column).cast("string")


def _write(df: DataFrame, key: str, url: Column, html: Column) -> DataFrame:
    """Pages from rows; the rows are dealt out before they grow."""
    return spread(df).select(key, url.alias("url"), html.alias("html"))


# Pages as they are.


def page_text(spark, sf_dir):
    """Title, main text and its length in bytes."""
    out = extract(_pages(spark, sf_dir), Request(text=True, article=("title",)), keep=["page_id"])
    return out.select("page_id", F.try_element_at("article", F.lit("title")).alias("title"), "text", F.col("content.text_length").alias("text_length"))


_PAGE_TEXT = r"trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<article>(.*?)(?:</article>|$)', 1, 's'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')
PAGE_TEXT_SQL = rf"""
WITH t AS (SELECT page_id, trim(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&quot;', '"'), '&amp;', '&')) AS title, {_PAGE_TEXT} AS text FROM pages)
SELECT page_id, title, text, octet_length(encode(text))::BIGINT AS text_length FROM t
"""


def page_links(spark, sf_dir):
    """Every link of every page, resolved: those within its site, then those that lead out of it."""
    out = extract(_pages(spark, sf_dir), Request(links=ALL), keep=["page_id"])
    def side(kind: str) -> Column:
        return F.transform(f"links.{kind}", lambda x, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("pos"), x["url"].alias("link_url"), x["text"].alias("link_text")))

    sides = [side("internal"), side("external")]
    return out.select("page_id", F.explode(F.concat(*sides)).alias("l")).select("page_id", "l.*")


_HREFS = r"""
SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS site, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS texts FROM pages
"""
PAGE_LINKS_SQL = f"""
WITH h AS ({_HREFS}), l AS (SELECT page_id, site, hrefs[i + 1] AS href, texts[i + 1] AS link_text, i FROM (SELECT page_id, site, hrefs, texts, unnest(range(0, len(hrefs))) AS i FROM h)),
k AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-z]+:') AND NOT starts_with(href || '/', site || '/') THEN 'external' ELSE 'internal' END AS kind FROM l)
SELECT page_id, kind, row_number() OVER (PARTITION BY page_id, kind ORDER BY i) - 1 AS pos, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href ELSE site || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') END AS link_url, link_text FROM k
"""


def link_summary(spark, sf_dir):
    out = extract(_pages(spark, sf_dir), Request(links=ALL), keep=["page_id"])
    return out.select("page_id", "links.summary.*")


LINK_SUMMARY_SQL = f"""
WITH h AS ({_HREFS})
SELECT page_id, len(hrefs)::BIGINT AS total, len(hrefs)::BIGINT AS internal_count, 0::BIGINT AS external_count, least(len(hrefs), 1)::BIGINT AS unique_domains FROM h
"""


def links_by_domain(spark, sf_dir):
    """Links of each host over all pages."""
    out = extract(_pages(spark, sf_dir), Request(links=ALL), keep=["page_id"])
    hosts = out.select("page_id", F.explode("links.by_domain").alias("domain", "links"))
    return hosts.groupBy("domain").agg(F.sum(F.size("links")).alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


LINKS_BY_DOMAIN_SQL = f"""
WITH h AS ({_HREFS})
SELECT regexp_extract(site, '//(.*)$', 1) AS domain, sum(len(hrefs))::BIGINT AS n_links, count(DISTINCT page_id)::BIGINT AS n_pages FROM h WHERE len(hrefs) > 0 GROUP BY 1
"""


# Links of many kinds, on a page for each customer.


def _customer_pages(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    host = F.concat(F.lit("shop"), _s("c_nationkey"), F.lit(".example.com"))
    html = F.concat(
        F.lit('<body><a href="../up/'), _s("c_custkey"), F.lit('">up</a><a href="#f">frag</a><a href="https://www.'), host, F.lit('/">www</a><a href="//other.example.org/x y">other</a><a href="mailto:a'),
        _s("c_custkey"), F.lit('@example.com">mail</a><a href="https://'), F.upper(host), F.lit(':8443/p?q=1">port</a><a href="/none"></a><a href="/twice">t</a><a href="/twice">t</a></body>'),
    )
    return _write(c, "c_custkey", F.concat(F.lit("https://"), host, F.lit("/a/b")), html)


def links_all(spark, sf_dir):
    out = extract(_customer_pages(spark, sf_dir), Request(links=ALL), keep=["c_custkey"])
    urls = lambda k: F.array_join(F.transform(f"links.{k}", lambda x: x["url"]), " ")
    return out.select("c_custkey", urls("internal").alias("internal"), urls("external").alias("external"), F.array_join(F.array_sort(F.map_keys("links.by_domain")), " ").alias("domains"), "links.summary.*")


_SITE = "'https://shop' || c_nationkey || '.example.com'"
_INTERNAL = f"{_SITE} || '/up/' || c_custkey || ' ' || {_SITE} || '/a/b#f ' || {_SITE} || ':8443/p?q=1 ' || {_SITE} || '/twice ' || {_SITE} || '/twice'"
_EXTERNAL = "'https://www.shop' || c_nationkey || '.example.com/ https://other.example.org/x%20y mailto:a' || c_custkey || '@example.com'"
LINKS_ALL_SQL = f"""
SELECT c_custkey, {_INTERNAL} AS internal, {_EXTERNAL} AS external, 'other.example.org shop' || c_nationkey || '.example.com www.shop' || c_nationkey || '.example.com' AS domains,
       8::BIGINT AS total, 5::BIGINT AS internal_count, 3::BIGINT AS external_count, 3::BIGINT AS unique_domains FROM customer
"""


def _filtered(option):
    def query(spark, sf_dir):
        out = extract(_customer_pages(spark, sf_dir), Request(links=(option,)), keep=["c_custkey"])
        return out.select("c_custkey", F.array_join(F.transform(f"links.{option}", lambda x: x["url"]), " ").alias("urls"), F.array_join(F.array_sort(F.map_keys("links.by_domain")), " ").alias("domains"), "links.summary.*")

    return query


LINKS_INTERNAL_SQL = f"SELECT c_custkey, {_INTERNAL} AS urls, 'shop' || c_nationkey || '.example.com' AS domains, 5::BIGINT AS total, 5::BIGINT AS internal_count, 0::BIGINT AS external_count, 1::BIGINT AS unique_domains FROM customer"
LINKS_EXTERNAL_SQL = f"SELECT c_custkey, {_EXTERNAL} AS urls, 'other.example.org www.shop' || c_nationkey || '.example.com' AS domains, 3::BIGINT AS total, 0::BIGINT AS internal_count, 3::BIGINT AS external_count, 2::BIGINT AS unique_domains FROM customer"


# Meta tags, on a page for each part or supplier.


def _meta(key: str, name: str, value: Column) -> Column:
    return F.concat(F.lit(f'<meta {key}="{name}" content="'), value, F.lit('">'))


#: Field -> tag of the social cards, as the pages are written.
_SOCIAL_TAGS = {n: ("name", n.replace("_", ":", 1)) if n.startswith("twitter") else ("property", "og:" + {"image_width": "image:width", "image_height": "image:height", "image_alt": "image:alt"}.get(n[3:], n[3:])) for n in SOCIALS}


def socials(spark, sf_dir):
    """Every social field; the tag is missing, empty or repeated for some rows, and the wrong attribute is used for others."""
    parts = []
    for i, (name, (key, tag)) in enumerate(_SOCIAL_TAGS.items()):
        value, k = F.concat(F.lit(f"{name} "), _s("p_name"), F.lit(" "), _s("p_partkey")), F.col("p_partkey") % (i + 3)
        wrong = "name" if key == "property" else "property"
        parts.append(F.when(k == 0, F.lit("")).when(k == 1, _meta(wrong, tag, value)).when(k == 2, F.concat(F.lit(f'<meta {key}="{tag}">'), _meta(key, tag, value), _meta(key, tag, F.lit("later")))).otherwise(_meta(key, tag, value)))
    pages = _write(_table(spark, sf_dir, "part"), "p_partkey", F.lit("https://example.com/"), F.concat(F.lit("<head>"), *parts, F.lit("</head>")))
    return _fields(extract(pages, Request(socials=ALL), keep=["p_partkey"]), "socials", SOCIALS, "p_partkey")


SOCIALS_SQL = "SELECT p_partkey, " + ", ".join(f"CASE WHEN p_partkey % {i + 3} IN (0, 1) THEN NULL ELSE '{n} ' || p_name || ' ' || p_partkey END AS {n}" for i, n in enumerate(_SOCIAL_TAGS)) + " FROM part"


def videos(spark, sf_dir):
    """Every video and book field: the first tag counts, even without content."""
    parts = []
    for i, name in enumerate(VIDEOS):
        tag, value, k = name.replace("_", ":", 1), F.concat(_s("c_name"), F.lit(f" {name}")), F.col("c_custkey") % (i + 4)
        parts.append(F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit(f'<meta property="{tag}">'), _meta("property", tag, value))).when(k == 2, _meta("property", tag, F.lit(""))).otherwise(F.concat(_meta("property", tag, value), _meta("property", tag, F.lit("second")))))
    pages = _write(_table(spark, sf_dir, "customer"), "c_custkey", F.lit("https://example.com/"), F.concat(*parts))
    return _fields(extract(pages, Request(videos=ALL), keep=["c_custkey"]), "videos", VIDEOS, "c_custkey")


VIDEOS_SQL = "SELECT c_custkey, " + ", ".join(f"CASE c_custkey % {i + 4} WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN '' ELSE c_name || ' {n}' END AS {n}" for i, n in enumerate(VIDEOS)) + " FROM customer"


# Products, on a page for each part: meta tags, JSON-LD, microdata or classes, by turns.

_PRODUCT_META = {"product_title": "product:title", "product_description": "product:description", "product_brand": "product:brand", "product_category": "product:category", "product_sku": "product:sku", "product_mpn": "product:mpn", "product_image": "product:image", "product_price": "product:price:amount", "product_currency": "product:price:currency", "product_availability": "product:availability", "product_original_price": "product:original_price"}
_PRODUCT_ITEMS = {"product_title": "name", "product_description": "description", "product_brand": "brand", "product_category": "category", "product_sku": "sku", "product_mpn": "mpn", "product_image": "image", "product_price": "price", "product_currency": "priceCurrency", "product_availability": "availability", "product_rating": "ratingValue", "product_review_count": "reviewCount", "product_best_rating": "bestRating", "product_worst_rating": "worstRating"}


def _product_value(name: str) -> Column:
    price, size = F.concat(F.lit("$"), _s("p_size"), F.lit(".50")), _s("p_size")
    return {"product_title": _s("p_name"), "product_brand": _s("p_brand"), "product_category": _s("p_type"), "product_price": price, "product_rating": size, "product_review_count": size}.get(name, F.concat(F.lit(f"{name[8:]}-"), _s("p_partkey")))


_PRODUCT_SQL_VALUES = {"product_title": "p_name", "product_brand": "p_brand", "product_category": "p_type", "product_price": "'$' || p_size || '.50'", "product_rating": "p_size::VARCHAR", "product_review_count": "p_size::VARCHAR"}


def product(spark, sf_dir):
    v = _product_value
    meta = F.concat(*[_meta("property", tag, v(n)) for n, tag in _PRODUCT_META.items()])
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    pair = lambda k, c: F.concat(F.lit(f'"{k}": '), c)
    offers = F.concat(F.lit("{"), F.concat_ws(",", pair("price", q(v("product_price"))), pair("priceCurrency", q(v("product_currency"))), pair("highPrice", q(v("product_original_price"))), pair("availability", q(v("product_availability")))), F.lit("}"))
    rating = F.concat(F.lit("{"), F.concat_ws(",", pair("ratingValue", q(v("product_rating"))), pair("reviewCount", q(v("product_review_count"))), pair("bestRating", q(v("product_best_rating"))), pair("worstRating", q(v("product_worst_rating")))), F.lit("}"))
    flat = [pair(k, q(v(n))) for n, k in {"product_title": "name", "product_description": "description", "product_category": "category", "product_sku": "sku", "product_mpn": "mpn"}.items()]
    brand, image = pair("brand", F.concat(F.lit('{"@type": "Brand", "name": '), q(v("product_brand")), F.lit("}"))), pair("image", F.concat(F.lit("["), q(v("product_image")), F.lit(', "other"]')))
    script = F.concat(F.lit('<script type="application/ld+json">[{"@type": "Product", '), F.concat_ws(",", *flat, brand, image, pair("offers", offers), pair("aggregateRating", rating)), F.lit("}]</script>"))
    micro = F.concat(*[F.concat(F.lit(f'<span itemprop="{k}">  '), v(n), F.lit(" </span>")) for n, k in _PRODUCT_ITEMS.items()])
    shown = F.concat(F.lit("<h1>"), v("product_title"), F.lit('</h1><b class="price">free</b><b class="big price">Now '), v("product_price"), F.lit(' only</b><i class="old-price">EUR 7 or 9 USD</i><div class="rating">'), v("product_rating"), F.lit(' stars</div><p class="review-count">'), v("product_review_count"), F.lit("</p>"))
    k = F.col("p_partkey") % 4
    pages = _write(_table(spark, sf_dir, "part"), "p_partkey", F.lit("https://example.com/p"), F.when(k == 0, meta).when(k == 1, script).when(k == 2, micro).otherwise(shown))
    return _fields(extract(pages, Request(product=ALL), keep=["p_partkey"]), "product", PRODUCT, "p_partkey")


def _product_sql() -> str:
    out = []
    for n in PRODUCT:
        value = _PRODUCT_SQL_VALUES.get(n, f"'{n[8:]}-' || p_partkey")
        cases = [value if n in _PRODUCT_META else "NULL", value, value if n in _PRODUCT_ITEMS else "NULL"]
        last = {"product_title": value, "product_price": value, "product_original_price": "'9 USD'", "product_rating": f"{value} || ' stars'", "product_review_count": value}.get(n, "NULL")
        out.append(f"CASE p_partkey % 4 WHEN 0 THEN {cases[0]} WHEN 1 THEN {cases[1]} WHEN 2 THEN {cases[2]} ELSE {last} END AS {n}")
    return "SELECT p_partkey, " + ", ".join(out) + " FROM part"


# Articles and their dates, on a page for each order.


def article(spark, sf_dir):
    """Every article field but the dates; bits of the order's key say which sources a page has."""
    bit = lambda i: F.col("o_orderkey").bitwiseAND(1 << i) > 0
    key, day = _s("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    put = lambda i, c: F.when(bit(i), c).otherwise(F.lit(""))
    html = F.concat(
        put(0, _meta("property", "og:title", F.concat(F.lit("og "), key))), put(1, _meta("name", "twitter:title", F.concat(F.lit("tw "), key))),
        put(2, F.concat(F.lit('<script type="application/ld+json">{"headline": "ld '), key, F.lit('", "author": {"name": "ld author"}, "keywords": ["k1", "k2"], bad}</script>'))),
        F.lit("<title> page "), key, F.lit("\n</title>"),
        put(1, _meta("property", "article:author", _s("o_custkey"))), put(3, _meta("name", "author", F.lit("named"))), put(4, F.lit('<a rel="author"> rel </a>')), put(2, _meta("name", "description", F.lit(""))),
        put(3, F.lit('<p itemprop="description">  item text </p>')), put(0, _meta("property", "article:modified_time", day)), put(4, _meta("property", "og:updated_time", F.lit("updated"))),
        put(3, _meta("property", "article:section", _s("o_orderpriority"))), put(4, _meta("property", "article:tag", _s("o_orderstatus"))), put(2, _meta("property", "article:published_time", day)), put(1, _meta("property", "article:expiration_time", F.lit("never"))), put(0, _meta("name", "keywords", F.lit("kw"))),
    )
    pages = _write(_table(spark, sf_dir, "orders"), "o_orderkey", F.lit("https://example.com/a"), html)
    names = [n for n in ARTICLE if n != "publication_date"]
    return _fields(extract(pages, Request(article=tuple(names)), keep=["o_orderkey"]), "article", names, "o_orderkey")


ARTICLE_SQL = """
WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey & 1 > 0 AS b0, o_orderkey & 2 > 0 AS b1, o_orderkey & 4 > 0 AS b2, o_orderkey & 8 > 0 AS b3, o_orderkey & 16 > 0 AS b4 FROM orders)
SELECT o_orderkey,
  CASE WHEN b0 THEN 'og ' || o_orderkey WHEN b1 THEN 'tw ' || o_orderkey WHEN b2 THEN 'ld ' || o_orderkey ELSE 'page ' || o_orderkey END AS title,
  CASE WHEN b1 THEN o_custkey::VARCHAR WHEN b3 THEN 'named' WHEN b4 THEN 'rel' END AS author,
  CASE WHEN b2 THEN '' WHEN b3 THEN 'item text' END AS description,
  CASE WHEN b0 THEN d WHEN b4 THEN 'updated' END AS modified_date,
  CASE WHEN b3 THEN o_orderpriority END AS article_section, CASE WHEN b4 THEN o_orderstatus END AS article_tag, CASE WHEN b1 THEN o_custkey::VARCHAR END AS article_author,
  CASE WHEN b2 THEN d END AS article_published_time, CASE WHEN b0 THEN d END AS article_modified_time, CASE WHEN b1 THEN 'never' END AS article_expiration_time,
  CASE WHEN b4 THEN o_orderstatus WHEN b3 THEN o_orderpriority WHEN b0 THEN 'kw' END AS categories
FROM o
"""


def publication_dates(spark, sf_dir):
    """Scored dates: in meta, JSON-LD and body, by bits of the order's key."""
    bit = lambda i: F.col("o_orderkey").bitwiseAND(1 << i) > 0
    put = lambda i, c: F.when(bit(i), c).otherwise(F.lit(""))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    html = F.concat(
        F.lit("<head>"), put(0, _meta("property", "article:published_time", day)), put(1, F.concat(F.lit('<script type="application/ld+json">{"datePublished": "'), day, F.lit('"}</script>'))), F.lit("</head><body><p>"),
        put(2, F.concat(day, F.lit(" "))), put(3, F.lit("on 01/02/2003 or ")), put(4, F.lit("March 4, 2005")), F.lit("</p>"), put(5, F.lit('<time datetime="noon">x</time>')), F.lit("</body>"),
    )
    pages = _write(_table(spark, sf_dir, "orders"), "o_orderkey", F.lit("https://example.com/a"), html)
    out = extract(pages, Request(article=("pub_date",)), keep=["o_orderkey"])
    rows = F.from_json(F.try_element_at("article", F.lit("publication_date")), "array<struct<date:string,confidence:double>>")
    return out.select("o_orderkey", F.explode(rows).alias("r")).select("o_orderkey", "r.date", F.round("r.confidence", 9).alias("confidence"))


PUBLICATION_DATES_SQL = """
WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey & 1 > 0 AS m, o_orderkey & 2 > 0 AS j, o_orderkey & 4 > 0 AS b, o_orderkey & 8 > 0 AS s, o_orderkey & 16 > 0 AS w, o_orderkey & 32 > 0 AS t FROM orders),
e AS (SELECT o_orderkey, d AS date, m, j, b FROM o WHERE m OR j OR b UNION ALL SELECT o_orderkey, '01/02/2003', false, false, true FROM o WHERE s
      UNION ALL SELECT o_orderkey, 'March 4, 2005', false, false, true FROM o WHERE w UNION ALL SELECT o_orderkey, 'noon', true, false, false FROM o WHERE t),
n AS (SELECT o_orderkey, count(*) AS n, count(*) FILTER (WHERE NOT m AND NOT j) AS only_body FROM e GROUP BY 1)
SELECT o_orderkey, date, round((CASE WHEN m AND j AND b THEN 1.0::DOUBLE WHEN m AND j THEN 0.8::DOUBLE WHEN m OR j THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END)
  * (CASE WHEN n = 1 THEN 1.0::DOUBLE WHEN NOT m AND NOT j AND only_body > 1 THEN 1.0::DOUBLE / (1.0::DOUBLE + (only_body - 1) * 0.3::DOUBLE) ELSE 1.0::DOUBLE / (1.0::DOUBLE + (n - 1) * 0.15::DOUBLE) END), 9) AS confidence
FROM e JOIN n USING (o_orderkey)
"""


# Robots rules, errors, other outputs.


def robots_allowed(spark, sf_dir):
    """Orders' pages against the rules of their nation's host."""
    n = _table(spark, sf_dir, "nation")
    rules = n.select(F.concat(F.lit("n"), _s("n_nationkey"), F.lit(".example.com")).alias("host"), F.concat(F.lit("User-agent: *\nDisallow: /"), _s("n_regionkey"), F.lit("/\nAllow: /"), _s("n_regionkey"), F.lit("/1\n\nUser-agent: Other\nDisallow: /")).alias("robots_txt")).where("n_nationkey < 20")
    o = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pages = o.select("o_orderkey", F.concat(F.lit("https://n"), _s("c_nationkey"), F.lit(".example.com:8443/"), (F.col("o_orderkey") % 5).cast("string"), F.lit("/"), _s("o_custkey"), F.lit("?x=/private")).alias("url"))
    return robots_gate(pages, rules, agent="Tester/1.0").select("o_orderkey", "allowed", F.col("error.message").alias("message"))


ROBOTS_SQL = """
WITH p AS (SELECT o_orderkey, 'https://n' || c_nationkey || '.example.com:8443/' || o_orderkey % 5 || '/' || o_custkey || '?x=/private' AS url,
  NOT (c_nationkey < 20 AND o_orderkey % 5 = n_regionkey AND NOT starts_with(o_custkey::VARCHAR, '1')) AS allowed FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT o_orderkey, allowed, CASE WHEN NOT allowed THEN 'Error: URL ' || url || ' is disallowed by robots.txt' END AS message FROM p
"""


def _served(url: str, client: Client) -> str:
    """Stands in for the network: some hosts do not answer."""
    n = int(url.rsplit("/", 1)[1])
    if n % 3 == 1:
        raise TimeoutError("no answer")
    if n % 3 == 2:
        raise ConnectionError("refused")
    return f"<title>page {n}</title>"


def fetched_batch(spark, sf_dir):
    """Pages that are fetched, given or fail, all kept as rows."""
    s = _table(spark, sf_dir, "customer")
    url = F.when(F.col("c_custkey") % 10 == 0, F.lit("not a url")).otherwise(F.concat(F.lit("https://example.com/"), _s("c_custkey")))
    pages = s.select("c_custkey", url.alias("url"), F.when(F.col("c_custkey") % 7 == 0, F.lit("")).alias("html"))
    out = extract(fetch_pages(pages, Client(fetcher=_served)), Request(article=("title",)), keep=["c_custkey"])
    return out.select("c_custkey", F.try_element_at("article", F.lit("title")).alias("title"), F.col("error.kind").alias("error_kind"), F.col("article").isNull().alias("no_article"))


FETCHED_SQL = """
WITH c AS (SELECT c_custkey, c_custkey % 7 = 0 AS given, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN 'InvalidUrl' WHEN c_custkey % 3 = 1 THEN 'Timeout' WHEN c_custkey % 3 = 2 THEN 'HttpError' END AS error_kind FROM customer)
SELECT c_custkey, CASE WHEN error_kind IS NULL AND NOT given THEN 'page ' || c_custkey END AS title, error_kind, error_kind IS NOT NULL AS no_article FROM c
"""


def text_json(spark, sf_dir):
    """Pages as JSON documents: text and its length, links and the title, of which absent ones leave no key."""
    out = to_json(extract(_pages(spark, sf_dir), Request(text=True, links=ALL, article=("title", "author"), socials=ALL)))
    at = lambda path: F.get_json_object("json", f"$.{path}")
    return out.select("url", at("url").alias("json_url"), at("text.content").alias("content"), at("text.text_length").cast("long").alias("text_length"), at("links.summary.total").cast("long").alias("total"), at("article").alias("article"), at("socials").alias("socials"), at("product").alias("product"))


TEXT_JSON_SQL = rf"""
WITH t AS (SELECT url, trim(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&quot;', '"'), '&amp;', '&')) AS title, {_PAGE_TEXT} AS text, len(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS n FROM pages)
SELECT url, url AS json_url, text AS content, octet_length(encode(text))::BIGINT AS text_length, n::BIGINT AS total, '{{"title":' || to_json(title)::VARCHAR || '}}' AS article, '{{}}' AS socials, NULL::VARCHAR AS product FROM t
"""


def page_language(spark, sf_dir):
    """Language of every page's main text."""
    out = extract(_pages(spark, sf_dir), Request(text=True, language=True), keep=["page_id"])
    return out.select("page_id", "language", "language_confidence")


def document_language(spark, sf_dir):
    """Documents by their language and the detected one."""
    docs = _table(spark, sf_dir, "documents").select("lang", "text")
    found = docs.withColumn("_l", language(F.col("text")))
    return found.groupBy("lang", F.col("_l.language").alias("language")).agg(F.count("*").alias("n"))


QUERIES = {
    "page_text": page_text,
    "page_links": page_links,
    "link_summary": link_summary,
    "links_by_domain": links_by_domain,
    "links_all": links_all,
    "links_internal": _filtered("internal"),
    "links_external": _filtered("external"),
    "socials": socials,
    "videos": videos,
    "product": product,
    "article": article,
    "publication_dates": publication_dates,
    "robots_allowed": robots_allowed,
    "fetched_batch": fetched_batch,
    "text_json": text_json,
    "page_language": page_language,
    "document_language": document_language,
}
ORACLE_SQL = {
    "page_text": PAGE_TEXT_SQL,
    "page_links": PAGE_LINKS_SQL,
    "link_summary": LINK_SUMMARY_SQL,
    "links_by_domain": LINKS_BY_DOMAIN_SQL,
    "links_all": LINKS_ALL_SQL,
    "links_internal": LINKS_INTERNAL_SQL,
    "links_external": LINKS_EXTERNAL_SQL,
    "socials": SOCIALS_SQL,
    "videos": VIDEOS_SQL,
    "product": _product_sql(),
    "article": ARTICLE_SQL,
    "publication_dates": PUBLICATION_DATES_SQL,
    "robots_allowed": ROBOTS_SQL,
    "fetched_batch": FETCHED_SQL,
    "text_json": TEXT_JSON_SQL,
}
