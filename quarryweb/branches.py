"""Registered queries over written pages for the branches that the given pages do not reach, and their DuckDB SQL."""

from __future__ import annotations

import asyncio
import json
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryweb.api import AsyncWebExtractor, WebExtractor, batch_extract
from quarryweb.html.index import CONTENT_CSS, ORIGINAL_PRICE_CSS, PRICE_CSS, RATING_CSS, REVIEW_COUNT_CSS, SKIPPED_CLASS_PARTS, SKIPPED_ID_PARTS, SKIPPED_ROLES, SKIPPED_TAGS
from quarryweb.operators.fields import ARTICLE_ALIASES, PRODUCT_ALIASES
from quarryweb.plans import Request, extract
from quarryweb.sources import Client, fetch_pages, robots_gate, spread
from quarryweb.sources.fetch import AGENTS
from quarryweb.sources.robots import fetch_rules, fresh


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(column: str) -> Column:
    return F.col(column).cast("string")


def _pick(by: Column, values: list[Column]) -> Column:
    """The value of the row's turn."""
    return F.get(F.array(*values), F.pmod(by, F.lit(len(values))).cast("int"))


def _sql_pick(by: str, values: list[str]) -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tagged(css: str, inner: Column) -> Column:
    """An element that the selector finds."""
    if css[0] == ".":
        attribute = f'class="first {css[1:]} last"'
    elif css[0] == "#":
        attribute = f'id="{css[1:]}"'
    elif css[0] == "[":
        name, _, value = css[1:-1].partition("=")
        attribute = f'{name}="{value.strip(chr(39)) or "7"}"'
    else:
        return F.concat(F.lit(f"<{css}>"), inner, F.lit(f"</{css}>"))
    return F.concat(F.lit(f"<div {attribute}>"), inner, F.lit("</div>"))


# Text: which element holds the main text, and what is left out of it.

_LONG = "words that are enough for the main text of a page, more than fifty bytes"


def content_choice(spark, sf_dir):
    """Each content selector by turns; on every third page its element is too short, so the body counts."""
    name, short = _s("c_name"), F.col("c_custkey") % 3 == 0
    inner = F.concat(F.lit("<b>"), name, F.lit("</b>"), F.when(short, F.lit("")).otherwise(F.lit(f" {_LONG}")))
    html = F.concat(F.lit("<body class='loaded'><p>before </p>"), _pick(F.col("c_custkey"), [_tagged(c, inner) for c in CONTENT_CSS]), F.lit("<p>after</p></body>"))
    pages = spread(_table(spark, sf_dir, "customer")).select("c_custkey", F.lit("https://example.com/").alias("url"), html.alias("html"))
    out = extract(pages, Request(text=True), keep=["c_custkey"])
    return out.select("c_custkey", "text", F.col("content.text_length").alias("text_length"))


CONTENT_CHOICE_SQL = f"""
WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'before ' || c_name || ' after' ELSE c_name || ' {_LONG}' END AS text FROM customer)
SELECT c_custkey, text, octet_length(encode(text))::BIGINT AS text_length FROM t
"""

_BOILERPLATE = [
    *[(f"<{t}>gone {t}</{t}>", "") for t in sorted(SKIPPED_TAGS)],
    *[(f'<div role="{r}">gone</div>', "") for r in sorted(SKIPPED_ROLES)],
    *[(f'<div id="My{p.title()}Box">gone <p>deep</p></div>', "") for p in sorted(SKIPPED_ID_PARTS)],
    *[(f'<div class="x {p.upper()}-y">gone</div>', "") for p in sorted(SKIPPED_CLASS_PARTS)],
    ('<div class="main-part" id="intro" role="note">kept </div>', "kept "),
    ("<p>a<i>b</i>\n  c</p>", "a b c "),
    ("", ""),
]


def boilerplate(spark, sf_dir):
    """A page for each part, with one element that is boilerplate by its tag, role, id or class, or is not."""
    key = F.col("p_partkey")
    html = F.concat(F.lit("<html><body><p>start</p>"), _pick(key, [F.lit(h) for h, _ in _BOILERPLATE]), F.lit("<p>"), _s("p_name"), F.lit(" ñ</p></body></html>"))
    pages = spread(_table(spark, sf_dir, "part")).select("p_partkey", F.lit("https://example.com/").alias("url"), html.alias("html"))
    out = extract(pages, Request(text=True), keep=["p_partkey"])
    return out.select("p_partkey", "text", F.col("content.text_length").alias("text_length"))


BOILERPLATE_SQL = f"""
WITH t AS (SELECT p_partkey, 'start ' || {_sql_pick("p_partkey", [_quoted(t) for _, t in _BOILERPLATE])} || p_name || ' ñ' AS text FROM part)
SELECT p_partkey, text, octet_length(encode(text))::BIGINT AS text_length FROM t
"""

#: Sentences of known languages; none of them is in what the model learned from.
SENTENCES = {
    "eng": "They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "deu": "Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "fra": "Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "spa": "Dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "ita": "Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "por": "Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "nld": "Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "swe": "De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap.",
    "fin": "Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "est": "Neile on antud mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim.",
    "lav": "Viņi ir apveltīti ar saprātu un sirdsapziņu, un viņiem jāizturas citam pret citu brālības garā.",
    "lit": "Jiems suteiktas protas ir sąžinė ir jie turi elgtis vienas kito atžvilgiu kaip broliai.",
    "pol": "Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "ces": "Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "slk": "Sú obdarení rozumom a svedomím a majú navzájom jednať v bratskom duchu.",
    "slv": "Obdarjeni so z razumom in vestjo in bi morali ravnati drug z drugim kakor bratje.",
    "hun": "Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "ron": "Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.",
    "tur": "Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "vie": "Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu.",
    "ind": "Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.",
    "cat": "Són dotats de raó i de consciència, i han de comportar-se fraternalment els uns amb els altres.",
    "rus": "Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "ukr": "Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства.",
    "srp": "Она су обдарена разумом и свешћу и треба једни према другима да поступају у духу братства.",
    "ara": "وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.",
    "pes": "همه دارای عقل و وجدان می باشند و باید نسبت به یکدیگر با روح برادری رفتار کنند.",
    "hin": "उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "jpn": "人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "cmn": "他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "kor": "인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "ell": "Είναι προικισμένοι με λογική και συνείδηση",
    "tha": "ต่างในตนมีเหตุผลและมโนธรรม",
}


def written_language(spark, sf_dir):
    """Pages in known languages, by turns; the last of each round has no text."""
    key = F.col("c_custkey")
    html = F.concat(F.lit("<body><p>"), _pick(key, [*map(F.lit, SENTENCES.values()), F.lit(" 12 ")]), F.lit("</p></body>"))
    pages = spread(_table(spark, sf_dir, "customer")).select("c_custkey", F.lit("https://example.com/").alias("url"), html.alias("html"))
    out = extract(pages, Request(text=True, language=True), keep=["c_custkey"])
    return out.select("c_custkey", "language", F.coalesce(F.col("language_confidence").between(0, 1), F.col("language").isNull()).alias("sure"))


WRITTEN_LANGUAGE_SQL = f"""
WITH t AS (SELECT c_custkey, {_sql_pick("c_custkey", [*map(_quoted, SENTENCES), "NULL"])} AS language FROM customer)
SELECT c_custkey, language, true AS sure FROM t
"""

# Products: each selector, each way to write a price, other names.

_SHOWN = [("€", "25,50", " €"), ("", "9", " USD"), ("£ ", "1,299.00", "")]


def product_selectors(spark, sf_dir):
    """Each selector of prices, ratings and counts by turns; an element that shows none stands before it, one with content after it counts only for its own field."""
    key = F.col("p_partkey")
    price = _pick(key, [F.concat(F.lit("only "), F.lit(a), F.lit(b), F.lit(c), F.lit(" today")) for a, b, c in _SHOWN])
    parts = [F.lit('<i class="price">free</i><i class="old-price">none</i>')]
    parts += [_pick(key, [_tagged(c, price) for c in group]) for group in (PRICE_CSS, ORIGINAL_PRICE_CSS)]
    parts += [_pick(key, [_tagged(c, F.concat(F.lit(" "), _s("p_size"), F.lit(" ") if c[0] == "[" and "itemprop" in c else F.lit(" in all"))) for c in group]) for group in (RATING_CSS, REVIEW_COUNT_CSS)]
    pages = spread(_table(spark, sf_dir, "part")).select("p_partkey", F.lit("https://example.com/").alias("url"), F.concat(*parts).alias("html"))
    names = ["product_price", "product_original_price", "product_rating", "product_review_count"]
    out = extract(pages, Request(product=tuple(names)), keep=["p_partkey"])
    return out.select("p_partkey", *[F.try_element_at("product", F.lit(n)).alias(n) for n in names])


def _shown_sql() -> str:
    # A price is shown by its sign before it, else its sign after it, else its code.
    found = ["€25,50", "9 USD", "£ 1,299.00"]
    price = _sql_pick("p_partkey", [_quoted(x) for x in found])
    item = _sql_pick("p_partkey", [_quoted(f"only {a}{b}{c} today") if c2 else "NULL" for (a, b, c), c2 in zip(_SHOWN, (1, 1, 1), strict=True)])
    by_item = f"CASE WHEN p_partkey % {len(PRICE_CSS)} = {PRICE_CSS.index(chr(91) + 'itemprop=' + chr(39) + 'price' + chr(39) + chr(93))} THEN {item} ELSE {price} END"
    ends = lambda group: _sql_pick("p_partkey", ["p_size::VARCHAR" if "itemprop" in c else "p_size || ' in all'" for c in group])
    return f"SELECT p_partkey, {by_item} AS product_price, {price} AS product_original_price, {ends(RATING_CSS)} AS product_rating, {ends(REVIEW_COUNT_CSS)} AS product_review_count FROM part"


PRODUCT_SELECTORS_SQL = _shown_sql()


def field_names(spark, sf_dir):
    """Fields by their other names, twice, and names that no catalogue has: the map has the full names, once."""
    meta = lambda k, n, v: F.concat(F.lit(f'<meta {k}="{n}" content="'), v, F.lit('">'))
    tags = {"product:title": "p_name", "product:brand": "p_brand", "product:category": "p_type", "product:sku": "p_partkey", "product:price:currency": "p_size", "product:availability": "p_brand", "article:section": "p_type", "article:tag": "p_name", "article:published_time": "p_partkey", "article:modified_time": "p_size", "article:expiration_time": "p_brand"}
    html = F.concat(*[meta("property", t, _s(c)) for t, c in tags.items()], F.lit('<meta name="description"><meta name="description" content="later"><meta property="twitter:card" content="wrong attribute">'))
    pages = spread(_table(spark, sf_dir, "part")).select("p_partkey", F.lit("https://example.com/").alias("url"), html.alias("html"))
    out = extract(pages, Request(product=(*PRODUCT_ALIASES, "title", "nonsense"), article=(*ARTICLE_ALIASES, "published_date"), socials=("og:title", "twitter_card"), videos=("duration",)), keep=["p_partkey"])
    text = lambda kind: F.array_join(F.array_sort(F.transform(F.map_entries(kind), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return out.select("p_partkey", text("product").alias("product"), text("article").alias("article"), F.size("socials").alias("n_socials"), F.size("videos").alias("n_videos"))


FIELD_NAMES_SQL = """
SELECT p_partkey,
  'product_availability=' || p_brand || ';product_brand=' || p_brand || ';product_category=' || p_type || ';product_currency=' || p_size || ';product_sku=' || p_partkey || ';product_title=' || p_name AS product,
  'article_expiration_time=' || p_brand || ';article_modified_time=' || p_size || ';article_published_time=' || p_partkey || ';article_section=' || p_type || ';article_tag=' || p_name || ';categories=' || p_name || ';publication_date=[{"date":"' || p_partkey || '","confidence":0.5}]' AS article,
  0 AS n_socials, 0 AS n_videos
FROM part
"""


def first_description(spark, sf_dir):
    """The first tag of a name counts for products, even without content; for articles the first that has one."""
    k = F.col("p_partkey") % 3
    html = F.concat(F.when(k == 0, F.lit('<meta name="description">')).when(k == 1, F.lit("")).otherwise(F.lit('<meta name="description" content="">')), F.lit('<meta name="description" content="'), _s("p_name"), F.lit('">'))
    pages = spread(_table(spark, sf_dir, "part")).select("p_partkey", F.lit("https://example.com/").alias("url"), html.alias("html"))
    out = extract(pages, Request(product=("description",), article=("description",)), keep=["p_partkey"])
    return out.select("p_partkey", F.try_element_at("product", F.lit("product_description")).alias("of_product"), F.try_element_at("article", F.lit("description")).alias("of_article"))


FIRST_DESCRIPTION_SQL = "SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN p_name WHEN 2 THEN '' END AS of_product, CASE p_partkey % 3 WHEN 2 THEN '' ELSE p_name END AS of_article FROM part"

# Dates: every tag, and their order.

_DATE_TAGS = ('property="article:published_time"', 'property="og:published_time"', 'name="pubdate"', 'name="date"', 'name="publication_date"')


def date_order(spark, sf_dir):
    """Where each date stands in the list: in all three sources, in meta (one of five tags), in JSON-LD, then in the body alone."""
    day, key = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    tag = _pick(key, [F.concat(F.lit(f"<meta {t} content='all "), F.lit("'>"), F.lit(f"<meta {t} content='never'>")) if t == "none" else F.concat(F.lit(f'<meta {t} content="'), day, F.lit(f'"><meta {t} content="never">')) for t in _DATE_TAGS])
    html = F.concat(F.lit("<head>"), tag, F.lit('<script type="application/ld+json">{"datePublished": "'), day, F.lit('", "x": "1999-12-31"}</script></head><body><p>Jan 2, 2003 and '), day, F.lit("</p></body>"))
    pages = spread(_table(spark, sf_dir, "orders")).select("o_orderkey", F.lit("https://example.com/").alias("url"), html.alias("html"))
    out = extract(pages, Request(article=("publication_date",)), keep=["o_orderkey"])
    rows = F.from_json(F.try_element_at("article", F.lit("publication_date")), "array<struct<date:string,confidence:double>>")
    return out.select("o_orderkey", F.posexplode(rows).alias("pos", "r")).select("o_orderkey", F.col("pos").cast("long").alias("pos"), "r.date", F.round("r.confidence", 9).alias("confidence"))


DATE_ORDER_SQL = """
WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
SELECT o_orderkey, 0::BIGINT AS pos, d AS date, round(1.0::DOUBLE / 1.3::DOUBLE, 9) AS confidence FROM o WHERE d <> '1999-12-31'
UNION ALL SELECT o_orderkey, 1::BIGINT, '1999-12-31', round(0.5::DOUBLE / 1.3::DOUBLE, 9) FROM o
UNION ALL SELECT o_orderkey, 2::BIGINT, 'Jan 2, 2003', round(0.1::DOUBLE / 1.3::DOUBLE, 9) FROM o
"""

# Nothing requested, errors, robots rules, the client and the facade.


def nothing_requested(spark, sf_dir):
    """Without any activity no page is fetched or parsed; an empty list of fields gives no map."""
    def fail(url: str, client: Client) -> str:
        raise AssertionError("fetched")

    pages = _table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("https://example.com/"), _s("n_nationkey")).alias("url"), F.lit(None).cast("string").alias("html"))
    request = Request(socials=())
    out = extract(fetch_pages(pages, Client(fetcher=fail)) if request.active() else pages, request, keep=["n_nationkey"])
    return out.select("n_nationkey", "url", F.col("text").isNull().alias("no_text"), F.col("content.text_length").alias("text_length"), F.col("socials").isNull().alias("no_socials"), F.col("links").isNull().alias("no_links"), F.col("error").isNull().alias("no_error"))


NOTHING_REQUESTED_SQL = "SELECT n_nationkey, 'https://example.com/' || n_nationkey AS url, true AS no_text, 0::BIGINT AS text_length, true AS no_socials, true AS no_links, true AS no_error FROM nation"


def _answers(url: str, client: Client) -> str:
    """Stands in for the network: each fifth host fails in another way."""
    n = int(url.rsplit("/", 1)[1]) % 5
    if n:
        raise {1: TimeoutError("slow"), 2: ConnectionError("refused"), 3: ValueError("bad"), 4: RuntimeError("odd")}[n]
    return f"<title>{url[-1]} {client.timeout} {client.agent} {client.headers}</title>"


def fetch_errors(spark, sf_dir):
    """The kind and the message of every failure; settings reach the fetcher."""
    pages = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("https://example.com/"), _s("c_custkey")).alias("url"))
    out = extract(fetch_pages(pages, Client(fetcher=_answers, timeout=7, agent="Tester/1.0", headers={"X-A": "b"})), Request(article=("title",)), keep=["c_custkey"])
    return out.select("c_custkey", F.try_element_at("article", F.lit("title")).alias("title"), F.col("error.kind").alias("kind"), F.col("error.message").alias("message"))


FETCH_ERRORS_SQL = """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN right(c_custkey::VARCHAR, 1) || ' 7 Tester/1.0 {''X-A'': ''b''}' END AS title,
  CASE c_custkey % 5 WHEN 1 THEN 'Timeout' WHEN 2 THEN 'HttpError' WHEN 3 THEN 'InvalidUrl' WHEN 4 THEN 'Other' END AS kind,
  CASE c_custkey % 5 WHEN 1 THEN 'Timeout: slow' WHEN 2 THEN 'HTTP error: refused' WHEN 3 THEN 'Invalid URL: bad' WHEN 4 THEN 'Error: odd' END AS message FROM customer
"""


def _robots_of(url: str, client: Client) -> str:
    """Stands in for robots.txt of host n{k}: some have none."""
    k = int(url.split("//n")[1].split(".")[0])
    if k % 4 == 3:
        raise ConnectionError("no answer")
    return f"User-agent: *\nDisallow: /a*/x\nDisallow: /{k}$\nDisallow: /q%3Cr\nAllow: /ab/x/{k}\n\nUser-agent: Tester\nUser-agent: other\nDisallow: /t\n" if k % 4 != 2 else "User-agent: nobody\nDisallow: /"


_ROBOTS_PATHS = ("/a1/x", "/ab/x/{k}", "/{k}", "/{k}/more", "/q<r", "/t", "/?a=/t")


def robots_fetched(spark, sf_dir):
    """Rules of hosts that no fresh row knows are fetched, by host and without port; known and fetched rules then gate each page."""
    n = _table(spark, sf_dir, "nation").select(_s("n_nationkey").alias("k"), "n_nationkey")
    pages = n.select("n_nationkey", F.posexplode(F.array(*[F.replace(F.lit(p), F.lit("{k}"), F.col("k")) for p in _ROBOTS_PATHS])).alias("pos", "path"), F.concat(F.lit("https://N"), F.col("k"), F.lit(".example.com:8443")).alias("site"))
    pages = pages.select("n_nationkey", "pos", F.concat("site", "path").alias("url"))
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    stored = n.select(F.concat(F.lit("n"), F.col("k"), F.lit(".example.com")).alias("host"), F.lit("User-agent: *\nDisallow: /").alias("robots_txt"), F.when(F.col("n_nationkey") % 5 == 0, now).otherwise(now - F.expr("interval 1 hour")).alias("fetched_at"))
    known = fresh(stored, now="2024-01-01 12:10:00")
    rules = known.unionByName(fetch_rules(pages, Client(fetcher=_robots_of), known))
    star, named = (robots_gate(pages, rules, agent=a).select("n_nationkey", "pos", F.col("allowed").alias(c)) for a, c in (("Someone/2.0", "for_others"), ("Mozilla tester 3", "for_tester")))
    return star.join(named, ["n_nationkey", "pos"]).select("n_nationkey", F.col("pos").cast("long").alias("pos"), "for_others", "for_tester")


ROBOTS_FETCHED_SQL = """
SELECT n_nationkey, pos,
  CASE WHEN n_nationkey % 5 = 0 THEN false WHEN n_nationkey % 4 > 1 THEN true ELSE pos NOT IN (0, 2, 4) END AS for_others,
  CASE WHEN n_nationkey % 5 = 0 THEN false WHEN n_nationkey % 4 > 1 THEN true ELSE pos <> 5 END AS for_tester
FROM nation, unnest(range(0, 7)) AS t(pos)
"""


class _Store:
    """A key-value store in memory, in place of a server."""

    def __init__(self):
        self.held: dict[str, str] = {}
        self.ttl = 0

    def get(self, key: str) -> str | None:
        return self.held.get(key)

    def setex(self, key: str, ttl: int, value: str) -> None:
        self.held[key], self.ttl = value, ttl

    def delete(self, key: str) -> None:
        self.held.pop(key, None)


def _facade_row(key: int, name: str) -> tuple:
    """What the one-page facade says about a region's page: its results, its warning, its errors, its robots rules."""
    from quarryweb.sources.robots import RulesStore

    html = f"<html><head><title>{name}</title><meta property='og:title' content='og {key}'></head><body><p>{name} text</p><a href='/in'>in</a><a href='https://other.org/'>out</a></body></html>"
    with WebExtractor(f"https://example.com/{key}", html) as x:
        try:
            x.run()
            error = None
        except RuntimeError as e:
            error = str(e).partition(":")[0]
        x.extract_text()
        x.extract_links(internal=True, external=key % 2 == 0)
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            x.extract_socials()
            x.extract_video([])
        x.extract_article(["title"])
        x.enable_robots_check()
        x.set_robots_redis_ttl(60)
        x.set_robots_txt(f"User-agent: *\nDisallow: /{key if key % 2 else 'none'}")
        allowed = x.check_robots_allowed()
        x.clear_robots_cache()
        x._store = RulesStore(_Store(), 60)
        x.set_robots_txt("")
        stored = x._store.get("example.com")
        x.remove_robots_from_redis()
        kept = x._store.get("example.com") is not None
        got = x.run()
    later = AsyncWebExtractor(f"https://example.com/{key}")
    later.set_timeout(0.5)
    later.set_user_agent("Agent/9")
    later.add_header("X-One", "1")
    later.set_headers({"X-Two": "2"})
    later.configure_client(lambda url, client: f"<title>{client.timeout} {client.chosen_agent()} {sorted(client.headers)} {url[-1]}</title>")
    later.extract_article(["title"])
    fetched = asyncio.run(later.run()).article["title"]
    other = WebExtractor(f"https://example.com/{key}")
    other.set_random_user_agent()
    other.configure_client(lambda url, client: f"<title>{client.chosen_agent()}</title>")
    other.extract_article(["title"])
    other.extract_product(["all"])
    any_agent = other.run().article["title"] in AGENTS
    out = got.to_dict()
    return (
        key, error, len([w for w in seen if w.category is UserWarning]), allowed, stored, kept, got.text, json.dumps(got.content), len(got.links["internal"]), len(got.links["external"]), got.grouped_links == got.links,
        json.dumps(got.socials), got.videos is None, got.article["title"], repr(got), ",".join(sorted(out)), out == got.result, got.language is None, fetched, any_agent,
    )


def facade(spark, sf_dir):
    """The one-page facade on the page of each region, of which there are five."""
    regions = sorted((r.r_regionkey, r.r_name) for r in _table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect())
    schema = "r_regionkey int, error string, n_warnings int, allowed boolean, stored string, kept boolean, text string, content string, n_internal int, n_external int, same_links boolean, socials string, no_videos boolean, title string, shown string, keys string, same_result boolean, no_language boolean, fetched string, any_agent boolean"
    return spark.createDataFrame([_facade_row(*r) for r in regions], schema)


FACADE_SQL = """
SELECT r_regionkey, 'No activities configured' AS error, 1 AS n_warnings, r_regionkey % 2 = 0 AS allowed, '' AS stored, false AS kept, r_name || ' text in out' AS text,
  '{"text": "' || r_name || ' text in out", "text_length": ' || length(r_name || ' text in out') || '}' AS content, 1 AS n_internal, CASE WHEN r_regionkey % 2 = 0 THEN 1 ELSE 0 END AS n_external, true AS same_links,
  '{"og_title": "og ' || r_regionkey || '"}' AS socials, true AS no_videos, 'og ' || r_regionkey AS title, 'ExtractionResult(url=''https://example.com/' || r_regionkey || ''')' AS shown,
  'article,links,socials,text,url' AS keys, true AS same_result, true AS no_language, '0 Agent/9 [''X-Two''] ' || r_regionkey AS fetched, true AS any_agent FROM region
"""


def facade_batch(spark, sf_dir):
    """A batch of all nations' pages in their order; pages that fail are left out."""
    keys = [r[0] for r in _table(spark, sf_dir, "nation").select("n_nationkey").orderBy(F.desc("n_nationkey")).collect()]

    def answer(url: str, client: Client) -> str:
        n = int(url.rsplit("/", 1)[1])
        if n % 4 == 1:
            raise ConnectionError("refused")
        return f"<title>nation {n}</title><meta property='video:tag' content='v{n}'>"

    got = asyncio.run(batch_extract([f"https://example.com/{k}" for k in keys], client=Client(fetcher=answer), max_concurrent=4))
    rows = [(i, r.url, r.article["title"], r.videos["video_tag"], r.text is None, r.links is None, len(r.product)) for i, r in enumerate(got)]
    return spark.createDataFrame(rows, "pos long, url string, title string, tag string, no_text boolean, no_links boolean, n_product int")


FACADE_BATCH_SQL = """
SELECT row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS pos, 'https://example.com/' || n_nationkey AS url, 'nation ' || n_nationkey AS title, 'v' || n_nationkey AS tag, true AS no_text, true AS no_links, 0 AS n_product
FROM nation WHERE n_nationkey % 4 <> 1
"""

QUERIES = {f.__name__: f for f in (content_choice, boilerplate, written_language, product_selectors, field_names, first_description, date_order, nothing_requested, fetch_errors, robots_fetched, facade, facade_batch)}
ORACLE_SQL = {
    "content_choice": CONTENT_CHOICE_SQL,
    "boilerplate": BOILERPLATE_SQL,
    "written_language": WRITTEN_LANGUAGE_SQL,
    "product_selectors": PRODUCT_SELECTORS_SQL,
    "field_names": FIELD_NAMES_SQL,
    "first_description": FIRST_DESCRIPTION_SQL,
    "date_order": DATE_ORDER_SQL,
    "nothing_requested": NOTHING_REQUESTED_SQL,
    "fetch_errors": FETCH_ERRORS_SQL,
    "robots_fetched": ROBOTS_FETCHED_SQL,
    "facade": FACADE_SQL,
    "facade_batch": FACADE_BATCH_SQL,
}
