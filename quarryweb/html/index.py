"""The page index: what the fields need from a page, gathered in one walk over its tree."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa

from quarryweb.functions import jsonld, urls
from quarryweb.html.tree import Element, parse

#: Unicode white space, which is what trimming and splitting look at.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WHITE_RUN = re.compile(f"[{WHITE}]+")

#: Selectors of the product fields, tried in this order.
PRICE_CSS = (".price", ".product-price", ".price-current", ".current-price", "[itemprop='price']", "[data-price]", "#price")
ORIGINAL_PRICE_CSS = (".original-price", ".old-price", ".price-original", ".was-price", "[data-original-price]")
RATING_CSS = ("[itemprop='ratingValue']", ".rating", ".product-rating", "[data-rating]", ".star-rating")
REVIEW_COUNT_CSS = ("[itemprop='reviewCount']", ".review-count", ".reviews-count", "[data-review-count]")
#: Where the main content is looked for, and what is left out of it.
CONTENT_CSS = ("article", "main", "[role='main']", ".main-content", ".content", "#main-content", "#content")
LEAST_CONTENT_BYTES = 50
SKIPPED_TAGS = frozenset("nav header footer aside script style noscript".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary".split())
SKIPPED_ID_PARTS = "nav header footer sidebar ad social comment breadcrumb cookie menu navigation".split()
SKIPPED_CLASS_PARTS = [*SKIPPED_ID_PARTS, "advertisement", "newsletter", "subscribe"]

_STRINGS, _BY_KEY, _FIRST = pa.list_(pa.string()), pa.map_(pa.string(), pa.list_(pa.string())), pa.map_(pa.string(), pa.string())
#: Fields of the index by the part that they belong to.
PARTS: dict[str, list[pa.Field]] = {
    "meta": [pa.field("meta_by_property", _BY_KEY), pa.field("meta_by_name", _BY_KEY)],
    "meta_first": [pa.field("meta_first_by_property", _FIRST), pa.field("meta_first_by_name", _FIRST)],
    "links": [pa.field("base_host", pa.string()), pa.field("links", pa.list_(pa.struct([(k, pa.string()) for k in ("href", "url", "host", "text")])))],
    "json_ld": [pa.field("json_ld", pa.list_(pa.struct([("raw", pa.string()), ("objects", pa.list_(_FIRST))])))],
    "tags": [pa.field("tag_text", _BY_KEY), pa.field("h1_first", pa.string()), pa.field("rel_author", pa.string())],
    "itemprop": [pa.field("itemprop", _BY_KEY), pa.field("itemprop_first", _FIRST)],
    "css": [pa.field("css_hits", pa.map_(pa.string(), pa.list_(pa.struct([("content", pa.string()), ("text", pa.string())]))))],
    "dates": [pa.field("time_datetime", _STRINGS), pa.field("body_text", pa.string())],
    "text": [pa.field("clean_text", pa.string())],
}
SPARK_TYPES = {
    "meta_by_property": "map<string,array<string>>", "meta_by_name": "map<string,array<string>>", "meta_first_by_property": "map<string,string>", "meta_first_by_name": "map<string,string>",
    "base_host": "string", "links": "array<struct<href:string,url:string,host:string,text:string>>", "json_ld": "array<struct<raw:string,objects:array<map<string,string>>>>",
    "tag_text": "map<string,array<string>>", "h1_first": "string", "rel_author": "string", "itemprop": "map<string,array<string>>", "itemprop_first": "map<string,string>",
    "css_hits": "map<string,array<struct<content:string,text:string>>>", "time_datetime": "array<string>", "body_text": "string", "clean_text": "string",
}

_BY_CLASS = {s[1:]: s for s in (*PRICE_CSS, *ORIGINAL_PRICE_CSS, *RATING_CSS, *REVIEW_COUNT_CSS) if s[0] == "."}
_BY_ATTRIBUTE = {s[1:-1]: s for s in (*PRICE_CSS, *ORIGINAL_PRICE_CSS, *RATING_CSS, *REVIEW_COUNT_CSS) if s.startswith("[data-")}
_BY_ITEMPROP = {s.split("'")[1]: s for s in (*PRICE_CSS, *RATING_CSS, *REVIEW_COUNT_CSS) if s.startswith("[itemprop")}


def collapse(text: str) -> str:
    return _WHITE_RUN.sub(" ", text).strip(WHITE)


def is_boilerplate(e: Element) -> bool:
    if e.tag in SKIPPED_TAGS:
        return True
    if not e.attrs:
        return False
    if e.attrs.get("role") in SKIPPED_ROLES:
        return True
    name, kind = e.attrs.get("id", "").lower(), e.attrs.get("class", "").lower()
    return any(p in name for p in SKIPPED_ID_PARTS) or any(p in kind for p in SKIPPED_CLASS_PARTS)


def clean_text(root: Element) -> str:
    """Trimmed text nodes below root, joined by spaces; elements that are boilerplate (root itself is not asked) are left out."""
    parts, stack = [], list(reversed(root.children))
    while stack:
        x = stack.pop()
        if type(x) is str:
            if text := x.strip(WHITE):
                parts.append(text)
        elif not is_boilerplate(x):
            stack += reversed(x.children)
    return " ".join(parts)


def main_text(root: Element) -> str:
    """The first content element with enough text, else the body."""
    first: dict[str, Element] = {}
    body = None
    for e in root.walk():
        if e.tag in ("article", "main"):
            first.setdefault(e.tag, e)
        elif e.tag == "body" and body is None:
            body = e
        if a := e.attrs:
            if a.get("role") == "main":
                first.setdefault("[role='main']", e)
            for token in a.get("class", "").split():
                if token in ("main-content", "content"):
                    first.setdefault(f".{token}", e)
            if a.get("id") in ("main-content", "content"):
                first.setdefault(f"#{a['id']}", e)
    for css in CONTENT_CSS:
        if css in first and len((text := clean_text(first[css])).encode("utf-8", "surrogatepass")) > LEAST_CONTENT_BYTES:
            return collapse(text)
    return collapse(clean_text(body)) if body is not None else " ".join(root.texts())


def index_page(url: str | None, html: str, parts: Iterable[str]) -> dict:
    """The requested parts of the index of one page."""
    parts = set(parts)
    root, out = parse(html), {}
    if "text" in parts:
        out["clean_text"] = main_text(root)
    if not parts - {"text"}:
        return out
    # Only what the requested parts read is gathered; the rest stays empty.
    with_meta, with_links, with_json, with_tags, with_items, with_css, with_dates = (p in parts for p in ("meta", "links", "json_ld", "tags", "itemprop", "css", "dates"))
    with_meta |= "meta_first" in parts
    meta: dict[str, dict[str, list[str]]] = {"property": {}, "name": {}}
    meta_first: dict[str, dict[str, str | None]] = {"property": {}, "name": {}}
    links, json_ld, tag_text, itemprop, itemprop_first, css, times = [], [], {}, {}, {}, {}, []
    h1 = author = body = None
    h1_seen = author_seen = False
    base = urls.try_parse(url) if with_links else None
    for e in root.walk():
        tag, a = e.tag, e.attrs
        if tag == "body" and body is None:
            body = e
        if with_tags and tag in ("title", "h1"):
            text = e.text().strip(WHITE)
            if text:
                tag_text.setdefault(tag, []).append(text)
            if tag == "h1" and not h1_seen:
                h1_seen, h1 = True, text or None
        if not a:
            continue
        content = a.get("content")
        if tag == "meta":
            if with_meta:
                for key in ("property", "name"):
                    if (name := a.get(key)) is not None:
                        meta_first[key].setdefault(name, content)
                        if content is not None:
                            meta[key].setdefault(name, []).append(content)
        elif tag == "a":
            if with_links and "href" in a and (text := e.text().strip(WHITE)):
                links.append(_link(a["href"], text, base))
            if with_tags and not author_seen and a.get("rel", "").lower() == "author":
                author_seen, author = True, e.text().strip(WHITE) or None
        elif tag == "script":
            if with_json and a.get("type", "").lower() == "application/ld+json" and (raw := next(e.texts(), None)):
                json_ld.append({"raw": raw, "objects": [jsonld.resolve(o) for o in jsonld.objects(raw)]})
        elif with_dates and tag == "time" and "datetime" in a:
            times.append(a["datetime"])
        name = a.get("itemprop")
        if with_items and name is not None:
            value = content if content is not None else e.text().strip(WHITE) or None
            itemprop_first.setdefault(name, value)
            if value is not None:
                itemprop.setdefault(name, []).append(value)
        if with_css:
            hits = [_BY_CLASS[t] for t in dict.fromkeys(a.get("class", "").split()) if t in _BY_CLASS]
            hits += [s for k, s in _BY_ATTRIBUTE.items() if k in a]
            if name in _BY_ITEMPROP:
                hits.append(_BY_ITEMPROP[name])
            if a.get("id") == "price":
                hits.append("#price")
            for s in hits:
                css.setdefault(s, []).append({"content": content, "text": e.text().strip(WHITE)})
    out |= {
        "base_host": (base.host or "") if base else "", "links": links, "json_ld": json_ld, "tag_text": list(tag_text.items()), "h1_first": h1, "rel_author": author,
        "meta_by_property": list(meta["property"].items()), "meta_by_name": list(meta["name"].items()), "meta_first_by_property": list(meta_first["property"].items()), "meta_first_by_name": list(meta_first["name"].items()),
        "itemprop": list(itemprop.items()), "itemprop_first": list(itemprop_first.items()), "css_hits": list(css.items()), "time_datetime": times,
    }
    if with_dates:
        out["body_text"] = " ".join((body or root).texts())
    return out


def _link(href: str, text: str, base: urls.Url | None) -> dict:
    """A link against its page: without a base, or if they do not join, the address stays as it is."""
    joined = href
    if base is not None:
        try:
            joined = str(urls.parse(href, base))
        except (ValueError, UnicodeError):
            joined = href
    target = urls.try_parse(joined)
    return {"href": href, "url": joined, "host": target.host if target else None, "text": text}
