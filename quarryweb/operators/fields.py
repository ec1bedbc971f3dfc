"""The field catalogues: name -> expression, the aliases, and the index parts that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryweb.functions.lookup import css, first_meta_name, first_meta_property, json_ld, meta_name, meta_property, part, schema_org, schema_org_any, tag_text
from quarryweb.html.index import ORIGINAL_PRICE_CSS, PRICE_CSS, RATING_CSS, REVIEW_COUNT_CSS
from quarryweb.operators.dates import publication_dates_json

Catalogue = dict[str, Callable[[], Column]]

#: Field names and the tags that they read.
SOCIALS: Catalogue = {
    **{f"twitter_{k}": (lambda k=k: meta_name(f"twitter:{k}")) for k in ("card", "site", "creator", "title", "description", "image")},
    **{f"og_{k.replace(':', '_')}": (lambda k=k: meta_property(f"og:{k}")) for k in ("url", "type", "title", "description", "image", "image:width", "image:height", "image:alt", "site_name", "locale")},
}
VIDEOS: Catalogue = {
    **{f"video_{k}": (lambda k=k: first_meta_property(f"video:{k}")) for k in ("duration", "release_date", "tag", "actor", "director", "writer", "series")},
    **{f"book_{k}": (lambda k=k: first_meta_property(f"book:{k}")) for k in ("author", "isbn", "release_date", "tag")},
}
PRODUCT: Catalogue = {
    "product_title": lambda: F.coalesce(first_meta_property("product:title"), first_meta_property("og:title"), json_ld("name", "title"), schema_org("name"), part("h1_first")),
    "product_description": lambda: F.coalesce(first_meta_property("product:description"), first_meta_property("og:description"), json_ld("description"), schema_org("description"), first_meta_name("description")),
    "product_brand": lambda: F.coalesce(first_meta_property("product:brand"), json_ld("brand", "brand.name", "manufacturer.name"), schema_org("brand")),
    "product_category": lambda: F.coalesce(first_meta_property("product:category"), json_ld("category", "productCategory"), schema_org("category")),
    "product_sku": lambda: F.coalesce(first_meta_property("product:sku"), json_ld("sku", "productID"), schema_org("sku")),
    "product_mpn": lambda: F.coalesce(first_meta_property("product:mpn"), json_ld("mpn"), schema_org("mpn")),
    "product_image": lambda: F.coalesce(first_meta_property("product:image"), first_meta_property("og:image"), json_ld("image", "image.url"), schema_org("image")),
    "product_price": lambda: F.coalesce(first_meta_property("product:price:amount"), first_meta_property("product:price"), json_ld("price", "offers.price", "offers.lowPrice"), schema_org("price"), css(PRICE_CSS, price=True)),
    "product_currency": lambda: F.coalesce(first_meta_property("product:price:currency"), json_ld("priceCurrency", "offers.priceCurrency"), schema_org("priceCurrency")),
    "product_availability": lambda: F.coalesce(first_meta_property("product:availability"), json_ld("availability", "offers.availability"), schema_org("availability")),
    "product_original_price": lambda: F.coalesce(first_meta_property("product:original_price"), json_ld("offers.highPrice", "originalPrice"), css(ORIGINAL_PRICE_CSS, price=True)),
    "product_rating": lambda: F.coalesce(json_ld("aggregateRating.ratingValue", "ratingValue"), schema_org("ratingValue"), css(RATING_CSS)),
    "product_review_count": lambda: F.coalesce(json_ld("aggregateRating.reviewCount", "reviewCount"), schema_org("reviewCount"), css(REVIEW_COUNT_CSS)),
    "product_best_rating": lambda: F.coalesce(json_ld("aggregateRating.bestRating", "bestRating"), schema_org("bestRating")),
    "product_worst_rating": lambda: F.coalesce(json_ld("aggregateRating.worstRating", "worstRating"), schema_org("worstRating")),
}
ARTICLE: Catalogue = {
    "title": lambda: F.coalesce(meta_property("og:title"), meta_name("twitter:title"), json_ld("headline", "name"), tag_text("title"), tag_text("h1")),
    "author": lambda: F.coalesce(meta_property("article:author"), meta_name("author"), meta_property("og:article:author"), part("rel_author"), schema_org_any("author")),
    "description": lambda: F.coalesce(meta_property("og:description"), meta_name("twitter:description"), meta_name("description"), schema_org_any("description")),
    "publication_date": publication_dates_json,
    "modified_date": lambda: F.coalesce(meta_property("article:modified_time"), meta_property("og:updated_time")),
    "article_section": lambda: meta_property("article:section"),
    "article_tag": lambda: meta_property("article:tag"),
    "article_author": lambda: meta_property("article:author"),
    "article_published_time": lambda: meta_property("article:published_time"),
    "article_modified_time": lambda: meta_property("article:modified_time"),
    "article_expiration_time": lambda: meta_property("article:expiration_time"),
    "categories": lambda: F.coalesce(meta_property("article:tag"), meta_property("article:section"), json_ld("articleSection", "keywords"), meta_name("keywords")),
}
#: Other names that requests may use.
ARTICLE_ALIASES = {
    "pub_date": "publication_date",
    "pub_date_time": "article_published_time",
    "modified_time": "article_modified_time",
    "expiration_time": "article_expiration_time",
    "section": "article_section",
    "tag": "article_tag",
    "tags": "article_tag",
    "category": "categories",
}
PRODUCT_ALIASES = {name.removeprefix("product_"): name for name in PRODUCT}

CATALOGUES: dict[str, tuple[Catalogue, dict[str, str]]] = {"socials": (SOCIALS, {}), "videos": (VIDEOS, {}), "product": (PRODUCT, PRODUCT_ALIASES), "article": (ARTICLE, ARTICLE_ALIASES)}

#: Index parts of each catalogue; dates and CSS hits only where a requested field reads them.
_PARTS = {"socials": {"meta"}, "videos": {"meta_first"}, "product": {"meta_first", "json_ld", "itemprop", "tags"}, "article": {"meta", "json_ld", "itemprop", "tags"}}
_CSS_FIELDS = {"product_price", "product_original_price", "product_rating", "product_review_count"}


def names(kind: str, fields: list[str]) -> list[str]:
    """Full names of the requested fields, without repeats; unknown ones are left out."""
    catalogue, aliases = CATALOGUES[kind]
    if "all" in fields:
        return list(catalogue)
    return [n for n in dict.fromkeys(aliases.get(f, f) for f in fields) if n in catalogue]


def parts(kind: str, fields: list[str]) -> set[str]:
    wanted = set(names(kind, fields))
    more = ({"css"} if wanted & _CSS_FIELDS else set()) | ({"dates", "meta_first"} if "publication_date" in wanted else set())
    return _PARTS[kind] | more if wanted else set()


def field_map(kind: str, fields: list[str]) -> Column:
    """A map of the fields that the page has; empty if it has none of them."""
    catalogue, _ = CATALOGUES[kind]
    wanted = names(kind, fields)
    if not wanted:
        return F.create_map().cast("map<string,string>")
    values = F.map_from_arrays(F.array(*map(F.lit, wanted)), F.array(*[catalogue[n]() for n in wanted]))
    return F.map_filter(values, lambda _, v: v.isNotNull())
