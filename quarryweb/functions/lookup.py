"""Lookups in the page index as Columns. `page` is the index struct's column name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX = "page_index"


def part(name: str) -> Column:
    return F.col(f"{INDEX}.{name}")


def first_of(map_column: Column, key: str) -> Column:
    """The first value of a key in a map of arrays."""
    return F.get(F.try_element_at(map_column, F.lit(key)), F.lit(0))


def meta_property(name: str) -> Column:
    """The first meta tag with this property that has content."""
    return first_of(part("meta_by_property"), name)


def meta_name(name: str) -> Column:
    return first_of(part("meta_by_name"), name)


def first_meta_property(name: str) -> Column:
    """The content of the first meta tag with this property, and nothing if that tag has none."""
    return F.try_element_at(part("meta_first_by_property"), F.lit(name))


def first_meta_name(name: str) -> Column:
    return F.try_element_at(part("meta_first_by_name"), F.lit(name))


def tag_text(tag: str) -> Column:
    return first_of(part("tag_text"), tag)


def itemprop(name: str) -> Column:
    return first_of(part("itemprop"), name)


def first_itemprop(name: str) -> Column:
    return F.try_element_at(part("itemprop_first"), F.lit(name))


def json_ld(*properties: str) -> Column:
    """Script by script: the properties in the objects, object by object; then, in the script's text, as quoted values."""
    in_text = [rf'"{re.escape(p)}"\s*:\s*"([^"]+)"' for p in properties]

    def of(script: Column) -> Column:
        found = F.flatten(F.transform(script["objects"], lambda o: F.array(*[F.try_element_at(o, F.lit(p)) for p in properties])))
        return F.concat(found, F.array(*[F.nullif(F.regexp_extract(script["raw"], f"(?U){p}", 1), F.lit("")) for p in in_text]))

    return F.get(F.filter(F.flatten(F.transform(part("json_ld"), of)), lambda x: x.isNotNull()), F.lit(0))


def schema_org(name: str) -> Column:
    """JSON-LD, then the first element with this itemprop."""
    return F.coalesce(json_ld(name), first_itemprop(name))


def schema_org_any(name: str) -> Column:
    """JSON-LD, then the first element with this itemprop that has a value."""
    return F.coalesce(json_ld(name), itemprop(name), first_itemprop(name))


#: How prices look, in order of preference.
PRICE_PATTERNS = (r"[£$€¥]\s*[\d,]+\.?\d*", r"[\d,]+\.?\d*\s*[£$€¥]", r"[\d,]+\.?\d*\s*(USD|EUR|GBP|JPY|CAD|AUD)")


def trim_white(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def price_in(text: Column) -> Column:
    """The first price in a text, by the first pattern that matches."""
    return trim_white(F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?U){p}", 0), F.lit("")) for p in PRICE_PATTERNS]))


def css(selectors: tuple[str, ...], price: bool = False) -> Column:
    """Selectors in order, their elements in document order: content if there is any attribute of it, else the text (or the price in it)."""

    def of(hit: Column) -> Column:
        return F.coalesce(hit["content"], price_in(hit["text"]) if price else F.nullif(hit["text"], F.lit("")))

    none = F.array().cast("array<string>")
    values = F.concat(*[F.coalesce(F.transform(F.try_element_at(part("css_hits"), F.lit(s)), of), none) for s in selectors])
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))
