"""Publication dates of a page, scored by where they are found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryweb.functions.lookup import first_meta_name, first_meta_property, part

#: The tags, the patterns and the weights.
META_PROPERTIES = ("article:published_time", "og:published_time")
META_NAMES = ("pubdate", "date", "publication_date")
ISO = r"\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?"
SLASHES = r"\b\d{1,2}/\d{1,2}/\d{4}\b"
MONTHS = r"\b(January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s+\d{4}\b"
PUBLISHED = r'"datePublished"\s*:\s*"([^"]+)"'
ALL_THREE, META_AND_JSON, ONE_OF_THEM, BODY_ONLY = 1.0, 0.8, 0.5, 0.1
BODY_PENALTY, OTHER_PENALTY = 0.3, 0.15


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(group))


def publication_dates() -> Column:
    """array<struct<date,confidence>>, most confident first; equal ones in order of meta, JSON-LD and body."""
    none = F.array().cast("array<string>")
    meta = F.array_compact(F.array(*map(first_meta_property, META_PROPERTIES), *map(first_meta_name, META_NAMES)))
    meta = F.concat(meta, F.coalesce(part("time_datetime"), none))
    json = F.coalesce(F.flatten(F.transform(part("json_ld"), lambda s: F.concat(_all(s["raw"], PUBLISHED, 1), _all(s["raw"], ISO, 0)))), none)
    text = part("body_text")
    body = F.coalesce(F.concat(_all(text, rf"\b{ISO}\b", 0), _all(text, SLASHES, 0), _all(text, MONTHS, 0)), none)
    # One struct holds the three lists, so that each is worked out once.
    found = F.transform(F.array(F.struct(meta.alias("m"), json.alias("j"), body.alias("b"))), _scored)
    return F.element_at(found, 1)


def _scored(x: Column) -> Column:
    distinct = F.array_distinct(F.concat(x["m"], x["j"], x["b"]))
    in_meta, in_json, in_body = (lambda d, k=k: F.array_contains(x[k], d) for k in "mjb")
    only_body = F.size(F.filter(distinct, lambda d: ~in_meta(d) & ~in_json(d)))
    n = F.size(distinct)

    def confidence(d: Column) -> Column:
        m, j, b = in_meta(d), in_json(d), in_body(d)
        base = F.when(m & j & b, ALL_THREE).when(m & j, META_AND_JSON).when(m | j, ONE_OF_THEM).otherwise(BODY_ONLY)
        alone = ~m & ~j & (only_body > 1)
        share = F.when(alone, 1.0 / (1.0 + (only_body - 1) * BODY_PENALTY)).otherwise(1.0 / (1.0 + (n - 1) * OTHER_PENALTY))
        return F.when(n > 1, base * share).otherwise(base)

    rows = F.transform(distinct, lambda d, i: F.struct((-confidence(d)).alias("c"), i.alias("i"), d.alias("d")))
    return F.transform(F.array_sort(rows), lambda r: F.struct(r["d"].alias("date"), (-r["c"]).alias("confidence")))


def publication_dates_json() -> Column:
    """The same as a JSON text; null if the page has no date."""
    dates = publication_dates()
    return F.when(F.size(dates) > 0, F.to_json(dates))
