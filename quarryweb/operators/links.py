"""Links of a page: internal, external and by host, with a summary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryweb.functions.lookup import part

LINK = "struct<url:string,text:string>"
TYPE = f"struct<internal:array<{LINK}>,external:array<{LINK}>,by_domain:map<string,array<{LINK}>>,summary:struct<total:bigint,internal_count:bigint,external_count:bigint,unique_domains:bigint>>"


def wanted(options: list[str] | None) -> tuple[bool, bool]:
    """(internal, external) of a request: nothing and "all" mean both, other words mean neither."""
    if not options or "all" in options:
        return True, True
    return "internal" in options, "external" in options


def _shown(links: Column) -> Column:
    return F.transform(links, lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text")))


def grouped_links(options: list[str] | None = None) -> Column:
    """A link is internal if its host is that of the page; one without a host is external and in no group."""
    links, host = part("links"), part("base_host")
    internal, external = wanted(options)
    is_internal = lambda x: F.coalesce(x["host"] == host, F.lit(False))
    none = F.array().cast(f"array<{LINK}>")
    inside = _shown(F.filter(links, is_internal)) if internal else none
    outside = _shown(F.filter(links, lambda x: ~is_internal(x))) if external else none
    kept = F.filter(links, lambda x: x["host"].isNotNull() & (is_internal(x) & F.lit(internal) | ~is_internal(x) & F.lit(external)))
    hosts = F.array_distinct(F.transform(kept, lambda x: x["host"]))
    by = F.map_from_entries(F.transform(hosts, lambda h: F.struct(h, _shown(F.filter(kept, lambda x: x["host"] == h)))))
    long = lambda c: F.size(c).cast("long")
    summary = F.struct((long(inside) + long(outside)).alias("total"), long(inside).alias("internal_count"), long(outside).alias("external_count"), long(hosts).alias("unique_domains"))
    return F.struct(inside.alias("internal"), outside.alias("external"), by.alias("by_domain"), summary.alias("summary"))
