"""The extraction plan: one Arrow stage that parses each page once, then Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryweb.functions.lookup import INDEX
from quarryweb.html.index import PARTS, SPARK_TYPES, index_page
from quarryweb.operators import fields as f
from quarryweb.operators.language import language
from quarryweb.operators.links import TYPE as LINKS_TYPE
from quarryweb.operators.links import grouped_links
from quarryweb.plans.request import Request

ERROR = "struct<kind:string,message:string>"


def page_index(df: DataFrame, parts: list[str], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """df without html_col and with the struct page_index of the requested parts; null html gives a null struct.

    mapInArrow is never run twice for a row, whatever stands above it. Filter
    and select before this stage: nothing is pushed through it.
    """
    kept = [c for c in df.columns if c != html_col]
    arrow_fields = [x for p in parts for x in PARTS[p]]
    kind = pa.struct(arrow_fields)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c in kept), f"{INDEX} struct<{', '.join(f'{x.name}:{SPARK_TYPES[x.name]}' for x in arrow_fields)}>"])
    wanted = frozenset(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, names = batch.column(html_col), batch.schema.names
            urls = batch.column(url_col).to_pylist() if url_col in names else [None] * batch.num_rows
            rows = [None if (html := page.as_py()) is None else index_page(url, html, wanted) for url, page in zip(urls, pages, strict=True)]
            index = pa.array(rows, kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), index], [*kept, INDEX])

    return df.mapInArrow(run, schema)


def _content(text: Column) -> Column:
    return F.struct(text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("text_length"))


def extract(pages: DataFrame, request: Request, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """url, text, language, language_confidence, links, socials, videos, product, article, content and error of every page.

    What was not requested is null; a requested map without any field is
    empty. Only the index parts that the request reads are built, and without
    any activity no page is parsed. `keep` names input columns to carry along;
    an `error` column of the input is kept, and its pages are not extracted.
    Works on batch and streaming frames; no shuffle.
    """
    has_error = "error" in pages.columns
    carried = [c for c in keep or [] if c not in (url_col, html_col, "error")]
    base = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"), *carried, *(["error"] if has_error else []))
    if has_error:
        base = base.withColumn("html", F.when(F.col("error").isNull(), F.col("html")))
    null = lambda t: F.lit(None).cast(t)
    if not request.parts():
        out = base.withColumn("_text", null("string"))
        found = None
    else:
        out = page_index(base, request.parts())
        found = F.col(INDEX).isNotNull()
        out = out.withColumn("_text", F.col(f"{INDEX}.clean_text") if request.text else null("string"))
    if request.language and request.text:
        out = out.withColumn("_language", language(F.col("_text")))
        spoken = [F.col("_language.language").alias("language"), F.col("_language.confidence").alias("language_confidence")]
    else:
        spoken = [null("string").alias("language"), null("double").alias("language_confidence")]
    maps = []
    for kind in f.CATALOGUES:
        wanted = list(getattr(request, kind))
        value = F.when(found, f.field_map(kind, wanted)) if wanted and found is not None else F.create_map().cast("map<string,string>") if wanted else null("map<string,string>")
        maps.append(value.alias(kind))
    links = F.when(found, grouped_links(list(request.links))) if request.links and found is not None else null(LINKS_TYPE)
    return out.select(
        "url", *carried, F.col("_text").alias("text"), *spoken, links.alias("links"), *maps, _content(F.col("_text")).alias("content"), (F.col("error") if has_error else null(ERROR)).alias("error")
    )


def to_json(extracted: DataFrame) -> DataFrame:
    """url and json: one document for each page, with text grouped and absent groups left out."""
    text = F.struct(F.col("text").alias("content"), "language", "language_confidence", F.col("content.text_length").alias("text_length"))
    return extracted.select("url", F.to_json(F.struct("url", text.alias("text"), "links", "socials", "videos", "product", "article")).alias("json"))
