"""The same plan over streams of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarryweb.plans import Request, extract

PAGES = "page_id long, url string, html string"


def page_stream(spark: SparkSession, path: str, schema: str = PAGES, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files of pages that arrive in path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def extract_stream(pages: DataFrame, request: Request, out: str, checkpoint: str, keep: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """Extracts pages as they arrive into Parquet files. Nothing is kept between batches, and the sink writes each page once."""
    query = extract(pages, request, keep=keep).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (query.trigger(availableNow=True) if once else query).start()
