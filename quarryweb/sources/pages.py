"""Pages from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """pages over at least `tasks` partitions (the cluster's cores) if the scan gives fewer, as one small file does.

    Parsing costs far more than moving a small table. A large one has many
    partitions already and is left as it is, without a shuffle.
    """
    wanted = tasks or pages.sparkSession.sparkContext.defaultParallelism
    if pages.isStreaming or pages.rdd.getNumPartitions() >= wanted:
        return pages
    return pages.repartition(wanted)
