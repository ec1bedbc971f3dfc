"""Benchmark decontamination: windows of benchmark words against windows of document words. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryweb.llm.common import ascii_lower, bloom, table

WINDOW = 10
#: The most windows whose hash set travels with the plan (some 2 MB); beyond it a filter of BLOOM_BITS at most and a shuffle of what passes it.
SENT_WINDOWS = 250_000
#: Everything but digits, lower-case letters and non-ASCII characters parts words (after lower-casing).
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _APART), "")


def _window_hashes(hashes: Column, n: Column, size: int) -> Column:
    """The hash of each run of `size` consecutive word hashes; none if there are fewer words."""
    at = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(size, window, items): every distinct window with the items that have it; an item of fewer words is one window."""
    words = benchmark.select(F.col(id_col).alias("_item"), item_words(F.col(text_col)).alias("_words")).where(F.size("_words") > 0)
    size = F.least(F.lit(window), F.size("_words"))
    runs = F.transform(F.sequence(F.lit(1), F.size("_words") - size + 1), lambda i: F.array_join(F.slice("_words", i, size), " "))
    one = words.select("_item", size.alias("size"), F.explode(F.array_distinct(runs)).alias("window"))
    return one.groupBy("size", "window").agg(F.collect_set(F.col("_item").cast("string")).alias("items"))


def _in_set(hashed: DataFrame) -> Callable[[Column], Column]:
    """Membership in the set of `hash`; the values go from the driver's JVM into the plan as they are."""
    jvm = hashed.sparkSession.sparkContext._jvm
    values = getattr(hashed._jdf, "as")(jvm.org.apache.spark.sql.Encoders.LONG()).collectAsList()
    return lambda x: Column(x._jc.isInCollection(values))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: id_col, text_hash, n_words, n_hit, items (sorted as strings), hit_runs.

    hit_runs are the covered runs of words, [begin, end) from 0, apart from
    each other and in order; n_hit is their total length. The benchmark's
    windows are counted first. Up to SENT_WINDOWS of them, the set of their
    hashes travels with the plan and is looked up at every word of every
    document in one scan; hits are then verified by joining their words with
    the benchmark's. Beyond that, windows that pass a Bloom filter are joined
    on their hashes by shuffle, and only documents with hits are read again.
    Nulls, empty texts and texts without words have no words and no hits;
    equal rows each get their own row; an empty benchmark hits nothing; items
    with a null id are left out; other columns are not looked at.
    """
    bench = benchmark_windows(benchmark.where(F.col(item_col).isNotNull()), item_col, item_text_col, window)
    hashed = bench.select(F.xxhash64(F.transform(F.split("window", " "), lambda w: F.xxhash64(w))).alias("hash")).distinct()
    sizes = dict(bench.groupBy("size").count().collect())  # `window` rows at most
    few = sum(sizes.values()) <= SENT_WINDOWS

    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull()).alias("_hash"), item_words(F.col(text_col)).alias("_words"))
    base = base.withColumn("_n", F.size("_words"))
    keyed = base.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    text = lambda x: F.array_join(F.slice("_words", x["at"] + 1, x["size"]), " ")
    known = _in_set(hashed) if few and sizes else None
    found = []
    for size in sorted(sizes):
        at = F.transform(_window_hashes(F.col("_h"), F.col("_n"), size), lambda h, i: F.struct(F.lit(size).alias("size"), i.alias("at"), h.alias("hash")))  # noqa: B023
        found.append(F.filter(at, lambda x: known(x["hash"])) if few else at)
    windows = F.concat(*found) if found else F.array().cast("array<struct<size:int,at:int,hash:bigint>>")
    named = lambda x: F.struct(x["size"].alias("size"), x["at"].alias("at"), text(x).alias("text"))
    # A row for each hit and one, at -1, for each document: it keeps those without hits and counts equal ones.
    mark = F.struct(F.lit(0).alias("size"), F.lit(-1).alias("at"), F.lit(None).cast("string").alias("text"))
    if few:
        out = keyed.select("_id", "_hash", "_n", F.explode(F.concat(F.array(mark), F.transform(windows, named))).alias("_x"))
    else:
        listed = keyed.select("_id", "_hash", F.explode(windows).alias("_x"))
        near = listed.where(bloom(hashed, sum(sizes.values()))(F.col("_x.hash"))).join(hashed, F.col("_x.hash") == F.col("hash"), "left_semi")
        places = near.groupBy(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2")).agg(F.collect_set("_x").alias("_all"))
        again = base.join(places, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2"))).dropDuplicates(["_id", "_hash"])
        out = again.select("_id", "_hash", "_n", F.explode(F.transform("_all", named)).alias("_x"))
    out = out.select("_id", "_hash", "_n", F.col("_x.size").alias("_size"), F.col("_x.at").alias("_at"), F.col("_x.text").alias("_text"))

    checked = bench.select(F.col("size").alias("_bsize"), F.col("window").alias("_window"), "items")
    same = (F.col("_size") == F.col("_bsize")) & (F.col("_text") == F.col("_window"))
    if few:
        out = out.join(F.broadcast(checked), same, "left")
    else:
        marks = base.select("_id", "_hash", "_n", F.lit(0).alias("_size"), F.lit(-1).alias("_at"), F.lit(None).cast("string").alias("_text"))
        out = out.join(checked, same).unionByName(marks, allowMissingColumns=True)
    hit = F.col("items").isNotNull()
    run = F.struct(F.col("_at").alias("begin"), (F.col("_at") + F.col("_size")).alias("end"))
    grouped = out.groupBy("_id", "_hash", "_n").agg(
        F.sum((F.col("_at") < 0).cast("int")).alias("_copies"),
        F.array_sort(F.collect_set(F.when(hit, run))).alias("_runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items")))))).alias("items"),
    )
    blank = F.array().cast("array<struct<begin:int,end:int>>")
    merged = F.aggregate(
        "_runs",
        blank,
        lambda acc, r: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= r["begin"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["begin"].alias("begin"), F.greatest(F.element_at(acc, -1)["end"], r["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(r))),
    )
    grouped = grouped.withColumn("hit_runs", merged)
    covered = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda acc, r: acc + (r["end"] - r["begin"]).cast("long"))
    result = grouped.select(F.col("_id").alias(id_col), F.col("_hash").alias("text_hash"), F.col("_n").cast("long").alias("n_words"), covered.alias("n_hit"), "items", "hit_runs", "_copies")
    return result.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest("_copies", F.lit(1))))).drop("_copy", "_copies")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") without the words that are hit and what parts them from the next.

    Columns and their types stay. Documents without hits keep their texts as
    they are, null and empty ones included. Contaminated documents are found
    as by find_contamination and joined back on id and text, so equal rows are
    treated alike.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    found = find_contamination(docs, benchmark, id_col, text_col, **how).where("n_hit > 0")
    found = found.select(F.col(id_col).alias("_id2"), F.col("text_hash").alias("_hash2"), F.col("hit_runs").alias("_runs")).dropDuplicates(["_id2", "_hash2"])
    same = F.col(id_col).eqNullSafe(F.col("_id2")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull()) == F.col("_hash2"))
    if remove == "documents":
        return docs.join(found.drop("_runs"), same, "left_anti")
    parts = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(0))
    # The parts and the place of the first word are worked out once for a text, not for each of its parts.
    lead = F.when(F.col(text_col).rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0)
    once = F.array(F.struct(parts.alias("parts"), lead.alias("lead")))
    kept = F.transform(once, lambda x: F.array_join(F.filter(x["parts"], lambda _, i: ~F.exists("_runs", lambda r: (i >= x["lead"] + 2 * r["begin"]) & (i < x["lead"] + 2 * r["end"]))), ""))
    cleaned = F.when(F.col("_runs").isNull(), F.col(text_col)).otherwise(F.element_at(kept, 1))
    return docs.join(found, same, "left").withColumn(text_col, cleaned).select(*docs.columns)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words, hits and matched items of every document against the whole benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win
       FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(k) WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT rid, size, k, array_to_string(w[k : k + size - 1], ' ') AS win FROM d, s, unnest(range(1, len(w) - size + 2)) AS t(k)),
h AS (SELECT rid, item_id, dw.size AS size, k FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, size, k FROM h) x, unnest(range(k, k + size)) AS t(p) GROUP BY rid),
m AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""
