"""Bottom-k sketches of word shingles. DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a
text's shingles. Sketches of parts merge into the sketch of the whole, and two
sketches estimate resemblance, containment and numbers of distinct shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryweb.llm.common import ascii_lower, table, whole_text

K = 128
SHINGLE = 5


def shingle_hashes(text: Column, words: int = SHINGLE) -> Column:
    """Hashes of all runs of `words` words (by ASCII white space, A-Z lower-cased); of the whole sequence if there are fewer; none without words."""
    hashes = F.transform(F.array_remove(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - words)
        return F.when(F.size(h) >= words, F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    # One element that holds the word hashes, so that they are computed once.
    return F.element_at(F.transform(F.array(hashes), runs), 1)


def sketch(text: Column, k: int = K, words: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text; that of null or of a text without words is empty."""
    return F.slice(F.array_sort(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k shingles, else estimated from the k-th smallest hash."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; exact if the union has at most k shingles. Two empty sketches are alike, an empty and another are not."""
    union = merge(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; of an empty sketch all."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge_groups(df: DataFrame, keys: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """One sketch for each group. Each task keeps at most k hashes of a group before the shuffle, so a hot group is small when it meets."""
    hashes = df.select(*keys, F.explode(sketch_col).alias("_hash")).distinct()
    low = hashes.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))).where(F.col("_n") <= k)
    return low.groupBy(*keys).agg(F.array_sort(F.collect_list("_hash")).alias(sketch_col))


def as_text(a: Column) -> Column:
    """A sketch as fixed-width hexadecimal digits."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(df: DataFrame, id_col: str, text_col: str, extra=None) -> DataFrame:
    """df's id and text with next_text, that of the next row by descending id (null last, equal ids by hash of the text); the last row's next is the first.

    extra(text) is a Column to be carried as well: `extra` and `next_extra`.
    Rows are dealt into ranges of ids, several for each shuffle partition, and
    the first row of each range is copied to the end of the range before it.
    Only the range bounds and the first ids reach the driver.
    """
    spark = df.sparkSession
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    parts = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(df.agg(F.percentile_approx(F.col(id_col), parts, 10 * ranges)).first()[0] or []))
    # Two steps of about the square root of the number of ranges each.
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def array(values, kind: str) -> Column:
        return F.from_json(F.lit(str(values)), kind) if values else F.array().cast(kind)

    coarse = F.size(F.filter(array([g[0] for g in groups], "array<bigint>"), lambda b: b <= F.col("_id")))
    fine = F.size(F.filter(F.get(array(groups, "array<array<bigint>>"), coarse - 1), lambda b: b <= F.col("_id")))
    place = F.when(coarse > 0, (coarse - 1) * step + fine).otherwise(0)
    rows = rows.withColumn("_range", F.coalesce(place, F.lit(0)))

    first = F.max(F.struct(F.col("_id").isNotNull().alias("has"), F.col("_id").alias("id"), F.col("_tie").alias("tie")))
    tops = sorted((r[0], r[1]["id"], r[1]["tie"]) for r in rows.groupBy("_range").agg(first).collect())
    size = len(bounds) + 1
    top_id, top_tie, goes = [0] * size, [0] * size, [-1] * size
    for i, (r, top, tie) in enumerate(tops):
        top_id[r], top_tie[r], goes[r] = (top if top is not None else 0), tie, tops[(i + 1) % len(tops)][0]
    is_top = F.coalesce(F.col("_id") == F.get(array(top_id, "array<bigint>"), F.col("_range")), F.lit(tops[0][1] is None if tops else False)) & (F.col("_tie") == F.get(array(top_tie, "array<bigint>"), F.col("_range")))
    copy = F.when(is_top, F.array(F.struct(F.get(array(goes, "array<int>"), F.col("_range")).alias("r"), F.lit(1).alias("copied")))).otherwise(F.array().cast("array<struct<r:int,copied:int>>"))
    dealt = rows.withColumn("_to", F.explode(F.concat(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("copied"))), copy)))
    dealt = dealt.select("_id", "_text", "_tie", F.col("_to.r").alias("_range"), F.col("_to.copied").alias("_copied"))
    order = Window.partitionBy("_range").orderBy("_copied", F.col("_id").desc_nulls_last(), F.col("_tie").desc())
    out = dealt.withColumn("next_text", F.lead("_text").over(order))
    if extra is not None:
        out = out.withColumn("extra", extra(F.col("_text"))).withColumn("next_extra", F.lead("extra").over(order))
    return out.where("_copied = 0").withColumnsRenamed({"_id": id_col, "_text": text_col}).drop("_tie", "_range", "_copied")


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how near they and the next document's are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    rows = with_next(docs, "doc_id", "text", extra=sketch)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("extra")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("extra"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("extra"), F.col("next_extra")).alias("near_next"),
    )
