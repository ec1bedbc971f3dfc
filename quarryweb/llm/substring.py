"""Substring dedup: seeds are winnowed anchors, extended both ways to the maximal repeats of at least WINDOW words.

Every run of WINDOW words holds exactly one anchor: its least k-gram hash. So
equal runs share their anchor and their place around it, and repeats are found
by joining anchors, never by comparing documents in pairs:

1. Seeds: each task sends its anchors, each with the widest stretch of words
   whose runs it anchors, once with a count, to slices of the anchors' range.
   Stretches that occur again are written; filters of fixed size tell which
   anchors have more than one stretch, and (about) which stretches occur again.
2. Full extension: an anchor whose whole stretch occurs again is repeated as a
   whole. Groups of copies end here, whatever their size, by counting.
3. Where an anchor has several different stretches, each is extended from the
   anchor to both sides, window by window, as far as its words go on as in
   another: a run of words that occurs at the anchor twice is repeated.

Overlapping repeats of a document are joined into maximal ones. Equal texts
have equal repeats, so they share one row until the end. No anchor is a hot
key: counts are combined before the shuffle, and joins are of plain exchanges,
which can be split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryweb.llm.common import bounded_batches, discard, free_name, give_back, table, written
from quarryweb.llm.slices import ROW, blobs, by_part, dealt, filter_of, may_have, segment, unpack
from quarryweb.llm.words import hashed_words

WINDOW, GRAM = 35, 8
#: Bytes of text for each slice of anchors, and anchors that a task gathers before it sends them.
SLICE_BYTES, GATHERED = 32 << 20, 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Base of the running hash, 3 modulo 4, and its inverse modulo 2**64.
_BASE = 0xD1342543DE82EF97
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    """Words by ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class RunHashes:
    """Hashes of any runs of words of one text, from sums that are made once."""

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, ids: np.ndarray):
        if len(ids) + 1 > len(RunHashes._up):
            size = 2 * len(ids) + 1024
            RunHashes._up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, np.uint64(_BASE)))])
            RunHashes._down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, np.uint64(_INVERSE)))])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * RunHashes._up[: len(ids)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * RunHashes._down[start]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(29))


def _least(x: np.ndarray, width: int, most: int = 1 << 20) -> np.ndarray:
    """The place of the least of each `width` that follow each other, by their high bits; the first of equal ones."""
    out, low = [], np.uint64(most - 1)
    for begin in range(0, len(x) - width + 1, most - width):
        part = x[begin : begin + most - 1]
        m, span = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * span <= width:
            m, span = np.minimum(m[:-span], m[span:]), 2 * span
        n = len(part) - width + 1
        out.append((np.minimum(m[:n], m[width - span : width - span + n]) & low).astype(np.int64) + begin)
    return np.concatenate(out)


def anchors(ids: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first run, last run, place in the first run) of each anchor of a text of at least `window` words."""
    n = len(ids) - gram + 1
    g = np.zeros(n, np.uint64)
    for i in range(gram):
        g = (g ^ ids[i : n + i]) * _MIX
        g ^= g >> np.uint64(29)
    at = _least(g, window - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return g[at[first]], first, last, at[first] - first


def _stretches(ids: np.ndarray, window: int, gram: int) -> tuple[RunHashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the text's run hashes; anchor, stretch, first run, number of runs) of each anchor."""
    runs = RunHashes(ids)
    anchor, first, last, left = anchors(ids, window, gram)
    stretch = runs.of(first, last + window) ^ (left.astype(np.uint64) * _MIX) ^ ((last - first).astype(np.uint64) << np.uint64(32))
    return runs, anchor, stretch, first, last - first + 1


def _class_key(anchor: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """What filters know a stretch by; it is in its anchor's slice."""
    high = np.uint64(0xFFFFFFFF) << np.uint64(32)
    return (anchor & high) | (((stretch ^ anchor) * _MIX) >> np.uint64(32))


def _seeds(texts: DataFrame, slices: int, window: int, gram: int) -> DataFrame:
    """(anchor, stretch) of stretches that occur again (kind 0), and segments of the filters: 1, of them; 2, of anchors with several stretches."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            yield from blobs(0, *_counted(*(np.concatenate(x) for x in zip(*held, strict=True))), slices)
            held.clear()

        for batch in batches:
            for _, hashes, cuts in hashed_words(batch.column(0), False):
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if b - a >= window:
                        _, anchor, stretch, _, _ = _stretches(hashes[a:b], window, gram)
                        held.append((anchor, stretch, np.ones(len(anchor), np.int64)))
                        size += len(anchor)
            if size > GATHERED:
                size = 0
                yield from out()
        if held:
            yield from out()
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, size, most = None, [], 0, GATHERED

        def add() -> tuple[np.ndarray, list[np.ndarray]]:
            return _counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))

        def close() -> Iterator[pa.RecordBatch]:
            anchor, (stretch, count) = add()
            parts.clear()
            again = count > 1
            several = np.flatnonzero(anchor[1:] == anchor[:-1])
            for i in range(0, int(again.sum()), 100_000):
                a, s = (x[again][i : i + 100_000].view(np.int64) for x in (anchor, stretch))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(a), pa.array(s), pa.nulls(len(a), pa.binary())], names)
            for kind, keys in ((1, _class_key(anchor[again], stretch[again])), (2, anchor[several])):
                low, bits = segment(keys, at, slices)
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([low], pa.int64()), pa.nulls(1, pa.int64()), pa.array([bits.tobytes()], pa.binary())], names)

        for part, _, data in by_part(batches):
            if part != at:
                if parts:
                    yield from close()
                at, size, most = part, 0, GATHERED
            parts.append(unpack(data, "uui"))
            size += len(parts[-1][0])
            if size > most:
                anchor, rest = add()
                parts[:] = [[anchor, *rest]]
                size, most = 0, max(GATHERED, len(anchor))
        if parts:
            yield from close()
        give_back()

    names = ["kind", "anchor", "stretch", "bits"]
    return dealt(texts.mapInArrow(gather, ROW), slices).mapInArrow(merge, "kind int, anchor long, stretch long, bits binary")


def _counted(anchor: np.ndarray, stretch: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Different pairs in the anchors' order, with their counts added up."""
    order = np.lexsort((stretch, anchor))
    anchor, stretch = anchor[order], stretch[order]
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1]))) if len(anchor) else np.zeros(0, np.int64)
    return anchor[first], [stretch[first], np.add.reduceat(count[order], first) if len(first) else count]


def repeats(df: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(text_hash, runs) of each text with repeats: runs of words [begin, end) in order, each of `window` words or more, each covered by windows that also start elsewhere.

    text_hash is xxhash64 of the text. Texts of fewer words than a window have
    none; equal texts (of equal rows, too) repeat each other and share one row.
    df is read twice. Stretches and runs are told apart by 64-bit hashes
    together with their anchors'.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    texts = df.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    seeds = written(_seeds(texts.select("text"), max(1, math.ceil(size / SLICE_BYTES)), window, gram), "substring-seeds")
    filters = spark.sparkContext.broadcast([filter_of([(r[0], r[1]) for r in seeds.where(F.col("kind") == k).select("anchor", "bits").collect()]) for k in (1, 2)])
    names = ["kind", "hash", "anchor", "run", "begin", "end"]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: whole stretches that occur again, about; 1: the runs of an anchor's stretches. Each text and stretch once for a task."""
        again, several = filters.value
        seen, told = set(), set()
        for batch in batches:
            keys, out = batch.column(0).to_numpy(), []
            for row, hashes, cuts in hashed_words(batch.column(1), False):
                for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), row):
                    if b - a < window or (key := int(keys[i])) in seen:
                        continue
                    seen.add(key)
                    runs, anchor, stretch, first, n = _stretches(hashes[a:b], window, gram)
                    full = np.flatnonzero(may_have(again, _class_key(anchor, stretch)))
                    out.append((np.zeros(len(full), np.int32), np.full(len(full), key), anchor[full], stretch[full], first[full], first[full] + n[full] - 1 + window))
                    part = np.flatnonzero(may_have(several, anchor))
                    part = np.array([k for k, c in zip(part.tolist(), stretch[part].tolist(), strict=True) if c not in told and not told.add(c)], np.int64)
                    if len(part):
                        of = np.repeat(part, n[part])
                        start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                        out.append((np.ones(len(of), np.int32), np.full(len(of), key), anchor[of], runs.of(start, start + window), start, start + window))
            if len(seen) > 200_000:
                seen.clear()
            if len(told) > 400_000:
                told.clear()
            if out:
                kind, key, anchor, run, begin, end = (np.concatenate(x) for x in zip(*out, strict=True))
                for i in range(0, len(kind), 100_000):
                    s = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(kind[s]), pa.array(key[s]), pa.array(anchor[s].view(np.int64)), pa.array(run[s].view(np.int64)), pa.array(begin[s].astype(np.int32)), pa.array(end[s].astype(np.int32))], names)
        give_back()

    found = written(texts.mapInArrow(extend, "kind int, hash long, anchor long, run long, begin int, end int"), "substring-extended")
    whole = found.where("kind = 0").drop("kind").join(seeds.where("kind = 0").select(F.col("anchor").alias("_a"), F.col("stretch").alias("_s")), (F.col("anchor") == F.col("_a")) & (F.col("run") == F.col("_s")))
    runs = found.where("kind = 1").drop("kind")
    twice = written(runs.groupBy(F.col("anchor").alias("_a"), F.col("run").alias("_r")).agg(F.count("*").alias("c")).where("c > 1").drop("c"), "substring-twice")
    part = runs.join(twice, (F.col("anchor") == F.col("_a")) & (F.col("run") == F.col("_r")))
    spans = whole.select("hash", "begin", "end").unionByName(part.select("hash", "begin", "end"))
    spans = written(spans.groupBy("hash").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("runs")), "substring-spans")
    discard(found, seeds, twice)
    blank = F.array().cast("array<struct<begin:int,end:int>>")
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate("runs", blank, lambda acc, r: F.when((F.size(acc) > 0) & (last(acc)["end"] >= r["begin"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["begin"].alias("begin"), F.greatest(last(acc)["end"], r["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(r))))
    return spans.select(F.col("hash").alias("text_hash"), joined.alias("runs"))


def remove_repeats(df: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """df with n_words, n_removed and kept: the words that no repeated window covers, joined by one space.

    Windows are judged on the texts as they are, so all places of a repeat go.
    Null and empty texts and texts without words have 0, 0 and an empty kept;
    rows, ids (null or repeated) and all other columns stay; columns named
    n_words, n_removed or kept are replaced. Runs of words are told apart by
    the anchor's 64-bit hash together with a 64-bit hash of the run. Ids are
    not looked at.
    """
    found = repeats(df, text_col, window, gram).withColumnsRenamed({"text_hash": "_of", "runs": "_runs"})
    df = df.drop("n_words", "n_removed", "kept")
    key = free_name(df, "_text_hash")
    both = df.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(found, F.col(key) == F.col("_of"), "left")

    @F.arrow_udf("struct<n_words:long,n_removed:long,kept:string>")
    def keep(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts, runs, strict=True):
            words, at, left, removed = words_of(text.as_py()), 0, [], 0
            for r in spans.as_py() or []:
                if r["begin"] > at:
                    left += words[at : r["begin"]]
                removed += max(0, r["end"] - max(at, r["begin"]))
                at = max(at, r["end"])
            left += words[at:]
            out.append({"n_words": len(words), "n_removed": removed, "kept": b" ".join(left).decode("utf-8", "surrogatepass")})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return both.withColumn("_k", keep(F.col(text_col), F.col("_runs"))).select(*df.columns, "_k.*")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words removed from every document, and a digest of those that are kept."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT rid, k, array_to_string(w[k : k + 34], ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS t(k)),
r AS (SELECT s FROM v GROUP BY s HAVING count(*) > 1),
h AS (SELECT DISTINCT rid, p FROM v JOIN r USING (s), unnest(range(k, k + 35)) AS u(p)),
g AS (SELECT rid, count(*) AS n FROM h GROUP BY rid),
p AS (SELECT d.rid, t.p, w[t.p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
q AS (SELECT p.rid, string_agg(x, ' ' ORDER BY p.p) AS kept FROM p LEFT JOIN h ON h.rid = p.rid AND h.p = p.p WHERE h.p IS NULL GROUP BY p.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (rid) LEFT JOIN q USING (rid)
"""
