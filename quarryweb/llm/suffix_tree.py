"""Language-model scores from a probabilistic suffix tree over words.

The root knows every word of the corpus. Below it are contexts of one to DEPTH
words. A context lists each next word that follows it at least LEAST times. It
is kept if its next-word distribution diverges from that of its suffix by more
than its parameters cost (half the log of its count each, as in minimum
description length), or if it is the suffix of one that is kept; each context
is tested on its own. Distributions are smoothed by absolute discounts; what
they leave goes to the words they do not list, in the suffix's proportions. A
word is scored in the longest context that the tree has for the words before
it.

Counts cover the whole corpus, and LEAST does not depend on its size, so the
tree grows with the input. Runs of words are counted in two steps: each task
sorts its runs and sends every different one once, with its count, in blobs
for slices of the range of their hashes; a slice then adds up the counts. So
no run is a hot key, however often it occurs. A run can only be frequent if
the shorter runs in it are, which a filter of fixed size tells (it drops no
run that is; when the corpus outgrows it, it just tells less).

A word that a context lists is listed by all its suffixes too, so a score is
the root's plus a sum over the runs of words in the text of one value a run:
what it adds as a context and as a listed word. Runs with a share of SHARE of
the corpus (so at most 1 / SHARE of each length) are sent to every task; all
others are looked up slice by slice. Runs are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryweb.llm.common import bounded_batches, discard, free_name, give_back, id_fold, table, written
from quarryweb.llm.slices import ENTRIES, ROW, blobs, by_part, dealt, filter_of, gathered, may_have, pack, row, segment, slice_of, unpack
from quarryweb.llm.words import PIECE, hashed_words, word_hash

#: The most words of a context.
DEPTH = 4
#: Contexts' listed next words have at least this count.
LEAST = 3
DISCOUNT = 0.5
#: Runs with this share of the corpus are sent to every task; it does not bound the tree.
SHARE = 5e-7
#: Bytes of text for each slice of run hashes in counting; slices of values are for more, as they hold fewer runs.
SLICE_BYTES, VALUE_SLICES = 5 << 20, 8
#: Runs that a task gathers before it sends them.
GATHERED = 1_000_000
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
_UNMIX = pow(_MIX[1], -1, 1 << 64)
#: Stand before the first word of each text, in contexts only, and after its last. No word holds a line feed.
START, END = word_hash(b"\n\n"), word_hash(b"\n")


def longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of runs of words with one more word; the empty run is 0."""
    x = key * np.uint64(_MIX[0]) + word
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(32))


def last_word(key: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The word by which a run is longer than its context."""
    x = (key ^ (key >> np.uint64(32))) * np.uint64(_UNMIX)
    x = x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))
    return x - context * np.uint64(_MIX[0])


def words_in(texts: pa.Array, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, hashes, starts) of groups of texts; hashes: START, the words and END of each text; starts: the places of START."""
    for first, words, cuts in hashed_words(texts, True, piece):
        n = len(cuts) - 1
        each = np.diff(cuts)
        starts = np.concatenate([[0], np.cumsum(each + 2)])
        hashes = np.full(len(words) + 2 * n, END)
        hashes[starts[:-1]] = START
        hashes[np.arange(len(words)) + 2 * np.repeat(np.arange(n), each) + 1] = words
        yield first, n, hashes, starts[:-1]


def _places(size: int, starts: np.ndarray) -> np.ndarray:
    return np.arange(size) - np.repeat(starts, np.diff(np.append(starts, size)))


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, x.dtype), x[:-1]])


def _counted(texts: DataFrame, depths: range, slices: int, known) -> DataFrame:
    """(depth, context, suffix, word, key, count) of runs of depth + 1 words: all of depth 0 and those of others with LEAST and more.

    Rows with a depth below zero are segments of the filter of the runs of the
    last depth. known: the filter of the runs of depths[0] words, for depths
    above 1.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {d: [] for d in depths}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for depth, parts in held.items():
                if parts:
                    key, count, rest = gathered(parts, False)
                    yield from blobs(depth, key, [count, *rest], slices)

        for batch in batches:
            for _, _, h, starts in words_in(batch.column(0)):
                place = _places(len(h), starts)
                key = np.zeros(len(h), np.uint64)
                shorter = key
                for depth in range(depths[-1] + 1):
                    context, suffix = _before(key) if depth else key, _before(shorter)
                    key, shorter = longer(context, h), key
                    here = place >= max(1, depth)
                    if known is not None:
                        # A run is frequent only if all runs of depths[0] words in it are.
                        if depth == depths[0] - 1:
                            may = here & may_have(known.value, key)
                            alive = may
                        elif depth in depths:
                            alive = may & np.append(False, alive[:-1])
                            here &= alive
                    if depth in depths:
                        at = np.flatnonzero(here)
                        columns = [key[at], context[at], suffix[at]]
                        held[depth].append(columns[: min(3, depth + 1)])
                        size += len(at)
            if size > GATHERED:
                size = 0
                yield from out()
        yield from out()
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # by depth: what is not added up, its size, and how large that may be
        at = None

        def close() -> Iterator[pa.RecordBatch]:
            for depth in sorted(held):
                key, count, rest = gathered(held.pop(depth)[0], True)
                if depth:
                    often = count >= LEAST
                    key, count, rest = key[often], count[often], [x[often] for x in rest]
                none = np.zeros(len(key), np.uint64)
                context, suffix = [*rest, none, none][:2]
                word = last_word(key, context)
                for i in range(0, len(key), 100_000):
                    s = slice(i, i + 100_000)
                    n = len(key[s])
                    signed = [pa.array(x[s].view(np.int64)) for x in (context, suffix, word, key)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, depth, np.int32)), *signed, pa.array(count[s]), pa.nulls(n, pa.binary())], names)
                if depth == depths[-1] and depth:
                    low, bits = segment(key, at, slices)
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([low], pa.int64()), *[pa.nulls(1, pa.int64())] * 4, pa.array([bits.tobytes()], pa.binary())], names)

        for part, depth, data in by_part(batches):
            if part != at:
                yield from close()
                at = part
            of = held.setdefault(depth, [[], 0, GATHERED])
            of[0].append(unpack(data, "ui" + "u" * min(2, depth)))
            of[1] += len(of[0][-1][0])
            if of[1] > of[2]:
                key, count, rest = gathered(of[0], True)
                of[:] = [[[key, count, *rest]], 0, max(GATHERED, len(key))]
        yield from close()
        give_back()

    names = ["depth", "context", "suffix", "word", "key", "count", "bits"]
    return dealt(texts.mapInArrow(runs, ROW), slices).mapInArrow(merge, "depth int, context long, suffix long, word long, key long, count long, bits binary")


def _root(counts: np.ndarray, total: int, distinct: int) -> np.ndarray:
    return np.log((counts + 0.5) / (total + 0.5 * (distinct + 1)))


@dataclass
class Tree:
    """What scoring needs. often: (sorted keys, values, word counts) of the runs that are sent; filter: of the others, which `values` has by slices."""

    total: int
    distinct: int
    often: tuple[np.ndarray, np.ndarray, np.ndarray]
    filter: np.ndarray
    slices: int
    values: DataFrame | None = None
    #: Number of kept contexts of each length.
    contexts: tuple[int, ...] = ()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"values": None}

    def root(self, counts: np.ndarray) -> np.ndarray:
        return _root(counts, self.total, self.distinct)


def _contexts(counts: DataFrame, total: int, distinct: int, documents: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Written (rows of frequent runs with n, their context's count, and before, the suffix's probability; kept contexts)."""
    spark = counts.sparkSession
    start = spark.createDataFrame([(int(longer(np.zeros(1, np.uint64), np.array([START])).view(np.int64)[0]), documents)], "key long, n long")
    sizes = counts.where((F.col("depth") >= 0) & (F.col("depth") < depth) & (F.col("count") >= LEAST)).select("key", F.col("count").alias("n")).union(start)
    rows = counts.where("depth > 0").drop("bits")
    rows = written(rows.join(sizes.withColumnRenamed("key", "_of"), F.col("context") == F.col("_of")).drop("_of"), "suffix-rows")
    p = (F.col("count") - DISCOUNT) / F.col("n")
    root = counts.where((F.col("depth") == 0) & (F.col("count") >= LEAST))
    root = root.select(F.lit(0).cast("long").alias("_s"), F.col("word").alias("_w"), ((F.col("count") + 0.5) / F.lit(total + 0.5 * (distinct + 1))).alias("before"))
    shorter = root.unionByName(rows.where(F.col("depth") < depth).select(F.col("context").alias("_s"), F.col("word").alias("_w"), p.alias("before")))
    told = written(rows.join(shorter, (F.col("suffix") == F.col("_s")) & (F.col("word") == F.col("_w"))).drop("_s", "_w", "word"), "suffix-told")
    discard(rows)
    sums = told.groupBy("context").agg(
        F.first("depth").alias("depth"),
        F.first("suffix").alias("suffix"),
        F.first("n").alias("n"),
        F.count("*").alias("listed"),
        F.sum(p).alias("p"),
        F.sum("before").alias("before"),
        F.sum(p * F.log(p / F.col("before"))).alias("gain"),
    )
    rest, rest_before = (F.greatest(1 - F.col(c), F.lit(1e-12)) for c in ("p", "before"))
    gain = F.col("n") * (F.col("gain") + rest * F.log(rest / rest_before))
    cost = 0.5 * F.col("listed") * F.log(F.greatest(F.col("n"), F.lit(2)))
    tested = written(sums.select("context", "depth", "suffix", "n", F.log(rest / rest_before).alias("alpha"), (gain > cost).alias("keep")), "suffix-tested")
    # Suffixes of kept contexts are kept.
    kept = [tested.where((F.col("depth") == depth) & F.col("keep"))]
    for d in range(depth - 1, 0, -1):
        longer_kept = kept[-1].select(F.col("suffix").alias("_s")).distinct()
        level = tested.where(F.col("depth") == d).join(longer_kept, F.col("context") == F.col("_s"), "left").where("keep or _s is not null").drop("_s")
        kept.append(written(level, "suffix-kept"))
    every = kept[0]
    for level in kept[1:]:
        every = every.unionByName(level)
    return told, written(every.select("context", "depth", "n", "alpha"), "suffix-contexts")


def _values(entries: DataFrame, slices: int, often: float) -> DataFrame:
    """Written rows by slice of (key, value, count, word count): 0, the blobs of runs; 1, those sent to every task; 2, (as part) the segments of the filter of the first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            order = np.argsort(columns[0])
            yield from blobs(0, columns[0][order], [x[order] for x in columns[1:]], slices)

        for batch in batches:
            if batch.num_rows:
                columns = [c.to_numpy() for c in batch.columns]
                held.append([columns[0].view(np.uint64), *columns[1:]])
                size += batch.num_rows
            if size > GATHERED:
                size = 0
                yield from out()
        if held:
            yield from out()
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            parts.clear()
            order = np.argsort(columns[0])
            key, value, count, word = (x[order] for x in columns)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, value, count, word = key[first], np.add.reduceat(value, first), np.maximum.reduceat(count, first), np.maximum.reduceat(word, first)
            sent = count >= often
            yield row(at, 1, pack(key[sent], value[sent], word[sent]))
            key, value, word = key[~sent], value[~sent], word[~sent]
            for i in range(0, len(key), ENTRIES):
                s = slice(i, i + ENTRIES)
                yield row(at, 0, pack(key[s], value[s], word[s]))
            low, bits = segment(key, at, slices)
            yield row(low, 2, bits.tobytes())

        for part, _, data in by_part(batches):
            if part != at and parts:
                yield from close()
            at = part
            parts.append(unpack(data, "ufii"))
        if parts:
            yield from close()
        give_back()

    return written(dealt(entries.mapInArrow(cut, ROW), slices).mapInArrow(merge, ROW), "suffix-values")


def train(docs: DataFrame, text_col: str = "text", depth: int = DEPTH) -> Tree:
    """The tree of all texts of docs (null: empty); docs is read once for the sizes, and once for each of about depth - 1 lengths."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, math.ceil(size / SLICE_BYTES))
    steps = [range(0, 2), *([range(2, 3)] if depth > 1 else []), *([range(3, depth + 1)] if depth > 2 else [])]
    known, counts = None, None
    for depths in steps:
        table_ = written(_counted(texts, depths, slices, known), "suffix-counts")
        counts = table_ if counts is None else counts.unionByName(table_)
        if known is not None:
            known.destroy()
        if depths is not steps[-1]:
            known = spark.sparkContext.broadcast(filter_of([(r[0], r[1]) for r in table_.where("depth < 0").select("context", "bits").collect()]))
    counts = counts.where("depth >= 0")
    words = counts.where("depth = 0")
    end = int(END.view(np.int64))
    total, distinct, documents = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == end, F.col("count"))), F.lit(0))).first()
    told, contexts = _contexts(counts, total, distinct, documents, depth)

    none = F.lit(0).cast("long")
    listed = told.join(contexts.select(F.col("context").alias("_of"), "alpha"), F.col("context") == F.col("_of"))
    entries = listed.select("key", (F.log((F.col("count") - DISCOUNT) / F.col("n")) - F.log("before") - F.col("alpha")).alias("value"), "count", none.alias("word"))
    entries = entries.unionAll(contexts.select("context", "alpha", "n", none)).unionAll(words.select("key", F.lit(0.0), "count", "count"))
    by_value = max(1, slices // VALUE_SLICES)
    values = _values(entries, by_value, max(1, SHARE * total))
    shape = dict(contexts.groupBy("depth").count().collect())
    discard(counts, told, contexts)
    parts = [unpack(bytes(r[0]), "ufi") for r in values.where("kind = 1").select("data").collect()]
    key, value, word = map(np.concatenate, zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64))
    order = np.argsort(key)
    bits = filter_of([(r[0], r[1]) for r in values.where("kind = 2").select("part", "data").collect()])
    return Tree(int(total), int(distinct), (key[order], value[order], word[order]), bits, by_value, values.where("kind = 0"), tuple(shape.get(d, 0) for d in range(1, depth + 1)))


def _looked(texts: DataFrame, shared, depth: int) -> DataFrame:
    """Of (hash, text): blobs of kind 1, the runs to look up, with their texts, and of kind 2, what each text has without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        keys, values, counts = tree.often
        roots = np.where(counts > 0, tree.root(counts), 0.0)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sent, size, turn = 0, 0, TaskContext.get().partitionId()

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, sent, turn
            key, of, names = ([x[i] for x in held] for i in range(3))
            first = np.concatenate([[0], np.cumsum([len(x) for x in names])])
            key, of, names = np.concatenate(key), np.concatenate([x + f for x, f in zip(of, first[:-1], strict=True)]), np.concatenate(names)
            held = []
            order = np.argsort(key)
            key, of = key[order], of[order]
            part = slice_of(key, tree.slices)
            cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                for i in range(a, b, ENTRIES):
                    s = slice(i, min(b, i + ENTRIES))
                    told, at = np.unique(of[s], return_inverse=True)
                    yield row(int(part[a]), 1, b"".join([len(told).to_bytes(8, "little"), pack(names[told]), pack(key[s]), pack(at.astype(np.int64))]))

        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            for first, n, h, starts in words_in(batch.column(1)):
                place, of = _places(len(h), starts), np.repeat(np.arange(n), np.diff(np.append(starts, len(h))))
                known, base, extra = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
                run_key, alive, wanted = np.zeros(len(h), np.uint64), np.ones(len(h), bool), []
                for d in range(depth + 1):
                    run_key = longer(_before(run_key) if d else run_key, h)
                    here = np.flatnonzero(alive & (place >= d))
                    key = run_key[here]
                    order = np.argsort(key)
                    key, doc = key[order], of[here[order]]
                    at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                    hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
                    extra += np.bincount(doc[hit], values[at[hit]], n)
                    ask = ~hit
                    if d:
                        ask &= may_have(tree.filter, key)
                        # A run is in the tree only if the run without its first word is.
                        alive = np.zeros(len(h), bool)
                        alive[here[order[hit | ask]]] = True
                    else:
                        base += np.bincount(doc[hit], roots[at[hit]], n)
                        known += np.bincount(doc[hit], counts[at[hit]] > 0, n).astype(np.int64)
                    wanted.append((key[ask], doc[ask]))
                names = hashes[first : first + n]
                held.append((np.concatenate([w[0] for w in wanted]), np.concatenate([w[1] for w in wanted]), names))
                sent += len(held[-1][0])
                words = np.diff(np.append(starts, len(h))) - 1
                yield row(turn % tree.slices, 2, pack(names, words, known, base, extra))
                turn += 1
            if sent > GATHERED // 3:
                sent = 0
                yield from out()
        if held:
            yield from out()
        give_back()

    return texts.mapInArrow(run, ROW)


def _answered(rows: DataFrame, total: int, distinct: int, slices: int) -> DataFrame:
    """(hash, copies, n, known, base, extra): parts of the sums of the texts of a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, values = None, [], None

        def batch_of(name, copies, n, known, base, extra) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), *[pa.array(x, pa.int64()) for x in (copies, n, known)], pa.array(base, pa.float64()), pa.array(extra, pa.float64())], names)

        for part, kind, data in by_part(batches):
            if part != at:
                at, held, values = part, [], None
            if kind == 0:
                held.append(unpack(data, "ufi"))
            elif kind == 2:
                name, n, known, base, extra = unpack(data, "uiiff")
                yield batch_of(name, np.ones(len(name), np.int64), n, known, base, extra)
            else:
                if values is None:
                    values = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)]
                    order = np.argsort(values[0])
                    values, held = [x[order] for x in values], []
                size = int.from_bytes(data[:8], "little")
                (name,) = unpack(data[8 : 8 + 8 * size], "u")
                key, doc = unpack(data[8 + 8 * size :], "ui")
                keys, value, count = values
                place = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                hit = keys[place] == key if len(keys) else np.zeros(len(key), bool)
                place, doc = place[hit], doc[hit]
                is_word = count[place] > 0
                known = np.bincount(doc[is_word], minlength=size)
                base = np.bincount(doc[is_word], _root(count[place[is_word]], total, distinct), size)
                some = np.zeros(size, bool)
                some[doc] = True
                zero = np.zeros(int(some.sum()), np.int64)
                yield batch_of(name[some], zero, zero, known[some], base[some], np.bincount(doc, value[place], size)[some])
        give_back()

    names = ["hash", "copies", "n", "known", "base", "extra"]
    return dealt(rows, slices, by_kind=True).mapInArrow(run, "hash long, copies long, n long, known long, base double, extra double")


def score_texts(df: DataFrame, tree: Tree, text_col: str = "text") -> DataFrame:
    """df with n_tokens, n_known, base_score and score (log10 of the text's probability under the root alone, and under the tree).

    Null and empty texts are the end alone. All rows (equal ones too) and
    other columns stay; columns of the new names are replaced. Texts are told
    apart by 64-bit hashes; the scores of equal texts are worked out apart and
    are one number. df is read twice.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(tree)
    df = df.drop("n_tokens", "n_known", "base_score", "score")
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    looked = _looked(df.select(text.alias("hash"), F.col(text_col).alias("text")), shared, len(tree.contexts))
    sums = _answered(looked.unionAll(tree.values), tree.total, tree.distinct, tree.slices).groupBy("hash").agg(*[F.sum(c).alias(c) for c in ("copies", "n", "known", "base", "extra")])
    of = free_name(df, "_text_hash")
    unknown = float(tree.root(np.zeros(1))[0])
    log10 = F.lit(math.log(10)) * F.col("copies")
    base = F.col("base") + (F.col("n") - F.col("known")) * F.lit(unknown)
    scores = sums.select(
        F.col("hash").alias(f"{of}2"),
        F.expr("n div copies").alias("n_tokens"),
        F.expr("known div copies").alias("n_known"),
        (base / log10).alias("base_score"),
        ((base + F.col("extra")) / log10).alias("score"),
    )
    scores = written(scores, "suffix-scores")
    return df.withColumn(of, text).join(scores, F.col(of) == F.col(f"{of}2"), "left").drop(of, f"{of}2")


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of every document, from a tree of four folds of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", id_fold("doc_id", 5) == 1)
    tree = train(docs.where("not held_out"))
    scored = score_texts(docs, tree)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")
