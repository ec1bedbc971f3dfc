import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryweb.llm import suffix_tree
from quarryweb.llm.slices import gathered
from quarryweb.llm.suffix_tree import END, START, last_word, longer, op3_lm_scoring, score_texts, train, words_in
from quarryweb.llm.words import word_hash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.01"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if w] + ["\n"]


def test_base_and_gain_on_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    c = Counter(w for d, t in docs.items() if not held[d] for w in words(t))
    n, v = sum(c.values()), len(c)
    rows = {r.doc_id: r for r in op3_lm_scoring(spark, SF).collect()}
    assert set(rows) == set(docs)
    base, score = {True: 0.0, False: 0.0}, {True: 0.0, False: 0.0}
    for d, r in rows.items():
        w = words(docs[d])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(x in c for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        base[r.held_out] += r.base_score
        score[r.held_out] += r.score
    assert score[True] > base[True] * 0.99 and score[False] > base[False] * 0.99
    assert score[True] > base[True]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "A a a b"), (2, "A a a b"), (3, "x " * 50_000)], "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("word", F.lit("q")).withColumn("_text_hash", F.lit(7))
    tree = train(df)
    got = score_texts(df, tree)
    assert got.columns == ["doc_id", "text", "word", "_text_hash", "n_tokens", "n_known", "base_score", "score"]
    rows = got.collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 5, 5, 50_001] and all(r.n_known == r.n_tokens and r.score < 0 for r in rows)
    empty = train(df.limit(0))
    far = score_texts(df, empty).collect()
    assert len(far) == 5 and all(r.n_known == 0 and r.base_score == pytest.approx(0) for r in far)
    assert score_texts(df.limit(0), tree).count() == 0


def test_words_of_any_bytes():
    texts = ["", None, "  a\tB\x0bc\x0cd\r\n", "É é É", "x" * 3000, "\u00a0 \u2003 a\x1cb", "one", " ", "t w" * 500]
    for piece in (16, 64, 1 << 20):
        got, starts = [], []
        for first, n, h, begin in words_in(pa.array(texts), piece):
            assert first == len(starts) and n == len(begin)
            starts += [len(got) + b for b in begin.tolist()]
            got += h.tolist()
        want = []
        for t in texts:
            want += [int(START), *(int(word_hash(w)) for w in (t or "").encode().lower().split()), int(END)]
        assert got == want and [got[s] for s in starts] == [int(START)] * len(texts)
    assert word_hash(b"Ab") == word_hash(b"aB") != word_hash(b"ba")
    context, word = np.random.default_rng(1).integers(0, 1 << 63, (2, 1000)).astype(np.uint64)
    assert (last_word(longer(context, word), context) == word).all()


def reference(texts, most):
    """Log10 scores of texts under the tree that they train, context by context, and the length of its longest."""
    seqs = [[None, *words(t)] for t in texts]
    c = Counter(w for s in seqs for w in s[1:])
    n, v = sum(c.values()), len(c)
    nexts, dist, keep = {}, {}, set()
    for depth in range(1, most + 1):
        nexts[depth] = {}
        for s in seqs:
            for i in range(depth, len(s)):
                nexts[depth].setdefault(tuple(s[i - depth : i]), Counter())[s[i]] += 1
        for ctx, follow in nexts[depth].items():
            size = sum(follow.values())
            p = {w: (k - 0.5) / size for w, k in follow.items() if k >= suffix_tree.LEAST}
            if not p:
                continue
            before = {w: dist[ctx[1:]][0][w] if depth > 1 else (c[w] + 0.5) / (n + 0.5 * (v + 1)) for w in p}
            rest, rest_before = 1 - sum(p.values()), 1 - sum(before.values())
            dist[ctx] = p, math.log(rest / rest_before)
            assert 0 < rest < 1 and sum(p.values()) + math.exp(dist[ctx][1]) * rest_before == pytest.approx(1)
            if size * (sum(p[w] * math.log(p[w] / before[w]) for w in p) + rest * math.log(rest / rest_before)) > 0.5 * len(p) * math.log(size):
                keep |= {ctx[i:] for i in range(depth)}
    out = []
    for s in seqs:
        log = 0.0
        for i in range(1, len(s)):
            ctx = next((k for d in range(depth, 0, -1) if d <= i and (k := tuple(s[i - d : i])) in keep), ())
            while ctx and s[i] not in dist[ctx][0]:
                log += dist[ctx][1]
                ctx = ctx[1:]
            log += math.log(dist[ctx][0][s[i]] if ctx else (c[s[i]] + 0.5) / (n + 0.5 * (v + 1)))
        out.append(log / math.log(10))
    return out, max(map(len, keep), default=0)


def same_as_reference(spark, texts, depth=10, asked=None):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tree = train(df, depth=depth)
    got = {r.doc_id: r.score for r in score_texts(df, tree).collect()}
    want, deepest = reference(texts, depth)
    assert [got[i] for i in range(len(texts))] == pytest.approx(want)
    assert max([d for d, n in enumerate(tree.contexts, 1) if n], default=0) == deepest
    return deepest


@pytest.mark.parametrize("share", [None, 0.02, 1.0])
def test_whole_tree_whatever_is_sent(spark, monkeypatch, share):
    # What follows the shared words of family d is told by the word d places before it.
    texts = [f"{a}{d} {' '.join(f's{d}{j}' for j in range(d - 1))} {b}{d} r{i * 7 % 5}" for d in range(1, 7) for i in range(12) for a, b in (("x", "y"), ("z", "q"))]
    if share:
        monkeypatch.setattr(suffix_tree, "SHARE", share)
    assert same_as_reference(spark, texts) >= 6
    assert same_as_reference(spark, texts, depth=4) == 4
    assert same_as_reference(spark, texts, depth=1) == 1


def test_many_slices_and_small_gatherings(spark, monkeypatch):
    for name, value in (("SLICE_BYTES", 3000), ("GATHERED", 500), ("VALUE_SLICES", 2), ("SHARE", 0.003)):
        monkeypatch.setattr(suffix_tree, name, value)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    assert same_as_reference(spark, texts, depth=4) == 4


def test_hot_texts_and_runs(spark):
    # A third of all rows is one text; a run of one word fills others.
    texts = ["same words again and again"] * 60 + ["x " * 300, "x x y " * 100, *(f"x x r{i}" for i in range(60))]
    same_as_reference(spark, texts, depth=4)


def test_repeated_pairs_count_in_a_large_corpus(spark):
    filler = spark.range(1200).select(F.expr("array_join(transform(sequence(1, 1000), x -> concat('w', (id * 1000 + x) % 400000)), ' ')").alias("text"))
    rare = spark.createDataFrame([("lorem ipsum",)] * 5, "text string")
    tree = train(filler.union(rare))
    row = score_texts(rare.limit(1), tree).first()
    assert row.score > row.base_score + 5


def test_gathering_does_not_hold_columns_twice():
    rng = np.random.default_rng(5)
    n = 250_000
    parts = []
    for _ in range(8):
        key = rng.integers(0, n, n).astype(np.uint64)
        parts.append([key, np.ones(n, np.int64), key + np.uint64(1), key + np.uint64(2)])
    want = Counter(np.concatenate([p[0] for p in parts]).tolist())
    tracemalloc.start()
    held = [[x.copy() for x in p] for p in parts]
    before = tracemalloc.get_traced_memory()[0]
    key, count, (one, two) = gathered(held, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(key.tolist(), count.tolist(), strict=True)) == want and key.tolist() == sorted(want)
    assert (one == key + np.uint64(1)).all() and (two == key + np.uint64(2)).all()
    assert not held and peak < 1.6 * before
