import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarryweb.llm.substring import _least, op8_substring_dedup, remove_repeats, repeats


def brute(rows, window=35):
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(x[2] for x in want) > 0
    assert got(op8_substring_dedup(spark, sf_dir)) == want


def test_passages_copies_and_odd_rows(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randint(0, 500))
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 80, 200)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            w += p[a : a + rnd.randint(20, 200)] + [word() for _ in range(rnd.randint(0, 3))]
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(w)))
    rows += [(200 + i, rows[5][1]) for i in range(40)] + [(300, ""), (301, None), (302, "x " * 200), (303, "y " * 35), (304, "y " * 36), (None, rows[7][1]), (5, rows[5][1]), (5, rows[5][1]), (305, "é " * 34), (306, "a b " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("begin", F.lit("x")).repartition(6)
    found = remove_repeats(df)
    assert set(found.columns) == {"doc_id", "text", "begin", "n_words", "n_removed", "kept"}
    assert got(found.withColumn("kept_sha256", F.sha2("kept", 256))) == brute(rows)
    assert remove_repeats(df.limit(0)).count() == 0


def test_repeats_are_maximal(spark):
    """Each run is a union of repeated windows that overlap or touch, and the words on both sides of it belong to none."""
    rnd = random.Random(8)
    fresh = lambda n: [f"u{rnd.randint(0, 10**9)}" for _ in range(n)]
    shared = [fresh(n) for n in (35, 60, 200, 34)]
    texts = [" ".join(x for i, p in enumerate(shared) for x in (*fresh(k + i), *p)) for k in (3, 9)] + [" ".join([*shared[2][50:120], *fresh(2)])]
    got = {r.text_hash: [tuple(x) for x in r.runs] for r in repeats(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", F.xxhash64("text").alias("h")).collect()
    words = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    for r in rows:
        w, want = words[r.i], []
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                want = [*want[:-1], (want[-1][0], k + 35)] if want and want[-1][1] >= k else [*want, (k, k + 35)]
        assert got[r.h] == want
    assert sorted(e - b for x in got.values() for b, e in x) == [35, 35, 60, 60, 70, 200, 200]


def test_least_of_windows():
    rng = np.random.default_rng(3)
    for n, width in ((28, 28), (500, 28), (5000, 7), (40, 1)):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1)
        x[rng.integers(0, n, n // 3)] = x[0]
        want = np.lib.stride_tricks.sliding_window_view(x >> np.uint64(20), width).argmin(axis=1) + np.arange(n - width + 1)
        assert (_least(x, width) == want).all()
    long = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    want = np.lib.stride_tricks.sliding_window_view(long >> np.uint64(9), 28).argmin(axis=1) + np.arange(2973)
    assert (_least(long, 28, 512) == want).all()
