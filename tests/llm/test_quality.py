import itertools
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from quarryweb.llm.common import id_fold
from quarryweb.llm.quality import LineModel, _forward_backward, chain_features, document_lines, fit, op9_quality_classifier, score_quality, train


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        scores, step = rng.normal(size=n).tolist(), rng.normal(size=(2, 2))
        weight = {y: math.exp(sum(s for s, v in zip(scores, y, strict=True) if v) + sum(step[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=n)}
        z = sum(weight.values())
        good, pairs, log_z = _forward_backward(scores, step)
        assert np.isclose(log_z, math.log(z))
        for i in range(n):
            assert np.isclose(good[i], sum(w for y, w in weight.items() if y[i]) / z)
        for i, p in enumerate(pairs):
            assert np.allclose(np.reshape(p, (2, 2)), [[sum(w for y, w in weight.items() if (y[i], y[i + 1]) == (a, b)) / z for b in (0, 1)] for a in (0, 1)])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op9_quality_classifier(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(rows[d], y) for d, y in labels.items() if d in rows and rows[d].held_out]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert {y for _, y in held} == {0, 1}
    for label in (0, 1):
        hits = [r.predicted == y for r, y in held if y == label]
        assert sum(hits) / len(hits) >= 0.97


def test_odd_rows_and_degenerate_labels(spark):
    model = LineModel(np.zeros(42), np.zeros((2, 2)), (1.0, 0.0))
    long = "a line\n" * 50_000
    df = spark.createDataFrame([(1, None), (None, ""), (2, "\n \n"), (2, long), (2, "é\n|||")], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = score_quality(df, model, out_col="quality_score")
    assert got.columns == ["doc_id", "text", "score", "quality_score"] and {r.quality_score for r in got.collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (1, 1), (2, 7)], "doc_id long, quality int")
    one = fit(df, labels)
    assert one.score("anything") > 0.99 and fit(df.limit(0), labels).score("x") == 0.5
    assert score_quality(df.limit(0), one).count() == 0
    assert document_lines(None) == [b""] and chain_features([b"", b"x"]).shape == (2, 42)
    assert train([]).score(None) == 0.5


def test_bounded_sample_keeps_the_share_of_labels(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words in a line").alias("text"))
    labels = df.select("doc_id", (F.col("doc_id") % 10 > 0).cast("int").alias("quality"))
    for documents in (20, 1000):
        assert abs(fit(df, labels, documents=documents).score("some words in a line") - 0.9) < 0.01


def test_repeated_labelled_id_sends_one_row_of_bounded_size(spark):
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("same id, text "), F.col("id") % 7).alias("text"))
    wide = spark.createDataFrame([(2, "x" * 3_000_000), (3, "||| ###\n" * 30_000), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    model = fit(rows.union(wide), labels)
    assert model.score("same id, text 3") > 0.5 > model.score("||| ###\n" * 3)


def test_every_score_equals_a_product_of_matrices(spark, sf_dir):
    """The whole query against each document's marginals from explicit transfer matrices."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    part = id_fold("doc_id", 3) != 1
    model = fit(docs.where(part), labels.where(part))
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in op9_quality_classifier(spark, sf_dir).collect():
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if x.strip(" \t\r\v\f")] or [""]
        scores = chain_features([x.encode() for x in lines]) @ model.emit
        after = [np.ones(2)]
        for s in scores[:0:-1]:
            v = np.exp(model.step) @ (np.exp([0, s]) * after[-1])
            after.append(v / v.sum())
        before, mean, size = np.ones(2), 0.0, 0
        for i, (line, s) in enumerate(zip(lines, scores, strict=True)):
            here = np.exp([0, s]) * (before @ np.exp(model.step) if i else before)
            before = here / here.sum()
            p = before * after[len(lines) - 1 - i]
            mean, size = mean + p[1] / p.sum() * (len(line.encode()) + 1), size + len(line.encode()) + 1
        a, b = model.scale
        want = 1 / (1 + math.exp(-max(-30, min(30, a * (mean / size - 0.5) + b))))
        assert r.held_out == held[r.doc_id] and math.isclose(r.score, want, rel_tol=1e-6, abs_tol=1e-9) and r.predicted == int(r.score >= 0.5)
