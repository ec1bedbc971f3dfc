"""Document quality from lines: a linear-chain conditional random field labels every line good or bad.

A line's features are its own and those of the lines before and after it. The
weights are trained by the exact gradient of the chain's likelihood, where
every line of a labelled document has the document's label. A document's
quality is the mean of its lines' forward-backward marginals, weighted by
length, put on the scale of the labels by a logistic curve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryweb.llm.common import bounded_batches, id_fold, table

#: The most labelled documents of each label that the model is fitted on: those with the least hash of their id.
TRAINING_DOCUMENTS = 1000
#: Long labelled documents are whole in scoring; in fitting, one document gives at most this many lines, which follow each other.
TRAINING_LINES = 200

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_SPACE = b" \t\r\v\f"
_STOPS = b".,;:?'\"-()"
_ALL = bytes(range(256))


def _without(keep: bytes) -> bytes:
    return bytes(b for b in _ALL if b not in keep)


_NOT_UPPER, _NOT_LOWER, _NOT_DIGIT, _NOT_STOP, _NOT_MARK, _NOT_ODD = (_without(x) for x in (_UPPER, _LOWER, _DIGITS, _STOPS, b"!", b"|#$%&*<>{}[]=+\\/^~@_`"))
N_OWN = 14


def line_features(line: bytes) -> list[float]:
    """Shares and shapes of one line, each about 0 to 1."""
    size = len(line) or 1
    words = line.split()
    n = len(words) or 1
    upper = len(line.translate(None, _NOT_UPPER))
    lower = len(line.translate(None, _NOT_LOWER))
    return [
        1.0,
        min(1.0, math.log1p(len(line)) / 8),
        upper / size,
        lower / size,
        len(line.translate(None, _NOT_DIGIT)) / size,
        len(line.translate(None, _NOT_STOP)) / n,
        len(line.translate(None, _NOT_MARK)) / n,
        len(line.translate(None, _NOT_ODD)) / n,
        min(1.0, size / n / 20),
        1.0 - len(set(words)) / n,
        float(line[-1:] in b".!?" and line[-1:] != b""),
        float(line[:1].isupper() or line[:1] > b"\x7f"),
        min(1.0, n / 40),
        sum(len(w) == 1 for w in words) / n,
    ]


def document_lines(text: str | None) -> list[bytes]:
    """The lines of a text that are not blank; an empty text is one empty line."""
    lines = [x for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
    return lines or [b""]


def chain_features(lines: list[bytes]) -> np.ndarray:
    """Features of each line, then those of the line before and the line after it (zero at the ends)."""
    return _chained(np.array([line_features(x) for x in lines]))


def _chained(own: np.ndarray) -> np.ndarray:
    none = np.zeros((1, N_OWN))
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])])


@dataclass(frozen=True)
class Example:
    """A labelled document for fitting: chain features of its lines, or of some that follow each other, and their lengths."""

    features: np.ndarray
    weights: np.ndarray
    label: int


def example(lines: list[bytes], label: int) -> Example:
    return Example(chain_features(lines), np.array([len(x) + 1 for x in lines]), label)


@dataclass(frozen=True)
class LineModel:
    """emit: weights of label good against bad; step[a, b]: of label b after a; scale: logistic curve of the mean marginal."""

    emit: np.ndarray
    step: np.ndarray
    scale: tuple[float, float]
    even: float = 0.5

    def marginals(self, features: np.ndarray) -> list[float]:
        """P(good) of each line by forward-backward."""
        return _forward_backward((features @ self.emit).tolist(), self.step)[0]

    def mean(self, lines: list[bytes]) -> float:
        return self.weighted(example(lines, 0))

    def weighted(self, of: Example) -> float:
        """The lines' marginals, weighted by length."""
        p, weight = self.marginals(of.features), of.weights.tolist()
        return sum(a * w for a, w in zip(p, weight, strict=True)) / sum(weight)

    def score(self, text: str | None) -> float:
        a, b = self.scale
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * (self.mean(document_lines(text)) - 0.5) + b))))


def _forward_backward(scores: list[float], step: np.ndarray) -> tuple[list[float], list[tuple[float, float, float, float]], float]:
    """Marginals of label 1, pairwise marginals of neighbours, and the log of the normaliser; scaled, so long chains are safe."""
    (s00, s01), (s10, s11) = np.exp(step).tolist()
    n, log_z = len(scores), 0.0
    forward = []
    a0 = a1 = 0.0
    for i, s in enumerate(scores):
        m = max(0.0, s)
        e0, e1 = math.exp(-m), math.exp(s - m)
        x, y = (e0, e1) if not i else ((a0 * s00 + a1 * s10) * e0, (a0 * s01 + a1 * s11) * e1)
        z = x + y
        a0, a1 = x / z, y / z
        log_z += math.log(z) + m
        forward.append((a0, a1))
    good, pairs = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * (n - 1)
    b0 = b1 = 1.0
    for i in range(n - 1, -1, -1):
        a0, a1 = forward[i]
        x, y = a0 * b0, a1 * b1
        good[i] = y / (x + y)
        if i:
            m = max(0.0, scores[i])
            e0, e1 = math.exp(-m) * b0, math.exp(scores[i] - m) * b1
            p0, p1 = forward[i - 1]
            w = (p0 * s00 * e0, p0 * s01 * e1, p1 * s10 * e0, p1 * s11 * e1)
            z = sum(w)
            pairs[i - 1] = tuple(v / z for v in w)
            b0, b1 = s00 * e0 + s01 * e1, s10 * e0 + s11 * e1
            z = b0 + b1
            b0, b1 = b0 / z, b1 / z
    return good, pairs, log_z


def train(documents: list[Example], rounds: int = 60, decay: float = 1e-3, stands_for: tuple[float, float] = (1.0, 1.0)) -> LineModel:
    """Fits the chain by gradient steps with running scales (Adam), then the curve on the documents' mean marginals.

    Classes are weighted to count alike in the chain; for the curve a document
    of label y counts as the `stands_for[y]` that it was chosen from. Without documents of both labels
    every score is the share of label 1 (one half without any).
    """
    labels = np.array([d.label for d in documents], float)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return LineModel(np.zeros(3 * N_OWN), np.zeros((2, 2)), (0.0, math.log(share / (1 - share))))
    chains = [d.features for d in documents]
    emit, step = np.zeros(3 * N_OWN), np.zeros((2, 2))
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    stacked = np.vstack(chains)
    ends = np.cumsum([len(c) for c in chains])
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(step), np.zeros_like(step)]
    for k in range(1, rounds + 1):
        scores, g_step, residual, at = (stacked @ emit).tolist(), np.zeros((2, 2)), np.empty(len(stacked)), 0
        for end, y, w in zip(ends.tolist(), labels.tolist(), weight.tolist(), strict=True):
            good, pairs, _ = _forward_backward(scores[at:end], step)
            residual[at:end] = (y - np.array(good)) * (w / (end - at))
            if pairs:
                seen = np.array(pairs).mean(axis=0).reshape(2, 2)
                g_step[int(y), int(y)] += w / 2
                g_step -= seen * w / 2
            at = end
        g_emit = residual @ stacked / len(labels) - decay * emit
        g_step = g_step / len(labels) - decay * step
        for i, (g, v) in enumerate(((g_emit, emit), (g_step, step))):
            m, s = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += 0.25 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    model = LineModel(emit, step, (1.0, 0.0))
    x = np.array([model.weighted(d) for d in documents]) - 0.5
    a, b = 4.0, 0.0
    each = np.where(labels > 0, stands_for[1], stands_for[0])
    each *= len(each) / each.sum()
    for _ in range(200):  # Newton's steps of a slightly damped logistic regression
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h = each * p * (1 - p)
        g = np.array([(each * (labels - p)) @ x - 0.02 * a, (each * (labels - p)).sum() - 0.001 * b])
        m = np.array([[(h * x * x).sum() + 0.02, (h * x).sum()], [(h * x).sum(), h.sum() + 0.001]])
        d = np.linalg.solve(m, g)
        a, b = a + float(np.clip(d[0], -2, 2)), b + float(np.clip(d[1], -2, 2))
        if abs(d).max() < 1e-9:
            break
    return LineModel(emit, step, (a, b))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", documents: int = TRAINING_DOCUMENTS) -> LineModel:
    """A model from at most `documents` labelled documents of each label, those with the least hash of their id.

    Null ids, and labels other than 0 and 1 take no part; a document with
    several labels has the least, and of rows of docs that share an id the one
    with the least hash of its text. Tasks send features of at most
    TRAINING_LINES + 2 lines of a document, never its text, so what comes to
    the driver is bounded in rows and bytes however often an id repeats.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    order = F.xxhash64("_id")
    sizes = dict(known.where("_id is not null").groupBy("_label").count().collect())
    stands_for = (max(1.0, sizes.get(0, 0) / documents), max(1.0, sizes.get(1, 0) / documents))
    ids = [known.where(F.col("_label") == y).orderBy(order, "_id").limit(documents) for y in (0, 1)]
    # The bound makes the chosen ids small enough to send to every task that reads documents.
    chosen = F.broadcast(ids[0].unionByName(ids[1]))
    rows = docs.join(chosen, F.col(id_col) == F.col("_id"))
    names = ["id", "label", "hash", "lead", "features", "weights"]

    def batch_of(best: dict[int, tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        columns = list(zip(*((i, *best[i]) for i in sorted(best)), strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for an id, so `2 * documents` at most in memory and out."""
        best: dict[int, tuple] = {}
        for batch in batches:
            for i, label, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i in best and best[i][1] <= key:
                    continue
                lines = document_lines(text)
                begin = key % (len(lines) - TRAINING_LINES + 1) if len(lines) > TRAINING_LINES else 0
                end = min(len(lines), begin + TRAINING_LINES)
                lead = int(begin > 0)
                own = np.array([line_features(x) for x in lines[begin - lead : end + 1]])
                best[i] = (label, key, lead, own.tobytes(), np.array([len(x) + 1 for x in lines[begin:end]], np.int64).tobytes())
        yield batch_of(best)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            for i, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i not in best or row[1] < best[i][1]:
                    best[i] = tuple(row)
        yield batch_of(best)

    schema = "id long, label int, hash long, lead int, features binary, weights binary"
    made = rows.select("_id", F.col("_label").cast("int"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), text_col).mapInArrow(features, schema)
    made = made.repartition("id").mapInArrow(least, schema).collect()
    examples = []
    for r in sorted(made, key=lambda r: r.id):
        weights = np.frombuffer(r.weights, np.int64)
        chain = _chained(np.frombuffer(r.features).reshape(-1, N_OWN))[r.lead : r.lead + len(weights)]
        examples.append(Example(chain, weights, r.label))
    return train(examples, stands_for=stands_for)


def quality_score(text: Column, model: LineModel) -> Column:
    """0 to 1, higher: label 1 likelier; null and empty texts are scored as one empty line."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(x.as_py()) for x in texts], pa.float64())

    return score(text)


def score_quality(df: DataFrame, model: LineModel, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """df with the score of every whole text; all rows and other columns stay; no shuffle."""
    bounded_batches(df.sparkSession)
    return df.withColumn(out_col, quality_score(F.col(text_col), model))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Scores of every document, with a model that learns from two folds of three."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_fold("doc_id", 3) == 1
    model = fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    scored = score_quality(docs, model, out_col="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
