"""Quality classification by ordinal cumulative-link regression.

All grades share one weight for each hashed feature of a text; ordered thresholds t_1 < t_2 < ... give
P(grade >= k) = logistic(w.x - t_k), hence an expected grade and the tail probability that selects documents.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable_on_workers, lean, materialize, output_schema

#: Labelled documents that the fit may use, taken by order of a hash; size of the hashed feature space.
SAMPLE_ROWS, FEATURES = 6_000, 2**15
#: Features that are not hashed: bias of repetition, length and kinds of words.
REPEATS, SHORT, BASE = 0, 1, 2
_RUNS = re.compile(rb"([^\w\s])\1+")
_KINDS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", b"A" * 26 + b"a" * 26 + b"9" * 10)
_SAME = re.compile(rb"([Aa9\x80-\xff])\1+")


def _bucket(kind: bytes, value: bytes) -> int:
    return BASE + xxhash.xxh64_intdigest(value, len(kind) and kind[0]) % (FEATURES - BASE)


class WordFeatures(dict):
    """Word to its two hashed features: itself in lower case, and its shape (runs of a kind as one)."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= self.LIMIT:
            self.clear()
        shape = _SAME.sub(rb"\1", word.translate(_KINDS))
        self[word] = got = (_bucket(b"w", word.lower()), _bucket(b"s", shape))
        return got


_WORDS = WordFeatures()


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (distinct, sorted) and values: frequencies of word features, share of repeated words."""
    parts = text.split() if text else []
    if not parts:
        return np.array([SHORT], np.int32), np.array([1.0], np.float32)
    pairs = np.fromiter((x for w in parts for x in _WORDS[w]), np.int32, 2 * len(parts))
    ids, counts = np.unique(pairs, return_counts=True)
    again = sum(map(operator.eq, parts, parts[1:])) / len(parts)
    values = np.sqrt(counts / len(parts)).astype(np.float32)
    return np.concatenate([[REPEATS, SHORT], ids]).astype(np.int32), np.concatenate([[3 * again, 1 / len(parts)], values]).astype(np.float32)


@dataclass
class Model:
    """Shared weights and ordered thresholds; grades are 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, rounds: int = 250, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """Maximum likelihood by Adam on all rows at once. rows: features, values and grade. Without rows, or with one
    grade only, the weights are 0 and the thresholds follow the shares."""
    w, n = np.zeros(FEATURES), len(rows)
    y = np.array([g for _, _, g in rows], int)
    shares = [np.clip((y >= k).mean() if n else 0.5, 1e-3, 1 - 1e-3) for k in range(1, grades)]
    t = np.sort(-np.log(np.array(shares) / (1 - np.array(shares))))
    if len(set(y.tolist())) < 2:
        return Model(w, t)
    start = np.concatenate([[0], np.cumsum([len(f) for f, _, _ in rows])])
    ids, values = np.concatenate([f for f, _, _ in rows]), np.concatenate([v for _, v, _ in rows]).astype(float)
    owner = np.repeat(np.arange(n), np.diff(start))
    p = np.concatenate([w, t[:1], np.log(np.maximum(np.diff(t), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, t = p[:FEATURES], np.cumsum(np.concatenate([p[FEATURES : FEATURES + 1], np.exp(p[FEATURES + 1 :])]))
        score = np.bincount(owner, w[ids] * values, n)
        up = np.column_stack([np.ones(n), 1 / (1 + np.exp(-np.clip(score[:, None] - t, -40, 40))), np.zeros(n)])
        slope = up * (1 - up)
        at = np.arange(n)
        prob = np.maximum(up[at, y] - up[at, y + 1], 1e-9)
        by_score = (slope[at, y] - slope[at, y + 1]) / prob
        by_t = np.zeros((n, grades + 1))
        by_t[at, y] -= slope[at, y] / prob
        by_t[at, y + 1] += slope[at, y + 1] / prob
        dt = by_t[:, 1:-1].sum(axis=0) / n
        dw = np.bincount(ids, by_score[owner] * values, FEATURES) / n - ridge * w
        tail = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate([dw, tail[:1], tail[1:] * np.exp(p[FEATURES + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(p[:FEATURES].copy(), np.cumsum(np.concatenate([p[FEATURES : FEATURES + 1], np.exp(p[FEATURES + 1 :])])))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 low quality, 1 good but toxic, 2 good. Rows with null quality or id have no grade; of
    several rows with one id the least grade counts; null toxic counts as not toxic."""
    grade = F.when(F.col("quality") < 1, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).otherwise(2)
    return labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


GRADES = 3


def train(docs: DataFrame, grades: DataFrame, n_grades: int = GRADES, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most `rows` graded documents, those whose ids come first by a hash. Their features are made where
    the texts are; the driver gets at most `rows` sparse vectors."""
    importable_on_workers(docs.sparkSession)
    total = grades.count()
    if total > rows:  # a hash threshold, then the exact cut: no sort of all
        part = min(1.0, 1.5 * rows / total + 0.001)
        grades = grades.filter(F.xxhash64("doc_id") / F.lit(float(2**64)) + 0.5 <= part).orderBy(F.xxhash64("doc_id")).limit(rows)
    chosen = materialize(grades, "grades")
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(x.as_py()) for x in batch.column(1).cast(pa.binary())]
            cols = [batch.column(0), batch.column(2), pa.array([f for f, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "grade", "ids", "vals"])

    made = both.mapInArrow(lean(run), "doc_id long, grade int, ids array<int>, vals array<float>").toArrow()
    order = np.argsort(made.column("doc_id").to_numpy(), kind="stable")
    ids, vals, grade = made.column("ids"), made.column("vals"), made.column("grade")
    return fit([(np.asarray(ids[int(i)].values), np.asarray(vals[int(i)].values), grade[int(i)].as_py()) for i in order], n_grades)


JUDGED = "expected_grade double, tail_probability double, selected boolean"


def classify(docs: DataFrame, model: Model, tail: int = 1, threshold: float = 0.5) -> DataFrame:
    """docs (text, any other columns) with expected_grade, tail_probability and selected added, for every row.

    selected: P(grade >= tail) >= threshold. A null, empty or blank text has no words and is judged by that alone.
    Columns of docs with one of the three names are an error.
    """
    importable_on_workers(docs.sparkSession)
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    schema = output_schema(docs, JUDGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            expected, tails = [], []
            for x in batch.column(at).cast(pa.binary()):
                f, v = features(x.as_py())
                up = own.tails(float(own.weights[f] @ v))
                expected.append(float(up.sum())), tails.append(float(up[tail - 1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected, pa.float64()), pa.array(tails, pa.float64()), pa.array([x >= threshold for x in tails], pa.bool_())], names=[*batch.schema.names, "expected_grade", "tail_probability", "selected"])

    return docs.mapInArrow(lean(run), schema)
