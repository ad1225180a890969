"""Toxicity (operator 2): cumulative-link ordinal regression over sparse text features.

P(grade > k | x) = sigmoid(w.x - theta_k) with one weight vector for all thresholds and theta_1 < theta_2 < ...;
the expected severity is the sum of these probabilities. Features are the distinct words of a text, hashed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import flat_lists, hashes, slices, table

BITS = 20
#: Bound on the labelled rows that a fit uses: those of the smallest id hashes, an even draw.
MAX_FIT_ROWS = 8000
MAX_GRADE = 2


def feature_words(text: Column) -> Column:
    """Letter runs of the lower-cased text."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")
    return F.array_remove(F.split(spaced, " "), "")


def features(text: Column) -> Column:
    """Hashed word features in text order, with repeats; negative numbers do not occur."""
    return F.transform(hashes(feature_words(text)), lambda h: F.shiftrightunsigned(h, 64 - BITS).cast("int"))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row number, feature) of each row's distinct features."""
    unique = [np.unique(np.asarray(r, np.int64)) for r in rows]
    counts = np.array([len(u) for u in unique], np.int64)
    return np.repeat(np.arange(len(rows)), counts), np.concatenate([*unique, np.empty(0, np.int64)]).astype(np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class OrdinalModel:
    """Sparse weights (feature -> weight) and increasing thresholds."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, thresholds: np.ndarray):
        self.index, self.weight, self.thresholds = index, weight, thresholds

    def above(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade > k) per row and threshold."""
        return self.above_flat(*_flat(rows), len(rows))

    def above_flat(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.index, feature), max(len(self.index) - 1, 0))
        hit = (self.index[at] == feature) if len(self.index) else np.zeros(len(feature), bool)
        score = np.bincount(row[hit], self.weight[at[hit]], minlength=n)
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, n_grades: int = MAX_GRADE + 1, min_rows: int = 3, l1: float = 2e-4, steps: int = 400
) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty by accelerated proximal gradient steps; thresholds stay ordered.

    The steps are scaled per feature by its frequency. Features of fewer than ``min_rows`` rows get no weight. With no rows
    the model has no weights and thresholds that make every grade improbable.
    """
    k = n_grades - 1
    if len(rows) == 0:
        return OrdinalModel(np.empty(0, np.int64), np.empty(0), 4.0 + np.arange(k))
    row, feature = _flat(rows)
    known, column, df = np.unique(feature, return_inverse=True, return_counts=True)
    used = df >= min_rows
    renumber = np.cumsum(used) - 1
    keep = used[column]
    row, column = row[keep], renumber[column[keep]]
    known, df = known[used], df[used].astype(float)
    n = len(rows)
    share = np.array([(grades > j).mean() for j in range(k)]).clip(1e-4, 1 - 1e-4)
    theta = -np.log(share / (1 - share))
    w = np.zeros(len(known))
    ahead_w, ahead_t, pace = w.copy(), theta.copy(), 1.0
    length = np.bincount(row, minlength=n).max() if len(row) else 1
    rate = 4.0 / (0.5 * min(length, 60))  # a text's features move together; the clip below keeps steps safe
    target = (grades[:, None] > np.arange(k)[None, :]).astype(float)
    for _ in range(steps):
        score = np.bincount(row, ahead_w[column], minlength=n)
        error = (_sigmoid(score[:, None] - ahead_t[None, :]) - target) / n
        slope = np.bincount(column, error.sum(1)[row], minlength=len(known))
        scale = rate / np.sqrt(df / n * (df / n).max() + 1e-6)
        fresh = ahead_w - np.clip(scale * slope, -0.5, 0.5)
        fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - l1 * scale, 0)
        fresh_t = np.maximum.accumulate(ahead_t + np.clip(2.0 * error.sum(0), -0.5, 0.5) + 1e-6 * np.arange(k))
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        push = min((pace - 1) / next_pace, 0.9)
        ahead_w, ahead_t = fresh + push * (fresh - w), np.maximum.accumulate(fresh_t + push * (fresh_t - theta))
        w, theta, pace = fresh, fresh_t, next_pace
    chosen = w != 0
    return OrdinalModel(known[chosen], w[chosen], theta)


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and 0/1 toxic labels of at most ``max_rows`` labelled documents (null labels are left out)."""
    drawn = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(max_rows)
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most max_rows rows
    got = joined.select("toxic", F.array_distinct(features(F.col("text"))).alias("f")).orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).toArrow()
    return [np.asarray(x.values) for x in got.column("f")], np.asarray(got.column("toxic"), np.int64)


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Ordered grades from binary labels: 0 is not toxic; toxic texts are 1 or 2 by how many distinct toxic features
    they have (a feature is one when toxic rows hold it at least ten times as often, smoothed), cut above the median."""
    row, feature = _flat(rows)
    known, column = np.unique(feature, return_inverse=True)
    if not toxic.any():
        return toxic.copy()
    pos = np.bincount(column, toxic[row] > 0, minlength=len(known))
    neg = np.bincount(column, toxic[row] == 0, minlength=len(known))
    lift = ((pos + 0.5) / ((toxic > 0).sum() + 1)) / ((neg + 0.5) / ((toxic == 0).sum() + 1))
    strong = (lift >= 10) & (pos >= 3)
    hits = np.bincount(row, strong[column], minlength=len(rows))
    return np.where(toxic == 0, 0, np.where(hits > np.median(hits[toxic > 0]), 2, 1))


def score_severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, expected_severity, p_toxic, grade, toxic) of every row of ``docs`` (doc_id, text; others are ignored).

    expected_severity is the sum of P(grade > k); grade the number of thresholds passed with probability over a half;
    toxic is grade >= 1. Null and empty texts have no features and get the base rate. Repeated rows score alike; an
    empty table gives an empty result. The model (sparse weights of a bounded fit) travels with the task.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            flat, ends = flat_lists(batch.column(1))
            flat, n = flat.astype(np.int64), batch.num_rows
            row = np.repeat(np.arange(n), np.diff(ends))
            hit = np.isin(flat, model.index)
            pairs = np.unique(row[hit] * np.int64(1 << BITS) + flat[hit])  # distinct features of weight per row
            above = model.above_flat(pairs >> BITS, pairs & ((1 << BITS) - 1), n)
            grade = (above > 0.5).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(grade.astype(np.int32)), pa.array(grade >= 1)],
                ["doc_id", "expected_severity", "p_toxic", "grade", "toxic"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", features(F.col("text")).alias("f")).mapInArrow(
        score, f"doc_id {kind}, expected_severity double, p_toxic double, grade int, toxic boolean"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, toxic = labelled_rows(docs, table(spark, sf_dir, "labels"))
    return score_severity(docs, fit_ordinal(rows, severity_grades(rows, toxic)))
