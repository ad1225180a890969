"""Packing (operator 4): length buckets that minimise padding, token-budget batches inside each bucket."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, words
from tidemark.operators.rowindex import with_row_index
from tidemark.session import cut

class Buckets(NamedTuple):
    upper: list[int]  # longest length of each bucket, ascending
    padding: int  # padded minus real tokens over all rows


def token_count(text: Column) -> Column:
    """Whitespace words plus an end mark; a null text has the end mark alone."""
    return (F.size(words(text)) + 1).cast("bigint")


def _layer(best: np.ndarray, b: int, longest: np.ndarray, rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of the first j bins in ``b`` buckets for every j, and where the last bucket begins, from that in ``b - 1``.

    The best begin never moves back as j grows (the padding of a bucket satisfies the quadrangle inequality), so the middle j of
    a range bounds the begins of both halves. All ranges of one depth are computed together: n log n steps a layer.
    """
    n = len(longest)
    fresh, came = np.full(n + 1, np.iinfo(np.int64).max), np.zeros(n + 1, np.int32)
    ranges = np.array([[b], [n], [b - 1], [n - 1]])  # j from, j to, begin from, begin to
    while ranges.shape[1]:
        low, high, first, last = ranges
        middle = (low + high) // 2
        size = np.minimum(last, middle - 1) - first + 1
        starts = np.cumsum(size) - size
        i = np.arange(size.sum()) - np.repeat(starts - first, size)
        j = np.repeat(middle, size)
        cost = best[i] + longest[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
        least = np.minimum.reduceat(cost, starts)
        at = np.flatnonzero(cost == np.repeat(least, size))
        begin = i[at[np.unique(np.searchsorted(starts, at, side="right"), return_index=True)[1]]]
        fresh[middle], came[middle] = least, begin
        halves = np.concatenate([[low, middle - 1, first, begin], [middle + 1, high, begin, last]], axis=1)
        ranges = halves[:, halves[0] <= halves[1]]
    return fresh, came


def best_boundaries(longest: np.ndarray, count: np.ndarray, total: np.ndarray, k: int) -> Buckets:
    """At most ``k`` buckets of consecutive bins with the least padding, by dynamic programming.

    ``longest``, ``count`` and ``total`` (rows, tokens) per bin in ascending order. The padding of bins i..j in one bucket is
    longest[j] * rows - tokens. With equal padding fewer and lower boundaries win.
    """
    longest = np.asarray(longest, np.int64)
    n = len(longest)
    if n == 0:
        return Buckets([], 0)
    rows = np.concatenate([[0], np.cumsum(np.asarray(count, np.int64))])
    tokens = np.concatenate([[0], np.cumsum(np.asarray(total, np.int64))])
    best = np.zeros(n + 1, np.int64)
    paddings, came = [], []
    for b in range(1, min(k, n) + 1):
        # One bucket begins at bin 0 only; ``_layer`` chooses among the begins that b - 1 buckets reach.
        best, begins = _layer(best, b, longest, rows, tokens) if b > 1 else (np.concatenate([[0], longest * rows[1:] - tokens[1:]]), np.zeros(n + 1, np.int32))
        paddings.append(int(best[n]))
        came.append(begins)
    b = int(np.argmin(paddings))
    least, upper, j = paddings[b], [], n
    while j > 0:
        upper.append(int(longest[j - 1]))
        j = int(came[b][j])
        b -= 1
    return Buckets(upper[::-1], least)


def length_buckets(lengths: DataFrame, k: int = 16) -> tuple[Buckets, dict[int, int]]:
    """Buckets from the global histogram of column n_tokens, and the rows in each.

    Every length is a bin. Different lengths add up to no more than all tokens, so a corpus of T tokens has fewer than sqrt(2 T):
    7 million for 25 000 billion tokens, and in practice as many as its longest text has words.
    """
    histogram = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow()
    length, n = (np.asarray(histogram.column(c), np.int64) for c in ("n_tokens", "n"))
    order = np.argsort(length)
    length, n = length[order], n[order]
    buckets = best_boundaries(length, n, length * n, k)
    ends = np.searchsorted(length, buckets.upper, side="right")
    rows = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends])]) if len(ends) else []
    return buckets, {u: int(r) for u, r in zip(buckets.upper, rows, strict=True)}


def packed_batches(docs: DataFrame, budget: int = 65536, k: int = 16, n_tokens: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_length, batch) of every row of ``docs`` (doc_id, text; others are ignored).

    ``bucket`` counts from 0 by length; ``padded_length`` is the bucket's longest length. In the order (n_tokens, doc_id) a bucket is
    cut into batches of floor(budget / padded_length) rows, at least one, so padded tokens of a batch stay within the budget unless
    a single row exceeds it. ``batch`` numbers count through all buckets. Rows are numbered by a range sort with running
    starts per partition: no bucket sits in one task. Null or empty texts have one token. Repeated rows are
    packed each for itself (equal rows are interchangeable); an empty table gives an empty result.
    """
    lengths = cut(docs.select("doc_id", (token_count(F.col("text")) if n_tokens is None else n_tokens).alias("n_tokens")))
    buckets, rows = length_buckets(lengths, k)
    bucket, padded, first_row, first_batch, room = (F.lit(None).cast(t) for t in ("int", *["bigint"] * 4))
    row = batch = 0
    plan = []
    for i, u in enumerate(buckets.upper):
        fit = max(budget // u, 1)
        plan.append((i, u, row, batch, fit))
        row, batch = row + rows[u], batch + -(-rows[u] // fit)
    for i, u, at_row, at_batch, fit in reversed(plan):
        here = F.col("n_tokens") <= u
        bucket, padded = F.when(here, F.lit(i)).otherwise(bucket), F.when(here, F.lit(u).cast("bigint")).otherwise(padded)
        first_row, first_batch = F.when(here, F.lit(at_row)).otherwise(first_row), F.when(here, F.lit(at_batch)).otherwise(first_batch)
        room = F.when(here, F.lit(fit)).otherwise(room)
    numbered = with_row_index(lengths, ["n_tokens", "doc_id"], "__row")
    return numbered.select(
        "doc_id", "n_tokens", bucket.alias("bucket"), padded.alias("padded_length"),
        (first_batch + F.floor((F.col("__row") - first_row) / room)).cast("bigint").alias("batch"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_batches(table(spark, sf_dir, "documents"))
