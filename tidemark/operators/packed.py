"""Many patterns over rows that do not compress: coverage on bit columns inside an Arrow batch.

A task turns the mask words of a block of rows into one bit column per selector, 64 rows a word. A pattern's coverage is an OR of the
selectors of each of its variables and an AND over the variables, counted by population count; rows that stand for several
(cells of a cube) are counted by the binary digits of their weight. No pair of a row and a pattern is ever made: a task
emits one row of sums per pattern, whatever it read, and class totals come from the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.profile import Layout

#: Pattern sets up to this size are sent to the tasks; larger ones are joined with the rows (``coverage.cover_join``).
LIMIT = 1 << 18
BLOCK_ROWS = 1 << 15
CHUNK = 256  # patterns whose coverage of a block is held at once


class Packed(NamedTuple):
    """Patterns as numbers: per variable the distinct masks and which of them a pattern has."""

    classes: list[str]
    own: np.ndarray  # per pattern, place of its class in ``classes``
    masks: list[np.ndarray]  # per variable: distinct masks x words of the variable
    choice: np.ndarray  # patterns x variables
    words: list[list[int]]  # per variable, its mask words


def packed_patterns(masks: np.ndarray, classes: list[str], layout: Layout) -> Packed:
    names = sorted(set(classes))
    at = {c: i for i, c in enumerate(names)}
    distinct, choice, words = [], [], []
    for v in range(len(layout.variables)):
        words.append(list(layout.words_of(v)))
        found, which = np.unique(masks[:, words[-1]], axis=0, return_inverse=True)
        distinct.append(found)
        choice.append(which.reshape(-1))
    return Packed(names, np.array([at[c] for c in classes], np.int64), distinct, np.stack(choice, axis=1), words)


def bit_rows(flags: np.ndarray) -> np.ndarray:
    """Booleans (any number x rows) as 64-bit words along the rows; rows are filled up with zeros."""
    wide = -(-flags.shape[1] // 64) * 8
    packed = np.packbits(flags, axis=1)
    out = np.zeros((flags.shape[0], wide), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def choice_bits(patterns: Packed, rows: np.ndarray) -> list[np.ndarray]:
    """Per variable: for each of its distinct masks the rows that share a value with it; a mask without values lets all pass."""
    out = []
    for found, words in zip(patterns.masks, patterns.words, strict=True):
        used = np.bitwise_or.reduce(found, axis=0) if len(found) else np.zeros(len(words), np.int64)
        columns, places = [], []
        for k, w in enumerate(words):
            bits = [b for b in range(64) if int(used[k]) >> b & 1]
            places += [(k, b) for b in bits]
            columns += [(rows[:, w] >> np.int64(b)) & 1 for b in bits]
        selectors = bit_rows(np.array(columns, bool).reshape(len(columns), len(rows)))
        everything = bit_rows(np.ones((1, len(rows)), bool))[0]
        bits_of = np.empty((len(found), len(everything)), np.uint64)
        for i, mask in enumerate(found):
            own = [s for s, (k, b) in enumerate(places) if int(mask[k]) >> b & 1]
            bits_of[i] = np.bitwise_or.reduce(selectors[own], axis=0) if own else everything
        out.append(bits_of)
    return out


def coverage_of(patterns: Packed, bits: list[np.ndarray], some: slice | np.ndarray) -> np.ndarray:
    """Rows covered by ``some`` of the patterns, as bits."""
    return reduce(np.bitwise_and, (bits[v][patterns.choice[some, v]] for v in range(len(bits))))


def _planes(weight: np.ndarray, flags: np.ndarray) -> list[np.ndarray]:
    """Rows of each set of ``flags`` (sets x rows) whose weight has the binary digit k, for every k."""
    digits = max(int(weight.max(initial=0)).bit_length(), 1)
    return [bit_rows(flags & ((weight >> k) & 1).astype(bool)) for k in range(digits)]


def _block_sums(patterns: Packed, rows: np.ndarray, weight: np.ndarray, row_class: np.ndarray) -> np.ndarray:
    """(patterns x 4) covered, hits, positives, total of one block; ``row_class`` is -1 for classes that no pattern has."""
    bits = choice_bits(patterns, rows)
    inside = np.arange(len(patterns.classes))[:, None] == row_class[None, :]
    total = _planes(weight, np.ones((1, len(rows)), bool))
    by_class = _planes(weight, inside)
    sums = np.zeros((len(patterns.own), 4), np.int64)
    for start in range(0, len(patterns.own), CHUNK):
        some = slice(start, start + CHUNK)
        covered = coverage_of(patterns, bits, some)
        for k, (every, own) in enumerate(zip(total, by_class, strict=True)):
            sums[some, 0] += np.bitwise_count(covered & every[0]).sum(axis=1, dtype=np.int64) << k
            sums[some, 1] += np.bitwise_count(covered & own[patterns.own[some]]).sum(axis=1, dtype=np.int64) << k
    positives = np.zeros(len(patterns.classes), np.int64)
    np.add.at(positives, row_class[row_class >= 0], weight[row_class >= 0])
    sums[:, 2] = positives[patterns.own]
    sums[:, 3] = weight.sum()
    return sums


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_ROWS) -> Iterator[pa.Table]:
    """The batches of a task in tables of about ``size`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def mask_rows(block: pa.Table, words: list[str]) -> np.ndarray:
    return np.stack([block.column(w).to_numpy().astype(np.int64) for w in words], axis=1)


def class_places(block: pa.Table, classes: list[str]) -> np.ndarray:
    """Place of each row's class among ``classes``, -1 for another."""
    coded = block.column("class").combine_chunks().dictionary_encode()
    at = {c: i for i, c in enumerate(classes)}
    places = np.array([at.get(c, -1) for c in coded.dictionary.to_pylist()], np.int64)
    return places[coded.indices.to_numpy()] if len(places) else np.full(block.num_rows, -1)


def listed_patterns(patterns: DataFrame, columns: list[str], limit: int) -> pa.Table | None:
    """The columns of at most ``limit`` patterns, None if there are more."""
    got = patterns.select(*columns).limit(limit + 1).toArrow()
    return got if got.num_rows <= limit else None


def masks_of(listed: pa.Table, layout: Layout) -> np.ndarray:
    flat = listed.column("masks").combine_chunks().flatten().to_numpy().astype(np.int64)
    return flat.reshape(listed.num_rows, len(layout.words))


def packed_counts(cells: DataFrame, patterns: DataFrame, layout: Layout) -> DataFrame | None:
    """(pattern_id, covered, hits, positives, total) of each pattern (pattern_id, class, masks) over ``cells`` (class, n, words).

    positives: rows of the pattern's class, total: all rows; both from the scan that counts the coverage. No rows give no sums. None if there
    are more than ``LIMIT`` patterns. Patterns without values cover every row here.
    """
    spark = cells.sparkSession
    listed = listed_patterns(patterns.dropDuplicates(["pattern_id"]), ["pattern_id", "class", "masks"], LIMIT)
    if listed is None:
        return None
    sent = spark.sparkContext.broadcast(packed_patterns(masks_of(listed, layout), listed.column("class").to_pylist(), layout))
    words = list(layout.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        sums = None
        for block in blocks(batches):
            part = _block_sums(own, mask_rows(block, words), block.column("n").to_numpy().astype(np.int64), class_places(block, own.classes))
            sums = part if sums is None else sums + part
        if sums is not None:
            columns = [pa.array(np.arange(len(sums), dtype=np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in sums.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "covered", "hits", "positives", "total"])

    made = cells.select("class", "n", *words).mapInArrow(count, "place int, covered bigint, hits bigint, positives bigint, total bigint")
    sums = made.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("covered", "hits", "positives", "total")])
    ids = pa.table({"place": pa.array(np.arange(listed.num_rows, dtype=np.int32)), "pattern_id": listed.column("pattern_id")})
    return sums.join(F.broadcast(spark.createDataFrame(ids, "place int, pattern_id string")), "place").drop("place")  # LIMIT rows at most
