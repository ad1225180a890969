"""Which rows a pattern covers.

Every pattern is filed under the values of one of its variables (the one that lets the fewest rows
through). A row can only be covered by patterns filed under one of its own values, so coverage is an
equi-join on that value followed by a check of the other variables. No cross product is formed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sqltext import all_of, any_of, array, case, long, name, num
from tidemark.operators.fuzzify import selectors_of
from tidemark.operators.packed import CHUNK, LIMIT, Packed, blocks, choice_bits, coverage_of, listed_patterns, mask_rows, masks_of, packed_patterns
from tidemark.operators.patterns import non_empty, participates, set_bits
from tidemark.operators.profile import Layout
from tidemark.session import cut

BROADCAST_BYTES = 64 << 20
#: Rows of one bitmap, as in Spark's bitmap functions.
BUCKET = 8 * 4096
BITMAPS = "name string, bucket bigint, bitmap binary"


def covers_expr(layout: Layout, row: Sequence[str], pattern: Sequence[str]) -> str:
    """AND over participating variables of "row and pattern share a value". Canonical masks expected."""
    tests = []
    for v in range(len(layout.variables)):
        words = layout.words_of(v)
        silent = all_of(f"{pattern[i]} = 0" for i in words)
        tests.append(any_of([silent, *[f"({row[i]} & {pattern[i]}) <> 0" for i in words]]))
    return all_of(tests)


def filed_patterns(patterns: DataFrame, layout: Layout, keep: Sequence[str]) -> DataFrame:
    """One row per (pattern, value of its filing variable) with the masks spread over columns p* and b*.

    b* holds the filing variable's values below this one: a row with several values (missing or tied)
    is then matched through the lowest shared value only, so no pair comes out twice.
    """
    fractions = array(
        f"struct({case([(participates(layout, v), f'{set_bits(layout, v)} / {num(variable.width)}')], '2D')} AS f, {v} AS v)"
        for v, variable in enumerate(layout.variables)
    )
    own = [case([(f"__by = {v}", f"masks[{i}]")], "0L") for i, v in enumerate(layout.word_var)]
    below = []
    for i, v in enumerate(layout.word_var):
        bit = f"(sel - {layout.word_offset(i)})"
        lower = case(
            [(f"{bit} <= 0", "0L"), (f"{bit} >= {layout.word_width(i)}", long(layout.full_mask(i)))],
            f"shiftleft(1L, {bit}) - 1L",
        )
        below.append(f"{case([(f'__by = {v}', f'masks[{i}] & {lower}')], '0L')} AS b{i}")
    return (
        non_empty(patterns)
        .withColumn("__by", F.expr(f"array_min({fractions}).v"))
        .withColumn("sel", F.expr(f"explode({selectors_of(layout, own)})"))
        .selectExpr(*[name(c) for c in keep], "sel", *[f"masks[{i}] AS p{i}" for i in range(len(own))], *below)
    )


def pattern_slices(filed: DataFrame, layout: Layout, known_rows: int | None = None) -> list[DataFrame]:
    """The filed patterns in slices that each stay under the broadcast budget; one slice if they are known to be few."""
    limit = max(BROADCAST_BYTES // (16 * (2 * len(layout.words) + 8)), 1)
    if known_rows is not None and known_rows <= limit:
        return [filed]
    filed = cut(filed)
    count = -(-filed.count() // limit)
    if count <= 1:
        return [filed]
    part = F.pmod(F.xxhash64("pattern_id", "pattern_class", "sel"), F.lit(2 * count))  # half full on average
    return [filed.filter(part == s) for s in range(2 * count)]


def cover_join(
    cells: DataFrame, patterns: DataFrame, layout: Layout, keep: Sequence[str] = (), known_rows: int | None = None
) -> DataFrame:
    """Cells joined with every pattern covering them.

    Result: the cell columns, ``pattern_id``, ``pattern_class`` and the pattern columns named in ``keep``.
    Patterns are broadcast, slice by slice if there are too many for one broadcast: cells are never shuffled (there are only
    as many join values as selectors), each further slice is one more scan of them.
    """
    named = patterns.withColumnRenamed("class", "pattern_class")
    kept = ["pattern_id", "pattern_class", *keep]
    filed = filed_patterns(named, layout, kept)
    spread = cells.withColumn("sel", F.expr(f"explode({selectors_of(layout, layout.words)})"))
    joined = reduce(DataFrame.unionByName, [spread.join(F.broadcast(part), "sel") for part in pattern_slices(filed, layout, known_rows)])
    fresh = [f"({w} & b{i}) = 0" for i, w in enumerate(layout.words)]
    test = covers_expr(layout, layout.words, [f"p{i}" for i in range(len(layout.words))])
    return joined.filter(all_of([*fresh, test])).select(*cells.columns, *kept)


def covered_pairs(rows: DataFrame, patterns: DataFrame, layout: Layout, keys: Sequence[str]) -> DataFrame:
    """(keys, pattern_id) for every covered row."""
    return cover_join(rows, patterns, layout).select(*keys, "pattern_id")


def _bitmap_rows(names: Sequence[str], flags: np.ndarray, index: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per bucket of the row numbers ``index`` a bitmap of each name that has a row there; ``flags``: names x rows."""
    buckets, bit = index // BUCKET, index % BUCKET
    for bucket in np.unique(buckets):
        own = np.flatnonzero(buckets == bucket)
        some = flags[:, own]
        hit = np.flatnonzero(some.any(axis=1))
        if len(hit):
            dense = np.zeros((len(hit), BUCKET), np.uint8)
            dense[:, bit[own]] = some[hit]
            maps = np.packbits(dense, axis=1, bitorder="little")
            columns = [[names[i] for i in hit], np.full(len(hit), bucket + 1, np.int64), [m.tobytes() for m in maps]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "bucket", "bitmap"])


def _merged(parts: DataFrame, name_: str) -> DataFrame:
    return parts.withColumnRenamed("name", name_).groupBy(name_, "bucket").agg(F.call_function("bitmap_or_agg", "bitmap").alias("bitmap"))


def coverage_bitmaps(rows: DataFrame, patterns: DataFrame, layout: Layout, index: str) -> DataFrame:
    """Covered row indices as bitmaps per (pattern, bucket): partial bitmaps per block of rows, OR-merged in the shuffle.

    ``index`` is a dense 0-based row number, best in order within a partition; bits have the places and buckets that Spark's bitmap functions
    give to index + 1. No pair of a row and a pattern is made, unless there are more patterns than tasks should hold.
    """
    listed = listed_patterns(non_empty(patterns).dropDuplicates(["pattern_id"]), ["pattern_id", "class", "masks"], LIMIT)
    if listed is None:
        pairs = cover_join(rows, patterns, layout).select("pattern_id", (F.col(index) + 1).alias("__pos"))
        return pairs.groupBy("pattern_id", F.call_function("bitmap_bucket_number", "__pos").alias("bucket")).agg(
            F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", "__pos")).alias("bitmap")
        )
    ids, words = listed.column("pattern_id").to_pylist(), list(layout.words)
    own = packed_patterns(masks_of(listed, layout), listed.column("class").to_pylist(), layout)
    sent = rows.sparkSession.sparkContext.broadcast((ids, tuple(own)))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own = sent.value[0], Packed(*sent.value[1])
        for block in blocks(batches):
            at, bits = block.column("__at").to_numpy(), choice_bits(own, mask_rows(block, words))
            for start in range(0, len(names), CHUNK):
                covered = coverage_of(own, bits, slice(start, start + CHUNK))
                flags = np.unpackbits(covered.view(np.uint8), axis=1)[:, : block.num_rows]
                yield from _bitmap_rows(names[start : start + CHUNK], flags, at)

    return _merged(rows.select(F.col(index).cast("bigint").alias("__at"), *words).mapInArrow(cover, BITMAPS), "pattern_id")


def class_bitmaps(rows: DataFrame, index: str) -> DataFrame:
    """Rows of each class as bitmaps per bucket."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            coded = block.column("class").combine_chunks().dictionary_encode()
            names, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            for start in range(0, len(names), CHUNK):
                some = np.arange(start, min(start + CHUNK, len(names)))
                yield from _bitmap_rows(names[start : start + CHUNK], some[:, None] == place[None, :], block.column("__at").to_numpy())

    return _merged(rows.select(F.col(index).cast("bigint").alias("__at"), "class").mapInArrow(mark, BITMAPS), "class")


def bitmap_sizes(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    return (
        bitmaps.select(*by, F.call_function("bitmap_count", "bitmap").alias("__n"))
        .groupBy(*by)
        .agg(F.sum("__n").alias("n_rows"))
    )


def covered_shapes(rows: DataFrame, patterns: DataFrame, layout: Layout) -> DataFrame:
    """Distinct mask combinations that occur in ``rows`` and that some pattern covers.

    Written out, so that its size is known, and marked for broadcast only within the budget; beyond it the
    join with the rows is a shuffle join.
    """
    shapes = cut(cover_join(rows.select(*layout.words).distinct(), patterns, layout).select(*layout.words).distinct())
    limit = BROADCAST_BYTES // (16 * (len(layout.words) + 8))
    return F.broadcast(shapes) if shapes.limit(limit + 1).count() <= limit else shapes


def union_coverage(rows: DataFrame, patterns: DataFrame, layout: Layout) -> DataFrame:
    """Rows (or cells) covered by at least one pattern.

    Coverage depends on a row's masks only, so the distinct masks are tested and rows are kept by a semi
    join on them: rows are not shuffled by an identity of their own, and a hot combination is tested once.
    """
    return rows.join(covered_shapes(rows, patterns, layout), layout.words, "left_semi")


def uncovered_of_class(rows: DataFrame, patterns: DataFrame, layout: Layout, cls: str) -> DataFrame:
    """Rows (or cells) of one class that no pattern covers."""
    own = rows.filter(F.col("class") == cls)
    return own.join(covered_shapes(own, patterns, layout), layout.words, "left_anti")


def newly_covered(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    return current.select(*keys).distinct().join(previous.select(*keys), list(keys), "left_anti")


def set_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def set_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def set_and_not(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_anti")


def set_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of exactly one side, in one pass over both."""
    tagged = a.distinct().withColumn("__side", F.lit(1)).union(b.distinct().withColumn("__side", F.lit(2)))
    return tagged.groupBy(*a.columns).agg(F.sum("__side").alias("__side")).filter(F.col("__side") < 3).drop("__side")


def set_not(everything: DataFrame, a: DataFrame) -> DataFrame:
    return set_and_not(everything, a)


def next_member(a: DataFrame, column: str, start: int) -> DataFrame:
    """Smallest member at or after ``start``."""
    return a.filter(F.col(column) >= start).agg(F.min(column).alias(column))
