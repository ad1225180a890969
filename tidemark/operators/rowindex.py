"""Row numbering and chunking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def with_unique_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Unique, increasing, not dense. No shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def with_row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index", offset: int = 0) -> DataFrame:
    """Dense index in the given total order, without a single-partition sort.

    Rows are range-partitioned (all sort columns, so a hot leading value is split) and numbered within
    their partition; partition sizes, one row each, give the running start. The numbered rows are
    checkpointed because a second evaluation of a range shuffle may draw other boundaries.
    """
    return _numbered(*_ranged(df, order_by), name, offset)


def _ranged(df: DataFrame, order_by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows in order with their partition and place, and a row per partition with its size."""
    ranged = cut(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumns({"__part": F.spark_partition_id(), "__mono": F.monotonically_increasing_id()})
    )
    return ranged, ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"), F.min("__mono").alias("__first"))


def _numbered(ranged: DataFrame, sizes: DataFrame, name: str, offset: int = 0) -> DataFrame:
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "__part", "__first", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")
    )
    return (
        ranged.join(F.broadcast(starts), "__part")  # one row per partition
        .withColumn(name, F.col("__start") + F.col("__mono") - F.col("__first") + F.lit(offset))
        .drop("__part", "__mono", "__first", "__start")
    )


def chunked(df: DataFrame, chunk_size: int = 5000, order_by: Sequence[str] = (), name: str = "batch_id") -> DataFrame:
    """Consecutive chunks of ``chunk_size`` rows."""
    return _chunk_of(with_row_index(df, order_by, "__index"), chunk_size, name)


def _chunk_of(indexed: DataFrame, chunk_size: int, name: str) -> DataFrame:
    return indexed.withColumn(name, F.floor(F.col("__index") / F.lit(chunk_size)).cast("bigint")).drop("__index")


def counted_chunks(
    df: DataFrame, chunk_size: int = 5000, order_by: Sequence[str] = (), name: str = "batch_id"
) -> tuple[DataFrame, int]:
    """As ``chunked``, and the number of chunks; the rows are not read again for it."""
    ranged, sizes = _ranged(df, order_by)
    sizes = cut(sizes)  # one row per partition
    rows = sizes.agg(F.sum("__size")).first()[0] or 0
    return _chunk_of(_numbered(ranged, sizes, "__index"), chunk_size, name), -(-rows // chunk_size)
