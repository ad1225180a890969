"""Streaming input and replay of stored tables as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.rowindex import chunked, counted_chunks, with_row_index  # noqa: F401  (chunked is part of this module too)

#: Consecutive pieces that one task of ``replay`` writes: tasks start in order, so pieces arrive about in order and a task's sort stays small.
PIECES_A_TASK = 8
#: Beyond so many tasks there are more pieces in each: a shuffle to up to 200 writes rows straight away, one to more sorts and spills them first.
MOST_TASKS = 200


def read_stream(
    spark: SparkSession,
    source: str,
    path: str | None = None,
    schema: T.StructType | str | None = None,
    topics: Sequence[str] = (),
    brokers: str = "localhost:9092",
    files_per_batch: int | None = None,
) -> DataFrame:
    """A streaming DataFrame from ``kafka`` (record values as text; needs the connector jar) or from files."""
    reader = spark.readStream.format(source)
    if source == "kafka":
        reader = reader.option("kafka.bootstrap.servers", brokers).option("subscribe", ",".join(topics))
        return reader.load().select(F.col("value").cast("string").alias("value"))
    if schema is not None:
        reader = reader.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def replay(df: DataFrame, target: str, order_by: Sequence[str], rate: int = 50_000) -> DataFrame:
    """Store a table as consecutive pieces of ``rate`` rows to be read back with ``files_per_batch=1``.

    Every piece becomes one folder entry; a batch reader sees the whole table with its ``batch_id``.
    """
    pieces, count = counted_chunks(df, rate, order_by)
    together = max(PIECES_A_TASK, -(-count // MOST_TASKS))
    task = F.floor(F.col("batch_id") / F.lit(together)).cast("int")
    dealt = pieces.repartitionById(max(-(-count // together), 1), task)
    dealt.sortWithinPartitions("batch_id", *order_by).write.partitionBy("batch_id").mode("overwrite").parquet(target)
    return df.sparkSession.read.parquet(target)


def send_to_kafka(df: DataFrame, topic: str, brokers: str, key: Sequence[str]) -> None:
    """Batch write of text lines, key = dense counter over the given order. Needs the connector jar."""
    keyed = with_row_index(df, key, "counter")
    value = F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns])
    keyed.select(F.col("counter").cast("string").alias("key"), value.alias("value")).write.format("kafka").option(
        "kafka.bootstrap.servers", brokers
    ).option("topic", topic).save()
