"""Test-then-train bookkeeping as table operations: scores, drift, model changes, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.measures import REPORTED
from tidemark.operators.contingency import evaluate_test
from tidemark.operators.fuzzify import compressed_cube
from tidemark.operators.profile import Layout
from tidemark.session import cut


def prequential_scores(rows: DataFrame, patterns: DataFrame, layout: Layout, batch: str = "batch_id") -> DataFrame:
    """Contingency and all measures per (batch, pattern), for the classes present in each batch."""
    cells = cut(compressed_cube(rows, layout, [batch]))  # read for the class totals and for the patterns
    return evaluate_test(cells, patterns, layout, by=[batch])


def drift(scores: DataFrame, measure: str, threshold: float, batch: str = "batch_id") -> DataFrame:
    """(batch, class, mean): classes whose mean measure is below the threshold."""
    return (
        scores.groupBy(batch, "class").agg(F.avg(measure).alias("mean_value")).filter(F.col("mean_value") < threshold)
    )


def classes_to_retrain(
    scores: DataFrame,
    active: DataFrame,
    confidence: float = 0.6,
    support: float = 0.1,
    batch: str = "batch_id",
    unmodelled: bool = True,
) -> DataFrame:
    """(batch, class): real or virtual drift, plus active classes no pattern speaks about (off with ``unmodelled``)."""
    means = scores.groupBy(batch, "class").agg(F.avg("confidence").alias("c"), F.avg("support").alias("s"))
    flagged = means.filter((F.col("c") < confidence) | (F.col("s") < support)).select(batch, "class")
    if not unmodelled:
        return flagged
    return flagged.union(active.select(batch, "class").join(means, [batch, "class"], "left_anti")).distinct()


def replace_class_patterns(model: DataFrame, new: DataFrame, classes: DataFrame) -> DataFrame:
    """Patterns of the re-mined classes are swapped. A class whose mining gave nothing keeps its old ones."""
    renewed = new.select("class").distinct().join(classes.select("class").distinct(), "class", "left_semi")
    kept = model.join(renewed, "class", "left_anti")
    return kept.unionByName(new.join(renewed, "class", "left_semi").select(*model.columns))


def append_patterns(model: DataFrame, new: DataFrame) -> DataFrame:
    return model.unionByName(new.select(*model.columns))


def enqueue_history(history: DataFrame | None, scores: DataFrame, keep: int, batch: str = "batch_id") -> DataFrame:
    """History with the scores added, one entry per (batch, pattern), only the last ``keep`` batches."""
    columns = [batch, "pattern_id", "class", *REPORTED]
    entries = scores.select(*columns)
    everything = entries if history is None else history.select(*columns).unionByName(entries)
    once = everything.dropDuplicates([batch, "pattern_id"])
    batches = once.select(batch).distinct().orderBy(F.col(batch).desc()).limit(keep)
    return once.join(F.broadcast(batches), batch, "left_semi")  # at most ``keep`` rows


def history_reward(history: DataFrame, measures: Sequence[str], batch: str = "batch_id") -> DataFrame:
    """Per pattern and measure: sum of value x 2^-age, the newest batch having age 1."""
    ages = history.select(batch).distinct()
    ages = ages.withColumn("age", F.row_number().over(Window.orderBy(F.col(batch).desc())))  # a row per kept batch
    weight = F.pow(F.lit(2.0), -F.col("age").cast("double"))
    return (
        history.join(F.broadcast(ages), batch)
        .groupBy("pattern_id")
        .agg(*[F.sum(F.col(m) * weight).alias(f"reward_{m}") for m in measures])
    )


def with_reward(scored: DataFrame, history: DataFrame, objectives: dict[str, str], batch: str = "batch_id") -> DataFrame:
    """Add each objective's reward to it (both raw, larger is better). ``objectives``: column -> measure."""
    rewards = history_reward(history, sorted(set(objectives.values())), batch)
    joined = scored.join(rewards, "pattern_id", "left")
    made = {c: F.col(c) + F.coalesce(f"reward_{m}", F.lit(0.0)) for c, m in objectives.items()}
    return joined.withColumns(made).select(*scored.columns)


def event_windows(rows: DataFrame, ts: str, width: str, name: str = "batch_id") -> DataFrame:
    """Batches as tumbling event-time windows, named by the window start (seconds since the epoch)."""
    start = F.window(ts, width).start
    if dict(rows.dtypes)[ts] == "timestamp_ntz":  # wall-clock time: no session time zone involved
        start = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), start)
    else:
        start = F.unix_seconds(start)
    return rows.withColumn(name, start)
