"""Reports: readable rules, training and test tables, per-batch summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.measures import REPORTED, six_decimals
from tidemark.operators.patterns import n_vars, rule_text
from tidemark.operators.profile import Layout


def render_rules(patterns: DataFrame, layout: Layout, batch: str | None = None) -> DataFrame:
    """(batch, class, pattern_id, rule): one line per pattern."""
    keys = [batch] if batch else []
    return rule_text(patterns, layout).select(*keys, "class", "pattern_id", "rule")


def training_report(patterns: DataFrame, objectives: Sequence[str], diversity: str | None = None) -> DataFrame:
    """Rule number within its class, id, class, objective values and diversity, values with six decimals."""
    number = F.row_number().over(Window.partitionBy("class").orderBy("pattern_id")) - 1
    shown = [six_decimals(F.col(o).cast("double")).alias(o) for o in [*objectives, *([diversity] if diversity else [])]]
    return patterns.select(number.alias("rule_no"), F.col("pattern_id").alias("id"), "class", *shown)


def test_report(scored: DataFrame, layout: Layout, batch: str = "batch_id", measures: Sequence[str] = REPORTED) -> DataFrame:
    """Detail rows and one average row per batch (pattern_id null), from one pass over grouping sets.

    Counts appear on detail rows only; ``n_rules`` is 1 there and the number of rules on the average row.
    """
    rows = scored.withColumn("n_vars", F.expr(n_vars(layout)))
    sets = [[F.col(batch), F.col("class"), F.col("pattern_id")], [F.col(batch)]]
    detail = F.grouping("pattern_id") == 0
    aggs = [F.count(F.lit(1)).alias("n_rules"), F.avg("n_vars").alias("n_vars")]
    aggs += [F.when(detail, F.max(c)).alias(c) for c in ("tp", "fp", "tn", "fn")]
    aggs += [F.avg(m).alias(m) for m in measures]
    return rows.groupingSets(sets, F.col(batch), F.col("class"), F.col("pattern_id")).agg(*aggs)


def summary_report(
    scored: DataFrame, layout: Layout, batch: str = "batch_id", measures: Sequence[str] = REPORTED, exec_ms: float | None = None
) -> DataFrame:
    """Per batch: number of rules, mean variables and the mean of every measure."""
    rows = scored.withColumn("n_vars", F.expr(n_vars(layout)))
    out = rows.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_rules"), F.avg("n_vars").alias("n_vars"), *[F.avg(m).alias(m) for m in measures]
    )
    return out.withColumn("exec_ms", F.lit(float(exec_ms))) if exec_ms is not None else out


def write_rules(rules: DataFrame, path: str) -> None:
    rules.select("rule").write.mode("overwrite").text(path)


def write_table(report: DataFrame, path: str) -> None:
    """Tab-separated with a header."""
    report.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)
