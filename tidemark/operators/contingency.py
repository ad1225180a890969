"""Contingency tables, objective evaluation, test evaluation and pattern enumeration."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.measures import MEASURES, WORST, with_measures
from tidemark.functions.sqltext import array, case, name, num, text
from tidemark.operators.coverage import cover_join
from tidemark.operators.fuzzify import selectors_of
from tidemark.operators.packed import packed_counts
from tidemark.operators.patterns import EMPTY_ID, pattern_key
from tidemark.operators.profile import Layout


def covered_counts(
    cells: DataFrame, patterns: DataFrame, layout: Layout, by: Sequence[str] = (), known_rows: int | None = None
) -> DataFrame:
    """(by, pattern_id, covered, hits): partial sums per task before the shuffle, so hot patterns stay cheap."""
    once = patterns.select("pattern_id", "class", "masks").dropDuplicates(["pattern_id"])
    return (
        cover_join(cells, once, layout, known_rows=known_rows)
        .groupBy(*by, "pattern_id")
        .agg(
            F.sum("n").alias("covered"),
            F.sum(F.when(F.col("class") == F.col("pattern_class"), F.col("n")).otherwise(F.lit(0))).alias("hits"),
        )
    )


def class_totals(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, positives, total): a row per class, so the window over it holds a handful of rows."""
    counts = cells.groupBy(*by, "class").agg(F.sum("n").alias("positives"))
    everything = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return counts.withColumn("total", F.sum("positives").over(everything))


def contingency(
    cells: DataFrame,
    patterns: DataFrame,
    layout: Layout,
    by: Sequence[str] = (),
    known_rows: int | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Pattern columns plus tp, fp, tn, fn (BIGINT, exact). Empty patterns get 0, 0, 0, 0.

    With ``by`` (batch columns) a pattern is scored on every batch in which its class occurs. Otherwise coverage and totals
    come from one scan by bit columns, unless the caller knows the totals or there are more patterns than tasks should hold.
    """
    patterns = patterns.drop("tp", "fp", "tn", "fn")  # counts from other data
    sums = packed_counts(cells, patterns, layout) if not by and totals is None else None
    if sums is not None:
        return _with_counts(patterns.join(sums, "pattern_id", "left"), patterns.columns)
    totals = class_totals(cells, by) if totals is None else totals
    counts = covered_counts(cells, patterns, layout, by, known_rows)
    if known_rows is not None and not by:
        counts = F.broadcast(counts)  # at most one row per pattern, and the caller knows how many there are
    if by:
        scored = patterns.join(totals, "class")
    else:
        # The grand total reaches patterns of classes without any row through a scalar subquery.
        scored = patterns.join(totals.drop("total"), "class", "left").withColumn(
            "total", totals.select(F.max("total")).scalar()
        )
    return _with_counts(scored.join(counts, [*by, "pattern_id"], "left"), patterns.columns, by)


def _with_counts(scored: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The four counts from covered, hits, positives and total; nulls are 0."""
    tp, covered = "coalesce(hits, 0L)", "coalesce(covered, 0L)"
    positives, total = "coalesce(positives, 0L)", "coalesce(total, 0L)"
    counts_of = {
        "tp": tp,
        "fp": f"{covered} - {tp}",
        "tn": f"{total} - {positives} - ({covered} - {tp})",
        "fn": f"{positives} - {tp}",
    }
    some = f"pattern_id <> {text(EMPTY_ID)}"
    return scored.selectExpr(
        *by, *[name(c) for c in columns], *[f"{case([(some, e)], '0L')} AS {c}" for c, e in counts_of.items()]
    )


def evaluate(
    cells: DataFrame,
    patterns: DataFrame,
    layout: Layout,
    objectives: Sequence[str],
    known_rows: int | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Objectives o1..oM as raw values to be maximised: null when out of range, the worst value for empty patterns."""
    table = contingency(cells, patterns, layout, known_rows=known_rows, totals=totals)
    out = table.withColumns({f"o{i}": MEASURES[m].column() for i, m in enumerate(objectives, 1)})
    checked = {}
    for i, m in enumerate(objectives, 1):
        sign = "-" if MEASURES[m].smaller_is_better else ""
        value = case(
            [(f"pattern_id = {text(EMPTY_ID)}", num(WORST.get(m, 0.0))), (MEASURES[m].valid(f"o{i}"), f"o{i}")]
        )
        checked[f"o{i}"] = F.expr(f"{sign}{value}")
    return out.withColumns(checked)


def evaluate_test(
    cells: DataFrame, patterns: DataFrame, layout: Layout, by: Sequence[str] = (), inverse: bool = False, known_rows: int | None = None
) -> DataFrame:
    """Contingency and every reported measure."""
    return with_measures(contingency(cells, patterns, layout, by, known_rows), inverse=inverse)


def enumerate_patterns(cells: DataFrame, layout: Layout, max_vars: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """All single-value patterns over at most ``max_vars`` variables, for every class (and batch ``by``), with exact counts.

    Each cell is expanded into its value combinations and summed map-side; the class rows of one
    combination are then laid side by side (a window over at most one row per class).
    """
    own = {
        v: [w if layout.word_var[i] == v else "0L" for i, w in enumerate(layout.words)]
        for v in range(len(layout.variables))
    }
    parts = []
    for size in range(1, max_vars + 1):
        # The variable choices are a literal array; one explode picks the choice, one per slot its values.
        choices = array(
            f"struct({', '.join(f'{selectors_of(layout, own[v])} AS s{k}' for k, v in enumerate(choice))})"
            for choice in combinations(range(len(layout.variables)), size)
        )
        part = cells.selectExpr(*by, "class", "n", f"explode({choices}) AS c")
        for k in range(size):
            part = part.withColumn(f"sel{k}", F.expr(f"explode(c.s{k})"))
        parts.append(part.selectExpr(*by, "class", "n", f"{array(f'sel{k}' for k in range(size))} AS sels"))
    combos = parts[0]
    for extra in parts[1:]:
        combos = combos.unionByName(extra)
    counts = combos.groupBy(*by, "sels", "class").agg(F.sum("n").alias("hits"))
    same = Window.partitionBy(*by, "sels")
    totals = class_totals(cells, by)
    hits = counts.withColumn("covered", F.sum("hits").over(same))
    masks = array(_mask_from_selectors(layout, i) for i in range(len(layout.words)))
    return (
        hits.join(totals if by else F.broadcast(totals), [*by, "class"])  # one row per class, bounded by the class domain
        .withColumn("masks", F.expr(masks))
        .withColumn("pattern_id", F.expr(pattern_key()))
        .select(
            *by,
            "pattern_id",
            "class",
            "masks",
            F.size("sels").alias("n_vars"),
            F.col("hits").alias("tp"),
            (F.col("covered") - F.col("hits")).alias("fp"),
            (F.col("total") - F.col("positives") - (F.col("covered") - F.col("hits"))).alias("tn"),
            (F.col("positives") - F.col("hits")).alias("fn"),
        )
    )


def _mask_from_selectors(layout: Layout, i: int) -> str:
    """Mask word i of a single-value pattern given as flat selectors."""
    base, top = layout.word_offset(i), layout.word_offset(i) + layout.word_width(i) - 1
    return (
        f"aggregate(filter(sels, s -> s BETWEEN {base} AND {top}), 0L, (acc, s) -> acc | shiftleft(1L, s - {base}))"
    )
