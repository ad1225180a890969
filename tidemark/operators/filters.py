"""Filters over pattern sets. ``pos`` is a pattern's place in its list; filters with a list order need it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.measures import MEASURES, intervals_overlap, with_measures, with_odds_interval
from tidemark.functions.sqltext import case, num
from tidemark.operators.contingency import contingency
from tidemark.operators.coverage import cover_join
from tidemark.operators.overlaps import overlap_pairs
from tidemark.operators.patterns import n_elements
from tidemark.operators.profile import Layout
from tidemark.session import cut

FILTERS: dict[str, Callable] = {}


def register_filter(name: str, fn: Callable) -> Callable:
    """Add a pattern-set filter: a function of (cells, patterns, layout) that returns the patterns it keeps, with ``pos``,
    ``pattern_id``, ``class``, ``masks`` and whatever else they had. ``mine(filters=[name])`` applies it."""
    FILTERS[name] = fn
    return fn


def coverage_ratio_filter(
    cells: DataFrame, patterns: DataFrame, layout: Layout, max_pct: float = 1.0, scored: DataFrame | None = None
) -> DataFrame:
    """Drop patterns without coverage, and of two that overlap too much the one with clearly worse odds.

    When the odds intervals overlap the longer pattern goes (the later one if equally long). The result
    is that of comparing the list pairwise in order, where a dropped later pattern is no longer compared
    but a dropped earlier one still is: pattern j goes at its first winner i; a pattern i that loses
    to a later j goes unless j was gone before i's turn. That needs two aggregates, no sequential pass.
    """
    if max_pct <= 0:
        raise ValueError("max_pct must be above 0: only patterns that share a row are compared")
    if scored is None:
        scored = contingency(cells, patterns, layout)
    scored = cut(with_odds_interval(scored).withColumn("size", F.expr(n_elements(layout))))  # read four times below
    live = scored.filter(F.col("tp") + F.col("fp") > 0)
    side = ["pos", "tp", "odds_low", "odds_high", "size"]
    one = live.select("class", *[F.col(c).alias(f"{c}1") for c in side])
    two = live.select("class", *[F.col(c).alias(f"{c}2") for c in side])
    pairs = overlap_pairs(cells, live.select("pos", "class", "masks"), layout, max_pct).join(one, ["class", "pos1"]).join(two, ["class", "pos2"])
    close = pairs.filter(f"greatest(both / tp1, both / tp2) >= {num(max_pct)}")
    loser = case(
        [
            ("odds_low1 > odds_high2", "2"),
            ("odds_low2 > odds_high1", "1"),
            (intervals_overlap("odds_low1", "odds_high1", "odds_low2", "odds_high2"), "int(if(size1 <= size2, 2, 1))"),
        ]
    )
    judged = close.select("class", "pos1", "pos2", F.expr(loser).alias("loser"))
    later = judged.filter(F.col("loser") == 2).groupBy("class", "pos2").agg(F.min("pos1").alias("gone_at"))
    earlier = (
        judged.filter(F.col("loser") == 1)
        .join(later, ["class", "pos2"], "left")
        .filter(F.col("gone_at").isNull() | (F.col("gone_at") > F.col("pos1")))
        .select("class", F.col("pos1").alias("pos"))
    )
    gone = later.select("class", F.col("pos2").alias("pos")).unionByName(earlier).distinct()
    return live.select(*patterns.columns).join(gone, ["class", "pos"], "left_anti").select(*patterns.columns)


def token_competition(cells: DataFrame, patterns: DataFrame, layout: Layout, scored: DataFrame | None = None) -> DataFrame:
    """Keep a pattern iff some row of its class has it as best-ranked coverer.

    Rank: normalised relative accuracy, then fewer elements, then id. Equal to walking the ranking and
    keeping whatever takes a row nobody better took. A class never ends up empty.
    """
    if scored is None:
        scored = contingency(cells, patterns, layout)
    order = Window.partitionBy("class").orderBy(F.col("wracc_norm").desc(), F.col("__size"), F.col("pattern_id"))
    ranked = (
        with_measures(scored, ["wracc_norm"])
        .withColumn("__size", F.expr(n_elements(layout)))
        .withColumn("rank", F.row_number().over(order))
        .select(*patterns.columns, "rank")
    )
    own = cover_join(cells, ranked, layout, keep=["rank"]).filter(F.col("class") == F.col("pattern_class"))
    winners = own.groupBy("class", *layout.words).agg(F.min("rank").alias("rank")).select("class", "rank").distinct()
    flagged = ranked.join(winners.withColumn("wins", F.lit(True)), ["class", "rank"], "left")
    some = F.max(F.coalesce("wins", F.lit(False))).over(Window.partitionBy("class"))
    return (
        flagged.withColumn("__some", some)
        .filter(F.col("wins") | (~F.col("__some") & (F.col("rank") == 1)))
        .select(*patterns.columns, "rank")
    )


def measure_threshold(scored: DataFrame, measure: str, threshold: float, by: Sequence[str] = ("class",)) -> DataFrame:
    """Keep patterns whose inverse value is below 1 - threshold; if a group has none, its single best one."""
    best_first = Window.partitionBy(*by).orderBy(F.col("__inv"), F.col("pattern_id"))
    passing = F.col("__inv") < F.lit(1.0 - threshold)
    return (
        scored.withColumn("__raw", MEASURES[measure].column())
        .withColumn("__inv", MEASURES[measure].inverse_of("__raw"))
        .withColumns({"__rn": F.row_number().over(best_first), "__any": F.max(passing).over(Window.partitionBy(*by))})
        .filter(passing | (~F.col("__any") & (F.col("__rn") == 1)))
        .drop("__raw", "__inv", "__rn", "__any")
    )


def drop_repeated(patterns: DataFrame) -> DataFrame:
    """Of patterns with equal masks keep the last in the list, whatever its class."""
    last = patterns.groupBy("masks").agg(F.max("pos").alias("pos"))
    return patterns.join(last, ["masks", "pos"], "left_semi")


def drop_repeated_scored(patterns: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """Of patterns with equal objectives and masks keep the first in the list."""
    first = patterns.groupBy(*objectives, "masks").agg(F.min("pos").alias("pos"))
    return patterns.join(first, [*objectives, "masks", "pos"], "left_semi")


def model_for_classes(model: DataFrame, classes: DataFrame) -> DataFrame:
    return model.join(classes.select("class").distinct(), "class", "left_semi")


register_filter("coverage_ratio", coverage_ratio_filter)
register_filter("token_competition", lambda cells, patterns, layout: token_competition(cells, patterns, layout).drop("rank"))
register_filter(
    "confidence",
    lambda cells, patterns, layout: measure_threshold(contingency(cells, patterns, layout), "confidence", 0.6).select(*patterns.columns),
)
register_filter("drop_repeated", lambda cells, patterns, layout: drop_repeated(patterns))
