"""Multi-objective cellular search. Population and archive (bounded by classes x size) are a local table; a generation scores
the children of all classes in one job over the cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import draw_int
from tidemark.functions.measures import MEASURES
from tidemark.functions.sqltext import array
from tidemark.operators.contingency import class_totals, contingency, evaluate
from tidemark.operators.coverage import cover_join
from tidemark.operators.dominance import front_mask, front_numbers
from tidemark.operators.filters import FILTERS, coverage_ratio_filter
from tidemark.operators.generate import coverage_patterns, crossover, mutate, oriented_patterns, slots_for
from tidemark.operators.patterns import EMPTY_ID, canonicalise
from tidemark.operators.profile import Layout, active_classes
from tidemark.session import cut

DEFAULT_OBJECTIVES = ("wracc_norm", "confidence")


def _names(objectives: Sequence[str]) -> list[str]:
    return [f"o{i}" for i in range(1, len(objectives) + 1)]


def held(df: DataFrame) -> DataFrame:
    """A population-sized table computed once and kept as a local relation: no later step computes it again, and joins on it
    need no shuffle. Only for tables bounded by classes x population size, whatever the data size.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def _score(
    cells: DataFrame,
    candidates: DataFrame,
    layout: Layout,
    objectives: Sequence[str],
    totals: DataFrame,
    rows: int,
    rewards: DataFrame | None = None,
) -> DataFrame:
    """Objective columns for every candidate row; equal candidates are counted once.

    ``rewards`` (pattern_id, reward_<measure>) is what earlier batches add to a pattern met there.
    """
    unique = candidates.select("pattern_id", "class", "masks").dropDuplicates(["pattern_id", "class"])
    totals = F.broadcast(totals)  # one row per class searched
    widest = max(v.width for v in layout.variables)
    scored = evaluate(cells, unique, layout, objectives, known_rows=rows * widest, totals=totals)
    if rewards is not None:
        scored = scored.join(rewards, "pattern_id", "left").withColumns(
            {
                f"o{i}": F.expr(f"o{i} {'-' if MEASURES[m].smaller_is_better else '+'} coalesce(reward_{m}, 0D)")
                for i, m in enumerate(objectives, 1)
            }
        )
    low = F.lit(float("-inf"))
    values = scored.select("pattern_id", "class", *[F.coalesce(o, low).alias(o) for o in _names(objectives)])
    return candidates.join(F.broadcast(values), ["pattern_id", "class"])  # no more rows than candidates


def crowding_of(values: np.ndarray) -> np.ndarray:
    """Crowding distance of one (bounded) front: ends get infinity, flat objectives add nothing."""
    total = np.zeros(len(values))
    for column in values.T:
        order = np.argsort(column, kind="stable")
        spread = column[order[-1]] - column[order[0]]
        total[order[0]] = total[order[-1]] = np.inf
        if len(values) > 2 and np.isfinite(spread) and spread > 0:
            total[order[1:-1]] += (column[order[2:]] - column[order[:-2]]) / spread
    return total


def settle(state: DataFrame, objectives: Sequence[str], size: int) -> DataFrame:
    """Rank the population and trim the archive, class by class.

    A class holds at most ``size`` population rows and 2 ``size`` archive candidates, whatever the data size.
    """
    names = _names(objectives)
    return state.groupBy("class").applyInPandas(lambda pdf: _settle_class(pdf, names, size), state.schema)


def _settle_class(pdf: pd.DataFrame, names: list[str], size: int) -> pd.DataFrame:
    pop = pdf[pdf["kind"] == "pop"].sort_values("slot")
    values = pop[names].to_numpy(dtype=float)
    fronts = front_numbers(values)
    crowd = np.zeros(len(pop))
    for f in np.unique(fronts):
        crowd[fronts == f] = crowding_of(values[fronts == f])
    pop = pop.assign(front=fronts, crowding=crowd)
    arc = pdf[(pdf["kind"] == "arc") & (pdf["pattern_id"] != EMPTY_ID)]
    arc = arc.drop_duplicates("pattern_id").sort_values("pattern_id")
    values = arc[names].to_numpy(dtype=float)
    first = front_mask(values)
    arc, values = arc[first], values[first]
    arc = arc.assign(front=0, crowding=crowding_of(values) if len(arc) else [])
    arc = arc.sort_values(["crowding", "pattern_id"], ascending=[False, True], kind="stable").head(size)
    arc = arc.assign(slot=np.arange(len(arc)))
    return pd.concat([pop, arc])[list(pdf.columns)]


def neighbour(cell: str, side: int, seed: int, purpose: str, identity: Sequence[str]) -> str:
    """A cell of the 3x3 neighbourhood on the side x side torus."""
    row = f"int({cell} DIV {side}) + {draw_int(-1, 1, seed, purpose + 'r', identity)}"
    col = f"{cell} % {side} + {draw_int(-1, 1, seed, purpose + 'c', identity)}"
    return f"(pmod({row}, {side}) * {side} + pmod({col}, {side}))"


def tournament(a: str, b: str) -> str:
    """The better of two individuals (structs with front and crowding): lower front, then less crowded, then the first."""
    return f"if({a}.front < {b}.front OR ({a}.front = {b}.front AND {a}.crowding >= {b}.crowding), {a}, {b})"


def offspring(state: DataFrame, layout: Layout, size: int, seed: int, p_cross: float, p_mut: float) -> DataFrame:
    """One child per cell: a parent from the neighbourhood, one from the archive (if any), crossover, mutation.

    The generation number is a column, not a literal, so every generation runs the same compiled plan.
    """
    side = math.isqrt(size)
    who = ("class", "slot", "gen")
    member = F.struct("slot", "masks", "front", "crowding")
    by_class = state.groupBy("class").agg(
        F.max("gen").alias("gen"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "pop", member))).alias("pop"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "arc", member))).alias("arc"),
    )
    near = [f"get(pop, {neighbour('slot', side, seed, p, who)})" for p in ("a1", "a2", "b1", "b2")]
    kept = [f"get(arc, {draw_int(0, 'greatest(size(arc) - 1, 0)', seed, p, who)})" for p in ("k1", "k2")]
    girl, _ = crossover(layout, "mom", "dad", seed, who, p_cross)
    children = (
        by_class.selectExpr("class", "gen + 1 AS gen", "pop", "arc", "explode(pop.slot) AS slot")
        .selectExpr(
            *who, f"{near[0]} AS a1", f"{near[1]} AS a2",
            f"if(size(arc) > 0, {kept[0]}, {near[2]}) AS b1", f"if(size(arc) > 0, {kept[1]}, {near[3]}) AS b2",
        )
        .selectExpr(*who, f"{tournament('a1', 'a2')}.masks AS mom", f"{tournament('b1', 'b2')}.masks AS dad")
        .selectExpr(*who, f"{girl} AS masks")
        .selectExpr(*who, f"{mutate(layout, 'masks', seed, who, p_mut)} AS masks")
    )
    return canonicalise(children, layout)


def _dominates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of ``a`` that are nowhere below and somewhere above their row of ``b``; NaN is above all, as in Spark."""
    nan = np.isnan(a)
    return ((a >= b) | nan).all(axis=1) & ((a > b) | (nan & ~np.isnan(b))).any(axis=1)


def _contested(children: pd.DataFrame, parents: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """The new occupant of every cell (the child unless its parent dominates it), and all children as archive candidates."""
    carried = ["pattern_id", "masks", *names]
    both = children.merge(parents[["class", "slot", *carried]], on=["class", "slot"], suffixes=("", "_me"))
    own = both[["class", "gen", "slot", *carried]].assign(front=0, crowding=0.0)
    stays = _dominates(both[[f"{o}_me" for o in names]].to_numpy(float), both[names].to_numpy(float))
    old = both[["class", "gen", "slot", *[f"{c}_me" for c in carried]]].set_axis(["class", "gen", "slot", *carried], axis=1)
    pop = pd.concat([own[~stays], old[stays].assign(front=0, crowding=0.0)])
    return pd.concat([pop.assign(kind="pop"), own.assign(kind="arc")])


def _ids(plain: pd.DataFrame) -> dict[str, set]:
    """Patterns of each class's population."""
    pop = plain[plain["kind"] == "pop"]
    return {c: set(own["pattern_id"]) for c, own in pop.groupby("class")}


def _columns(objectives: Sequence[str]) -> list[str]:
    return ["class", "kind", "gen", "slot", "pattern_id", "masks", *_names(objectives), "front", "crowding"]


def _as_state(scored: DataFrame, kind: str, objectives: Sequence[str], gen: int = 0) -> DataFrame:
    return scored.withColumns(
        {"kind": F.lit(kind), "gen": F.lit(gen), "front": F.lit(0), "crowding": F.lit(0.0)}
    ).select(*_columns(objectives))


def seed_population(
    layout: Layout, classes: Sequence[str], size: int, seed: int, spark, previous: DataFrame | None = None
) -> DataFrame:
    """(class, slot, masks, pattern_id): earlier patterns of the class first, oriented random ones for the rest.

    No earlier pattern is lost: those beyond ``size`` keep their place in the list (slot >= size).
    """
    fresh = oriented_patterns(layout, slots_for(spark, classes, size), seed)
    if previous is None:
        return fresh
    old = canonicalise(previous.filter(F.col("class").isin(list(classes))).select("class", "masks"), layout)
    both = old.select("class", "masks", "pattern_id", F.lit(0).alias("age"), F.lit(0).alias("slot")).unionByName(
        fresh.select("class", "masks", "pattern_id", F.lit(1).alias("age"), "slot")
    )
    place = F.row_number().over(Window.partitionBy("class").orderBy("age", "slot", "pattern_id")) - 1
    return both.withColumn("slot", place).filter((F.col("slot") < size) | (F.col("age") == 0)).select("class", "slot", "masks", "pattern_id")


def covered_cells(cells: DataFrame, patterns: DataFrame, layout: Layout, known_rows: int | None = None) -> DataFrame:
    """(class, words, cell_class): cells each class's population covers; rows of one cell are covered together.

    A cell is named by its words and class, not by a hash of them.
    """
    unique = patterns.select("pattern_id", "class", "masks").dropDuplicates(["pattern_id", "class"])
    return (
        cover_join(cells, unique, layout, known_rows=known_rows)
        .select(F.col("pattern_class").alias("class"), *layout.words, F.col("class").alias("cell_class"))
        .distinct()
    )


def front_covered_cells(cells: DataFrame, population: DataFrame, layout: Layout) -> DataFrame:
    """As ``covered_cells`` for the non-dominated patterns only (``front`` = 0)."""
    return covered_cells(cells, population.filter("front = 0"), layout)


def newly_covering_classes(previous: DataFrame, current: DataFrame) -> list[str]:
    """Classes whose population covers something it did not cover before."""
    fresh = current.join(previous, current.columns, "left_anti")
    return [r["class"] for r in fresh.select("class").distinct().collect()]


def needs_reinit(last_change: dict[str, int], evaluations: int, budget: int, pct: float = 0.25) -> list[str]:
    """Classes without newly covered rows for at least ``pct`` of the budget."""
    return sorted(c for c, at in last_change.items() if evaluations - at >= int(budget * pct))


def reinitialise(
    cells: DataFrame, population: DataFrame, layout: Layout, classes: Sequence[str], size: int, seed: int, pct: float = 0.25
) -> DataFrame:
    """New populations for stalled classes: filtered survivors, then patterns seeded from uncovered rows, then random ones."""
    spark = cells.sparkSession
    own = population.filter(F.col("class").isin(list(classes)))
    placed = own.dropDuplicates(["pattern_id", "class"]).withColumn(
        "pos", F.row_number().over(Window.orderBy("class", "slot")) - 1  # at most size rows per class
    ).select("pos", "pattern_id", "class", "masks")
    survivors = cut(coverage_ratio_filter(cells, cut(placed), layout))
    hit = cover_join(cells, survivors, layout).filter(F.col("class") == F.col("pattern_class"))
    keys = [*layout.words, "class"]
    missed = cells.filter(F.col("class").isin(list(classes))).join(hit.select(*keys).distinct(), keys, "left_anti")
    ranked = Window.partitionBy("class").orderBy(F.xxhash64(F.lit(seed), *layout.words), *layout.words)
    seeds = missed.withColumn("slot", F.row_number().over(ranked)).filter(F.col("slot") <= size)
    seeded = coverage_patterns(layout, seeds.select(*keys, "slot"), seed, pct)
    fresh = oriented_patterns(layout, slots_for(spark, classes, size), seed + 1, pct)
    pool = (
        survivors.select("class", "masks", "pattern_id", F.lit(0).alias("age"), F.col("pos").alias("slot"))
        .unionByName(seeded.select("class", "masks", "pattern_id", F.lit(1).alias("age"), "slot"))
        .unionByName(fresh.select("class", "masks", "pattern_id", F.lit(2).alias("age"), "slot"))
    )
    place = F.row_number().over(Window.partitionBy("class").orderBy("age", "slot", "pattern_id")) - 1
    kept = pool.withColumn("slot", place).filter(F.col("slot") < size)
    return kept.select("class", "slot", "masks", "pattern_id", (F.col("age") == 0).alias("survivor"))


def search(
    cells: DataFrame,
    layout: Layout,
    classes: Sequence[str],
    objectives: Sequence[str] = DEFAULT_OBJECTIVES,
    size: int = 49,
    evaluations: int = 5000,
    seed: int = 7,
    p_cross: float = 0.6,
    p_mut: float = 0.1,
    reinit_pct: float = 0.25,
    previous: DataFrame | None = None,
    rewards: DataFrame | None = None,
    check_every: int = 1,
) -> DataFrame:
    """Archive of every class after the budget: (class, pattern_id, masks, objectives, crowding). ``size`` is a square.

    ``previous`` patterns of a class open its population; ``rewards`` are added to the objectives.
    """
    spark = cells.sparkSession
    if math.isqrt(size) ** 2 != size:
        raise ValueError("population size must be a square")
    totals = held(class_totals(cells))
    rows = size * len(classes)
    columns = _columns(objectives)
    names = _names(objectives)
    start = _score(cells, seed_population(layout, classes, size, seed, spark, previous), layout, objectives, totals, rows, rewards)
    start = held(start.select("class", "slot", "pattern_id", "masks", *names))
    opening = _as_state(start.filter(F.col("slot") < size), "pop", objectives).unionByName(_as_state(start, "arc", objectives))
    schema = opening.schema

    def settled(*parts: pd.DataFrame) -> tuple[pd.DataFrame, DataFrame]:
        """Population and archive of all classes, as plain rows and as a local relation."""
        together = pd.concat([p for p in parts if len(p)])
        kept = pd.concat([_settle_class(own, names, size) for _, own in together.groupby("class", sort=True)])
        return kept, spark.createDataFrame(kept, schema)

    def numbers(scored: pd.DataFrame) -> dict:
        """Objectives by class and pattern; the cells stay the same for the whole search, so each is scored once."""
        return dict(zip(zip(scored["class"], scored["pattern_id"]), scored[names].itertuples(index=False, name=None)))

    first = opening.toPandas()
    known = numbers(first)
    plain, state = settled(first)
    covered = cut(covered_cells(cells, state.filter("kind = 'pop'"), layout, rows * max(v.width for v in layout.variables)))
    # Patterns of each class that cover nothing beyond ``covered``: a population of such patterns covers nothing new.
    inside = _ids(plain)
    done = size
    last_change = {c: done for c in classes}
    generation = 0
    while done < evaluations:
        generation += 1
        children = offspring(state, layout, size, seed, p_cross, p_mut).toPandas()
        fresh = children.drop_duplicates(["class", "pattern_id"])
        fresh = fresh[[pair not in known for pair in zip(fresh["class"], fresh["pattern_id"])]]
        if len(fresh):
            unknown = spark.createDataFrame(fresh[["class", "pattern_id", "masks"]], "class string, pattern_id string, masks array<bigint>")
            known |= numbers(_score(cells, unknown, layout, objectives, totals, rows, rewards).select("class", "pattern_id", *names).toPandas())
        values = [known[pair] for pair in zip(children["class"], children["pattern_id"])]
        children[names] = np.array(values, float).reshape(len(children), len(names))
        plain, state = settled(_contested(children, plain[plain["kind"] == "pop"], names)[columns], plain[plain["kind"] == "arc"])
        done += size
        if generation % check_every == 0 and done < evaluations:
            pop = state.filter("kind = 'pop'")
            present = _ids(plain)
            changed = sorted(c for c in present if present[c] - inside.get(c, set()))
            growing = []
            if changed:
                now = covered_cells(cells, pop.filter(F.col("class").isin(changed)), layout, rows * max(v.width for v in layout.variables))
                growing = newly_covering_classes(covered, now)
            for c in changed:
                inside[c] = present[c] if c in growing else inside.get(c, set()) | present[c]
            for c in growing:
                last_change[c] = done
            if growing:
                covered = covered.filter(~F.col("class").isin(growing)).unionByName(now.filter(F.col("class").isin(growing)))
            stalled = needs_reinit(last_change, done, evaluations, reinit_pct)
            if stalled:
                renewed = reinitialise(cells, pop, layout, stalled, size, seed + 1000 * generation + 500, 0.25)
                renewed = held(renewed)
                survivors = renewed.filter("survivor")
                renewed = _score(cells, renewed, layout, objectives, totals, rows, rewards)
                renewed = held(renewed.select("class", "slot", "pattern_id", "masks", *names))
                both = _as_state(renewed, "pop", objectives, generation).unionByName(_as_state(renewed, "arc", objectives, generation))
                both = both.toPandas()
                known |= numbers(both)
                plain, state = settled(plain[(plain["kind"] == "arc") | ~plain["class"].isin(stalled)], both)
                # A renewed population is not charged to the budget, so every class has its whole one; what it is
                # later compared with is the coverage of the patterns that survived.
                for c in stalled:
                    last_change[c] = done
                left = survivors.select("class", "pattern_id").toPandas()
                inside |= {c: set(left.loc[left["class"] == c, "pattern_id"]) for c in stalled}
                fresh = cut(covered_cells(cells, survivors, layout, rows * max(v.width for v in layout.variables)))
                covered = covered.filter(~F.col("class").isin(stalled)).unionByName(fresh.filter(F.col("class").isin(stalled)))
            covered = cut(covered) if growing or stalled else covered
    return state.filter("kind = 'arc'").select("class", "pattern_id", "masks", *names, "crowding")


def mine(
    cells: DataFrame,
    layout: Layout,
    objectives: Sequence[str] = DEFAULT_OBJECTIVES,
    classes: Sequence[str] | None = None,
    max_pct: float = 1.0,
    filters: Sequence[str | Callable] = (),
    **options,
) -> DataFrame:
    """The elite patterns of all classes: search, then the filters in order. Adds tp, fp, tn, fn.

    ``filters`` are registered names or functions of (cells, patterns, layout); none given means the coverage-ratio
    filter with ``max_pct``.
    """
    if classes is None:
        classes = [r["class"] for r in active_classes(cells, "class").select("class").orderBy("class").collect()]
    archive = search(cells, layout, classes, objectives, **options)
    listed = cut(
        archive.withColumn("pos", F.row_number().over(Window.orderBy("class", F.col("crowding").desc(), "pattern_id")) - 1)
    )  # the archives hold at most size rows per class
    elite = listed
    for chosen in filters or [partial(coverage_ratio_filter, max_pct=max_pct)]:
        elite = cut((FILTERS[chosen] if isinstance(chosen, str) else chosen)(cells, elite, layout).select(*listed.columns))
    return contingency(cells, elite.drop("pos", "crowding"), layout)
