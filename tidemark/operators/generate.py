"""Making patterns: random ones, ones seeded from rows, crossover and mutation. All draws are hashes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.draws import draw, draw_int, hashed
from tidemark.functions.sqltext import array, case, long, plus
from tidemark.operators.patterns import canonicalise
from tidemark.operators.profile import Layout

WHO = ("class", "slot")


def random_words(layout: Layout, seed: int, purpose: str, identity: Sequence[str]) -> list[str]:
    """One mask word per layout word, each bit set with probability one half."""
    return [
        f"(shiftrightunsigned({hashed(seed, f'{purpose}{i}', identity)}, 1) & {long(layout.full_mask(i))})"
        for i in range(len(layout.words))
    ]


def slots_for(spark: SparkSession, classes: Sequence[str], n: int, fixed: bool = True) -> DataFrame:
    """(class, slot): n slots for every class, or n in all with the classes taking turns."""
    names = F.array(*[F.lit(c) for c in classes])
    base = spark.range(n).select(F.col("id").cast("int").alias("slot"))
    if fixed:
        return base.select(F.explode(names).alias("class"), "slot")
    return base.select(F.get(names, F.col("slot") % len(classes)).alias("class"), "slot")


def random_patterns(layout: Layout, slots: DataFrame, seed: int) -> DataFrame:
    """Every bit of every variable at random, one pattern per row of ``slots(class, slot)``."""
    return canonicalise(slots.withColumn("masks", F.expr(array(random_words(layout, seed, "random", WHO)))), layout)


def _some_variables(layout: Layout, count: str, seed: int, purpose: str, identity: Sequence[str]) -> str:
    """Array of ``count`` variable numbers in a drawn order."""
    order = array(f"struct({draw(seed, f'{purpose}{v}', identity)} AS d, {v} AS v)" for v in range(len(layout.variables)))
    return f"transform(slice(array_sort({order}), 1, {count}), s -> s.v)"


def oriented_patterns(layout: Layout, slots: DataFrame, seed: int, pct: float = 0.25) -> DataFrame:
    """Few variables per pattern: 1..round(pct V) of them, half of their values set, never none and never all."""
    most = max(1, math.floor(pct * len(layout.variables) + 0.5))
    drawn = slots.withColumns(
        {
            "__chosen": F.expr(_some_variables(layout, draw_int(1, most, seed, "count", WHO), seed, "pick", WHO)),
            "__words": F.expr(array(random_words(layout, seed, "oriented", WHO))),
            "__lucky": F.expr(array(draw_int(0, v.width - 1, seed, f"fix{k}", WHO) for k, v in enumerate(layout.variables))),
        }
    )
    masks = []
    for i, v in enumerate(layout.word_var):
        bits = plus(f"bit_count(__words[{k}])" for k in layout.words_of(v))
        local = f"(__lucky[{v}] - {layout.word_low[i]})"
        flip = case(
            [(f"{bits} IN (0, {layout.variables[v].width}) AND {local} BETWEEN 0 AND {layout.word_width(i) - 1}", f"shiftleft(1L, {local})")],
            "0L",
        )
        masks.append(case([(f"array_contains(__chosen, {v})", f"__words[{i}] ^ {flip}")], "0L"))
    return canonicalise(drawn.withColumn("masks", F.expr(array(masks))).drop("__chosen", "__words", "__lucky"), layout)


def coverage_patterns(layout: Layout, rows: DataFrame, seed: int, pct: float = 0.25) -> DataFrame:
    """One pattern per given row (word columns, class, slot) that covers the row: 1..ceil(pct pairs)+1 of its values.

    Variables are chosen first, then one value of each is drawn among those that cover the row, so the count is capped at V.
    """
    who = [*WHO, *layout.words]
    pairs = plus(f"bit_count({w})" for w in layout.words)
    most = f"int(least(ceil({pct}D * {pairs}) + 1, {len(layout.variables)}))"
    chosen = _some_variables(layout, draw_int("1", most, seed, "seeds", who), seed, "seed", who)
    picks = []
    for v in range(len(layout.variables)):
        own = layout.words_of(v)
        # The k-th of the values that cover the row, k drawn; counted through the variable's words.
        k = draw_int("1", f"greatest({plus(f'bit_count(w{i})' for i in own)}, 1)", seed, f"value{v}", who)
        picks.append(f"IF(array_contains(__chosen, {v}), {k}, 0)")
    drawn = rows.withColumn("__chosen", F.expr(chosen)).withColumn("__picks", F.expr(array(picks)))
    masks = []
    for i, v in enumerate(layout.word_var):
        before = plus(["0", *[f"bit_count(w{j})" for j in layout.words_of(v) if j < i]])
        left = f"(__picks[{v}] - ({before}))"
        # Clearing the lowest value left - 1 times leaves the wanted one lowest.
        rest = f"aggregate(sequence(1, {left} - 1, 1), w{i}, (m, x) -> m & (m - 1L))"
        cleared = f"IF({left} > 1, {rest}, w{i})"
        masks.append(f"IF({left} BETWEEN 1 AND bit_count(w{i}), {cleared} & -({cleared}), 0L)")
    return canonicalise(drawn.withColumn("masks", F.expr(array(masks))).drop("__chosen", "__picks"), layout)


def crossover(
    layout: Layout, mom: str, dad: str, seed: int, identity: Sequence[str], p: float = 0.6, points: int = 2
) -> tuple[str, str]:
    """Both children of an n-point crossover over variables; a swap starts or ends after each distinct cut point."""
    last = len(layout.variables) - 1
    cuts = f"array_distinct({array(draw_int(0, last, seed, f'cut{k}', identity) for k in range(points))})"
    mate = f"{draw(seed, 'mate', identity)} < {p}D"
    swap = [f"({mate} AND size(filter({cuts}, c -> c < {v})) % 2 = 1)" for v in layout.word_var]
    girl = array(f"if({s}, {dad}[{i}], {mom}[{i}])" for i, s in enumerate(swap))
    boy = array(f"if({s}, {mom}[{i}], {dad}[{i}])" for i, s in enumerate(swap))
    return girl, boy


def mutate(layout: Layout, masks: str, seed: int, identity: Sequence[str], p: float = 0.1) -> str:
    """With probability p change one variable: clear it, or flip each of its values with probability one half."""
    hit = f"{draw(seed, 'mutate', identity)} <= {p}D"
    which = draw_int(0, len(layout.variables) - 1, seed, "variable", identity)
    clear = f"{draw(seed, 'clear', identity)} < 0.5D"
    flips = random_words(layout, seed, "flip", identity)
    return array(
        case([(f"{hit} AND {which} = {v}", f"if({clear}, 0L, {masks}[{i}] ^ {flips[i]})")], f"{masks}[{i}]")
        for i, v in enumerate(layout.word_var)
    )
