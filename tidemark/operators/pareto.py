"""Multi-objective ranking. Objectives are maximised; null objectives take no part."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sqltext import array, name, num, plus
from tidemark.operators.dominance import front_mask, front_numbers
from tidemark.session import cut

BLOCK = 1 << 16  # objective vectors compared inside one task
BROADCAST_VECTORS = 200_000  # a front up to this size is shipped to the rows it is matched with
GROUP = "__group"


def _dominated_by(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), dtype=bool)
    for start in range(0, len(others), 512):
        part = others[start : start + 512]
        ge = (part[None, :, :] >= values[:, None, :]).all(axis=2)
        gt = (part[None, :, :] > values[:, None, :]).any(axis=2)
        out |= (ge & gt).any(axis=1)
    return out


def _vectors(df: DataFrame, objectives: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Group and objective vector of every row that has all objectives."""
    picked = df.select(_group_column(by).alias(GROUP), *[F.col(o).cast("double").alias(o) for o in objectives])
    return picked.dropna()


def _group_column(by: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in by]).cast("string") if by else F.lit("all")


def _schema(objectives: Sequence[str], *extra: str) -> str:
    return ", ".join([f"{GROUP} string", *[f"`{o}` double" for o in objectives], *extra])


def _group_sizes(vectors: DataFrame) -> tuple[int, int]:
    """Vectors in the largest group, and in all."""
    row = vectors.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return row[0] or 0, row[1] or 0


def _front_vectors(vectors: DataFrame, objectives: Sequence[str]) -> tuple[DataFrame, int]:
    """Distinct non-dominated vectors, and an upper limit of their number.

    Each task keeps the front of what it sees, so only survivors are shuffled; they then meet block by block.
    """
    names = list(objectives)

    def local_front(batches):
        fronts: dict[str, np.ndarray] = {}
        for pdf in batches:
            for group, part in pdf.groupby(GROUP):
                values = part[names].to_numpy(dtype=float)
                if group in fronts:
                    values = np.vstack([fronts[group], values])
                values = np.unique(values, axis=0)  # equal vectors do not dominate each other
                fronts[group] = values[front_mask(values)]
        for group, values in fronts.items():
            out = pd.DataFrame(values, columns=names)
            out.insert(0, GROUP, group)
            yield out

    survivors = cut(vectors.mapInPandas(local_front, _schema(names)).distinct())
    largest, total = _group_sizes(survivors)
    blocks = math.ceil(largest / BLOCK)
    if blocks <= 1:

        def final_front(pdf):
            return pdf[front_mask(pdf[names].to_numpy(dtype=float))]

        return survivors.groupBy(GROUP).applyInPandas(final_front, _schema(names)), total

    # Too many survivors for one task: every pair of hash blocks is compared in a task of its own,
    # and a vector stays only if no block dominates it.
    block = F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int")
    placed = survivors.withColumn("__block", block)
    everyone = F.sequence(F.lit(0), F.lit(blocks - 1))
    candidates = placed.withColumn("__other", F.explode(everyone)).withColumn("__role", F.lit(0))
    rivals = (
        placed.withColumnRenamed("__block", "__other")
        .withColumn("__block", F.explode(everyone))
        .withColumn("__role", F.lit(1))
    )

    def beaten(pdf):
        mine = pdf[pdf["__role"] == 0]
        others = pdf[pdf["__role"] == 1]
        lost = _dominated_by(mine[names].to_numpy(dtype=float), others[names].to_numpy(dtype=float))
        return mine.loc[lost, [GROUP, *names]]

    losers = (
        candidates.unionByName(rivals).groupBy(GROUP, "__block", "__other").applyInPandas(beaten, _schema(names)).distinct()
    )
    return survivors.join(losers, [GROUP, *names], "left_anti"), total


def pareto_front(df: DataFrame, objectives: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows no other row of their group dominates."""
    front, total = _front_vectors(_vectors(df, objectives, by), objectives)
    if total <= BROADCAST_VECTORS:
        front = F.broadcast(front)
    return (
        df.withColumn(GROUP, _group_column(by)).join(front, [GROUP, *objectives], "left_semi").drop(GROUP)
    )


def pareto_rank(df: DataFrame, objectives: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``front``: 0 for the non-dominated rows, 1 for those left when they are taken away, and so on."""
    names = list(objectives)
    vectors = cut(_vectors(df, names, by).distinct())
    if _group_sizes(vectors)[0] <= BLOCK:

        def rank_group(pdf):
            return pdf.assign(front=front_numbers(pdf[names].to_numpy(dtype=float)))

        ranked = vectors.groupBy(GROUP).applyInPandas(rank_group, _schema(names, "front int"))
    else:
        rest, ranked, level = vectors, None, 0
        while not rest.isEmpty():
            front = cut(_front_vectors(rest, names)[0])
            part = front.withColumn("front", F.lit(level))
            ranked = part if ranked is None else ranked.unionByName(part)
            rest = cut(rest.join(front, [GROUP, *names], "left_anti"))
            level += 1
        if ranked is None:
            ranked = vectors.withColumn("front", F.lit(0))
    return df.withColumn(GROUP, _group_column(by)).join(ranked, [GROUP, *names]).drop(GROUP)


def crowding_distance(
    df: DataFrame, objectives: Sequence[str], by: Sequence[str], order: Sequence[str] = ("pattern_id",)
) -> DataFrame:
    """Add ``crowding``: per front, the sum over objectives of the normalised gap between neighbours.

    The ends get infinity; a front flat in one objective gets 0 from it.
    """
    total = F.lit(0.0)
    for o in objectives:
        sorted_front = Window.partitionBy(*by).orderBy(F.col(o), *order)
        whole = Window.partitionBy(*by)
        before, after = F.lag(o).over(sorted_front), F.lead(o).over(sorted_front)
        spread = F.max(o).over(whole) - F.min(o).over(whole)
        gap = (
            F.when(before.isNull() | after.isNull(), F.lit(float("inf")))
            .when(spread == 0, F.lit(0.0))
            .otherwise((after - before) / spread)
        )
        total = total + gap
    return df.withColumn("crowding", F.when(F.isnan(total), F.lit(0.0)).otherwise(total))


def select_top(
    df: DataFrame, k: int, by: Sequence[str] = (), order: Sequence[str] = ("pattern_id",)
) -> DataFrame:
    """The k best rows per group: whole fronts first, the last one by crowding (needs front and crowding)."""
    keys = [F.col("front").asc(), F.col("crowding").desc(), *[F.col(c) for c in order]]
    if not by:
        return df.orderBy(*keys).limit(k)
    return (
        df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))
        .filter(F.col("__rn") <= k)
        .drop("__rn")
    )


def reference_association(df: DataFrame, objectives: Sequence[str], points: Sequence[Sequence[float]]) -> DataFrame:
    """Add ``ref`` and ``ref_distance``: the direction each row lies closest to (first one on ties).

    The directions are a parameter, so each becomes a Column; nothing is joined.
    """
    candidates = []
    for r, point in enumerate(points):
        norm = sum(p**2 for p in point)
        dot = plus(f"{name(o)} * {num(p)}" for o, p in zip(objectives, point))
        # Fixed value: the projection used for an all-zero direction is the largest double minus one.
        k = f"{dot} / {num(norm)}" if norm else num(1.7976931348623157e308)
        squared = plus(f"pow({k} * {num(p)} - {name(o)}, 2D)" for o, p in zip(objectives, point))
        candidates.append(f"struct(sqrt({squared}) AS ref_distance, {r} AS ref)")
    return df.withColumn("__best", F.expr(f"array_min({array(candidates)})")).select(
        *df.columns, F.col("__best.ref").alias("ref"), F.col("__best.ref_distance").alias("ref_distance")
    )
