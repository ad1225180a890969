"""Mean, deviation and mean confidence interval per group."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Two-sided 95 % Student quantiles for 1..28 degrees of freedom, and the normal one.
STUDENT_95 = [
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252,
    2.306004135, 2.262157163, 2.228138852, 2.200985160, 2.178812830, 2.160368656, 2.144786688,
    2.131449546, 2.119905299, 2.109815578, 2.100922040, 2.093024054, 2.085963447, 2.079613845,
    2.073873068, 2.068657610, 2.063898562, 2.059538553, 2.055529439, 2.051830516, 2.048407142,
]
NORMAL_95 = 1.959963985


def group_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )


def student_quantile(p: float, freedom: int) -> float:
    """Quantile of Student's distribution, by bisecting its distribution function (a finite sum for whole degrees)."""

    def below(t: float) -> float:
        angle = math.atan(t / math.sqrt(freedom))
        term = total = math.cos(angle) if freedom % 2 else 1.0
        for k in range(3 if freedom % 2 else 2, freedom - 1, 2):
            term *= math.cos(angle) ** 2 * (k - 1) / k
            total += term
        if freedom == 1:
            return 0.5 + angle / math.pi
        if freedom % 2:
            return 0.5 + (angle + math.sin(angle) * total) / math.pi
        return 0.5 + math.sin(angle) * total / 2

    low, high = 0.0, 1e7
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return (low + high) / 2


def mean_confidence_interval(df: DataFrame, value: str, by: list[str], level: float = 0.95) -> DataFrame:
    """Interval of the given level: mean +- 0.1 for one value, Student t below 30 values, normal from 30 on."""
    n = F.col("n")
    usual = level == 0.95
    two_sided = 0.5 + level / 2
    quantile = F.lit(NORMAL_95 if usual else NormalDist().inv_cdf(two_sided))
    quantiles = STUDENT_95 if usual else [student_quantile(two_sided, k) for k in range(1, 29)]
    student = F.element_at(F.array(*[F.lit(q) for q in quantiles]), (n - 1).cast("int"))
    half = (
        F.when(n == 1, F.lit(0.1))
        .when(n < 30, student * F.col("sd") / F.sqrt(n.cast("double")))
        .otherwise(quantile * F.col("sd") / F.sqrt(n.cast("double")))
    )
    return (
        group_stats(df.filter(F.col(value).isNotNull()), value, by)
        .withColumn("half", half)
        .withColumns({"ci_low": F.col("mean") - F.col("half"), "ci_high": F.col("mean") + F.col("half")})
        .drop("half")
    )


