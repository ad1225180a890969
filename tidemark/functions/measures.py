"""Quality measures of a pattern as guarded Column arithmetic over its contingency counts.

Every measure is ``fn(tp, fp, tn, fn) -> Column`` and never divides by zero (ANSI mode would raise).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sqltext import case, num

INF = float("inf")
TOLERANCE = 1e-13


def _ratio(top: str, bottom: str, empty: float = 0.0) -> str:
    return case([(f"({bottom}) = 0", num(empty))], f"cast({top} AS DOUBLE) / cast({bottom} AS DOUBLE)")


def tpr(tp, fp, tn, fn):
    return _ratio(tp, f"({tp} + {fn})")


def fpr(tp, fp, tn, fn):
    """1 when there are no negatives: nothing can then speak for the pattern."""
    return _ratio(fp, f"({fp} + {tn})", 1.0)


def tnr(tp, fp, tn, fn):
    return _ratio(tn, f"({fp} + {tn})")


def _total(tp, fp, tn, fn):
    return f"({tp} + {fp} + {tn} + {fn})"


def auc(*t):
    return f"(1D + {tpr(*t)} - {fpr(*t)}) / 2D"


def accuracy(tp, fp, tn, fn):
    return _ratio(f"({tp} + {tn})", _total(tp, fp, tn, fn))


def confidence(tp, fp, tn, fn):
    return _ratio(tp, f"({tp} + {fp})")


def coverage(tp, fp, tn, fn):
    return _ratio(f"({tp} + {fp})", _total(tp, fp, tn, fn))


def g_mean(*t):
    return f"sqrt({tpr(*t)} * {tnr(*t)})"


def growth_rate(*t):
    with_negatives = (f"{fpr(*t)} <> 0", f"{tpr(*t)} / {fpr(*t)}")
    return case([with_negatives, (f"{tpr(*t)} = 0", "0D")], num(INF))


def is_growth_rate(*t):
    return case([(f"{growth_rate(*t)} > 1", "1D")], "0D")


def jaccard(tp, fp, tn, fn):
    return _ratio(tp, f"({tp} + {fn} + {fp})")


def supp_diff(*t):
    return f"({tpr(*t)} - {fpr(*t)})"


def support(tp, fp, tn, fn):
    return _ratio(tp, _total(tp, fp, tn, fn))


def _prior(tp, fp, tn, fn):
    return _ratio(f"({tp} + {fn})", _total(tp, fp, tn, fn))


def wracc(*t):
    return f"({coverage(*t)} * ({confidence(*t)} - {_prior(*t)}))"


def wracc_norm(*t):
    reach = f"({_prior(*t)} * (1D - {_prior(*t)}))"
    return case([(f"{reach} = 0", "0D")], f"({wracc(*t)} + {reach}) / ({reach} + {reach})")


def odds_ratio(tp, fp, tn, fn):
    """0 when either error count is 0, so a perfect pattern gets the worst odds (kept on purpose)."""
    bottom = f"(cast({fp} AS DOUBLE) * cast({fn} AS DOUBLE))"
    return case([(f"{bottom} = 0", "0D")], f"cast({tp} AS DOUBLE) * cast({tn} AS DOUBLE) / {bottom}")


def inverse_fpr(*t):
    return f"(1D - {fpr(*t)})"


def complement(v: str) -> str:
    return f"(1D - {v})"


def _reciprocal(at_zero: float) -> Callable[[str], str]:
    return lambda v: case([(f"{v} = 0", num(at_zero)), (f"{v} = {num(INF)}", "0D")], f"1D / {v}")


def _supp_diff_inverse(v: str) -> str:
    return case([(f"{v} > 0", f"1D - {v}"), (f"{v} < 0", f"{v} + 1D")], "0D")


@dataclass(frozen=True)
class Measure:
    """``fn`` and ``inverse`` give SQL text or a Column; see ``register_measure``."""

    name: str
    fn: Callable
    inverse: Callable = complement
    low: float | None = 0.0
    high: float | None = 1.0
    smaller_is_better: bool = False
    sql: bool = False

    def column(self) -> Column:
        counts = ("tp", "fp", "tn", "fn")
        return F.expr(self.fn(*counts)) if self.sql else self.fn(*[F.col(c) for c in counts])

    def inverse_of(self, value: str) -> Column:
        """The value used where objectives are minimised, from the column holding the raw value."""
        made = self.inverse(value) if self.sql or self.inverse is complement else self.inverse(F.col(value))
        return F.expr(made) if isinstance(made, str) else made

    def valid(self, value: str) -> str:
        """Test on the column holding the value: in range up to the tolerance, and not NaN."""
        tests = [f"NOT isnan({value})"]
        if self.low is not None:
            tests.append(f"{value} >= {num(self.low - TOLERANCE)}")
        if self.high is not None:
            tests.append(f"{value} <= {num(self.high + TOLERANCE)}")
        return " AND ".join(tests)


MEASURES: dict[str, Measure] = {}
REPORTED: list[str] = []


def register_measure(
    name: str,
    fn: Callable,
    inverse: Callable = complement,
    low: float | None = 0.0,
    high: float | None = 1.0,
    smaller_is_better: bool = False,
    reported: bool = False,
    sql: bool = False,
) -> Measure:
    """Add a measure ``fn(tp, fp, tn, fn) -> Column``; it then works everywhere the built-in ones do.

    With ``sql`` the function gets column names and returns an expression as text (the built-in ones do).
    """
    measure = Measure(name, fn, inverse, low, high, smaller_is_better, sql)
    MEASURES[name] = measure
    if reported and name not in REPORTED:
        REPORTED.append(name)
    return measure


register_measure("auc", auc, reported=True, sql=True)
register_measure("accuracy", accuracy, reported=True, sql=True)
register_measure("confidence", confidence, reported=True, sql=True)
register_measure("coverage", coverage, reported=True, sql=True)
register_measure("fpr", fpr, smaller_is_better=True, reported=True, sql=True)
register_measure("g_mean", g_mean, reported=True, sql=True)
register_measure("growth_rate", growth_rate, inverse=_reciprocal(INF), high=None, reported=True, sql=True)
register_measure("is_growth_rate", is_growth_rate, reported=True, sql=True)
register_measure("jaccard", jaccard, reported=True, sql=True)
register_measure("supp_diff", supp_diff, inverse=_supp_diff_inverse, low=-1.0, reported=True, sql=True)
register_measure("support", support, reported=True, sql=True)
register_measure("tnr", tnr, reported=True, sql=True)
register_measure("tpr", tpr, reported=True, sql=True)
register_measure("wracc", wracc, inverse=_reciprocal(0.0), low=None, high=None, reported=True, sql=True)
register_measure("wracc_norm", wracc_norm, reported=True, sql=True)
register_measure("odds_ratio", odds_ratio, inverse=_reciprocal(INF), high=None, sql=True)
register_measure("inverse_fpr", inverse_fpr, high=None, sql=True)

# Value an objective takes for an empty pattern, as a raw (maximised) score.
WORST = {name: (0.0 if m.low is None or m.low >= 0 else m.low) for name, m in MEASURES.items()}
WORST["fpr"] = 1.0


def with_measures(table: DataFrame, names: list[str] | None = None, inverse: bool = False) -> DataFrame:
    """Add one column per measure to a table with tp, fp, tn and fn."""
    picked = [MEASURES[n] for n in (names or REPORTED)]
    out = table.withColumns({m.name: m.column() for m in picked})
    if inverse:
        out = out.withColumns({f"inv_{m.name}": m.inverse_of(m.name) for m in picked})
    return out


def with_odds_interval(table: DataFrame, z: float = 1.96) -> DataFrame:
    """95 % interval of the odds ratio; a zero count adds nothing to the width."""
    spread = " + ".join(case([(f"{c} = 0", "0D")], f"1D / {c}") for c in ("tp", "fp", "tn", "fn"))
    odds, width = odds_ratio("tp", "fp", "tn", "fn"), f"{num(z)} * sqrt({spread})"
    return table.withColumns(
        {"odds_low": F.expr(f"{odds} * exp(-({width}))"), "odds_high": F.expr(f"{odds} * exp({width})")}
    )


def intervals_overlap(low1: str, high1: str, low2: str, high2: str) -> str:
    """The interval with the larger top must start at or below the smaller top."""
    return case([(f"{high1} > {high2}", f"{low1} <= {high2}")], f"{low2} <= {high1}")


def six_decimals(value: Column) -> Column:
    return (
        F.when(value == INF, F.lit("inf"))
        .when(value == -INF, F.lit("-inf"))
        .when(F.isnan(value), F.lit("nan"))
        .otherwise(F.format_string("%.6f", value))
    )


def top_patterns(table: DataFrame, measure: str, k: int, by: str | Sequence[str] = "class") -> DataFrame:
    """The k best patterns of each class by one measure (ties by pattern id)."""
    chosen = MEASURES[measure]
    value = F.col(measure)
    order = value.asc() if chosen.smaller_is_better else value.desc()
    ranked = Window.partitionBy(by).orderBy(order, F.col("pattern_id"))
    return table.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
