"""Scoring tables with fuzzy rule sets: strengths and discrete outputs are plain expressions; continuous
outputs are defuzzified over a 1000-point grid in Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import membership
from tidemark.functions.connectors import ACCUMULATION, ACTIVATION, DUAL, PLAIN_AND, PLAIN_OR, arithmetic
from tidemark.functions.sqltext import case, name, num

POINTS = 1000
ROWS_PER_STEP = 256  # rows x grid points held at once by a task

CONTINUOUS = ("cog", "coa", "lm", "rm", "mm")


@dataclass(frozen=True)
class Output:
    """Terms are (family, parameters); for ``cogf`` outputs a term is an arithmetic tree instead."""

    terms: dict
    method: str = "cog"
    default: float | None = None
    accumulate: str = "max"
    bounds: tuple[float, float] | None = None

    def universe(self) -> tuple[float, float]:
        if self.bounds:
            return self.bounds
        reach = [membership.universe(f, p) for f, p in self.terms.values()]
        return min(r[0] for r in reach), max(r[1] for r in reach)


@dataclass(frozen=True)
class Rule:
    """``when`` is ("is", input, term), ("not", e), ("and", e, ...) or ("or", e, ...)."""

    when: tuple
    then: tuple  # ((output, term), ...) or ((output, term, negated), ...)
    weight: float = 1.0


@dataclass(frozen=True)
class RuleSet:
    inputs: dict  # input column -> {term: (family, parameters)}
    outputs: dict  # output name -> Output
    rules: tuple
    conjunction: str = "min"
    activation: str = "min"

    @property
    def disjunction(self) -> str:
        return DUAL[self.conjunction]

    def for_output(self, output: str) -> list[tuple[int, str, bool]]:
        """(rule number, term, negated) of every consequent about one output, in rule order."""
        found = []
        for r, rule in enumerate(self.rules):
            for target, term, *negated in rule.then:
                if target == output:
                    found.append((r, term, bool(negated and negated[0])))
        return found


def with_disjunction(rules: RuleSet, disjunction: str) -> RuleSet:
    """Choose the connectives by the OR method; the AND method follows."""
    return replace(rules, conjunction=next(a for a, o in DUAL.items() if o == disjunction))


def _inputs(tree: tuple) -> list[str]:
    """Input columns that an antecedent reads, each once."""
    kind, *rest = tree
    return [rest[0]] if kind == "is" else list(dict.fromkeys(c for t in rest for c in _inputs(t)))


def antecedent(rules: RuleSet, tree: tuple) -> str:
    """Degree of an antecedent; null where any input that it reads is missing."""
    missing = " OR ".join(f"isnan(coalesce(double({name(c)}), {num(float('nan'))}))" for c in _inputs(tree))
    return f"if({missing}, NULL, {_degree(rules, tree)})"


def _degree(rules: RuleSet, tree: tuple) -> str:
    kind, *rest = tree
    if kind == "is":
        column, term = rest
        family, params = rules.inputs[column][term]
        return membership.degree(f"double({name(column)})", family, params)
    if kind == "not":
        return f"(1D - {_degree(rules, rest[0])})"
    join = PLAIN_AND[rules.conjunction] if kind == "and" else PLAIN_OR[rules.disjunction]
    return reduce(join, [_degree(rules, t) for t in rest])


def strengths(rules: RuleSet) -> list[str]:
    return [f"({antecedent(rules, rule.when)} * {num(rule.weight)})" for rule in rules.rules]


def with_strengths(df: DataFrame, rules: RuleSet, prefix: str = "__s") -> DataFrame:
    return df.withColumns({f"{prefix}{r}": F.expr(e) for r, e in enumerate(strengths(rules))})


def grid_degrees(spark, output: Output) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Grid points of an output and each term's degree there: 1000 rows computed by the same expressions."""
    low, high = output.universe()
    step = (high - low) / POINTS
    terms = list(output.terms)
    made = [f"{membership.degree('x', *output.terms[t])} AS t{i}" for i, t in enumerate(terms)]
    rows = spark.range(POINTS).selectExpr("id", f"{num(low)} + id * {num(step)} AS x").selectExpr("id", "x", *made)
    table = rows.orderBy("id").toPandas()
    return table["x"].to_numpy(), {t: table[f"t{i}"].to_numpy() for i, t in enumerate(terms)}


def _accumulate(kind: str, acc: np.ndarray, y: np.ndarray) -> None:
    """Fold one rule's curve into ``acc`` (in place; both are the same part of the grid)."""
    if kind == "max":
        np.maximum(acc, y, out=acc)
        return
    if kind == "probabilistic":
        acc += y - acc * y
        return
    acc += y
    if kind == "bounded_sum":
        np.minimum(1.0, acc, out=acc)
    elif kind == "normed_sum":
        acc /= np.maximum(1.0, acc)


def _centre_of_area(values: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Where a sweep from both ends meets, if always the side with the smaller area so far moves (left on ties).

    That is the first point whose left area exceeds everything to its right; the end points carry no area
    until they are reached.
    """
    left = np.cumsum(values[:, 1:], axis=1)
    right = np.zeros_like(left)
    right[:, :-2] = np.cumsum(values[:, -2:1:-1], axis=1)[:, ::-1]
    beyond = left > right
    beyond[:, -1] = True
    meet = beyond.argmax(axis=1)
    return np.where(left[np.arange(len(values)), meet] > 0, xs[meet + 1], np.nan)


def _defuzzify(method: str, values: np.ndarray, xs: np.ndarray) -> np.ndarray:
    if method == "coa":
        return _centre_of_area(values, xs)
    if method == "cog":
        total = values.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(total > 0, values @ xs / total, np.nan)
    top = values.max(axis=1)
    at_top = values == top[:, None]
    if method == "lm":
        found = xs[at_top.argmax(axis=1)]
    elif method == "rm":
        found = xs[values.shape[1] - 1 - at_top[:, ::-1].argmax(axis=1)]
    else:
        found = (at_top * xs).sum(axis=1) / at_top.sum(axis=1)
    return np.where(top > 0, found, np.nan)


def continuous_output(spark, rules: RuleSet, output: str, columns: Sequence[str]) -> Column:
    """Defuzzified value of one output from strength columns (null when no rule reaches it)."""
    spec = rules.outputs[output]
    xs, degrees = grid_degrees(spark, spec)
    parts = [(r, 1.0 - degrees[t] if negated else degrees[t]) for r, t, negated in rules.for_output(output)]
    used = sorted({r for r, _ in parts})
    slot = {r: k for k, r in enumerate(used)}
    plan = []
    for r, degree in parts:
        at = np.flatnonzero(degree)  # outside its support a term adds nothing, whatever the accumulation
        if len(at):
            plan.append((slot[r], slice(at[0], at[-1] + 1), degree[at[0] : at[-1] + 1]))
    method, kind, by_min = spec.method, spec.accumulate, rules.activation == "min"

    def score(*series: pd.Series) -> pd.Series:
        # Rows of equal strengths have equal outputs; most batches hold few different ones.
        given, back = np.unique(np.stack([s.to_numpy(dtype=float) for s in series], axis=1), axis=0, return_inverse=True)
        out = np.empty(len(given))
        for start in range(0, len(given), ROWS_PER_STEP):
            part = given[start : start + ROWS_PER_STEP]
            acc = np.zeros((len(part), POINTS))
            for k, where, degree in plan:
                strength = part[:, [k]]
                _accumulate(kind, acc[:, where], np.minimum(strength, degree) if by_min else strength * degree)
            out[start : start + ROWS_PER_STEP] = _defuzzify(method, acc, xs)
        out[np.isnan(given).any(axis=1)] = np.nan  # a rule of this output reads a missing input
        return pd.Series(out[back.reshape(-1)])

    value = F.pandas_udf(score, "double")(*[F.col(columns[r]) for r in used])
    return F.when(~F.isnan(value), value)


def discrete_output(rules: RuleSet, output: str, columns: Sequence[str]) -> str:
    """Centre of gravity over single points: sum(x y) / sum(y), null when the heights sum to zero or a strength is missing."""
    spec = rules.outputs[output]
    join, act = ACCUMULATION[spec.accumulate], ACTIVATION[rules.activation]
    heights: dict[str, str] = {}
    for r, term, negated in rules.for_output(output):
        if spec.method == "cogf":
            points = [(arithmetic(spec.terms[term]), 1.0)]
        else:
            family, params = spec.terms[term]
            points = [tuple(params) if len(params) > 1 else (params[0], 1.0)] if family == "singleton" else [tuple(p) for p in params]
            points = [(num(x), y) for x, y in points]
        for x, y in points:
            made = act(f"`{columns[r]}`", num(1.0 - y if negated else y))
            heights[x] = join(heights.get(x, "0D"), made)
    total = " + ".join(heights.values())
    weighted = " + ".join(f"{x} * {y}" for x, y in heights.items())
    known = " + ".join(f"`{columns[r]}`" for r in sorted({r for r, _, _ in rules.for_output(output)}))
    return case([(f"isnotnull({known}) AND ({total}) <> 0", f"({weighted}) / ({total})")])


def fuzzy_score(df: DataFrame, rules: RuleSet, keep: Sequence[str]) -> DataFrame:
    """One column per output; its default (null if it has none) where no rule reaches it."""
    columns = [f"__s{r}" for r in range(len(rules.rules))]
    staged = with_strengths(df, rules)
    made = []
    for output, spec in rules.outputs.items():
        if spec.method in CONTINUOUS:
            value = continuous_output(df.sparkSession, rules, output, columns)
        else:
            value = F.expr(discrete_output(rules, output, columns))
        if spec.default is not None:
            value = F.coalesce(value, F.lit(float(spec.default)))
        made.append(value.alias(output))
    return staged.select(*keep, *made)


def rule_firing(df: DataFrame, rules: RuleSet, keys: Sequence[str]) -> DataFrame:
    """(keys, rule, strength): every rule's strength on every row."""
    items = ", ".join(f"struct({r} AS rule, {e} AS strength)" for r, e in enumerate(strengths(rules)))
    return df.selectExpr(*[name(k) for k in keys], f"explode(array({items})) AS f").select(*keys, "f.rule", "f.strength")


def rule_firing_mean(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Mean strength per rule over the whole table; summed wide so no row is exploded."""
    wide = df.selectExpr(*[f"{e} AS s{r}" for r, e in enumerate(strengths(rules))]).agg(
        *[F.avg(f"s{r}").alias(f"s{r}") for r in range(len(rules.rules))]
    )
    items = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"s{r}").alias("mean_strength")) for r in range(len(rules.rules))])
    return wide.select(F.explode(items).alias("f")).select("f.*")


def function_score(df: DataFrame, expressions: dict, keep: Sequence[str]) -> DataFrame:
    """One column per arithmetic tree."""
    return df.selectExpr(*[name(k) for k in keep], *[f"{arithmetic(t)} AS {name(o)}" for o, t in expressions.items()])
