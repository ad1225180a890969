"""Fitting rule sets to a target column. Every step scores all its candidates in one job over the table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import membership
from tidemark.operators.inference import CONTINUOUS, RuleSet, continuous_output, discrete_output, strengths
from tidemark.session import cut

CHUNK = 32  # candidates scored side by side in one pass
STEPS_PER_RANGE = 1000.0
WEIGHT_STEP = 0.01
FLAT = 1e-7
LINE_STEPS = 20
ITERATIONS = 100  # at most; every method stops before when an iteration changes nothing
WEIGHT = "__weight"


@dataclass(frozen=True)
class Parameter:
    """A tunable number: parameter ``index`` of a term of an input or output, or the weight of a rule."""

    owner: str
    term: str = ""
    index: int = 0
    rule: int = -1

    @property
    def label(self) -> str:
        return f"rule {self.rule} weight" if self.rule >= 0 else f"{self.owner}.{self.term}[{self.index}]"


def _flat(family: str, params: Sequence) -> list[float]:
    return [float(v) for p in params for v in p] if family in ("piecewise", "singletons") else [float(v) for v in params]


def _shaped(family: str, values: Sequence[float]) -> tuple:
    if family in ("piecewise", "singletons"):
        return tuple((values[i], values[i + 1]) for i in range(0, len(values), 2))
    return tuple(values)


def _terms(rules: RuleSet, owner: str) -> dict:
    return rules.inputs[owner] if owner in rules.inputs else rules.outputs[owner].terms


def _range(rules: RuleSet, owner: str) -> tuple[float, float]:
    if owner in rules.outputs:
        return rules.outputs[owner].universe()
    reach = [membership.universe(f, p) for f, p in rules.inputs[owner].values()]
    return min(r[0] for r in reach), max(r[1] for r in reach)


def parameters(rules: RuleSet, owners: Sequence[str] = (), weights: bool = True) -> list[Parameter]:
    found = [
        Parameter(owner, term, i)
        for owner in owners
        for term, (family, params) in _terms(rules, owner).items()
        for i in range(len(_flat(family, params)))
    ]
    return found + [Parameter("", rule=r) for r in range(len(rules.rules))] if weights else found


def get_value(rules: RuleSet, p: Parameter) -> float:
    if p.rule >= 0:
        return rules.rules[p.rule].weight
    return _flat(*_terms(rules, p.owner)[p.term])[p.index]


def step_of(rules: RuleSet, p: Parameter) -> float:
    if p.rule >= 0:
        return WEIGHT_STEP
    family, params = _terms(rules, p.owner)[p.term]
    low, high = membership.universe(family, params)
    if high == low:
        low, high = _range(rules, p.owner)
    return (high - low) / STEPS_PER_RANGE


def with_value(rules: RuleSet, p: Parameter, value: float, limits: RuleSet | None = None) -> RuleSet | None:
    """The rule set with one parameter changed, or None if that leaves its range or breaks the term.

    ``limits`` is the rule set whose ranges bind (the one tuning started from).
    """
    if p.rule >= 0:
        changed = [replace(r, weight=value) if i == p.rule else r for i, r in enumerate(rules.rules)]
        return replace(rules, rules=tuple(changed))
    low, high = _range(limits or rules, p.owner)
    if not low <= value <= high:
        return None
    family, params = _terms(rules, p.owner)[p.term]
    values = _flat(family, params)
    values[p.index] = value
    shaped = _shaped(family, values)
    if membership.check(family, shaped):
        return None
    terms = {**_terms(rules, p.owner), p.term: (family, shaped)}
    if p.owner in rules.inputs:
        return replace(rules, inputs={**rules.inputs, p.owner: terms})
    return replace(rules, outputs={**rules.outputs, p.owner: replace(rules.outputs[p.owner], terms=terms)})


def _prediction(df: DataFrame, rules: RuleSet, output: str, columns: Sequence[str]) -> Column:
    spec = rules.outputs[output]
    if spec.method in CONTINUOUS:
        value = continuous_output(df.sparkSession, rules, output, columns)
    else:
        value = F.expr(discrete_output(rules, output, columns))
    return F.coalesce(value, F.lit(float(spec.default))) if spec.default is not None else value


def _tree_columns(tree) -> list[str]:
    if isinstance(tree, str):
        return [tree]
    return [c for t in tree[1:] for c in _tree_columns(t)] if isinstance(tree, tuple) else []


def distinct_rows(df: DataFrame, rules: RuleSet, targets: dict[str, str]) -> DataFrame:
    """The different combinations of what the rules read and the targets, with their number of rows, written out once.

    Every step of a tuning then reads this table in place of the input.
    """
    formulas = [t for o in rules.outputs.values() if o.method == "cogf" for t in o.terms.values()]
    columns = [*rules.inputs, *targets.values(), *(c for t in formulas for c in _tree_columns(t))]
    return cut(df.groupBy(*dict.fromkeys(columns)).agg(F.count(F.lit(1)).alias(WEIGHT)))


def squared(miss: Column) -> Column:
    return miss * miss


def tune_sweep(
    df: DataFrame, candidates: Sequence[RuleSet], targets: dict[str, str], loss: Callable[[Column], Column] = squared
) -> DataFrame:
    """(candidate, error): root of the summed squared error of each candidate rule set over the whole table.

    ``targets`` maps outputs to the columns they should match (several outputs add up); ``loss`` may replace
    the square of the difference by another Column of it. Candidates are laid
    out as columns, so the table is read once per 32 of them and only their sums are shuffled. Rows of ``distinct_rows`` count
    as often as they stood in the table.
    """
    weight = F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1)
    parts = None
    for start in range(0, len(candidates), CHUNK):
        group = candidates[start : start + CHUNK]
        staged = df
        names = []
        for i, rules in enumerate(group):
            own = [f"__s{i}_{r}" for r in range(len(rules.rules))]
            staged = staged.withColumns({c: F.expr(e) for c, e in zip(own, strengths(rules))})
            names.append(own)
        squares = []
        for i, rules in enumerate(group):
            for k, (output, target) in enumerate(targets.items()):
                miss = _prediction(df, rules, output, names[i]) - F.col(target).cast("double")
                squares.append((loss(miss) * weight).alias(f"__q{i}_{k}"))
        sums = staged.select(*squares).agg(
            *[
                F.sqrt(sum((F.coalesce(F.sum(f"__q{i}_{k}"), F.lit(0.0)) for k in range(len(targets))), F.lit(0.0))).alias(f"__e{i}")
                for i in range(len(group))
            ]
        )
        rows = F.array(*[F.struct(F.lit(start + i).alias("candidate"), F.col(f"__e{i}").alias("error")) for i in range(len(group))])
        part = sums.select(F.explode(rows).alias("r")).select("r.*")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def tuning_error(df: DataFrame, rules: RuleSet, targets: dict[str, str]) -> DataFrame:
    return tune_sweep(df, [rules], targets).select("error")


def errors_of(df: DataFrame, candidates: Sequence[RuleSet], targets: dict[str, str]) -> list[float]:
    """Errors on the driver: one number per candidate."""
    if not candidates:
        return []
    return [r["error"] for r in tune_sweep(df, candidates, targets).orderBy("candidate").collect()]


def delta_jump(
    df: DataFrame, rules: RuleSet, targets: dict[str, str], params: Sequence[Parameter], iterations: int = ITERATIONS
) -> tuple[RuleSet, list[float]]:
    """Move one parameter at a time by +-step, doubling while the error keeps falling. Returns errors per move."""
    df = distinct_rows(df, rules, targets)
    limits, error = rules, errors_of(df, [rules], targets)[0]
    trace = [error]
    for _ in range(iterations):
        at_start = error
        for p in params:
            value, step = get_value(rules, p), step_of(limits, p)
            tries = [(s, with_value(rules, p, value + s, limits)) for s in (step, -step)]
            tries = [(s, c) for s, c in tries if c is not None]
            found = errors_of(df, [c for _, c in tries], targets)
            jump = next((s for (s, _), e in zip(tries, found) if e < error), 0.0)
            if not jump:
                continue
            line = []
            for k in range(LINE_STEPS):
                moved = with_value(rules, p, value + jump * 2.0**k, limits)
                if moved is None:
                    break
                line.append(moved)
            best = rules
            for moved, e in zip(line, errors_of(df, line, targets)):
                if e < error:
                    best, error = moved, e
                else:
                    break
            rules = best
            trace.append(error)
        if error >= at_start:
            break
    return rules, trace


def _slopes(df, rules, targets, params, limits, error) -> list[float]:
    """Forward (else backward) difference per parameter, all in one sweep."""
    tries = []
    for p in params:
        value, step = get_value(rules, p), step_of(limits, p)
        for s in (step, -step):
            moved = with_value(rules, p, value + s, limits)
            if moved is not None:
                tries.append((p, s, moved))
                break
    slope = {p: 0.0 for p in params}
    for (p, s, _), e in zip(tries, errors_of(df, [c for _, _, c in tries], targets)):
        slope[p] = (e - error) / s
    return [slope[p] for p in params]


def _line(df, targets, candidates, rules, error):
    """First candidate along a halving line search that lowers the error."""
    usable = [c for c in candidates if c is not None]
    for moved, e in zip(usable, errors_of(df, usable, targets)):
        if e < error:
            return moved, e
    return rules, error


def coordinate_descent(
    df: DataFrame, rules: RuleSet, targets: dict[str, str], params: Sequence[Parameter], iterations: int = ITERATIONS
) -> tuple[RuleSet, list[float]]:
    """Step down the partial derivative of each parameter in turn; step halves until the error falls (<= 20)."""
    df = distinct_rows(df, rules, targets)
    limits, error = rules, errors_of(df, [rules], targets)[0]
    trace = [error]
    for _ in range(iterations):
        at_start = error
        for p in params:
            slope = _slopes(df, rules, targets, [p], limits, error)[0]
            if abs(slope) <= FLAT:
                continue
            value = get_value(rules, p)
            line = [with_value(rules, p, value - slope * 0.5**k, limits) for k in range(LINE_STEPS)]
            rules, error = _line(df, targets, line, rules, error)
            trace.append(error)
        if error >= at_start:
            break
    return rules, trace


def gradient_descent(
    df: DataFrame, rules: RuleSet, targets: dict[str, str], params: Sequence[Parameter], iterations: int = ITERATIONS
) -> tuple[RuleSet, list[float]]:
    """Step all parameters along the negative gradient; stop when its squared norm is at most 1e-7."""
    df = distinct_rows(df, rules, targets)
    limits, error = rules, errors_of(df, [rules], targets)[0]
    trace = [error]
    for _ in range(iterations):
        at_start = error
        slopes = _slopes(df, rules, targets, params, limits, error)
        if sum(s * s for s in slopes) <= FLAT:
            break
        line = []
        for k in range(LINE_STEPS):
            moved = rules
            for p, slope in zip(params, slopes):
                # A parameter that cannot take its step stays where it is.
                moved = with_value(moved, p, get_value(rules, p) - slope * 0.5**k, limits) or moved
            line.append(moved)
        rules, error = _line(df, targets, line, rules, error)
        trace.append(error)
        if error >= at_start:
            break
    return rules, trace
