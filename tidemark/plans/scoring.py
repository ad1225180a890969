"""Queries: fuzzy inference over whole tables and tuning of rule sets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions.connectors import ACCUMULATION, AND, DUAL, OR
from tidemark.operators import inference as inf
from tidemark.operators import tuning as tu
from tidemark.plans.datasets import ROW_KEYS
from tidemark.plans.registry import load, query, rounded

KEY = ", ".join(ROW_KEYS)
Q, D = "l_quantity", "l_discount"

QUANTITY = {
    "small": ("piecewise", ((1.0, 1.0), (20.0, 0.0))),
    "middle": ("piecewise", ((10.0, 0.0), (20.0, 1.0), (30.0, 1.0), (40.0, 0.0))),
    "large": ("piecewise", ((30.0, 0.0), (50.0, 1.0))),
}
DISCOUNT = {
    "low": ("piecewise", ((0.0, 1.0), (0.06, 0.0))),
    "high": ("piecewise", ((0.04, 0.0), (0.1, 1.0))),
}
CARE = {
    "little": ("piecewise", ((0.0, 0.0), (5.0, 1.0), (10.0, 0.0))),
    "normal": ("piecewise", ((10.0, 0.0), (15.0, 1.0), (20.0, 0.0))),
    "much": ("piecewise", ((20.0, 0.0), (25.0, 1.0), (30.0, 0.0))),
}
POINTS = {"little": ("singleton", (5.0,)), "normal": ("singleton", (15.0,)), "much": ("singleton", (25.0,))}
RULES = (
    inf.Rule(("or", ("is", Q, "small"), ("is", D, "low")), (("care", "little"),)),
    inf.Rule(("is", Q, "middle"), (("care", "normal"),), 0.9),
    inf.Rule(("and", ("is", Q, "large"), ("is", D, "high")), (("care", "much"),)),
)


def rule_set(method="cog", terms=None, accumulate="max", conjunction="min", activation="min", rules=RULES):
    outputs = {"care": inf.Output(terms or CARE, method, 0.0, accumulate)}
    return inf.RuleSet({Q: QUANTITY, D: DISCOUNT}, outputs, rules, conjunction, activation)


def _rows(spark, sf_dir):
    return load(spark, sf_dir, "lineitem")


# ---- the same in SQL ----------------------------------------------------------------------------


def _lines(x, points):
    out = f"CASE WHEN {x} <= {points[0][0]}::DOUBLE THEN {points[0][1]}::DOUBLE"
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out += f" WHEN {x} <= {x1}::DOUBLE THEN {y0}::DOUBLE + ({y1 - y0})::DOUBLE * (({x} - {x0}::DOUBLE) / {x1 - x0!r}::DOUBLE)"
    return out + f" ELSE {points[-1][1]}::DOUBLE END"


DEGREES = ", ".join(
    f"({_lines(c, points)})::DOUBLE AS {c}_{t}" for c, terms in ((Q, QUANTITY), (D, DISCOUNT)) for t, (_, points) in terms.items()
)
COMBOS = f"WITH cb AS (SELECT DISTINCT {Q}, {D} FROM lineitem), dg AS (SELECT *, {DEGREES} FROM cb)"
QS, QM, QL, DL, DH = f"{Q}_small", f"{Q}_middle", f"{Q}_large", f"{D}_low", f"{D}_high"

AND_SQL = {
    "min": "least({a}, {b})",
    "product": "{a} * {b}",
    "bounded_difference": "greatest(0::DOUBLE, {a} + {b} - 1)",
    "drastic": "CASE WHEN {a} = 1 THEN {b} WHEN {b} = 1 THEN {a} ELSE 0 END",
    "nilpotent": "CASE WHEN {a} + {b} > 1 THEN least({a}, {b}) ELSE 0 END",
    "hamacher": "CASE WHEN {a} = 0 AND {b} = 0 THEN 0 ELSE ({a} * {b}) / ({a} + {b} - {a} * {b}) END",
}
OR_SQL = {
    "max": "greatest({a}, {b})",
    "probabilistic": "{a} + {b} - {a} * {b}",
    "bounded_sum": "least(1::DOUBLE, {a} + {b})",
    "drastic": "CASE WHEN {a} = 0 THEN {b} WHEN {b} = 0 THEN {a} ELSE 1 END",
    "nilpotent": "CASE WHEN {a} + {b} < 1 THEN greatest({a}, {b}) ELSE 1 END",
    "einstein": "({a} + {b}) / (1 + {a} * {b})",
}
ACC_SQL = {
    "max": "greatest({a}, {y})",
    "bounded_sum": "least(1::DOUBLE, {a} + {y})",
    "normed_sum": "({a} + {y}) / greatest(1::DOUBLE, {a} + {y})",
    "probabilistic": "{a} + {y} - {a} * {y}",
    "sum": "{a} + {y}",
}


def _strengths(conjunction="min"):
    both = AND_SQL[conjunction].format(a=QL, b=DH)
    either = OR_SQL[DUAL[conjunction]].format(a=QS, b=DL)
    return COMBOS + f", st AS (SELECT {Q}, {D}, ({either})::DOUBLE AS s0, {QM} * 0.9::DOUBLE AS s1, ({both})::DOUBLE AS s2 FROM dg)"


GRID = (
    ", grid AS (SELECT 0::DOUBLE + i * 0.03::DOUBLE AS x, i FROM range(1000) t(i)), "
    "gd AS (SELECT x, i, " + ", ".join(f"({_lines('x', points)})::DOUBLE AS {t}" for t, (_, points) in CARE.items()) + " FROM grid)"
)


def _shape(activation, accumulate):
    def act(s, t):
        return f"least({s}, {t})" if activation == "min" else f"({s} * {t})"

    y = "0::DOUBLE"
    for s, t in (("s0", "little"), ("s1", "normal"), ("s2", "much")):
        y = "(" + ACC_SQL[accumulate].format(a=y, y=act(s, t)) + ")"
    return f", shape AS (SELECT {Q}, {D}, x, i, {y} AS y FROM st, gd)"


def _joined(value_cte):
    keys = ", ".join(f"l.{k}" for k in ROW_KEYS)
    return f"{value_cte} SELECT {keys}, round(coalesce(v, 0), 6) AS care FROM lineitem l JOIN val USING ({Q}, {D})"


def _cog_sql(activation="min", accumulate="max"):
    shape = _strengths() + GRID + _shape(activation, accumulate)
    return _joined(shape + f", val AS (SELECT {Q}, {D}, CASE WHEN sum(y) > 0 THEN sum(x * y) / sum(y) END AS v FROM shape GROUP BY ALL)")


def _top_sql(pick):
    shape = _strengths() + GRID + _shape("min", "max")
    return _joined(
        shape + f", top AS (SELECT {Q}, {D}, max(y) AS t FROM shape GROUP BY ALL), "
        f"val AS (SELECT {Q}, {D}, CASE WHEN any_value(t) > 0 THEN {pick}(x) FILTER (y = t) END AS v FROM shape JOIN top USING ({Q}, {D}) GROUP BY ALL)"
    )


def _points_sql(conjunction="min", accumulate="max"):
    strengths = _strengths(conjunction)
    heights = [ACC_SQL[accumulate].format(a="0::DOUBLE", y=f"least(s{i}, 1::DOUBLE)") for i in range(3)]
    total = " + ".join(f"({h})" for h in heights)
    weighted = " + ".join(f"{x}::DOUBLE * ({h})" for x, h in zip((5, 15, 25), heights))
    return _joined(strengths + f", val AS (SELECT {Q}, {D}, CASE WHEN {total} <> 0 THEN ({weighted}) / ({total}) END AS v FROM st)")


def _score(spark, sf_dir, rules):
    return rounded(inf.fuzzy_score(_rows(spark, sf_dir), rules, ROW_KEYS), ["care"])


# ---- connectives and defuzzifiers ----------------------------------------------------------------


def _connective(kind, name, sql):
    table = AND if kind == "and" else OR

    @query(
        f"{kind}_{name}",
        COMBOS + f" SELECT {', '.join(f'l.{k}' for k in ROW_KEYS)}, round(({sql.format(a=QS, b=DL)})::DOUBLE, 6) AS degree FROM lineitem l JOIN dg USING ({Q}, {D})",
    )
    def run(spark, sf_dir):
        rules = rule_set()
        a = inf.antecedent(rules, ("is", Q, "small"))
        b = inf.antecedent(rules, ("is", D, "low"))
        return _rows(spark, sf_dir).selectExpr(*ROW_KEYS, f"round({table[name](a, b)}, 6) AS degree")


for _n, _sql in AND_SQL.items():
    _connective("and", _n, _sql)
for _n, _sql in OR_SQL.items():
    _connective("or", _n, _sql)


@query(
    "antecedent_tree",
    COMBOS + f" SELECT {', '.join(f'l.{k}' for k in ROW_KEYS)}, round(1 - greatest(least({QS}, {DL}), 1 - {QL}), 6) AS degree FROM lineitem l JOIN dg USING ({Q}, {D})",
)
def antecedent_tree(spark, sf_dir):
    """Nested AND, OR and NOT."""
    tree = ("not", ("or", ("and", ("is", Q, "small"), ("is", D, "low")), ("not", ("is", Q, "large"))))
    return _rows(spark, sf_dir).selectExpr(*ROW_KEYS, f"round({inf.antecedent(rule_set(), tree)}, 6) AS degree")


def _accumulated(name):
    @query(f"accumulate_{name}", _cog_sql(accumulate=name))
    def run(spark, sf_dir):
        return _score(spark, sf_dir, rule_set(accumulate=name))


for _n in ACCUMULATION:
    _accumulated(_n)


@query("activate_product", _cog_sql(activation="product"))
def activate_product(spark, sf_dir):
    return _score(spark, sf_dir, rule_set(activation="product"))


@query("defuzzify_cog", _cog_sql())
def defuzzify_cog(spark, sf_dir):
    return _score(spark, sf_dir, rule_set())


@query("defuzzify_lm", _top_sql("min"))
def defuzzify_lm(spark, sf_dir):
    return _score(spark, sf_dir, rule_set("lm"))


@query("defuzzify_rm", _top_sql("max"))
def defuzzify_rm(spark, sf_dir):
    return _score(spark, sf_dir, rule_set("rm"))


@query("defuzzify_mm", _top_sql("avg"))
def defuzzify_mm(spark, sf_dir):
    return _score(spark, sf_dir, rule_set("mm"))


@query("defuzzify_coa")
def defuzzify_coa(spark, sf_dir):
    """Two-ended sweep over the grid; checked against a plain loop in the tests."""
    return _score(spark, sf_dir, rule_set("coa"))


@query("defuzzify_cogs", _points_sql())
def defuzzify_cogs(spark, sf_dir):
    return _score(spark, sf_dir, rule_set("cogs", POINTS))


@query("connectives_hamacher", _points_sql("hamacher", "bounded_sum"))
def connectives_hamacher(spark, sf_dir):
    """Rules under the Hamacher AND and its dual, single-point outputs, bounded-sum accumulation."""
    return _score(spark, sf_dir, inf.with_disjunction(rule_set("cogs", POINTS, "bounded_sum"), "einstein"))


# ---- scoring jobs -------------------------------------------------------------------------------


@query(
    "fuzzy_score",
    _strengths() + GRID + _shape("min", "max")
    + f", val AS (SELECT {Q}, {D}, CASE WHEN sum(y) > 0 THEN sum(x * y) / sum(y) END AS v FROM shape GROUP BY ALL), "
    f"rk AS (SELECT {Q}, {D}, CASE WHEN s0 + s2 <> 0 THEN (1 * s0 + 9 * s2) / (s0 + s2) END AS r FROM st) "
    f"SELECT {', '.join(f'l.{k}' for k in ROW_KEYS)}, round(coalesce(v, 0), 6) AS care, round(r, 6) AS risk FROM lineitem l JOIN val USING ({Q}, {D}) JOIN rk USING ({Q}, {D})",
)
def fuzzy_score(spark, sf_dir):
    """Two outputs: one defuzzified over the grid with a default, one over single points without one."""
    base = rule_set()
    outputs = {**base.outputs, "risk": inf.Output({"low": ("singleton", (1.0,)), "high": ("singleton", (9.0,))}, "cogs")}
    extra = (replace(RULES[0], then=(("care", "little"), ("risk", "low"))), RULES[1], replace(RULES[2], then=(("care", "much"), ("risk", "high"))))
    made = inf.fuzzy_score(_rows(spark, sf_dir), replace(base, outputs=outputs, rules=extra), ROW_KEYS)
    return rounded(made, ["care", "risk"])


MISSING = "l_orderkey % 17 = 0"


def _rows_missing(spark, sf_dir):
    """Line items where every 17th quantity is missing."""
    return _rows(spark, sf_dir).withColumn(Q, F.expr(f"CASE WHEN NOT ({MISSING}) THEN {Q} END"))


@query(
    "fuzzy_score_missing",
    _strengths() + GRID + _shape("min", "max")
    + f", val AS (SELECT {Q}, {D}, CASE WHEN sum(y) > 0 THEN sum(x * y) / sum(y) END AS v FROM shape GROUP BY ALL), "
    f"rk AS (SELECT {Q}, {D}, CASE WHEN s0 + s2 <> 0 THEN (1 * s0 + 9 * s2) / (s0 + s2) END AS r FROM st), "
    f"hd AS (SELECT {D}, max({DH}) AS h FROM dg GROUP BY {D}) "
    f"SELECT {', '.join(f'l.{k}' for k in ROW_KEYS)}, CASE WHEN {MISSING} THEN 0 ELSE round(coalesce(v, 0), 6) END AS care, "
    f"CASE WHEN NOT ({MISSING}) THEN round(r, 6) END AS risk, CASE WHEN h <> 0 THEN 7::DOUBLE END AS price "
    f"FROM lineitem l JOIN val USING ({Q}, {D}) JOIN rk USING ({Q}, {D}) JOIN hd USING ({D})",
)
def fuzzy_score_missing(spark, sf_dir):
    """A rule that reads a missing input has no strength, an output with such a rule no value: its default or null."""
    base = rule_set()
    singles = {"low": ("singleton", (1.0,)), "high": ("singleton", (9.0,))}
    outputs = {**base.outputs, "risk": inf.Output(singles, "cogs"), "price": inf.Output({"cut": ("singleton", (7.0,))}, "cogs")}
    extra = (
        replace(RULES[0], then=(("care", "little"), ("risk", "low"))),
        RULES[1],
        replace(RULES[2], then=(("care", "much"), ("risk", "high"))),
        inf.Rule(("is", D, "high"), (("price", "cut"),)),
    )
    made = inf.fuzzy_score(_rows_missing(spark, sf_dir), replace(base, outputs=outputs, rules=extra), ROW_KEYS)
    return rounded(made, ["care", "risk", "price"])


@query(
    "rule_firing_missing",
    _strengths() + " " + " UNION ALL ".join(
        f"SELECT {', '.join(f'l.{k}' for k in ROW_KEYS)}, {i} AS rule, CASE WHEN NOT ({MISSING}) THEN round(s{i}, 6) END AS strength FROM lineitem l JOIN st USING ({Q}, {D})"
        for i in range(3)
    )
    + f" UNION ALL SELECT {', '.join(f'l.{k}' for k in ROW_KEYS)}, 3 AS rule, round(1 - {DH}, 6) AS strength FROM lineitem l JOIN dg USING ({Q}, {D})",
)
def rule_firing_missing(spark, sf_dir):
    rules = rule_set(rules=(*RULES, inf.Rule(("not", ("is", D, "high")), (("care", "little"),))))
    return rounded(inf.rule_firing(_rows_missing(spark, sf_dir), rules, ROW_KEYS), ["strength"])


@query(
    "rule_firing",
    _strengths() + " " + " UNION ALL ".join(f"SELECT {', '.join(f'l.{k}' for k in ROW_KEYS)}, {i} AS rule, round(s{i}, 6) AS strength FROM lineitem l JOIN st USING ({Q}, {D})" for i in range(3)),
)
def rule_firing(spark, sf_dir):
    return rounded(inf.rule_firing(_rows(spark, sf_dir), rule_set(), ROW_KEYS), ["strength"])


@query(
    "rule_firing_mean",
    _strengths() + " " + " UNION ALL ".join(f"SELECT {i} AS rule, round(avg(s{i}), 6) AS mean_strength FROM lineitem l JOIN st USING ({Q}, {D})" for i in range(3)),
)
def rule_firing_mean(spark, sf_dir):
    return rounded(inf.rule_firing_mean(_rows(spark, sf_dir), rule_set()), ["mean_strength"])


HOLES = "(SELECT *, CASE WHEN l_orderkey % 17 <> 0 THEN l_quantity END AS q FROM lineitem)"
NAN = "'nan'::DOUBLE"


@query(
    "function_score",
    f"SELECT {KEY}, round(coalesce(q, 0) + l_tax + 2, 6) AS total, round(l_extendedprice - coalesce(q, 0) - l_tax, 6) AS rest, "
    "round(coalesce(q, 1) * l_discount, 6) AS product, round(CASE WHEN q IS NULL THEN exp(l_tax) ELSE exp(l_tax) / q END, 6) AS ratio, "
    "round(pow(1 + l_discount, 2), 6) AS power, round(l_extendedprice % 7, 6) AS remainder, round(exp(l_tax), 6) AS growth, "
    f"round(CASE WHEN q IS NULL THEN {NAN} ELSE ln(q) END, 6) AS log_q, round(log10(l_extendedprice), 6) AS log_price, "
    "round(sin(l_tax) + cos(l_tax) + tan(l_tax) + abs(-l_tax), 6) AS waves, round(coalesce(q, l_tax), 6) AS first_known "
    f"FROM {HOLES}",
)
def function_score(spark, sf_dir):
    """Outputs by arithmetic over columns; missing operands are skipped."""
    rows = _rows(spark, sf_dir).withColumn("q", F.expr("CASE WHEN l_orderkey % 17 <> 0 THEN l_quantity END"))
    trees = {
        "total": ("+", "q", "l_tax", 2),
        "rest": ("-", "l_extendedprice", "q", "l_tax"),
        "product": ("*", "q", "l_discount"),
        "ratio": ("/", ("exp", "l_tax"), "q"),
        "power": ("^", ("+", 1, "l_discount"), 2),
        "remainder": ("%", "l_extendedprice", 7),
        "growth": ("exp", "l_tax"),
        "log_q": ("ln", "q"),
        "log_price": ("log10", "l_extendedprice"),
        "waves": ("+", ("sin", "l_tax"), ("cos", "l_tax"), ("tan", "l_tax"), ("abs", ("-", "l_tax"))),
        "first_known": ("first", "q", "l_tax"),
    }
    return rounded(inf.function_score(rows, trees, ROW_KEYS), list(trees))


FUNCTIONS = {"little": ("+", "l_tax", 1), "normal": ("*", "l_quantity", 2), "much": ("-", "l_quantity", "l_tax")}


@query(
    "defuzzify_cogf",
    _strengths()
    + f" SELECT {', '.join(f'l.{k}' for k in ROW_KEYS)}, round(CASE WHEN s0 + s1 + s2 <> 0 THEN ((l_tax + 1) * s0 + ({Q} * 2) * s1 + ({Q} - l_tax) * s2) / (s0 + s1 + s2) ELSE 0 END, 6) AS care "
    f"FROM lineitem l JOIN st USING ({Q}, {D})",
)
def defuzzify_cogf(spark, sf_dir):
    """Outputs that are functions of the row, weighted by rule strength."""
    return _score(spark, sf_dir, rule_set("cogf", FUNCTIONS))


# ---- tuning -------------------------------------------------------------------------------------

TARGET = "30D * l_discount * 10D * l_quantity / 50D"
TARGET_SQL = "30.0::DOUBLE * l_discount * 10.0::DOUBLE * l_quantity / 50.0::DOUBLE"


def _tuning_rows(spark, sf_dir):
    return _rows(spark, sf_dir).selectExpr(Q, D, f"{TARGET} AS target")


def _weighted_error(candidate, w0, w1, w2):
    s = [f"least(s0 * {w0}::DOUBLE, 1)", f"least(s1 / 0.9::DOUBLE * {w1}::DOUBLE, 1)", f"least(s2 * {w2}::DOUBLE, 1)"]
    total = " + ".join(s)
    value = f"coalesce(CASE WHEN {total} <> 0 THEN (5 * {s[0]} + 15 * {s[1]} + 25 * {s[2]}) / ({total}) END, 0)"
    return f"SELECT {candidate} AS candidate, round(sqrt(sum(pow({value} - ({TARGET_SQL}), 2))), 4) AS error FROM lineitem l JOIN st USING ({Q}, {D})"


WEIGHTS = [(a, b, c) for a in (0.5, 1.0) for b in (0.4, 0.9) for c in (0.6, 1.0)]


@query("tuning_error", _strengths() + f" SELECT error FROM ({_weighted_error(0, 1.0, 0.9, 1.0)})")
def tuning_error(spark, sf_dir):
    made = tu.tuning_error(_tuning_rows(spark, sf_dir), rule_set("cogs", POINTS), {"care": "target"})
    return made.select(F.round("error", 4).alias("error"))


@query("tune_sweep", _strengths() + " " + " UNION ALL ".join(_weighted_error(i, *w) for i, w in enumerate(WEIGHTS)))
def tune_sweep(spark, sf_dir):
    """Every combination of rule weights, scored in one pass."""
    base = rule_set("cogs", POINTS)
    candidates = [replace(base, rules=tuple(replace(r, weight=x) for r, x in zip(RULES, w))) for w in WEIGHTS]
    made = tu.tune_sweep(_tuning_rows(spark, sf_dir), candidates, {"care": "target"})
    return made.select("candidate", F.round("error", 4).alias("error"))


def _tuned(spark, sf_dir, method):
    rows = _tuning_rows(spark, sf_dir)
    base = rule_set("cogs", POINTS)
    params = tu.parameters(base, ["care"])
    tuned, trace = method(rows, base, {"care": "target"}, params)
    found = [(p.label, tu.get_value(base, p), tu.get_value(tuned, p), trace[0], trace[-1]) for p in params]
    return spark.createDataFrame(found, "parameter string, before double, after double, error_before double, error_after double")


@query("tune_delta_jump")
def tune_delta_jump(spark, sf_dir):
    return _tuned(spark, sf_dir, tu.delta_jump)


@query("tune_coordinate_descent")
def tune_coordinate_descent(spark, sf_dir):
    return _tuned(spark, sf_dir, tu.coordinate_descent)


@query("tune_gradient_descent")
def tune_gradient_descent(spark, sf_dir):
    return _tuned(spark, sf_dir, tu.gradient_descent)
