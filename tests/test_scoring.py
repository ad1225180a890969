from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.functions import membership as mf
from tidemark.functions.connectors import arithmetic
from tidemark.operators import inference as inf
from tidemark.operators import tuning as tu

SERVICE = {
    "poor": ("piecewise", ((0.0, 1.0), (4.0, 0.0))),
    "good": ("piecewise", ((1.0, 0.0), (4.0, 1.0), (6.0, 1.0), (9.0, 0.0))),
    "excellent": ("piecewise", ((6.0, 0.0), (9.0, 1.0))),
}
FOOD = {"rancid": ("piecewise", ((0.0, 1.0), (1.0, 1.0), (3.0, 0.0))), "delicious": ("piecewise", ((7.0, 0.0), (9.0, 1.0)))}
TIP = {
    "cheap": ("piecewise", ((0.0, 0.0), (5.0, 1.0), (10.0, 0.0))),
    "average": ("piecewise", ((10.0, 0.0), (15.0, 1.0), (20.0, 0.0))),
    "generous": ("piecewise", ((20.0, 0.0), (25.0, 1.0), (30.0, 0.0))),
}
RULES = inf.RuleSet(
    {"service": SERVICE, "food": FOOD},
    {"tip": inf.Output(TIP, "cog", 0.0)},
    (
        inf.Rule(("or", ("is", "service", "poor"), ("is", "food", "rancid")), (("tip", "cheap"),)),
        inf.Rule(("is", "service", "good"), (("tip", "average"),)),
        inf.Rule(("and", ("is", "service", "excellent"), ("is", "food", "delicious")), (("tip", "generous"),)),
    ),
)
CASES = [(3.0, 7.0, 11.7016038), (8.0, 8.0, 20.7446383), (0.0, 0.0, 5.0000200), (9.0, 9.0, 24.9999800)]


@pytest.fixture(scope="module")
def meals(spark):
    return spark.createDataFrame([(s, f) for s, f, _ in CASES], "service double, food double")


def test_tip(meals):
    got = {(r.service, r.food): r.tip for r in inf.fuzzy_score(meals, RULES, ["service", "food"]).collect()}
    for s, f, tip in CASES:
        assert got[s, f] == pytest.approx(tip, abs=1e-5)


def test_rule_strengths(meals):
    got = {r.rule: r.strength for r in inf.rule_firing(meals, RULES, ["service"]).filter("service = 3").collect()}
    assert got == {0: pytest.approx(0.25), 1: pytest.approx(2 / 3), 2: 0.0}


def plain_area(values, low, step):
    left, right, a, b = 0, len(values) - 1, 0.0, 0.0
    while left < right:
        if a <= b:
            left += 1
            a += values[left]
        else:
            right -= 1
            b += values[right]
    return low + step * left if a > 0 else None


def test_centre_of_area_against_a_plain_loop(meals):
    rules = replace(RULES, outputs={"tip": replace(RULES.outputs["tip"], method="coa")})
    xs, degrees = inf.grid_degrees(meals.sparkSession, rules.outputs["tip"])
    strength = {}
    for r in inf.rule_firing(meals, RULES, ["service", "food"]).collect():
        strength.setdefault((r.service, r.food), {})[r.rule] = r.strength
    for r in inf.fuzzy_score(meals, rules, ["service", "food"]).collect():
        s = strength[r.service, r.food]
        shape = [max(min(s[k], degrees[t][i]) for k, t in enumerate(TIP)) for i in range(len(xs))]
        assert r.tip == pytest.approx(plain_area(shape, 0.0, 0.03), abs=1e-9)


def test_nothing_fires(spark):
    silent = spark.createDataFrame([(None, None)], "service double, food double").fillna(100.0)
    bare = replace(RULES, outputs={"tip": replace(RULES.outputs["tip"], default=None)}, rules=RULES.rules[1:2])
    assert inf.fuzzy_score(silent, bare, []).first().tip is None
    with_default = replace(bare, outputs={"tip": replace(RULES.outputs["tip"], default=3.0)})
    assert inf.fuzzy_score(silent, with_default, []).first().tip == 3.0


def test_negated_consequent_and_weight(meals):
    rules = replace(RULES, rules=(inf.Rule(("is", "service", "good"), (("tip", "average", True),), 0.5),))
    assert inf.rule_firing(meals, rules, ["service"]).filter("service = 3").first().strength == pytest.approx(1 / 3)
    assert inf.fuzzy_score(meals, rules, ["service"]).filter("service = 3").first().tip == pytest.approx(15.0, abs=0.05)


def test_arithmetic_skips_missing(spark):
    row = spark.createDataFrame([(None, 2.0, 0.0)], "a double, b double, z double")
    tree = {
        "s": ("+", "a", "b", 3), "d": ("-", "a", "b", 3), "n": ("-", "b"), "q": ("/", "b", "z"), "p": ("*", "a", "a"),
        "l": ("ln", "z"), "m": ("%", "b", "z"), "f": ("first", "a", "b"),
    }
    r = row.selectExpr(*[f"{arithmetic(t)} AS {k}" for k, t in tree.items()]).first()
    assert (r.s, r.d, r.n, r.q, r.l, r.f) == (5.0, -1.0, -2.0, float("inf"), float("-inf"), 2.0)
    assert r.p != r.p and r.m != r.m


@pytest.mark.parametrize("family, params", [("triangle", (3, 2, 1)), ("piecewise", ((1, 0), (1, 1))), ("gaussian", (0, 0)), ("nope", ())])
def test_bad_parameters_are_refused(family, params):
    assert mf.check(family, params)
    with pytest.raises(ValueError):
        mf.degree("x", family, params)


def test_universe():
    assert mf.universe("gaussian", (1.0, 2.0)) == (-7.0, 9.0)
    assert mf.universe("gen_bell", (0.0, 1.0, 0.5)) == (-999.0, 999.0)


def tuned_rules():
    points = {"cheap": ("singleton", (4.0,)), "average": ("singleton", (14.0,)), "generous": ("singleton", (27.0,))}
    return replace(RULES, outputs={"tip": inf.Output(points, "cogs", 0.0, bounds=(0.0, 30.0))})


@pytest.mark.parametrize("method", [tu.delta_jump, tu.coordinate_descent, tu.gradient_descent])
def test_tuning_lowers_the_error(meals, method):
    rows = meals.withColumn("wanted", F.col("service") * 3.0).cache()
    base = tuned_rules()
    tuned, trace = method(rows, base, {"tip": "wanted"}, tu.parameters(base, ["tip"]))
    assert trace[-1] < trace[0]
    again = tu.tuning_error(rows, tuned, {"tip": "wanted"}).first().error
    assert again == pytest.approx(trace[-1])


def test_sweep_over_many_candidates_equals_single_errors(meals):
    rows = meals.withColumn("wanted", F.col("service") * 3.0).cache()
    base = tuned_rules()
    many = [replace(base, rules=tuple(replace(r, weight=w / 40) for r in base.rules)) for w in range(1, 41)]
    got = tu.errors_of(rows, many, {"tip": "wanted"})
    assert len(got) == 40
    assert got[7] == pytest.approx(tu.errors_of(rows, [many[7]], {"tip": "wanted"})[0])


def test_continuous_sweep(meals):
    rows = meals.withColumn("wanted", F.col("service") * 3.0)
    one, two = tu.errors_of(rows, [RULES, RULES], {"tip": "wanted"})
    assert one == two > 0


def test_parameter_limits():
    base = tuned_rules()
    p = tu.Parameter("tip", "cheap", 0)
    assert tu.with_value(base, p, 31.0) is None
    assert tu.get_value(tu.with_value(base, p, 6.0), p) == 6.0
    q = tu.Parameter("service", "poor", 0)
    assert tu.with_value(RULES, q, 5.0) is None  # would pass the next point
    assert tu.step_of(RULES, q) == pytest.approx(4.0 / 1000)
