"""Queries: quality measures, statistics, ranking, filters, enumeration-based mining and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import measures as qm
from tidemark.functions import stats
from tidemark.operators import contingency as ct
from tidemark.operators import filters as fl
from tidemark.operators import generate as gn
from tidemark.operators import pareto as pa
from tidemark.operators import patterns as pt
from tidemark.operators import search as se
from tidemark.plans.datasets import (
    lift_patterns, line_cube, line_masks, line_patterns, line_rows, listed, sql_contingency, sql_covers, sql_lift,
    sql_lines, sql_patterns,
)
from tidemark.plans.registry import load, query, r6, rounded
from tidemark.session import cut

FOUR = range(4)
PAT = sql_patterns(2)

TPR = "(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn)::DOUBLE END)"
FPR = "(CASE WHEN fp + tn = 0 THEN 1 ELSE fp::DOUBLE / (fp + tn)::DOUBLE END)"
TNR = "(CASE WHEN fp + tn = 0 THEN 0 ELSE tn::DOUBLE / (fp + tn)::DOUBLE END)"
CONF = "(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp)::DOUBLE END)"
N = "(tp + fp + tn + fn)"
COV = f"(CASE WHEN {N} = 0 THEN 0 ELSE (tp + fp)::DOUBLE / {N}::DOUBLE END)"
PRIOR = f"(CASE WHEN {N} = 0 THEN 0 ELSE (tp + fn)::DOUBLE / {N}::DOUBLE END)"
INF = "'inf'::DOUBLE"
WRACC = f"({COV} * ({CONF} - {PRIOR}))"
REACH = f"({PRIOR} * (1.0::DOUBLE - {PRIOR}))"
GROWTH = f"(CASE WHEN {FPR} <> 0 THEN {TPR} / {FPR} WHEN {TPR} = 0 THEN 0 ELSE {INF} END)"
ODDS = "(CASE WHEN fp = 0 OR fn = 0 THEN 0 ELSE (tp::DOUBLE * tn::DOUBLE) / (fp::DOUBLE * fn::DOUBLE) END)"

MEASURE_SQL = {
    "auc": f"(1.0::DOUBLE + {TPR} - {FPR}) / 2",
    "accuracy": f"CASE WHEN {N} = 0 THEN 0 ELSE (tp + tn)::DOUBLE / {N}::DOUBLE END",
    "confidence": CONF,
    "coverage": COV,
    "fpr": FPR,
    "g_mean": f"sqrt({TPR} * {TNR})",
    "growth_rate": GROWTH,
    "is_growth_rate": f"CASE WHEN {GROWTH} > 1 THEN 1 ELSE 0 END",
    "jaccard": "CASE WHEN tp + fn + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn + fp)::DOUBLE END",
    "supp_diff": f"{TPR} - {FPR}",
    "support": f"CASE WHEN {N} = 0 THEN 0 ELSE tp::DOUBLE / {N}::DOUBLE END",
    "tnr": TNR,
    "tpr": TPR,
    "wracc": WRACC,
    "wracc_norm": f"CASE WHEN {REACH} = 0 THEN 0 ELSE ({WRACC} + {REACH}) / ({REACH} + {REACH}) END",
    "odds_ratio": ODDS,
    "inverse_fpr": f"1 - {FPR}",
}
INVERSE_SQL = {
    **{m: f"1 - ({e})" for m, e in MEASURE_SQL.items()},
    "growth_rate": f"CASE WHEN {GROWTH} = 0 THEN {INF} WHEN {GROWTH} = {INF} THEN 0 ELSE 1 / {GROWTH} END",
    "supp_diff": f"CASE WHEN {TPR} - {FPR} > 0 THEN 1 - ({TPR} - {FPR}) WHEN {TPR} - {FPR} < 0 THEN ({TPR} - {FPR}) + 1 ELSE 0 END",
    "wracc": f"CASE WHEN {WRACC} = 0 THEN 0 ELSE 1 / {WRACC} END",
    "odds_ratio": f"CASE WHEN {ODDS} = 0 THEN {INF} ELSE 1 / {ODDS} END",
}


def _round(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE, {digits}) AS {name}"


def scored(spark, sf_dir, names=None):
    return qm.with_measures(line_patterns(spark, sf_dir), names)


# ---- measures -----------------------------------------------------------------------------------


def _measure_query(name):
    @query(f"measure_{name}", PAT + f" SELECT pattern_id, {_round(MEASURE_SQL[name], name)} FROM pat")
    def run(spark, sf_dir):
        return scored(spark, sf_dir, [name]).select("pattern_id", r6(name).alias(name))


for _name in MEASURE_SQL:
    _measure_query(_name)

LIFT = sql_lines(missing=True) + ", " + sql_lift() + ", " + sql_contingency()


@query(
    "measures_all",
    LIFT + " SELECT pattern_id, class, tp, fp, tn, fn, " + ", ".join(_round(MEASURE_SQL[m], m) for m in qm.REPORTED) + " FROM ctg",
)
def measures_all(spark, sf_dir):
    """Test evaluation of multi-value patterns on data with missing values: counts and the 15 reported measures."""
    cells, layout = line_cube(spark, sf_dir, missing=True)
    cells = cut(cells)
    return rounded(ct.evaluate_test(cells, lift_patterns(cells, layout), layout).drop("masks"), qm.REPORTED)


@query(
    "measures_inverse",
    PAT + " SELECT pattern_id, " + ", ".join(_round(INVERSE_SQL[m], f"inv_{m}") for m in MEASURE_SQL) + " FROM pat",
)
def measures_inverse(spark, sf_dir):
    made = qm.with_measures(line_patterns(spark, sf_dir), list(MEASURE_SQL), inverse=True)
    return made.select("pattern_id", *[r6(f"inv_{m}").alias(f"inv_{m}") for m in MEASURE_SQL])


@query(
    "measures_valid",
    PAT
    + ", v AS (SELECT pattern_id, variant, tp, CASE WHEN variant = 1 THEN -fn ELSE fn END AS fn, tn, CASE WHEN variant = 2 THEN -fp ELSE fp END AS fp "
    "FROM pat, (VALUES (0), (1), (2)) x(variant)), m AS (SELECT pattern_id, variant, "
    + ", ".join(f"({MEASURE_SQL[m]})::DOUBLE AS {m}" for m in ("confidence", "supp_diff", "growth_rate"))
    + " FROM v) SELECT pattern_id, variant, confidence BETWEEN -1e-13 AND 1 + 1e-13 AS confidence_ok, "
    "supp_diff BETWEEN -1 - 1e-13 AND 1 + 1e-13 AS supp_diff_ok, growth_rate >= -1e-13 AND NOT isnan(growth_rate) AS growth_rate_ok FROM m",
)
def measures_valid(spark, sf_dir):
    """Range checks of measures on true counts (variant 0) and on counts with the sign of fn (1) or fp (2) turned, which breaks ranges."""
    variants = F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("variant")
    turned = {c: F.when(F.col("variant") == k, -F.col(c)).otherwise(F.col(c)) for k, c in ((1, "fn"), (2, "fp"))}
    counts = line_patterns(spark, sf_dir).select("pattern_id", "tp", "fp", "tn", "fn", variants).withColumns(turned)
    made = qm.with_measures(counts, ["confidence", "supp_diff", "growth_rate"])
    checks = [f"{qm.MEASURES[m].valid(m)} AS {m}_ok" for m in ("confidence", "supp_diff", "growth_rate")]
    return made.selectExpr("pattern_id", "variant", *checks)


SPREAD = " + ".join(f"CASE WHEN {c} = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / {c} END" for c in ("tp", "fp", "tn", "fn"))
ODDS_CTE = (
    f", o AS (SELECT *, {ODDS} * exp(-(1.96::DOUBLE * sqrt({SPREAD}))) AS lo, {ODDS} * exp(1.96::DOUBLE * sqrt({SPREAD})) AS hi FROM pat)"
)


@query("odds_interval", PAT + ODDS_CTE + " SELECT pattern_id, round(lo::DOUBLE, 6) AS odds_low, round(hi::DOUBLE, 6) AS odds_high FROM o")
def odds_interval(spark, sf_dir):
    made = qm.with_odds_interval(line_patterns(spark, sf_dir))
    return made.select("pattern_id", r6("odds_low").alias("odds_low"), r6("odds_high").alias("odds_high"))


@query(
    "odds_overlap",
    PAT + ODDS_CTE
    + " SELECT a.pattern_id AS one_var, b.pattern_id AS two_vars, CASE WHEN a.hi > b.hi THEN a.lo <= b.hi ELSE b.lo <= a.hi END AS overlap "
    "FROM o a JOIN o b ON a.class = b.class AND a.m0 = b.m0 AND a.m0 <> 0 AND a.n_vars = 1 AND b.n_vars = 2",
)
def odds_overlap(spark, sf_dir):
    """Does adding a second condition to a quantity pattern change its odds clearly?"""
    made = cut(qm.with_odds_interval(line_patterns(spark, sf_dir)).withColumn("m0", F.col("masks")[0]).filter("m0 <> 0"))
    one = made.filter("n_vars = 1").selectExpr("class", "m0", "pattern_id AS one_var", "odds_low AS lo1", "odds_high AS hi1")
    two = made.filter("n_vars = 2").selectExpr("class", "m0", "pattern_id AS two_vars", "odds_low AS lo2", "odds_high AS hi2")
    test = qm.intervals_overlap("lo1", "hi1", "lo2", "hi2")
    return one.join(two, ["class", "m0"]).selectExpr("one_var", "two_vars", f"{test} AS overlap")


def _top_sql(measure, order):
    return (
        PAT + f" SELECT pattern_id, class, {_round(MEASURE_SQL[measure], measure)}, rank FROM (SELECT *, "
        f"row_number() OVER (PARTITION BY class ORDER BY ({MEASURE_SQL[measure]})::DOUBLE {order}, pattern_id) AS rank FROM pat) WHERE rank <= 10"
    )


@query("top_confidence", _top_sql("confidence", "DESC"))
def top_confidence(spark, sf_dir):
    top = qm.top_patterns(scored(spark, sf_dir, ["confidence"]), "confidence", 10)
    return top.select("pattern_id", "class", r6("confidence").alias("confidence"), "rank")


@query("top_fpr", _top_sql("fpr", "ASC"))
def top_fpr(spark, sf_dir):
    top = qm.top_patterns(scored(spark, sf_dir, ["fpr"]), "fpr", 10)
    return top.select("pattern_id", "class", r6("fpr").alias("fpr"), "rank")


@query("user_measure", PAT + " SELECT pattern_id, " + _round(f"2 * {CONF} * {TPR} / nullif({CONF} + {TPR}, 0)", "f_score") + " FROM pat")
def user_measure(spark, sf_dir):
    """A measure registered by the user as a Column function."""

    def f_score(tp, fp, tn, fn):
        precision, recall = tp / (tp + fp), tp / (tp + fn)
        return 2 * precision * recall / (precision + recall)

    measure = qm.register_measure("f_score", f_score)
    return line_patterns(spark, sf_dir).withColumn("f_score", measure.column()).select("pattern_id", r6("f_score").alias("f_score"))


# ---- statistics ---------------------------------------------------------------------------------

PRICE = "sqrt(o_totalprice)"
QUANTILES = "[" + ", ".join(f"{q}::DOUBLE" for q in stats.STUDENT_95) + "]"


def _ci_sql(key):
    half = (
        f"CASE WHEN n = 1 THEN 0.1::DOUBLE WHEN n < 30 THEN ({QUANTILES})[n - 1] * sd / sqrt(n) "
        f"ELSE {stats.NORMAL_95}::DOUBLE * sd / sqrt(n) END"
    )
    return (
        f"SELECT {key}, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - {half}, 6) AS ci_low, round(mean + {half}, 6) AS ci_high "
        f"FROM (SELECT {key}, count(*) AS n, avg({PRICE}) AS mean, stddev_samp({PRICE}) AS sd FROM orders GROUP BY {key})"
    )


def _ci_query(name, key):
    @query(name, _ci_sql(key))
    def run(spark, sf_dir):
        rows = load(spark, sf_dir, "orders").selectExpr(key, f"{PRICE} AS price")
        made = stats.mean_confidence_interval(rows, "price", [key])
        return made.withColumns({c: r6(c) for c in ("mean", "sd", "ci_low", "ci_high")})


_ci_query("mean_interval_small_groups", "o_custkey")
_ci_query("mean_interval_large_groups", "o_orderpriority")


@query("group_stats", f"SELECT o_orderstatus, count(*) AS n, round(avg({PRICE}), 6) AS mean, round(stddev_samp({PRICE}), 6) AS sd FROM orders GROUP BY 1")
def group_stats(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").selectExpr("o_orderstatus", f"{PRICE} AS price")
    return stats.group_stats(rows, "price", ["o_orderstatus"]).withColumns({c: r6(c) for c in ("mean", "sd")})


# ---- ranking ------------------------------------------------------------------------------------

OBJECTIVES = ["confidence", "support"]
SC = PAT + f", sc AS (SELECT *, ({MEASURE_SQL['confidence']})::DOUBLE AS confidence, ({MEASURE_SQL['support']})::DOUBLE AS support, ({MEASURE_SQL['tnr']})::DOUBLE AS tnr FROM pat)"
DOMINATES = "a.class = b.class AND a.confidence >= b.confidence AND a.support >= b.support AND (a.confidence > b.confidence OR a.support > b.support)"
RANKED = (
    SC.replace("WITH ", "WITH RECURSIVE ", 1)
    + f", edge AS (SELECT a.pattern_id AS a, b.pattern_id AS b FROM sc a JOIN sc b ON {DOMINATES}), "
    "depth AS (SELECT pattern_id, 0 AS d FROM sc UNION SELECT edge.b, depth.d + 1 FROM depth JOIN edge ON edge.a = depth.pattern_id), "
    "ranked AS (SELECT sc.*, x.front FROM sc JOIN (SELECT pattern_id, max(d) AS front FROM depth GROUP BY 1) x USING (pattern_id))"
)


def _gap(o):
    w = f"(PARTITION BY class, front ORDER BY {o}, pattern_id)"
    whole = "(PARTITION BY class, front)"
    return (
        f"CASE WHEN lag({o}) OVER {w} IS NULL OR lead({o}) OVER {w} IS NULL THEN {INF} "
        f"WHEN max({o}) OVER {whole} = min({o}) OVER {whole} THEN 0 "
        f"ELSE (lead({o}) OVER {w} - lag({o}) OVER {w}) / (max({o}) OVER {whole} - min({o}) OVER {whole}) END"
    )


CROWDED = RANKED + f", crowded AS (SELECT *, (0.0::DOUBLE + {_gap('confidence')}) + {_gap('support')} AS crowding FROM ranked)"


@query("pareto_front", SC + f" SELECT b.pattern_id FROM sc b WHERE NOT EXISTS (SELECT 1 FROM sc a WHERE {DOMINATES})")
def pareto_front(spark, sf_dir):
    return pa.pareto_front(cut(scored(spark, sf_dir, OBJECTIVES)), OBJECTIVES, ["class"]).select("pattern_id")


THREE = "a.class = b.class AND a.confidence >= b.confidence AND a.support >= b.support AND a.tnr >= b.tnr AND (a.confidence > b.confidence OR a.support > b.support OR a.tnr > b.tnr)"


@query("pareto_front3", SC + f" SELECT b.pattern_id FROM sc b WHERE NOT EXISTS (SELECT 1 FROM sc a WHERE {THREE})")
def pareto_front3(spark, sf_dir):
    names = ["confidence", "support", "tnr"]
    return pa.pareto_front(cut(scored(spark, sf_dir, names)), names, ["class"]).select("pattern_id")


@query(
    "pareto_front_rows",
    "WITH d AS (SELECT DISTINCT l_returnflag, l_quantity, l_extendedprice FROM lineitem), "
    "best AS (SELECT l_returnflag, l_quantity, max(l_extendedprice) AS l_extendedprice FROM d GROUP BY 1, 2), "
    "f AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM best a WHERE a.l_returnflag = b.l_returnflag "
    "AND a.l_quantity > b.l_quantity AND a.l_extendedprice >= b.l_extendedprice)) "
    "SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag, l.l_quantity, l.l_extendedprice FROM lineitem l JOIN f USING (l_returnflag, l_quantity, l_extendedprice)",
)
def pareto_front_rows(spark, sf_dir):
    """The front of the table itself: largest quantity and price per return flag."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    return pa.pareto_front(rows, ["l_quantity", "l_extendedprice"], ["l_returnflag"])


def _ranked(spark, sf_dir):
    return pa.pareto_rank(cut(scored(spark, sf_dir, OBJECTIVES)), OBJECTIVES, ["class"])


@query("pareto_rank", RANKED + " SELECT pattern_id, front FROM ranked")
def pareto_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("pattern_id", "front")


def _crowded(spark, sf_dir):
    return pa.crowding_distance(_ranked(spark, sf_dir), OBJECTIVES, ["class", "front"])


@query("crowding", CROWDED + " SELECT pattern_id, front, round(crowding, 6) AS crowding FROM crowded")
def crowding(spark, sf_dir):
    return _crowded(spark, sf_dir).select("pattern_id", "front", r6("crowding").alias("crowding"))


@query(
    "select_top",
    CROWDED + " SELECT pattern_id, class, front FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY front, crowding DESC, pattern_id) AS rn FROM crowded) WHERE rn <= 10",
)
def select_top(spark, sf_dir):
    return pa.select_top(_crowded(spark, sf_dir), 10, ["class"]).select("pattern_id", "class", "front")


POINTS = [(1.0, 0.0), (0.75, 0.25), (0.5, 0.5), (0.25, 0.75), (0.0, 1.0)]


def _distance(x, y):
    k = f"((confidence * {x}::DOUBLE + support * {y}::DOUBLE) / {x * x + y * y}::DOUBLE)"
    return f"sqrt(pow({k} * {x}::DOUBLE - confidence, 2) + pow({k} * {y}::DOUBLE - support, 2))"


@query(
    "reference_association",
    SC + " SELECT pattern_id, ref, round(ref_distance, 6) AS ref_distance FROM (SELECT pattern_id, ref, ref_distance, "
    "row_number() OVER (PARTITION BY pattern_id ORDER BY ref_distance, ref) AS rn FROM ("
    + " UNION ALL ".join(f"SELECT pattern_id, {i} AS ref, {_distance(x, y)} AS ref_distance FROM sc" for i, (x, y) in enumerate(POINTS))
    + ")) WHERE rn = 1",
)
def reference_association(spark, sf_dir):
    made = pa.reference_association(scored(spark, sf_dir, OBJECTIVES), OBJECTIVES, POINTS)
    return made.select("pattern_id", "ref", r6("ref_distance").alias("ref_distance"))


@query(
    "front_coverage",
    RANKED + " SELECT q.class, sum(r.n)::BIGINT AS n_rows FROM (SELECT DISTINCT class FROM ranked) q JOIN cells r ON "
    f"EXISTS (SELECT 1 FROM ranked f WHERE f.front = 0 AND f.class = q.class AND {sql_covers('r', 'f')}) GROUP BY q.class",
)
def front_coverage(spark, sf_dir):
    """Rows the non-dominated patterns of each class cover together."""
    cells, layout = line_cube(spark, sf_dir)
    cells = cut(cells)
    made = cut(qm.with_measures(ct.enumerate_patterns(cells, layout, 2), OBJECTIVES))
    ranked = cut(pa.pareto_rank(made, OBJECTIVES, ["class"]))
    covered = se.front_covered_cells(cells, ranked, layout)
    named = cells.withColumnRenamed("class", "cell_class").select(*layout.words, "cell_class", "n")
    return covered.join(named, [*layout.words, "cell_class"]).groupBy("class").agg(F.sum("n").alias("n_rows"))


# ---- filters ------------------------------------------------------------------------------------

LISTED = PAT + ", lst AS (SELECT *, row_number() OVER (ORDER BY class, pattern_id) - 1 AS pos FROM pat)"
OVERLAPS = LISTED + (
    ", hits AS (SELECT q.class, q.pos, r.w0, r.w1, r.w2, r.w3, r.n FROM lst q JOIN cells r ON r.class = q.class AND " + sql_covers() + "), "
    "ov AS (SELECT a.class, a.pos AS pos1, b.pos AS pos2, sum(a.n)::BIGINT AS \"both\" FROM hits a JOIN hits b ON a.class = b.class AND a.pos < b.pos "
    "AND a.w0 = b.w0 AND a.w1 = b.w1 AND a.w2 = b.w2 AND a.w3 = b.w3 GROUP BY 1, 2, 3)"
)


def _listed(spark, sf_dir):
    cells, layout = line_cube(spark, sf_dir)
    cells = cut(cells)
    return cells, layout, cut(listed(ct.enumerate_patterns(cells, layout, 2)))


@query("overlap_pairs", OVERLAPS + ' SELECT class, pos1, pos2, "both" FROM ov')
def overlap_pairs(spark, sf_dir):
    cells, layout, patterns = _listed(spark, sf_dir)
    return fl.overlap_pairs(cells, patterns, layout)


MAX_PCT = 0.9
RATIO = OVERLAPS + (
    f", oo AS (SELECT *, {ODDS} * exp(-(1.96::DOUBLE * sqrt({SPREAD}))) AS lo, {ODDS} * exp(1.96::DOUBLE * sqrt({SPREAD})) AS hi FROM lst WHERE tp + fp > 0), "
    "judged AS (SELECT ov.class, pos1, pos2, CASE WHEN a.lo > b.hi THEN 2 WHEN b.lo > a.hi THEN 1 WHEN a.n_vars <= b.n_vars THEN 2 ELSE 1 END AS loser "
    "FROM ov JOIN oo a ON a.pos = pos1 JOIN oo b ON b.pos = pos2 "
    f"WHERE greatest(\"both\"::DOUBLE / a.tp, \"both\"::DOUBLE / b.tp) >= {MAX_PCT}::DOUBLE), "
    "later AS (SELECT pos2, min(pos1) AS gone_at FROM judged WHERE loser = 2 GROUP BY 1), "
    "gone AS (SELECT pos2 AS pos FROM later UNION SELECT pos1 FROM judged LEFT JOIN later USING (pos2) WHERE loser = 1 AND (gone_at IS NULL OR gone_at > pos1))"
)


@query("coverage_ratio_filter", RATIO + " SELECT pattern_id, class FROM oo WHERE pos NOT IN (SELECT pos FROM gone)")
def coverage_ratio_filter(spark, sf_dir):
    cells, layout, patterns = _listed(spark, sf_dir)
    kept = fl.coverage_ratio_filter(cells, patterns.select("pos", "pattern_id", "class", "masks"), layout, MAX_PCT)
    return kept.select("pattern_id", "class")


@query(
    "token_competition",
    PAT + f", rk AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY ({MEASURE_SQL['wracc_norm']})::DOUBLE DESC, n_vars, pattern_id) AS rank FROM pat), "
    f"win AS (SELECT DISTINCT class, rank FROM (SELECT r.class, min(q.rank) AS rank FROM cells r JOIN rk q ON r.class = q.class AND {sql_covers()} "
    "GROUP BY r.class, r.w0, r.w1, r.w2, r.w3)) SELECT rk.pattern_id, rk.class, rk.rank FROM rk JOIN win USING (class, rank)",
)
def token_competition(spark, sf_dir):
    cells, layout, patterns = _listed(spark, sf_dir)
    return fl.token_competition(cells, patterns, layout).select("pattern_id", "class", "rank")


@query(
    "measure_threshold",
    PAT + f", t AS (SELECT pattern_id, class, 1 - ({CONF}) AS inv FROM pat), "
    "x AS (SELECT *, bool_or(inv < 0.2::DOUBLE) OVER (PARTITION BY class) AS any_kept, row_number() OVER (PARTITION BY class ORDER BY inv, pattern_id) AS rn FROM t) "
    "SELECT pattern_id, class FROM x WHERE inv < 0.2::DOUBLE OR (NOT any_kept AND rn = 1)",
)
def measure_threshold(spark, sf_dir):
    return fl.measure_threshold(line_patterns(spark, sf_dir), "confidence", 0.8).select("pattern_id", "class")


@query(
    "measure_threshold_fallback",
    PAT + f" SELECT pattern_id, class FROM (SELECT pattern_id, class, row_number() OVER (PARTITION BY class ORDER BY 1 - ({MEASURE_SQL['jaccard']}), pattern_id) AS rn FROM pat) WHERE rn = 1",
)
def measure_threshold_fallback(spark, sf_dir):
    return fl.measure_threshold(line_patterns(spark, sf_dir), "jaccard", 0.99).select("pattern_id", "class")


@query(
    "drop_repeated",
    LISTED + " SELECT pattern_id FROM lst QUALIFY row_number() OVER (PARTITION BY m0, m1, m2, m3 ORDER BY pos DESC) = 1",
)
def drop_repeated(spark, sf_dir):
    return fl.drop_repeated(_listed(spark, sf_dir)[2]).select("pattern_id")


@query(
    "drop_repeated_scored",
    LISTED + " SELECT pattern_id FROM lst QUALIFY row_number() OVER (PARTITION BY tp, m0, m1, m2, m3 ORDER BY pos) = 1",
)
def drop_repeated_scored(spark, sf_dir):
    return fl.drop_repeated_scored(_listed(spark, sf_dir)[2], ["tp"]).select("pattern_id")


@query(
    "model_for_classes",
    PAT + " SELECT pattern_id FROM pat WHERE class IN (SELECT CASE WHEN l_extendedprice >= 50000 THEN 'high' ELSE 'low' END FROM lineitem WHERE l_extendedprice >= 60000)",
)
def model_for_classes(spark, sf_dir):
    present = line_rows(spark, sf_dir).filter("l_extendedprice >= 60000").select(F.col("cls").alias("class"))
    return fl.model_for_classes(line_patterns(spark, sf_dir), present).select("pattern_id")


# ---- flagship -----------------------------------------------------------------------------------


@query(
    "flagship",
    CROWDED
    + " SELECT pattern_id, class, front, tp, fp, tn, fn, "
    + ", ".join(_round(MEASURE_SQL[m], m) for m in qm.REPORTED)
    + " FROM (SELECT * EXCLUDE (confidence, support, tnr), row_number() OVER (PARTITION BY class ORDER BY front, crowding DESC, pattern_id) AS rn FROM crowded) WHERE rn <= 20",
)
def flagship(spark, sf_dir):
    """Which patterns separate high-price line items: the 20 best per class by Pareto front and crowding."""
    ranked = pa.pareto_rank(cut(scored(spark, sf_dir)), OBJECTIVES, ["class"])
    top = pa.select_top(pa.crowding_distance(ranked, OBJECTIVES, ["class", "front"]), 20, ["class"])
    return rounded(top, qm.REPORTED).select("pattern_id", "class", "front", "tp", "fp", "tn", "fn", *qm.REPORTED)


# ---- search (draws differ from SQL's, so these are checked by properties in the tests) -------------


def _population(spark, sf_dir, maker):
    cells, layout = line_cube(spark, sf_dir)
    cells = cut(cells)
    made = cut(maker(layout, gn.slots_for(spark, ["high", "low"], 49), 11).dropDuplicates(["pattern_id", "class"]))
    return ct.contingency(cells, made.select("pattern_id", "class", "masks"), layout).drop("masks")


@query("random_patterns")
def random_patterns(spark, sf_dir):
    return _population(spark, sf_dir, gn.random_patterns)


@query("oriented_patterns")
def oriented_patterns(spark, sf_dir):
    return _population(spark, sf_dir, gn.oriented_patterns)


@query("coverage_patterns")
def coverage_patterns(spark, sf_dir):
    """One pattern seeded from every row of the table, counted by pattern."""
    rows, layout = line_masks(spark, sf_dir, missing=True, keep=["l_orderkey"])
    seeds = rows.withColumn("slot", F.col("l_orderkey")).drop("l_orderkey")
    return gn.coverage_patterns(layout, seeds, 5).groupBy("class", "pattern_id").agg(F.count(F.lit(1)).alias("n"))


@query("crossover_mutation")
def crossover_mutation(spark, sf_dir):
    """Every enumerated pattern crossed with the next one of its class, both children mutated and scored."""
    cells, layout, patterns = _listed(spark, sf_dir)
    mates = patterns.selectExpr("class", "pos + 1 AS pos", "masks AS dad")
    pairs = patterns.select("class", "pos", F.col("masks").alias("mom")).join(mates, ["class", "pos"])
    girl, boy = gn.crossover(layout, "mom", "dad", 3, ["class", "pos"])
    children = pairs.selectExpr("class", "pos", f"explode(array({girl}, {boy})) AS masks")
    children = cut(children.selectExpr("class", f"{gn.mutate(layout, 'masks', 3, ['class', 'pos'], 0.5)} AS masks"))
    unique = cut(pt.canonicalise(children, layout).dropDuplicates(["pattern_id"]))
    return ct.contingency(cells, unique.select("pattern_id", "class", "masks"), layout).drop("masks")


@query("mine")
def mine(spark, sf_dir):
    """Cellular search over both classes with the default budget."""
    cells, layout = line_cube(spark, sf_dir)
    return se.mine(cut(cells), layout).drop("masks")


@query("reinitialise")
def reinitialise(spark, sf_dir):
    cells, layout = line_cube(spark, sf_dir)
    cells = cut(cells)
    pop = cut(gn.oriented_patterns(layout, gn.slots_for(spark, ["high", "low"], 49), 11))
    return se.reinitialise(cells, pop, layout, ["high", "low"], 49, 17).drop("masks", "survivor")
