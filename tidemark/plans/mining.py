"""Queries: profiling, fuzzification, patterns, coverage and contingency."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import contingency as ct
from tidemark.operators import coverage as cv
from tidemark.operators import fuzzify as fz
from tidemark.operators import patterns as pt
from tidemark.operators import profile as pr
from tidemark.plans.datasets import (
    KEYS, LINE_NUMERIC, ROW_KEYS, lift_patterns, line_cube, line_masks, line_patterns, line_rows, sql_contingency, sql_covers,
    sql_degree, sql_feet, sql_key, sql_lift, sql_line, sql_lines, sql_patterns,
)
from tidemark.plans.registry import load, query, r6, rounded
from tidemark.session import cut

FOUR = range(4)
M4 = ", ".join(f"m{i}" for i in FOUR)
W4 = ", ".join(f"w{i}" for i in FOUR)

# ---- profiling ----------------------------------------------------------------------------------


def _profile_sql() -> str:
    numeric = [
        f"SELECT '{c}' AS name, 'numeric' AS kind, count({c}) AS n_present, min({c})::DOUBLE AS \"min\", max({c})::DOUBLE AS \"max\", "
        f"NULL::BIGINT AS n_values, NULL::VARCHAR AS domain FROM lineitem"
        for c in LINE_NUMERIC
    ]
    nominal = [
        f"SELECT '{c}', 'nominal', count({c}), NULL::DOUBLE, NULL::DOUBLE, count(DISTINCT {c}), string_agg(DISTINCT {c}, '|' ORDER BY {c}) FROM lineitem"
        for c in ("l_returnflag", "l_linestatus")
    ]
    return " UNION ALL ".join(numeric + nominal)


@query("profile", _profile_sql())
def profile(spark, sf_dir):
    return pr.profile(load(spark, sf_dir, "lineitem"), LINE_NUMERIC, ["l_returnflag", "l_linestatus"])


DECLARED = {"o_orderstatus": ["P", "O", "F", "X"]}


@query(
    "profile_declared",
    "SELECT 'o_totalprice' AS name, 'numeric' AS kind, count(o_totalprice) AS n_present, min(o_totalprice) AS \"min\", "
    "max(o_totalprice) AS \"max\", NULL::BIGINT AS n_values, NULL::VARCHAR AS domain FROM orders UNION ALL "
    "SELECT 'o_orderstatus', 'nominal', count(*) FILTER (o_orderstatus IN ('P','O','F','X')), NULL, NULL, 4, 'P|O|F|X' FROM orders",
)
def profile_declared(spark, sf_dir):
    return pr.profile_declared(load(spark, sf_dir, "orders"), ["o_totalprice"], DECLARED)


@query(
    "bounds",
    " UNION ALL ".join(
        f"SELECT l_returnflag, count(*) AS n_rows, {i} AS var, '{c}' AS name, min({c}) AS \"min\", max({c}) AS \"max\", "
        f"count({c}) AS n_present FROM lineitem GROUP BY l_returnflag"
        for i, c in enumerate(LINE_NUMERIC)
    ),
)
def bounds(spark, sf_dir):
    return pr.numeric_bounds(load(spark, sf_dir, "lineitem"), LINE_NUMERIC, ["l_returnflag"])


def _bounds_where(condition: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, min({c}) AS lo, max({c}) AS hi FROM lineitem WHERE {condition}" for c in LINE_NUMERIC
    )


@query(
    "widen_bounds",
    f"WITH cur AS ({_bounds_where('l_orderkey % 5 = 0')}), bat AS ({_bounds_where('l_orderkey % 5 <> 0')}) "
    "SELECT cur.name, least(cur.lo, bat.lo) AS \"min\", greatest(cur.hi, bat.hi) AS \"max\", "
    "(bat.lo < cur.lo OR bat.hi > cur.hi) AS changed FROM cur JOIN bat USING (name)",
)
def widen_bounds(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    first = pr.numeric_bounds(rows.filter("l_orderkey % 5 = 0"), LINE_NUMERIC)
    return pr.widen_bounds(first, pr.numeric_bounds(rows.filter("l_orderkey % 5 <> 0"), LINE_NUMERIC))


@query("active_classes", "SELECT event_type AS class, count(*) AS n FROM events GROUP BY event_type")
def active_classes(spark, sf_dir):
    return pr.active_classes(load(spark, sf_dir, "events"), "event_type")


# ---- fuzzification ------------------------------------------------------------------------------


@query(
    "partition",
    f"WITH {sql_line()}, {sql_feet(LINE_NUMERIC, 5)} "
    + " UNION ALL ".join(
        f"SELECT {i} AS var, '{c}' AS name, {j} AS label, round(c{i}_a{j}, 6) AS a, round(c{i}_b{j}, 6) AS b, round(c{i}_c{j}, 6) AS c FROM p"
        for i, c in enumerate(LINE_NUMERIC)
        for j in range(5)
    ),
)
def partition(spark, sf_dir):
    table = fz.partition_table(pr.numeric_bounds(load(spark, sf_dir, "lineitem"), LINE_NUMERIC), 5)
    return rounded(table, ["a", "b", "c"])


@query(
    "membership",
    f"WITH {sql_line()}, {sql_feet(LINE_NUMERIC)} SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round({sql_degree('l_quantity', 0, j)}, 6) AS d{j}" for j in range(3))
    + " FROM src, p",
)
def membership(spark, sf_dir):
    rows = line_rows(spark, sf_dir)
    quantity = fz.fit(rows, LINE_NUMERIC).variables[0]
    return rows.selectExpr(*KEYS, *[f"round({d}, 6) AS d{j}" for j, d in enumerate(fz.degrees("l_quantity", quantity))])


@query("labels", sql_lines() + " SELECT l_orderkey, l_linenumber, class, g0, g1, g2, g3 FROM lab")
def labels(spark, sf_dir):
    rows = line_rows(spark, sf_dir)
    layout = fz.fit(rows, LINE_NUMERIC)
    made = [f"{fz.label_argmax(v.name, v)} AS g{i}" for i, v in enumerate(layout.variables)]
    return rows.selectExpr(*KEYS, "cls AS class", *made)


def _tied_sql() -> str:
    def mask(i):
        top = f"greatest(d{i}_0, d{i}_1, d{i}_2)"
        bits = " + ".join(f"CASE WHEN d{i}_{j} >= {top} - 1e-11::DOUBLE THEN {1 << j} ELSE 0 END" for j in range(3))
        return f"CASE WHEN x{i} IS NULL THEN 7::BIGINT ELSE ({bits})::BIGINT END AS w{i}"

    return sql_lines(missing=True) + f" SELECT l_orderkey, l_linenumber, class, {', '.join(mask(i) for i in FOUR)} FROM d"


@query("labels_tied", _tied_sql())
def labels_tied(spark, sf_dir):
    return line_masks(spark, sf_dir, missing=True, ties="all")[0]


@query(
    "nominal_selectors",
    "SELECT o_orderkey, o_orderpriority AS class, CASE WHEN s IS NULL THEN 7::BIGINT ELSE (1::BIGINT << (list_position(dom, s) - 1)) END AS w0 "
    "FROM (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS s FROM orders), "
    "(SELECT list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS dom FROM orders WHERE o_orderkey % 17 <> 0)",
)
def nominal_selectors(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END"))
    layout = fz.fit(rows, [], ["o_orderstatus"])
    return fz.selectors(rows, layout, "o_orderpriority", keep=["o_orderkey"])


@query(
    "wide_domain",
    "WITH dom AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS i FROM (SELECT DISTINCT p_name FROM part)) "
    "SELECT p_type AS class, CASE WHEN i < 63 THEN (1::BIGINT << i) ELSE 0::BIGINT END AS w0, "
    "CASE WHEN i >= 63 THEN (1::BIGINT << (i - 63)) ELSE 0::BIGINT END AS w1, count(*) AS n "
    "FROM part JOIN dom USING (p_name) GROUP BY ALL",
)
def wide_domain(spark, sf_dir):
    """A nominal column with more values than one mask word holds."""
    rows = load(spark, sf_dir, "part")
    layout = fz.fit(rows, [], ["p_name"])
    return fz.compressed_cube(fz.selectors(rows, layout, "p_type"), layout)


@query("selectors", sql_lines(missing=True) + f" SELECT l_orderkey, l_linenumber, class, {W4} FROM rows_")
def selectors(spark, sf_dir):
    return line_masks(spark, sf_dir, missing=True)[0]


@query("cube", sql_lines(keep="") + f" SELECT {W4}, class, n FROM cells")
def cube(spark, sf_dir):
    return line_cube(spark, sf_dir)[0]


@query("cube_missing", sql_lines(missing=True, keep="") + f" SELECT {W4}, class, n FROM cells")
def cube_missing(spark, sf_dir):
    return line_cube(spark, sf_dir, missing=True)[0]


@query("selector_counts", sql_lines(missing=True, keep="") + ", " + sql_lift() + " SELECT var, value, class, n FROM sc")
def selector_counts(spark, sf_dir):
    return fz.selector_counts(*line_cube(spark, sf_dir, missing=True))


@query(
    "selectors_covering",
    sql_lines(missing=True)
    + " "
    + " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, {i} AS var, {j} AS value FROM rows_ WHERE (w{i} & {1 << j}) <> 0"
        for i in FOUR
        for j in range(3)
    ),
)
def selectors_covering(spark, sf_dir):
    masks, layout = line_masks(spark, sf_dir, missing=True)
    return fz.selectors_covering(masks, layout, KEYS)


QUANTITY_TERMS = {
    "triangle": (0.0, 10.0, 30.0),
    "trapezoid": (5.0, 15.0, 25.0, 40.0),
    "gaussian": (25.0, 8.0),
    "gaussian2": (15.0, 5.0, 30.0, 7.0),
    "gen_bell": (25.0, 10.0, 2.5),
    "sigmoid": (0.4, 25.0),
    "sigmoid_difference": (0.6, 15.0, 0.5, 35.0),
    "cosine": (12.0, 25.0),
    "piecewise": ((5.0, 0.0), (20.0, 1.0), (30.0, 0.25), (45.0, 0.75)),
    "singleton": (25.0, 0.8),
    "singletons": ((10.0, 0.3), (20.0, 0.9), (30.0, 0.6)),
}

X = "l_quantity"
FAMILY_SQL = {
    "triangle": f"CASE WHEN {X} < 0 OR {X} > 30 THEN 0 WHEN {X} = 10 THEN 1 WHEN {X} < 10 THEN ({X} - 0) / 10.0::DOUBLE ELSE 1 - ({X} - 10) / 20.0::DOUBLE END",
    "trapezoid": f"CASE WHEN {X} < 5 OR {X} > 40 THEN 0 WHEN {X} BETWEEN 15 AND 25 THEN 1 WHEN {X} < 15 THEN ({X} - 5) / 10.0::DOUBLE ELSE 1 - ({X} - 25) / 15.0::DOUBLE END",
    "gaussian": f"exp(-(({X} - 25) * ({X} - 25)) / 128.0::DOUBLE)",
    "gaussian2": f"CASE WHEN {X} < 15 THEN exp(-(({X} - 15) * ({X} - 15)) / 50.0::DOUBLE) WHEN {X} > 30 THEN exp(-(({X} - 30) * ({X} - 30)) / 98.0::DOUBLE) ELSE 1 END",
    "gen_bell": f"1.0::DOUBLE / (1.0::DOUBLE + pow(abs(({X} - 25) / 10.0::DOUBLE), 5.0::DOUBLE))",
    "sigmoid": f"1.0::DOUBLE / (1.0::DOUBLE + exp(-0.4::DOUBLE * ({X} - 25)))",
    "sigmoid_difference": f"greatest(1.0::DOUBLE / (1.0::DOUBLE + exp(-0.6::DOUBLE * ({X} - 15))) - 1.0::DOUBLE / (1.0::DOUBLE + exp(-0.5::DOUBLE * ({X} - 35))), 0.0::DOUBLE)",
    "cosine": f"CASE WHEN {X} - 25 BETWEEN -12 AND 12 THEN (cos(({X} - 25) * (pi() / 12.0::DOUBLE)) + 1) / 2 ELSE 0 END",
    "piecewise": f"CASE WHEN {X} <= 5 THEN 0 WHEN {X} <= 20 THEN ({X} - 5) / 15.0::DOUBLE WHEN {X} <= 30 THEN 1 - 0.75::DOUBLE * ({X} - 20) / 10.0::DOUBLE "
    f"WHEN {X} <= 45 THEN 0.25::DOUBLE + 0.5::DOUBLE * ({X} - 30) / 15.0::DOUBLE ELSE 0.75::DOUBLE END",
    "singleton": f"CASE WHEN {X} = 25 THEN 0.8::DOUBLE ELSE 0 END",
    "singletons": f"CASE WHEN {X} <= 10 THEN 0.3::DOUBLE WHEN {X} > 30 THEN 0.6::DOUBLE WHEN {X} = 20 THEN 0.9::DOUBLE WHEN {X} = 30 THEN 0.6::DOUBLE ELSE 0 END",
}


def _family(family):
    params = QUANTITY_TERMS[family]

    @query(
        f"family_{family}",
        f"SELECT l_orderkey, l_linenumber, round(({FAMILY_SQL[family]})::DOUBLE, 6) AS degree FROM lineitem",
    )
    def run(spark, sf_dir):
        made = fz.fuzzify(load(spark, sf_dir, "lineitem"), [("l_quantity", "t", family, params)], keep=KEYS)
        return made.select(*KEYS, r6("l_quantity_t").alias("degree"))


for _name in QUANTITY_TERMS:
    _family(_name)


@query(
    "families_missing",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"CASE WHEN l_orderkey % 17 > 1 THEN round(({FAMILY_SQL[f]})::DOUBLE, 6) END AS {f}" for f in QUANTITY_TERMS)
    + " FROM lineitem",
)
def families_missing(spark, sf_dir):
    """Every family where a part of the quantities is null and another NaN: neither has a degree."""
    holes = "CASE WHEN l_orderkey % 17 > 1 THEN l_quantity WHEN l_orderkey % 17 = 1 THEN double('NaN') END"
    rows = load(spark, sf_dir, "lineitem").withColumn("l_quantity", F.expr(holes))
    made = fz.fuzzify(rows, [("l_quantity", f, f, p) for f, p in QUANTITY_TERMS.items()], keep=KEYS)
    return made.select(*KEYS, *[r6(f"l_quantity_{f}").alias(f) for f in QUANTITY_TERMS])


@query(
    "fuzzify",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({FAMILY_SQL[f]})::DOUBLE, 6) AS l_quantity_{f}" for f in QUANTITY_TERMS)
    + " FROM lineitem",
)
def fuzzify(spark, sf_dir):
    terms = [("l_quantity", f, f, params) for f, params in QUANTITY_TERMS.items()]
    return rounded(fz.fuzzify(load(spark, sf_dir, "lineitem"), terms, keep=KEYS), [f"l_quantity_{f}" for f in QUANTITY_TERMS])


@query(
    "fuzzy_histogram",
    " UNION ALL ".join(
        f"SELECT l_returnflag, 'l_quantity' AS name, '{f}' AS term, round(sum(({FAMILY_SQL[f]})::DOUBLE), 3) AS sum_degree, "
        f"round(avg(({FAMILY_SQL[f]})::DOUBLE), 6) AS mean_degree FROM lineitem GROUP BY l_returnflag"
        for f in QUANTITY_TERMS
    ),
)
def fuzzy_histogram(spark, sf_dir):
    terms = [("l_quantity", f, f, params) for f, params in QUANTITY_TERMS.items()]
    made = fz.fuzzy_histogram(load(spark, sf_dir, "lineitem"), terms, ["l_returnflag"])
    return made.withColumns({"sum_degree": F.round("sum_degree", 3), "mean_degree": r6("mean_degree")})


# ---- patterns and coverage ----------------------------------------------------------------------


@query("enumerate1", sql_patterns(1) + f" SELECT pattern_id, class, n_vars, {M4}, tp, fp, tn, fn FROM pat")
def enumerate1(spark, sf_dir):
    return _flat(line_patterns(spark, sf_dir, 1))


@query("enumerate2", sql_patterns(2) + f" SELECT pattern_id, class, n_vars, {M4}, tp, fp, tn, fn FROM pat")
def enumerate2(spark, sf_dir):
    return _flat(line_patterns(spark, sf_dir, 2))


@query("enumerate3", sql_patterns(3) + f" SELECT pattern_id, class, n_vars, {M4}, tp, fp, tn, fn FROM pat")
def enumerate3(spark, sf_dir):
    return _flat(line_patterns(spark, sf_dir, 3))


def _flat(patterns):
    rest = [c for c in patterns.columns if c != "masks"]
    return patterns.select(*rest, *[F.col("masks")[i].alias(f"m{i}") for i in FOUR])


def _lifted(spark, sf_dir):
    cells, layout = line_cube(spark, sf_dir, missing=True)
    cells = cut(cells)
    return cells, layout, cut(lift_patterns(cells, layout))


LIFT = sql_lines(missing=True) + ", " + sql_lift()


@query(
    "pattern_shape",
    LIFT
    + " SELECT pattern_id, "
    + " + ".join(f"(m{i} <> 0)::INT" for i in FOUR)
    + " AS n_vars, ("
    + " + ".join(f"bit_count(m{i})" for i in FOUR)
    + ")::INT AS n_elements, false AS is_empty FROM lift",
)
def pattern_shape(spark, sf_dir):
    _, layout, patterns = _lifted(spark, sf_dir)
    return pt.pattern_shape(patterns, layout).select("pattern_id", "n_vars", "n_elements", "is_empty")


@query(
    "canonical_patterns",
    LIFT
    + ", raw AS (SELECT class, m0 | 7 AS m0, m1, m2, m3 FROM lift UNION ALL SELECT class, m0, m1, 0, 0 FROM lift), "
    "can AS (SELECT class, " + ", ".join(f"CASE WHEN m{i} = 7 THEN 0::BIGINT ELSE m{i} END AS m{i}" for i in FOUR) + " FROM raw) "
    f"SELECT CASE WHEN m0 + m1 + m2 + m3 = 0 THEN 'empty' ELSE {sql_key([f'm{i}' for i in FOUR])} END AS pattern_id, "
    "count(*) AS copies FROM can GROUP BY 1",
)
def canonical_patterns(spark, sf_dir):
    """Raw masks with full and cut-off variables: all-set variables drop out, empty patterns fall together."""
    _, layout, patterns = _lifted(spark, sf_dir)
    raw = patterns.selectExpr("class", "array(masks[0] | 7, masks[1], masks[2], masks[3]) AS masks").unionByName(
        patterns.selectExpr("class", "array(masks[0], masks[1], 0L, 0L) AS masks")
    )
    return pt.canonicalise(raw, layout).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("copies"))


@query("covers", LIFT + f" SELECT r.l_orderkey, r.l_linenumber, q.pattern_id FROM rows_ r JOIN lift q ON {sql_covers()}")
def covers(spark, sf_dir):
    _, layout, patterns = _lifted(spark, sf_dir)
    rows, _ = line_masks(spark, sf_dir, missing=True)
    return cv.covered_pairs(rows, patterns, layout, KEYS)


@query(
    "coverage_bitmaps",
    LIFT + f" SELECT q.pattern_id, count(*) AS n_rows FROM rows_ r JOIN lift q ON {sql_covers()} GROUP BY q.pattern_id",
)
def coverage_bitmaps(spark, sf_dir):
    from tidemark.operators.rowindex import with_row_index

    _, layout, patterns = _lifted(spark, sf_dir)
    rows, _ = line_masks(spark, sf_dir, missing=True)
    maps = cv.coverage_bitmaps(with_row_index(rows, KEYS), patterns, layout, "row_index")
    return cv.bitmap_sizes(maps, ["pattern_id"])


@query("class_bitmaps", LIFT + " SELECT class, count(*) AS n_rows FROM rows_ GROUP BY class")
def class_bitmaps(spark, sf_dir):
    from tidemark.operators.rowindex import with_row_index

    rows, _ = line_masks(spark, sf_dir, missing=True)
    return cv.bitmap_sizes(cv.class_bitmaps(with_row_index(rows, KEYS), "row_index"), ["class"])


LIFT_ROWS = sql_lines(missing=True, keep=", ".join(ROW_KEYS)) + ", " + sql_lift()
SHOW_ROW = " SELECT " + ", ".join(f"r.{k}" for k in ROW_KEYS) + " FROM rows_ r WHERE "


def _hit(cls: str) -> str:
    return f"EXISTS (SELECT 1 FROM lift q WHERE q.class = '{cls}' AND {sql_covers()})"


def _lifted_rows(spark, sf_dir):
    _, layout, patterns = _lifted(spark, sf_dir)
    rows, _ = line_masks(spark, sf_dir, missing=True, keep=ROW_KEYS)
    return rows, layout, patterns.filter("class = 'high'"), patterns.filter("class = 'low'")


@query("union_coverage", LIFT_ROWS + SHOW_ROW + _hit("high"))
def union_coverage(spark, sf_dir):
    rows, layout, high, _ = _lifted_rows(spark, sf_dir)
    return cv.union_coverage(rows, high, layout).select(*ROW_KEYS)


@query("uncovered_of_class", LIFT_ROWS + SHOW_ROW + f"r.class = 'low' AND NOT {_hit('high')}")
def uncovered_of_class(spark, sf_dir):
    rows, layout, high, _ = _lifted_rows(spark, sf_dir)
    return cv.uncovered_of_class(rows, high, layout, "low").select(*ROW_KEYS)


@query("newly_covered", LIFT_ROWS + SHOW_ROW + f"{_hit('low')} AND NOT {_hit('high')}")
def newly_covered(spark, sf_dir):
    rows, layout, high, low = _lifted_rows(spark, sf_dir)
    before, after = (cv.union_coverage(rows, patterns, layout) for patterns in (high, low))
    return cv.newly_covered(before, after, ROW_KEYS)


SET_SQL = {
    "and": "SELECT k FROM a INTERSECT SELECT k FROM b",
    "or": "SELECT k FROM a UNION SELECT k FROM b",
    "xor": "(SELECT k FROM a EXCEPT SELECT k FROM b) UNION (SELECT k FROM b EXCEPT SELECT k FROM a)",
    "and_not": "SELECT k FROM a EXCEPT SELECT k FROM b",
    "not": "SELECT k FROM u EXCEPT SELECT k FROM a",
}
SETS = (
    "WITH u AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), "
    "a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_discount >= 0.05), "
    "b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_tax >= 0.04) "
)


def _sets(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
    return rows.select("k"), rows.filter("l_discount >= 0.05").select("k"), rows.filter("l_tax >= 0.04").select("k")


def _set_query(kind):
    @query(f"set_{kind}", SETS + SET_SQL[kind])
    def run(spark, sf_dir):
        u, a, b = _sets(spark, sf_dir)
        return {
            "and": lambda: cv.set_and(a, b), "or": lambda: cv.set_or(a, b), "xor": lambda: cv.set_xor(a, b),
            "and_not": lambda: cv.set_and_not(a, b), "not": lambda: cv.set_not(u, a),
        }[kind]()


for _kind in SET_SQL:
    _set_query(_kind)


@query("set_next", SETS + "SELECT min(k) AS k FROM a WHERE k >= 1000")
def set_next(spark, sf_dir):
    return cv.next_member(_sets(spark, sf_dir)[1], "k", 1000)


# ---- contingency --------------------------------------------------------------------------------


@query("contingency", LIFT + ", " + sql_contingency() + " SELECT pattern_id, class, tp, fp, tn, fn FROM ctg")
def contingency(spark, sf_dir):
    cells, layout, patterns = _lifted(spark, sf_dir)
    return ct.contingency(cells, patterns, layout).drop("masks")


@query(
    "evaluate",
    LIFT + ", " + sql_contingency()
    + " SELECT pattern_id, round((tp::DOUBLE / (tp + fn) + 1 - CASE WHEN fp + tn = 0 THEN 1 ELSE fp::DOUBLE / (fp + tn) END) / 2, 6) AS o1, "
    "round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS o2 FROM ctg",
)
def evaluate(spark, sf_dir):
    """Objectives straight from uncompressed row masks (the path taken when the cube does not compress)."""
    _, layout, patterns = _lifted(spark, sf_dir)
    rows, _ = line_masks(spark, sf_dir, missing=True, keep=[])
    made = ct.evaluate(fz.as_cells(rows), patterns, layout, ["auc", "confidence"])
    return made.select("pattern_id", r6("o1").alias("o1"), r6("o2").alias("o2"))
