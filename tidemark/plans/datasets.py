"""The mining tables the queries run on, in Spark and as SQL text, and pattern sets derived from them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.sqltext import array
from tidemark.operators import fuzzify as fz
from tidemark.operators.contingency import class_totals, enumerate_patterns
from tidemark.operators.patterns import canonicalise, non_empty
from tidemark.operators.profile import Layout
from tidemark.plans.registry import load
from tidemark.session import cut

LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber"]
ROW_KEYS = [*KEYS, "l_partkey", "l_suppkey"]  # unique, a total order
PRICE_SPLIT = 50000
LABELS = 3


def line_rows(spark: SparkSession, sf_dir: str, missing: bool = False) -> DataFrame:
    """lineitem with a price-band class; optionally with every 17th order's quantity missing."""
    rows = load(spark, sf_dir, "lineitem").withColumn(
        "cls", F.when(F.col("l_extendedprice") >= PRICE_SPLIT, "high").otherwise("low")
    )
    if missing:
        rows = rows.withColumn("l_quantity", F.when(F.col("l_orderkey") % 17 != 0, F.col("l_quantity")))
    return rows


def line_masks(spark, sf_dir, missing=False, keep=KEYS, ties="first") -> tuple[DataFrame, Layout]:
    rows = line_rows(spark, sf_dir, missing)
    layout = fz.fit(rows, LINE_NUMERIC, labels=LABELS)
    return fz.selectors(rows, layout, "cls", keep=keep, ties=ties), layout


def line_cube(spark, sf_dir, missing=False) -> tuple[DataFrame, Layout]:
    masks, layout = line_masks(spark, sf_dir, missing, keep=[])
    return fz.compressed_cube(masks, layout), layout


def line_patterns(spark, sf_dir, max_vars=2) -> DataFrame:
    """Every single-value pattern over at most two columns, with counts."""
    cube, layout = line_cube(spark, sf_dir)
    return enumerate_patterns(cut(cube), layout, max_vars)


def lift_patterns(cells: DataFrame, layout: Layout) -> DataFrame:
    """Patterns with several values per column: the labels each class is over-represented in, one or two columns at a time."""
    counts = fz.selector_counts(cells, layout)
    totals = class_totals(cells)
    by_value = counts.groupBy("var", "value").agg(F.sum("n").alias("all_n"))
    strong = (
        counts.join(by_value, ["var", "value"])
        .join(totals, "class")
        .filter(F.col("n") * F.col("total") > F.col("positives") * F.col("all_n"))
    )
    masks = strong.groupBy("class").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("var") == v, F.expr("shiftleft(1L, value)"))), F.lit(0)).alias(f"m{v}")
            for v in range(len(layout.variables))
        ]
    )
    n = len(layout.variables)
    choices = [c for size in (1, 2) for c in combinations(range(n), size)]
    shapes = array(array(f"m{v}" if v in c else "0L" for v in range(n)) for c in choices)
    found = masks.select("class", F.explode(F.expr(shapes)).alias("masks"))
    return non_empty(canonicalise(found, layout)).dropDuplicates(["pattern_id"]).select("pattern_id", "class", "masks")


def listed(patterns: DataFrame) -> DataFrame:
    """Pattern list with positions: by class, then id. The sets here are a few hundred rows at most."""
    return patterns.withColumn("pos", (F.row_number().over(Window.orderBy("class", "pattern_id")) - 1).cast("bigint"))


# ---- the same, as SQL ---------------------------------------------------------------------------


def sql_line(missing: bool = False) -> str:
    quantity = "CASE WHEN l_orderkey % 17 <> 0 THEN l_quantity END" if missing else "l_quantity"
    return (
        f"src AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, {quantity} AS l_quantity, l_extendedprice, "
        f"l_discount, l_tax, CASE WHEN l_extendedprice >= {PRICE_SPLIT} THEN 'high' ELSE 'low' END AS cls FROM lineitem)"
    )


def sql_feet(columns, labels: int = LABELS, source: str = "src") -> str:
    """CTEs b (bounds) and p (one row: feet c<i>_a<j>, c<i>_b<j>, c<i>_c<j> of every label)."""
    bounds = ", ".join(f"min({c})::DOUBLE AS lo{i}, max({c})::DOUBLE AS hi{i}" for i, c in enumerate(columns))
    steps = ", ".join(f"lo{i}, hi{i}, (hi{i} - lo{i}) / {float(labels - 1)}::DOUBLE AS s{i}" for i in range(len(columns)))
    feet = []
    for i in range(len(columns)):
        def snapped(k):
            v = f"(lo{i} + s{i} * ({float(k)}::DOUBLE))"
            return (
                f"CASE WHEN {v} > -0.0001::DOUBLE AND {v} < 0.0001::DOUBLE THEN 0.0::DOUBLE "
                f"WHEN {v} > hi{i} - 0.0001::DOUBLE AND {v} < hi{i} + 0.0001::DOUBLE THEN hi{i} ELSE {v} END"
            )
        for j in range(labels):
            left = f"lo{i} - s{i}" if j == 0 else snapped(j - 1)
            right = f"hi{i} + s{i}" if j == labels - 1 else snapped(j + 1)
            feet.append(f"{left} AS c{i}_a{j}, {snapped(j)} AS c{i}_b{j}, {right} AS c{i}_c{j}")
    return (
        f"b0 AS (SELECT {bounds} FROM {source}), b AS (SELECT {steps} FROM b0), p AS (SELECT {', '.join(feet)} FROM b)"
    )


def sql_degree(x: str, i: int, j: int) -> str:
    a, b, c = (f"c{i}_{k}{j}" for k in "abc")
    return (
        f"(CASE WHEN {x} < {a} OR {x} > {c} THEN 0.0::DOUBLE WHEN {x} = {b} THEN 1.0::DOUBLE "
        f"WHEN {x} < {b} THEN ({x} - {a}) / ({b} - {a}) ELSE 1.0::DOUBLE - ({x} - {b}) / ({c} - {b}) END)"
    )


def sql_labels(columns, keep: str, cls: str = "cls", labels: int = LABELS, source: str = "src") -> str:
    """CTEs d (degrees), lab (labels g<i>, -1 when missing) and rows_ (words w<i>)."""
    n = len(columns)
    degrees = ", ".join(f"{sql_degree(c, i, j)} AS d{i}_{j}" for i, c in enumerate(columns) for j in range(labels))
    values = ", ".join(f"{c} AS x{i}" for i, c in enumerate(columns))

    def label(i):
        tests = [f"WHEN x{i} IS NULL THEN -1"]
        for j in range(labels - 1):
            tests.append("WHEN " + " AND ".join(f"d{i}_{j} >= d{i}_{k}" for k in range(j + 1, labels)) + f" THEN {j}")
        return f"CASE {' '.join(tests)} ELSE {labels - 1} END AS g{i}"

    full = (1 << labels) - 1
    words = ", ".join(f"CASE WHEN g{i} = -1 THEN {full}::BIGINT ELSE (1::BIGINT << g{i}) END AS w{i}" for i in range(n))
    keep = keep + ", " if keep else ""
    return (
        f"d AS (SELECT {keep}{cls} AS class, {values}, {degrees} FROM {source}, p), "
        f"lab AS (SELECT *, {', '.join(label(i) for i in range(n))} FROM d), "
        f"rows_ AS (SELECT *, {words} FROM lab), "
        f"cells AS (SELECT {', '.join(f'w{i}' for i in range(n))}, class, count(*) AS n FROM rows_ GROUP BY ALL)"
    )


def sql_lines(missing: bool = False, keep: str = "l_orderkey, l_linenumber") -> str:
    return "WITH " + ", ".join([sql_line(missing), sql_feet(LINE_NUMERIC), sql_labels(LINE_NUMERIC, keep)])


def sql_key(masks, cls: str = "class") -> str:
    return f"{cls} || ':' || " + " || '.' || ".join(f"CAST({m} AS VARCHAR)" for m in masks)


def sql_enumerated(n: int = len(LINE_NUMERIC), max_vars: int = 2) -> str:
    """CTE pat: single-value patterns with counts (no missing values assumed)."""
    singles = []
    for size in range(1, max_vars + 1):
        for choice in combinations(range(n), size):
            masks = ", ".join(f"w{i} AS m{i}" if i in choice else f"0::BIGINT AS m{i}" for i in range(n))
            group = ", ".join(f"w{i}" for i in choice)
            singles.append(f"SELECT {masks}, {size} AS n_vars, class, sum(n)::BIGINT AS hits FROM cells GROUP BY {group}, class")
    masks = ", ".join(f"m{i}" for i in range(n))
    return (
        f"hit AS ({' UNION ALL '.join(singles)}), "
        "tot AS (SELECT class, sum(n)::BIGINT AS positives, (SELECT sum(n)::BIGINT FROM cells) AS total FROM cells GROUP BY class), "
        f"cov AS (SELECT {masks}, sum(hits)::BIGINT AS covered FROM hit GROUP BY {masks}), "
        f"pat AS (SELECT {sql_key([f'hit.m{i}' for i in range(n)], 'hit.class')} AS pattern_id, hit.class AS class, "
        + ", ".join(f"hit.m{i} AS m{i}" for i in range(n))
        + ", n_vars, hits AS tp, covered - hits AS fp, total - positives - (covered - hits) AS tn, positives - hits AS fn "
        "FROM hit JOIN tot ON hit.class = tot.class JOIN cov ON "
        + " AND ".join(f"hit.m{i} = cov.m{i}" for i in range(n))
        + ")"
    )


def sql_patterns(max_vars: int = 2) -> str:
    return sql_lines(keep="") + ", " + sql_enumerated(max_vars=max_vars)


def sql_lift(n: int = len(LINE_NUMERIC), labels: int = LABELS) -> str:
    """CTE lift(pattern_id, class, m0..): the patterns of ``lift_patterns``."""
    selectors = " UNION ALL ".join(
        f"SELECT {i} AS var, {j} AS value, class, sum(n)::BIGINT AS n FROM cells WHERE (w{i} & {1 << j}) <> 0 GROUP BY class"
        for i in range(n)
        for j in range(labels)
    )
    masks = ", ".join(f"coalesce(sum(CASE WHEN var = {v} THEN (1::BIGINT << value) END), 0)::BIGINT AS m{v}" for v in range(n))
    choices = [c for size in (1, 2) for c in combinations(range(n), size)]
    shapes = " UNION ALL ".join(
        "SELECT class, " + ", ".join(f"m{v}" if v in c else f"0::BIGINT AS m{v}" for v in range(n)) + " FROM strong" for c in choices
    )
    full = (1 << labels) - 1
    canon = ", ".join(f"CASE WHEN m{v} = {full} THEN 0::BIGINT ELSE m{v} END AS m{v}" for v in range(n))
    return (
        f"sc AS ({selectors}), "
        "ct AS (SELECT class, sum(n)::BIGINT AS positives, (SELECT sum(n)::BIGINT FROM cells) AS total FROM cells GROUP BY class), "
        "av AS (SELECT var, value, sum(n)::BIGINT AS all_n FROM sc GROUP BY var, value), "
        f"strong AS (SELECT sc.class AS class, {masks} FROM sc JOIN av USING (var, value) JOIN ct ON sc.class = ct.class "
        "WHERE sc.n * total > positives * all_n GROUP BY sc.class), "
        f"shapes AS ({shapes}), canon AS (SELECT class, {canon} FROM shapes), "
        f"lift AS (SELECT DISTINCT {sql_key([f'm{v}' for v in range(n)])} AS pattern_id, class, {', '.join(f'm{v}' for v in range(n))} "
        f"FROM canon WHERE {' + '.join(f'm{v}' for v in range(n))} > 0)"
    )


def sql_covers(row: str = "r", pattern: str = "q", n: int = len(LINE_NUMERIC)) -> str:
    tests = [f"({pattern}.m{i} = 0 OR ({row}.w{i} & {pattern}.m{i}) <> 0)" for i in range(n)]
    some = " OR ".join(f"{pattern}.m{i} <> 0" for i in range(n))
    return f"({some}) AND " + " AND ".join(tests)


def sql_contingency(patterns: str = "lift") -> str:
    """CTE ctg(pattern_id, class, tp, fp, tn, fn) of a pattern CTE over cells."""
    return (
        "cc AS (SELECT q.pattern_id, sum(r.n)::BIGINT AS covered, sum(CASE WHEN r.class = q.class THEN r.n ELSE 0 END)::BIGINT AS hits "
        f"FROM {patterns} q JOIN cells r ON {sql_covers()} GROUP BY q.pattern_id), "
        "cp AS (SELECT class, sum(n)::BIGINT AS positives, (SELECT sum(n)::BIGINT FROM cells) AS total FROM cells GROUP BY class), "
        "ctg AS (SELECT q.pattern_id, q.class, coalesce(hits, 0) AS tp, coalesce(covered, 0) - coalesce(hits, 0) AS fp, "
        "total - positives - (coalesce(covered, 0) - coalesce(hits, 0)) AS tn, positives - coalesce(hits, 0) AS fn "
        f"FROM {patterns} q LEFT JOIN cc ON q.pattern_id = cc.pattern_id JOIN cp ON q.class = cp.class)"
    )
