"""Fuzzification: triangular partitions, label masks per row, and the compressed cube."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import membership
from tidemark.functions.sqltext import all_of, case, long, name, num, text
from tidemark.operators.profile import (
    Layout, Variable, check_domain_sizes, domain_table, nominal_values, numeric_bounds,
)

SNAP = 1e-4
TIE = 1e-11
CASE_LIMIT = 63  # widest domain written as one CASE; wider ones join their (size-checked) value table


def partition_table(bounds: DataFrame, labels: int = 3) -> DataFrame:
    """(var, name, label, a, b, c): evenly spaced triangles over each row's [min, max].

    Feet and centres within 1e-4 of zero or of the maximum snap to it; the two outer feet never do.
    """
    if labels < 2:
        raise ValueError("a partition needs at least two labels")
    j = F.col("label").cast("double")
    step = (F.col("max") - F.col("min")) / F.lit(float(labels - 1))

    def snapped(v: Column) -> Column:
        top = F.col("max")
        return (
            F.when((v > -SNAP) & (v < SNAP), F.lit(0.0))
            .when((v > top - SNAP) & (v < top + SNAP), top)
            .otherwise(v)
        )

    return (
        bounds.select("var", "name", "min", "max", F.explode(F.sequence(F.lit(0), F.lit(labels - 1))).alias("label"))
        .withColumn("step", step)
        .select(
            "var",
            "name",
            "label",
            F.when(F.col("label") == 0, F.col("min") - F.col("step"))
            .otherwise(snapped(F.col("min") + F.col("step") * (j - 1))).alias("a"),
            snapped(F.col("min") + F.col("step") * j).alias("b"),
            F.when(F.col("label") == labels - 1, F.col("max") + F.col("step"))
            .otherwise(snapped(F.col("min") + F.col("step") * (j + 1))).alias("c"),
        )
    )


def fit(
    df: DataFrame, numeric: Sequence[str], nominal: Sequence[str] = (), labels: int = 3, max_domain: int | None = None
) -> Layout:
    """Learn the variables of a table. Only column bounds and the domains of nominal columns reach the driver.

    ``max_domain`` makes a wider nominal column an error; None takes domains of any size. A numeric column without any
    value gets one label, which all its rows carry.
    """
    variables = fit_numeric(numeric_bounds(df, numeric), labels) if numeric else []
    if nominal:
        values = nominal_values(df, nominal).persist()
        if max_domain is not None:
            check_domain_sizes(values, max_domain)
        found: dict[str, list[str]] = {c: [] for c in nominal}
        for r in domain_table(values).orderBy("name", "idx").collect():
            found[r["name"]].append(r["value"])
        values.unpersist()
        variables += [Variable(c, domain=tuple(found[c])) for c in nominal]
    return Layout.of(variables)


def fit_numeric(bounds: DataFrame, labels: int) -> list[Variable]:
    feet: dict[int, list] = {}
    names: dict[int, str] = {}
    for r in partition_table(bounds, labels).orderBy("var", "label").collect():
        names[r["var"]] = r["name"]
        if r["b"] is None:  # no value in the whole column
            feet[r["var"]] = [(0.0, 0.0, 0.0)]
        else:
            feet.setdefault(r["var"], []).append((r["a"], r["b"], r["c"]))
    return [Variable(names[v], labels=tuple(feet[v])) for v in sorted(feet)]


def degrees(x: str, variable: Variable) -> list[str]:
    return [membership.triangle(x, a, b, c) for a, b, c in variable.labels]


def _degree(x: float, feet: tuple[float, float, float]) -> float:
    """One triangle at one number, in the same operations the generated expressions use."""
    a, b, c = feet
    if x < a or x > c:
        return 0.0
    if x == b:
        return 1.0
    return (x - a) / (b - a) if x < b else 1.0 - (x - b) / (c - b)


def thresholds(variable: Variable) -> list[float] | None:
    """Largest value still belonging to label j, for every label but the last; None if the triangles are irregular.

    Between two centres only their two triangles reach, one falling and one rising, so "label j is at
    least as true" switches once. Bisecting down to neighbouring doubles finds that switch exactly.
    """
    feet = variable.labels
    for (_, b0, c0), (a1, b1, _) in zip(feet, feet[1:]):
        if not (b0 < b1 and c0 == b1 and a1 == b0):
            return None
    found = []
    for left, right in zip(feet, feet[1:]):
        low, high = left[1], right[1]
        while True:
            middle = low + (high - low) / 2
            if middle in (low, high):
                break
            if _degree(middle, left) >= _degree(middle, right):
                low = middle
            else:
                high = middle
        found.append(low)
    return found


def by_label(x: str, variable: Variable, results: Sequence[str]) -> str:
    """``results[j]`` for the first label j with the largest degree; label 0 when no triangle reaches the value."""
    steps = thresholds(variable)
    if steps is not None:
        last = variable.labels[-1][2]
        inside = [(f"{x} <= {num(t)}", r) for t, r in zip(steps, results)]
        return case([*inside, (f"{x} > {num(last)}", results[0])], results[-1])
    d = degrees(x, variable)
    branches = [(all_of(f"{d[j]} >= {later}" for later in d[j + 1 :]), results[j]) for j in range(len(d) - 1)]
    return case(branches, results[-1])


def label_argmax(x: str, variable: Variable) -> str:
    return by_label(x, variable, [str(j) for j in range(variable.width)])


def label_mask_tied(x: str, variable: Variable) -> str:
    """Mask of every label whose degree is within 1e-11 of the largest one."""
    d = degrees(x, variable)
    top = f"greatest({', '.join(d)})" if len(d) > 1 else d[0]
    return "(" + " | ".join(case([(f"{degree} >= {top} - {num(TIE)}", long(1 << j))], "0L") for j, degree in enumerate(d)) + ")"


def nominal_index(x: str, domain: Sequence[str]) -> str:
    """Position in the domain, null for a value outside it."""
    return case([(f"{x} = {text(value)}", str(j)) for j, value in enumerate(domain)])


def _with_position(df: DataFrame, variable: Variable, position: str) -> DataFrame:
    """Bring the domain position of a wide nominal column in by an equi-join with its value table."""
    rows = [(value, j) for j, value in enumerate(variable.domain)]
    table = df.sparkSession.createDataFrame(rows, f"__value string, `{position}` int")
    # The domain is part of the layout, held by the driver already; beyond a million values the join shuffles.
    return df.join(F.broadcast(table) if len(rows) <= 1_000_000 else table, df[variable.name].cast("string") == F.col("__value"), "left").drop("__value")


def selectors(
    df: DataFrame, layout: Layout, class_col: str, keep: Sequence[str] = (), ties: str = "first"
) -> DataFrame:
    """Row masks: one BIGINT word column per layout word plus ``class``; rows without a class are left out.

    A missing value is covered by every selector of its variable. ``ties="all"`` sets all tied labels.
    """
    rows = df.filter(F.col(class_col).isNotNull())
    words: list[str] = []
    for v, variable in enumerate(layout.variables):
        at = layout.words_of(v)
        column = name(variable.name)
        if not variable.nominal:
            value = f"double({column})"
            mask = label_mask_tied(value, variable) if ties == "all" else by_label(value, variable, [long(1 << j) for j in range(variable.width)])
            missing = f"{column} IS NULL OR isnan({value})"
            words.append(case([(missing, long(layout.full_mask(at[0])))], mask) + f" AS w{at[0]}")
            continue
        if variable.width <= CASE_LIMIT:
            position = nominal_index(f"string({column})", variable.domain)
        else:
            rows = _with_position(rows, variable, f"__pos{v}")
            position = f"__pos{v}"
        for i in at:
            low, high = layout.word_low[i], layout.word_low[i] + layout.word_width(i) - 1
            here = f"{position} BETWEEN {low} AND {high}"
            words.append(
                case([(f"{column} IS NULL", long(layout.full_mask(i))), (here, f"shiftleft(1L, {position} - {low})")], "0L")
                + f" AS w{i}"
            )
    kept = [name(c) for c in keep]
    return rows.selectExpr(*kept, *words, f"string({name(class_col)}) AS class")


def compressed_cube(rows: DataFrame, layout: Layout, by: Sequence[str] = ()) -> DataFrame:
    """Distinct mask combinations with their row count; combined map-side, so hot cells cost nothing extra."""
    return rows.groupBy(*by, *layout.words, "class").agg(F.count(F.lit(1)).alias("n"))


def as_cells(rows: DataFrame) -> DataFrame:
    """Uncompressed rows in the shape of a cube (every row counts once).

    For tables whose masks hardly repeat; otherwise the cube is the cheaper first step of the same job.
    """
    return rows.withColumn("n", F.lit(1).cast("bigint"))


def selectors_of(layout: Layout, words: Sequence[str]) -> str:
    """Flat selector numbers set in a list of mask words, as an array."""
    parts = []
    for i, word in enumerate(words):
        base = layout.word_offset(i)
        one = f"array(bit_count({word} - 1L) + {base})"
        bits = f"sequence(0, {layout.word_width(i) - 1})"
        many = f"transform(filter({bits}, b -> getbit({word}, b) = 1), b -> b + {base})"
        parts.append(case([(f"bit_count({word}) = 1", one)], many))
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def selector_names(spark, layout: Layout) -> DataFrame:
    """(sel, var, value, name, value_name): one row per selector, as many as the layout is wide."""
    rows = [
        (layout.offsets[v] + j, v, j, variable.name, variable.value_name(j))
        for v, variable in enumerate(layout.variables)
        for j in range(variable.width)
    ]
    return spark.createDataFrame(rows, "sel int, var int, value int, name string, value_name string")


def split_selector(layout: Layout, sel: str = "sel") -> tuple[str, str]:
    """(variable number, value number) of a flat selector."""
    starts = list(enumerate(layout.offsets))[::-1]
    var = case([(f"{sel} >= {offset}", str(v)) for v, offset in starts])
    value = case([(f"{sel} >= {offset}", f"{sel} - {offset}") for _, offset in starts])
    return var, value


def selector_counts(cells: DataFrame, layout: Layout) -> DataFrame:
    """(var, value, class, n): how many rows each selector covers per class."""
    var, value = split_selector(layout)
    return (
        cells.selectExpr(f"explode({selectors_of(layout, layout.words)}) AS sel", "class", "n")
        .groupBy("sel", "class")
        .agg(F.sum("n").alias("n"))
        .selectExpr(f"{var} AS var", f"{value} AS value", "class", "n")
    )


def selectors_covering(rows: DataFrame, layout: Layout, keys: Sequence[str]) -> DataFrame:
    """(keys, var, value) for every selector that covers the given rows."""
    var, value = split_selector(layout)
    return rows.selectExpr(*keys, f"explode({selectors_of(layout, layout.words)}) AS sel").selectExpr(
        *keys, f"{var} AS var", f"{value} AS value"
    )


def fuzzify(df: DataFrame, terms: Sequence[tuple[str, str, str, Sequence]], keep: Sequence[str] = ()) -> DataFrame:
    """One degree column ``<column>_<term>`` per (column, term, family, parameters)."""
    made = [
        f"{membership.degree(f'double({name(c)})', family, params)} AS {name(f'{c}_{term}')}" for c, term, family, params in terms
    ]
    return df.selectExpr(*[name(c) for c in keep], *made)


def fuzzy_histogram(df: DataFrame, terms: Sequence[tuple[str, str, str, Sequence]], by: Sequence[str]) -> DataFrame:
    """Sum and mean of every degree per group, in long form; aggregated wide first so nothing is exploded per row."""
    wide = fuzzify(df, terms, keep=by)
    aggs = []
    for i, (c, term, _, _) in enumerate(terms):
        aggs += [F.sum(f"{c}_{term}").alias(f"__s{i}"), F.avg(f"{c}_{term}").alias(f"__m{i}")]
    grouped = wide.groupBy(*by).agg(*aggs)
    items = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"), F.lit(term).alias("term"),
                F.col(f"__s{i}").alias("sum_degree"), F.col(f"__m{i}").alias("mean_degree"),
            )
            for i, (c, term, _, _) in enumerate(terms)
        ]
    )
    return grouped.select(*by, F.explode(items).alias("t")).select(*by, "t.*")
