"""Profiling: numeric bounds, nominal domains, and the variable list built from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rowindex import with_row_index

BITS = 63  # values per BIGINT mask word, sign bit left alone
LISTED = 4096  # widest domain that ``profile`` writes out as one string


def numeric_bounds(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per column with its bounds and non-missing count. NaN counts as missing."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.min(v).alias(f"__lo{i}"), F.max(v).alias(f"__hi{i}"), F.count(v).alias(f"__c{i}")]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("var"),
                F.lit(c).alias("name"),
                F.col(f"__lo{i}").alias("min"),
                F.col(f"__hi{i}").alias("max"),
                F.col(f"__c{i}").alias("n_present"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(*by, F.col("__n").alias("n_rows"), F.explode(rows).alias("r")).select(*by, "n_rows", "r.*")


def nominal_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value, n): the distinct values of each column, counted with map-side combine."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p"))
        .filter(F.col("p.value").isNotNull())
        .groupBy(F.col("p.name").alias("name"), F.col("p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def check_domain_sizes(values: DataFrame, max_domain: int) -> dict[str, int]:
    """Domain size per column; raises rather than dropping values when a column is wider than the caller allows."""
    sizes = {r["name"]: r["size"] for r in values.groupBy("name").agg(F.count(F.lit(1)).alias("size")).collect()}
    wide = {c: n for c, n in sizes.items() if n > max_domain}
    if wide:
        raise ValueError(f"domain too wide for pattern mining (limit {max_domain}): {wide}")
    return sizes


def domain_table(values: DataFrame) -> DataFrame:
    """(name, value, idx, n) with idx the position in sorted order.

    Values are numbered by one range sort over all columns, so a key-like column is spread over tasks like any other.
    """
    numbered = with_row_index(values.select("name", "value", "n"), ["name", "value"], "__place")
    first = numbered.groupBy("name").agg(F.min("__place").alias("__first"))  # one row per column
    idx = (F.col("__place") - F.col("__first")).alias("idx")
    return numbered.join(F.broadcast(first), "name").select("name", "value", idx, "n")


def profile(df: DataFrame, numeric: Sequence[str], nominal: Sequence[str]) -> DataFrame:
    """One row per column: kind, row count, bounds or domain (sorted, missing left out).

    Columns of any width are counted; a domain of more than ``LISTED`` values is not written out as one string
    (null); ``domain_table`` has its rows, numbered, whatever their number.
    """
    empty = F.lit(None)
    parts = []
    if numeric:
        parts.append(
            numeric_bounds(df, numeric).select(
                "name", F.lit("numeric").alias("kind"), "n_present", "min", "max",
                empty.cast("bigint").alias("n_values"), empty.cast("string").alias("domain"),
            )
        )
    if nominal:
        values = nominal_values(df, nominal)
        sizes = values.groupBy("name").agg(F.sum("n").alias("n_present"), F.count(F.lit(1)).alias("n_values"))
        listed = (
            values.join(F.broadcast(sizes.filter(F.col("n_values") <= LISTED).select("name")), "name")  # one row per column
            .groupBy("name").agg(F.sort_array(F.collect_list("value")).alias("v"))
        )
        parts.append(
            sizes.join(listed, "name", "left")
            .select(
                "name", F.lit("nominal").alias("kind"), "n_present",
                empty.cast("double").alias("min"), empty.cast("double").alias("max"),
                "n_values", F.array_join("v", "|").alias("domain"),
            )
        )
    out = parts[0]
    for extra in parts[1:]:
        out = out.unionByName(extra)
    return out


def profile_declared(df: DataFrame, numeric: Sequence[str], declared: dict[str, Sequence[str]]) -> DataFrame:
    """As ``profile`` with domains taken from a header: order kept, values never seen kept with count 0."""
    spark = df.sparkSession
    header = spark.createDataFrame(
        [(c, v, i) for c, values in declared.items() for i, v in enumerate(values)], "name string, value string, idx int"
    )
    seen = nominal_values(df, list(declared))
    nominal = (
        header.join(seen, ["name", "value"], "left")
        .groupBy("name")
        .agg(
            F.sum(F.coalesce("n", F.lit(0))).alias("n_present"),
            F.count(F.lit(1)).alias("n_values"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]), "|").alias("domain"),
        )
        .select("name", F.lit("nominal").alias("kind"), "n_present", F.lit(None).cast("double").alias("min"),
                F.lit(None).cast("double").alias("max"), "n_values", "domain")
    )
    stats = numeric_bounds(df, numeric).select(
        "name", F.lit("numeric").alias("kind"), "n_present", "min", "max",
        F.lit(None).cast("bigint").alias("n_values"), F.lit(None).cast("string").alias("domain"),
    )
    return stats.unionByName(nominal)


def widen_bounds(current: DataFrame, batch: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Extend the known bounds where a batch falls outside them; new columns are taken over as they are."""
    b = batch.select(*keys, F.col("min").alias("batch_min"), F.col("max").alias("batch_max"))
    joined = current.select(*keys, "min", "max").join(b, list(keys), "full")
    lo, hi = F.least("min", "batch_min"), F.greatest("max", "batch_max")
    return joined.select(
        *keys,
        lo.alias("min"),
        hi.alias("max"),
        (F.coalesce(F.col("batch_min") < F.col("min"), F.lit(False)) | F.coalesce(F.col("batch_max") > F.col("max"), F.lit(False))).alias("changed"),
    )


def active_classes(df: DataFrame, class_col: str) -> DataFrame:
    return (
        df.filter(F.col(class_col).isNotNull())
        .groupBy(F.col(class_col).alias("class"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@dataclass(frozen=True)
class Variable:
    """A column patterns may speak about: a fuzzy partition when numeric, a value list when nominal."""

    name: str
    labels: tuple[tuple[float, float, float], ...] = ()
    domain: tuple[str, ...] = ()

    @property
    def nominal(self) -> bool:
        return not self.labels

    @property
    def width(self) -> int:
        return len(self.domain) if self.nominal else len(self.labels)

    def value_name(self, j: int) -> str:
        return self.domain[j] if self.nominal else f"L{j}"


@dataclass(frozen=True)
class Layout:
    """Where each variable's values live: consecutive BIGINT words, 63 values each."""

    variables: tuple[Variable, ...]
    word_var: tuple[int, ...] = field(default=())
    word_low: tuple[int, ...] = field(default=())

    @staticmethod
    def of(variables: Sequence[Variable]) -> Layout:
        owners, lows = [], []
        for v, variable in enumerate(variables):
            for low in range(0, variable.width, BITS):
                owners.append(v)
                lows.append(low)
        return Layout(tuple(variables), tuple(owners), tuple(lows))

    @property
    def words(self) -> list[str]:
        return [f"w{i}" for i in range(len(self.word_var))]

    def words_of(self, v: int) -> list[int]:
        return [i for i, owner in enumerate(self.word_var) if owner == v]

    def word_width(self, i: int) -> int:
        return min(BITS, self.variables[self.word_var[i]].width - self.word_low[i])

    def full_mask(self, i: int) -> int:
        return (1 << self.word_width(i)) - 1

    @property
    def offsets(self) -> list[int]:
        """First flat selector number of each variable."""
        out, total = [], 0
        for variable in self.variables:
            out.append(total)
            total += variable.width
        return out

    def word_offset(self, i: int) -> int:
        return self.offsets[self.word_var[i]] + self.word_low[i]
