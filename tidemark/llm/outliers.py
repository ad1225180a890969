"""Quality rules (operator 1): base rules, then robust multivariate outliers per language and source.

Location and scatter of transformed statistic vectors are minimum-covariance-determinant estimates with
deterministic starts: from each start, concentration steps (estimate, distances, keep the h closest rows) run
until no determinant falls any more; the start with the smallest determinant wins. All of it is aggregates over a
narrow statistics table; the texts are read once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import hashes, let, table, words
from tidemark.session import cut, cut_plain

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Features and the least standard deviation that each is given: many rates are 0 in almost every text, and a
#: covariance of constants has no inverse. Differences well below these carry no judgement.
FEATURES = {"f_length": 0.06, "f_symbol": 0.04, "f_dup": 0.10, "f_repeat": 0.12, "f_upper": 0.06, "f_again": 0.08}
P = len(FEATURES)
#: Values are rounded to this grid, so that exact percentiles need a bounded number of counters.
GRID = 1024
STARTS = 3
#: Tables of one row per group (some 25 numbers) are broadcast up to this many groups, 10 MB; beyond, they are shuffled.
FEW_GROUPS = 50_000


def _chi2_cdf(x: float, k: int) -> float:
    """Lower regularised gamma function of k / 2 and x / 2, by its series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def _chi2_quantile(q: float, k: int) -> float:
    low, high = 1e-9, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < q else (low, mid)
    return (low + high) / 2


def _repeat_words(ws: Column) -> Column:
    """Words inside 8-word windows that stand twice or more in the text."""

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
                F.get(s, j + 1)["h"] == x["h"], F.lit(False)
            )
            return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

        def length(at: Column) -> Column:
            own = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(own, F.lit(0), lambda a, b: a + b)

        some = let(let(ordered, starts), length)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(some)

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        )

    return F.when(F.size(ws) <= WINDOW, F.lit(0)).otherwise(let(let(hashes(ws), windows), covered))


def _again_words(ws: Column) -> Column:
    """Words that equal the word before them."""
    return F.size(F.filter(ws, lambda x, i: (i > 0) & (x == F.get(ws, i - 1))))


def statistics(docs: DataFrame) -> DataFrame:
    """Base statistics and transformed vector of every row. Needs doc_id, text, lang, source; null text: no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    counted = docs.select(
        "doc_id", F.xxhash64("text").alias("text_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"), _again_words(w).alias("n_again_words"))).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
    ).select(
        "doc_id", "text_id", "lang", "source", F.col("w.n_words").cast("bigint").alias("n_words"),
        F.col("word_chars").cast("bigint"), F.col("n_symbols").cast("bigint"), F.col("l.dup").cast("bigint").alias("n_dup_lines"),
        F.col("w.n_repeat_words").cast("bigint").alias("n_repeat_words"), F.col("w.n_again_words").cast("bigint").alias("n_again_words"), F.col("l.n").alias("n_lines"), "n_upper",
    )
    # Rates of short texts are noisy: each denominator gets some weight of "nothing found".
    share = lambda part, whole, prior: F.sqrt(F.col(part) / (F.col(whole) + prior))
    mean_length = (F.col("word_chars") + 50 * 5.5) / (F.col("n_words") + 50)
    raw = {
        "f_length": F.log(mean_length),
        "f_symbol": share("n_symbols", "word_chars", 50),
        "f_dup": share("n_dup_lines", "n_lines", 10),
        "f_repeat": share("n_repeat_words", "n_words", 50),
        "f_upper": share("n_upper", "word_chars", 200),
        "f_again": share("n_again_words", "n_words", 20),
    }
    return counted.withColumns({k: F.round(v * GRID) / GRID for k, v in raw.items()}).drop("n_lines", "n_upper")


def _sums() -> dict[str, str]:
    """Aggregates of rows from which ``_estimate`` makes a model, as SQL: their number, sums and sums of products."""
    f = list(FEATURES)
    sums = {"n": "count(1)"} | {f"s{i}": f"sum({f[i]})" for i in range(P)}
    return sums | {f"q{i}_{j}": f"sum({f[i]} * {f[j]})" for i in range(P) for j in range(i + 1)}


def _named(sql: dict[str, str]) -> list[str]:
    return [f"{v} AS {k}" for k, v in sql.items()]


def _estimate(sums: DataFrame, *keep: str) -> DataFrame:
    """Mean and Cholesky factor of the covariance of the rows that were summed up, with its log determinant, beside columns to keep.

    One select whose columns refer to those before them: the loops plan it in every step, so it is made and analysed in one call.
    """
    floors = list(FEATURES.values())
    out = {f"m{i}": f"s{i} / n" for i in range(P)}
    cov = {(i, j): f"(q{i}_{j} / n - m{i} * m{j} + {floors[i] ** 2 if i == j else 0.0!r}D)" for i in range(P) for j in range(i + 1)}
    for j in range(P):  # Cholesky, one column after the other
        known = " + ".join(["0D", *(f"l{j}_{k} * l{j}_{k}" for k in range(j))])
        out[f"l{j}_{j}"] = f"sqrt(greatest({cov[j, j]} - ({known}), {floors[j] ** 2 / 2!r}D))"
        for i in range(j + 1, P):
            known = " + ".join(["0D", *(f"l{i}_{k} * l{j}_{k}" for k in range(j))])
            out[f"l{i}_{j}"] = f"({cov[i, j]} - ({known})) / l{j}_{j}"
    out["log_det"] = " + ".join(["0D", *(f"ln(l{j}_{j})" for j in range(P))])
    return sums.selectExpr(*keep, *_named(out)).select(*keep, *_model_columns(), "log_det")


def _model_columns() -> list[str]:
    return [f"m{i}" for i in range(P)] + [f"l{i}_{j}" for i in range(P) for j in range(i + 1)]


def _squared_distance(rows: DataFrame, models: DataFrame, keys: list[str], name: str = "d2") -> DataFrame:
    """Mahalanobis distance of each row to its model, by forward substitution. Where models are too many for a broadcast the
    join shuffles the rows (narrow, no texts), and adaptive execution splits a hot group."""
    y = {}
    for i, f in enumerate(FEATURES):
        done = " + ".join(["0D", *(f"l{i}_{k} * y{k}" for k in range(i))])
        y[f"y{i}"] = f"({f} - m{i} - ({done})) / l{i}_{i}"
    d2 = " + ".join(["0D", *(f"y{i} * y{i}" for i in range(P))])
    joined = rows.join(models, keys)
    left = [c for c in joined.columns if c not in _model_columns()]
    return joined.selectExpr("*", *_named(y), f"{d2} AS {name}").select(*left, name)


def _bin(d2: Column) -> Column:
    """Distances on a logarithmic scale of 32 steps a factor of e: few values, so that percentiles are exact and small."""
    return F.floor(F.log(F.greatest(d2, F.lit(1e-6))) * 32)


def _hint(few: bool) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts tables of one row per group where the groups were counted and are at most ``FEW_GROUPS``."""
    return F.broadcast if few else lambda df: df


def _concentrated(rows: DataFrame, models: DataFrame, keys: list[str], support: float, few: bool) -> DataFrame:
    """The next models: estimates from each group's ``support`` share of rows nearest to its present model, whose log determinant is ``was``.

    The rows are read once and summed up by group and bin of distance; each group's bound, and what lies within, come from its bins.
    """
    before = models.select(*keys, *_model_columns(), F.col("log_det").alias("was"))
    near = _squared_distance(rows, _hint(few)(before), keys)
    bins = near.groupBy(*keys, _bin(F.col("d2")).alias("__bin")).agg(F.expr("max(was) AS was"), *map(F.expr, _named(_sums())))
    bound = F.ceil(F.percentile("__bin", F.lit(support), F.col("n")).over(Window.partitionBy(*keys)))
    inside = bins.withColumn("__bound", bound).where("__bin <= __bound")
    summed = inside.groupBy(*keys).agg(F.expr("max(was) AS was"), *map(F.expr, _named({k: f"sum({k})" for k in _sums()})))
    out = _estimate(summed, *keys, "was")
    return cut_plain(out.repartition(1)) if few else cut(out)


def robust_models(stats: DataFrame, keys: list[str], support: float = 0.75, max_steps: int = 10, few: bool = False) -> DataFrame:
    """One model per group: every start makes two concentration steps, the best of them goes on until no group's log
    determinant falls by more than 1e-6 (``max_steps`` at most).

    Starts: all rows; the half nearest to the medians in median-absolute-deviation units; the half nearest by the
    largest single deviation. ``few``: the groups fit a broadcast.
    """
    hint = _hint(few)
    medians = stats.groupBy(*keys).agg(*[F.percentile(f, F.lit(0.5)).alias(f"med_{f}") for f in FEATURES])
    off = stats.join(hint(medians), keys).withColumns({f"dev_{f}": F.abs(F.col(f) - F.col(f"med_{f}")) for f in FEATURES})
    mads = off.groupBy(*keys).agg(*[F.percentile(f"dev_{f}", F.lit(0.5)).alias(f"mad_{f}") for f in FEATURES])
    unit = [F.col(f"dev_{f}") / F.sqrt((1.4826 * F.col(f"mad_{f}")) ** 2 + floor**2) for f, floor in FEATURES.items()]
    scored = off.join(hint(mads), keys).withColumns(
        {"__euclid": _bin(sum((u * u for u in unit), F.lit(0.0))), "__largest": _bin(F.greatest(*unit))}
    )
    started = cut(scored.select(*keys, *FEATURES, "__euclid", "__largest"))
    halves = started.groupBy(*keys).agg(
        F.percentile("__euclid", F.lit(0.5)).alias("__half_e"), F.percentile("__largest", F.lit(0.5)).alias("__half_l")
    )
    chosen = started.join(hint(halves), keys).select(
        *keys, *FEATURES,
        F.explode(F.filter(
            F.array(F.lit(0), F.when(F.col("__euclid") <= F.col("__half_e"), 1), F.when(F.col("__largest") <= F.col("__half_l"), 2)),
            lambda x: x.isNotNull(),
        )).alias("start"),
    )
    both = [*keys, "start"]
    models = cut(_estimate(chosen.groupBy(*both).agg(*map(F.expr, _named(_sums()))), *both))
    rows = started.select(*keys, *FEATURES)
    tried = rows.withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(STARTS)])))
    for _ in range(2):
        models = _concentrated(tried, models, both, support, few)
    models = models.groupBy(*keys).agg(F.min_by(F.struct(*_model_columns(), "log_det"), F.struct("log_det", "start")).alias("m")).select(*keys, "m.*")
    models = cut(models.coalesce(1) if few else models)
    for _ in range(max_steps):
        models = _concentrated(rows, models, keys, support, few)
        if models.where("log_det < was - 1e-6").isEmpty():
            break
    return models.select(*keys, *_model_columns())


def quality_verdicts(
    docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, min_group: int = 200, support: float = 0.75,
    quantile: float = 1 - 1e-3,
) -> DataFrame:
    """Statistics, distance and verdict of every row of ``docs`` (doc_id, text, lang, source; others are ignored).

    base_failed: fewer than ``min_words`` words, or over ``max_repeat_percent`` percent of the words in repeated
    windows. Other rows are estimated per (lang, source); groups of fewer than ``min_group`` such rows are pooled per
    language, and a language of fewer still goes to one common pool (a pool as small as that judges nobody: distance
    null, kept). A row is rejected if its squared distance, corrected for the ``support`` of the estimate, exceeds the
    chi-square ``quantile`` for 6 degrees of freedom, about 22. Null lang or source counts as ''. Null and empty texts have
    no words and fail the base rules. Repeated rows are judged alike, each for itself. An empty table gives an empty result.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    stats = cut(statistics(docs).withColumn("base_failed", failed))
    sizes = stats.where("NOT base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("__n"))
    small = F.when(F.col("__n") < min_group, F.col("__n")).otherwise(0)
    rest = F.sum(small).over(Window.partitionBy("lang"))  # one row per source
    own = F.col("__n") >= min_group
    # A pool is named by "*" where a group has "=" and the value.
    lang = F.when(own | (rest >= min_group), F.concat(F.lit("="), "lang")).otherwise("*")
    groups = cut(sizes.select("lang", "source", "__n", F.concat_ws("\x00", lang, F.when(own, F.concat(F.lit("="), "source")).otherwise("*")).alias("grp")))
    few = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    pools = groups.groupBy("grp").agg((F.sum("__n") >= min(min_group, 30)).alias("__enough"))
    named = cut(groups.join(pools, "grp").select("lang", "source", "grp", "__enough"))
    judged = stats.where("NOT base_failed").join(_hint(few)(named), ["lang", "source"])
    models = robust_models(judged.where("__enough").select("grp", *FEATURES), ["grp"], support, few=few)
    inner = _chi2_quantile(support, P)
    consistency = support / _chi2_cdf(inner, P + 2)
    measured = _squared_distance(judged.where("__enough"), _hint(few)(models), ["grp"], "__d2").withColumn(
        "distance2", F.col("__d2") / consistency
    )
    unjudged = judged.where("NOT __enough").withColumn("distance2", F.lit(None).cast("double"))
    rest = stats.where("base_failed").withColumn("distance2", F.lit(None).cast("double"))
    out = [*stats.columns, "distance2"]
    verdict = ~F.col("base_failed") & (F.col("distance2").isNull() | (F.col("distance2") <= _chi2_quantile(quantile, P)))
    return (
        measured.select(*out).unionByName(unjudged.select(*out)).unionByName(rest.select(*out)).withColumn("kept", verdict)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(table(spark, sf_dir, "documents"))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_again_words", "base_failed", "kept",
        F.round("distance2", 6).alias("distance2"), *[F.col(f) for f in FEATURES],
    )
