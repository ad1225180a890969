import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import measures as qm

ZERO_TABLES = [(0, 0, 0, 0), (0, 0, 5, 5), (5, 0, 0, 0), (0, 5, 0, 0), (5, 0, 5, 0), (3, 3, 0, 0), (1, 2, 3, 4)]


def plain(name, tp, fp, tn, fn):
    """The formulas once more, in plain Python."""
    n = tp + fp + tn + fn
    tpr = tp / (tp + fn) if tp + fn else 0.0
    fpr = fp / (fp + tn) if fp + tn else 1.0
    tnr = tn / (fp + tn) if fp + tn else 0.0
    conf = tp / (tp + fp) if tp + fp else 0.0
    cov = (tp + fp) / n if n else 0.0
    prior = (tp + fn) / n if n else 0.0
    growth = tpr / fpr if fpr else (math.inf if tpr else 0.0)
    wracc = cov * (conf - prior)
    reach = prior * (1 - prior)
    return {
        "auc": (1 + tpr - fpr) / 2,
        "accuracy": (tp + tn) / n if n else 0.0,
        "confidence": conf,
        "coverage": cov,
        "fpr": fpr,
        "g_mean": math.sqrt(tpr * tnr),
        "growth_rate": growth,
        "is_growth_rate": 1.0 if growth > 1 else 0.0,
        "jaccard": tp / (tp + fn + fp) if tp + fn + fp else 0.0,
        "supp_diff": tpr - fpr,
        "support": tp / n if n else 0.0,
        "tnr": tnr,
        "tpr": tpr,
        "wracc": wracc,
        "wracc_norm": (wracc + reach) / (2 * reach) if reach else 0.0,
        "odds_ratio": tp * tn / (fp * fn) if fp * fn else 0.0,
        "inverse_fpr": 1 - fpr,
    }[name]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ZERO_TABLES, "tp long, fp long, tn long, fn long")


def test_every_measure_on_the_zero_tables(table):
    names = [m for m in qm.MEASURES if m != "f_score"]
    for r in qm.with_measures(table, names).collect():
        for m in names:
            assert r[m] == pytest.approx(plain(m, r.tp, r.fp, r.tn, r.fn), abs=1e-12), (m, r)


def test_reported_measures_are_fifteen():
    assert len(qm.REPORTED) == 15


def test_inverses(spark):
    rows = spark.createDataFrame([(0.0,), (0.25,), (-0.25,), (float("inf"),)], "v double")
    shown = [
        tuple(r)
        for r in rows.select(
            qm.MEASURES["supp_diff"].inverse_of("v"), qm.MEASURES["growth_rate"].inverse_of("v"), qm.MEASURES["wracc"].inverse_of("v")
        ).collect()
    ]
    assert shown[0] == (0.0, math.inf, 0.0)
    assert shown[1] == (0.75, 4.0, 4.0)
    assert shown[2][0] == 0.75
    assert shown[3][1] == 0.0


def test_perfect_pattern_has_infinite_growth_and_zero_odds(spark):
    row = spark.createDataFrame([(15117, 0, 28230, 16653)], "tp long, fp long, tn long, fn long")
    r = qm.with_measures(row, ["growth_rate", "odds_ratio", "wracc_norm", "auc"]).first()
    assert math.isinf(r.growth_rate) and r.odds_ratio == 0.0
    assert r.wracc_norm == pytest.approx(r.auc)


def test_interval_overlap_and_text(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 2.0, 3.0), (1.0, 1.5, 2.0, 3.0), (2.5, 4.0, 1.0, 3.0)], "a double, b double, c double, d double")
    assert [r[0] for r in rows.selectExpr(qm.intervals_overlap("a", "b", "c", "d")).collect()] == [True, False, True]
    assert rows.select(qm.six_decimals(F.lit(1.23456789))).first()[0] == "1.234568"
    assert rows.select(qm.six_decimals(F.lit(float("inf")))).first()[0] == "inf"


def test_user_measure_with_columns(table):
    made = qm.register_measure("share_of_positives", lambda tp, fp, tn, fn: (tp + fn) / F.greatest(tp + fp + tn + fn, F.lit(1)))
    assert table.withColumn("v", made.column()).filter("tp = 1").first().v == pytest.approx(0.5)
    del qm.MEASURES["share_of_positives"]
