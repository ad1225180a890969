"""Missing inputs, odd ARFF files, columns without values, interval levels, budgets and stream stops."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tidemark.functions import connectors, membership, stats
from tidemark.operators import filters as fl
from tidemark.operators import fuzzify as fz
from tidemark.operators import profile as pr
from tidemark.sources import arff
from tidemark.streaming.test_then_train import trigger_seconds


def test_missing_inputs_have_no_degree(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (2.0,)], "x double")
    points = ((0.0, 0.0), (5.0, 1.0))
    got = rows.selectExpr(f"{membership.degree('x', 'piecewise', points)} AS p", f"{membership.degree('x', 'sigmoid_difference', (1.0, 0.0, 1.0, 5.0))} AS s").collect()
    assert [r.p for r in got] == [None, None, 0.4] and got[0].s is None and got[1].s is None and got[2].s > 0


@pytest.mark.parametrize("table", [connectors.AND, connectors.OR])
def test_connectives_keep_missing_degrees(spark, table):
    rows = spark.createDataFrame([(None, 1.0), (0.0, None), (0.5, 0.25)], "a double, b double")
    for join in table.values():
        got = [r[0] for r in rows.selectExpr(f"double({join('a', 'b')}) AS d").collect()]
        assert got[0] is None and got[1] is None and got[2] is not None


def test_arff_headers_are_read_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = tmp_path / "long.arff"
    path.write_text("@relation r\n@attribute a real\n@attribute b real\n@data\n1,2\n")
    monkeypatch.setattr(arff, "HEADER_LINES", 2)
    with pytest.raises(ValueError, match="no @data"):
        arff.read_arff(spark, str(path))
    monkeypatch.setattr(arff, "HEADER_LINES", 4)
    assert arff.read_arff(spark, str(path)).columns == ["a", "b"]


def test_arff_with_quotes_and_comments(spark, tmp_path):
    path = tmp_path / "odd.arff"
    path.write_text(
        "% a comment\n@relation odd\n@attribute 'body height' real\n@attribute \"eye-colour\" {'light, blue', brown}\n@attribute class {a,b}\n"
        "@data\n% another\n1.5,'light, blue',a\n\n?,brown,b\n2,\"brown\",b\n"
    )
    assert arff.arff_header(spark, str(path)) == [
        ("body height", "numeric", []), ("eye-colour", "nominal", ["light, blue", "brown"]), ("class", "nominal", ["a", "b"])
    ]
    rows = [tuple(r) for r in arff.read_arff(spark, str(path)).collect()]
    assert rows == [(1.5, "light, blue", "a"), (None, "brown", "b"), (2.0, "brown", "b")]
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "part").write_text("1,brown,a\n")
    with pytest.raises(ValueError):
        arff.arff_schema(spark, str(tmp_path / "data"))
    assert arff.read_arff(spark, str(tmp_path / "data"), header=str(path)).count() == 1


def test_columns_without_values_and_wide_domains(spark):
    rows = spark.range(5000).select(F.lit(None).cast("double").alias("none"), F.col("id").cast("string").alias("key"), F.lit("c").alias("cls"))
    layout = fz.fit(rows, ["none"], ["key"])
    assert layout.variables[0].width == 1 and layout.variables[1].width == 5000
    assert fz.selectors(rows, layout, "cls").filter("w0 <> 1").count() == 0
    with pytest.raises(ValueError):
        fz.fit(rows, [], ["key"], max_domain=4096)
    with pytest.raises(ValueError):
        fz.fit(rows.withColumn("none", F.lit(1.0)), ["none"], labels=1)
    got = {r["name"]: r for r in pr.profile(rows, ["none"], ["key", "cls"]).collect()}
    assert got["key"].n_values == 5000 and got["key"].domain is None and got["cls"].domain == "c"


def test_interval_levels(spark):
    assert stats.student_quantile(0.975, 1) == pytest.approx(12.706204736)
    assert stats.student_quantile(0.975, 12) == pytest.approx(stats.STUDENT_95[11])
    assert stats.student_quantile(0.95, 28) == pytest.approx(1.701130934)
    rows = spark.createDataFrame([("g", float(i)) for i in range(40)], "g string, v double")
    r = stats.mean_confidence_interval(rows, "v", ["g"], level=0.9).first()
    assert r.ci_high - r.mean == pytest.approx(NormalDist().inv_cdf(0.95) * r.sd / math.sqrt(40))


def test_small_settings():
    assert trigger_seconds({"processingTime": "2 seconds"}) == 2 and trigger_seconds({"processingTime": "500 milliseconds"}) == 0.5
    assert trigger_seconds({"availableNow": True}) is None and trigger_seconds(None) is None
    assert {"coverage_ratio", "token_competition", "confidence", "drop_repeated"} <= set(fl.FILTERS)
    with pytest.raises(ValueError):
        fl.coverage_ratio_filter(None, None, None, max_pct=0)
