"""What the steps of the pipeline leave with the driver: few broadcasts a step, none after use."""

from __future__ import annotations

import os
import random
import re

import numpy as np
from pyspark import SparkContext

from tidemark.llm import jaccard_join, outliers


def test_a_concentration_step_reads_its_rows_once_and_broadcasts_the_models_only(spark, monkeypatch):
    draw = random.Random(4)
    width = len(outliers.FEATURES)
    values = [[round(draw.gauss(0.3, 0.1) * 1024) / 1024 for _ in range(width)] for _ in range(400)]
    rows = spark.createDataFrame([("ab"[i % 2], *v) for i, v in enumerate(values)], ["grp", *outliers.FEATURES])
    plans, cut, plain = [], outliers.cut, outliers.cut_plain

    def seen(df):
        out = plain(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    rows = cut(rows)
    everything = rows.groupBy("grp").agg(*map(outliers.F.expr, outliers._named(outliers._sums())))
    models = cut(outliers._estimate(everything, "grp"))
    monkeypatch.setattr(outliers, "cut_plain", seen)
    got = {r["grp"]: r for r in outliers._concentrated(rows, models, ["grp"], 0.75, True).collect()}
    assert len(plans) == 1 and "AdaptiveSparkPlan" not in plans[0]
    assert len(re.findall(r"(?<!Reused)\bBroadcastExchange", plans[0])) == 1  # two before, beside a second scan of the rows
    assert plans[0].count("Scan ExistingRDD") == 2  # rows and models
    floors = np.diag(np.square(list(outliers.FEATURES.values())))
    for at, grp in enumerate("ab"):
        x = np.array(values[at::2])
        low = np.linalg.cholesky(np.cov(x.T, bias=True) + floors)
        d2 = (np.linalg.solve(low, (x - x.mean(0)).T) ** 2).sum(0)
        bins = np.floor(np.log(np.maximum(d2, 1e-6)) * 32)
        near = x[bins <= np.ceil(np.percentile(bins, 75))]
        np.testing.assert_allclose([got[grp][f"m{i}"] for i in range(width)], near.mean(0), rtol=1e-9)
        want = np.linalg.cholesky(np.cov(near.T, bias=True) + floors)
        np.testing.assert_allclose([got[grp][f"l{i}_{j}"] for i in range(width) for j in range(i + 1)], want[np.tril_indices(width)], rtol=1e-7, atol=1e-12)
        np.testing.assert_allclose([got[grp]["was"], got[grp]["log_det"]], [np.log(np.diag(low)).sum(), np.log(np.diag(want)).sum()], rtol=1e-9)


def test_the_frequency_classes_do_not_stay_with_the_driver(spark, monkeypatch):
    made, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: made.append(broadcast(self, value)) or made[-1])
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other words stand in this text")], ["doc_id", "text"])
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert made and not any(os.path.exists(b._path) for b in made)
