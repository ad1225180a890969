"""Sets of the Jaccard join are dealt once; rounds move names and marks, and tokens only of pairs that their marks let through."""

import random

import numpy as np
import pytest
from conftest import make_docs, prose, vocabulary

from tidemark import session
from tidemark.llm import jaccard_join

OWN_SETTINGS = ("spark.sql.adaptive.enabled", "spark.sql.requireAllClusterKeysForCoPartition")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sets_are_not_moved_by_a_round(spark, monkeypatch):
    rng, vocab = random.Random(12), vocabulary(4000)
    base = prose(rng, 200, vocab).split()
    texts = [" ".join([*base[:k], f"own{k}", *base[k + 1 :]]) for k in range(0, 200, 5)]
    seen = []
    plain = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, sets, t: seen.append(sets) or plain(pairs, sets, t))
    got = jaccard_join.similar_components(make_docs(spark, texts)).collect()
    assert {r["component_id"] for r in got} == {0} and seen
    for sets in seen:
        assert "Exchange" not in plan(sets.groupBy("rep").count())


def test_marks_are_compared_before_tokens_are_sent(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base = np.sort(rng.choice(1 << 48, 400, replace=False).astype(np.uint64))
    like = np.sort(np.concatenate([base[10:], rng.choice(1 << 48, 10, replace=False).astype(np.uint64)]))
    unlike = np.sort(np.concatenate([base[150:], rng.choice(1 << 48, 150, replace=False).astype(np.uint64)]))
    rows = [(i, 400, bytearray(jaccard_join._pack(x)), jaccard_join._marks(x).tolist()) for i, x in enumerate((base, like, unlike))]
    sets = spark.createDataFrame(rows, "rep bigint, n_shingles bigint, tokens binary, marks array<bigint>")
    counts = []
    plain = jaccard_join.cut

    def counted(df):
        out = plain(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "cut", counted)
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a bigint, b bigint")
    found = jaccard_join._verified(pairs, sets, jaccard_join.Threshold(85, 100))
    assert [tuple(r) for r in found.collect()] == [(0, 1)]
    assert counts == [1, 1]  # pairs whose tokens are sent, links


def test_one_name_for_several_texts(spark):
    """Rows that repeat a doc_id are several sets under one name, also where they are dealt by that name."""
    rng, vocab = random.Random(14), vocabulary(4000)
    first, second = prose(rng, 100, vocab).split(), prose(rng, 100, vocab).split()
    near = [" ".join([*words[:50], "own", *words[51:]]) for words in (first, second)]
    docs = make_docs(spark, [" ".join(first), " ".join(second), *near, prose(rng, 100, vocab)], [7, 7, 9, 11, 12])
    got = jaccard_join.similar_components(docs, 4, (85, 100)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(7, 7), (7, 7), (9, 7), (11, 7), (12, 12)]


def test_settings_are_put_back(spark):
    before = [spark.conf.get(name) for name in OWN_SETTINGS]
    out = session.cut_by(spark.range(100).selectExpr("id % 7 AS k", "id"), "k")
    assert "Exchange" not in plan(out.groupBy("k").count()) and out.groupBy("k").count().count() == 7
    with pytest.raises(Exception, match="ARITHMETIC|DIVIDE"):
        session.cut_by(spark.range(3).selectExpr("1 div (id - 1) AS k"), "k")
    assert [spark.conf.get(name) for name in OWN_SETTINGS] == before
