import inspect
import random

import numpy as np
import pytest

from tidemark.operators import contingency as ct
from tidemark.operators import fuzzify as fz
from tidemark.operators import generate as gn
from tidemark.operators import pareto as pa
from tidemark.operators import search as se
from tidemark.plans import ranking
from tidemark.plans.datasets import LINE_NUMERIC, line_rows
from tidemark.session import cut


def dominated(a, b):
    return all(x >= y for x, y in zip(a, b)) and any(x > y for x, y in zip(a, b))


def peel(points):
    left, level, out = list(points), 0, {}
    while left:
        front = [p for p in left if not any(dominated(q[1:], p[1:]) for q in left)]
        for p in front:
            out[p[0]] = level
        left = [p for p in left if p not in front]
        level += 1
    return out


@pytest.fixture(scope="module")
def points():
    rng = random.Random(5)
    return [(i, float(rng.randrange(20)), float(rng.randrange(20)), float(rng.randrange(5))) for i in range(200)]


@pytest.mark.parametrize("block", [4096, 16])
def test_front_and_ranks(spark, points, monkeypatch, block):
    """One-task and block-by-block comparison, sweep and peeling give the same fronts."""
    monkeypatch.setattr(pa, "BLOCK", block)
    frame = spark.createDataFrame(points, "id int, a double, b double, c double").repartition(5)
    want = peel(points)
    front = {r.id for r in pa.pareto_front(frame, ["a", "b", "c"]).collect()}
    assert front == {i for i, f in want.items() if f == 0}
    if block == 4096:
        assert {r.id: r.front for r in pa.pareto_rank(frame, ["a", "b", "c"]).collect()} == want


def test_ranks_by_peeling(spark, points, monkeypatch):
    monkeypatch.setattr(pa, "BLOCK", 20)
    few = points[:30]
    frame = spark.createDataFrame(few, "id int, a double, b double, c double")
    assert {r.id: r.front for r in pa.pareto_rank(frame, ["a", "b"]).collect()} == peel([p[:3] for p in few])


def test_crowding_and_selection(spark):
    rows = spark.createDataFrame([("p", 0.0, 4.0), ("q", 1.0, 3.0), ("r", 3.0, 1.0), ("s", 4.0, 0.0)], "pattern_id string, a double, b double")
    made = pa.crowding_distance(rows.selectExpr("*", "0 AS front", "'x' AS class"), ["a", "b"], ["class", "front"])
    got = {r.pattern_id: r.crowding for r in made.collect()}
    assert got["p"] == got["s"] == float("inf") and got["q"] == got["r"] == pytest.approx(1.5)
    assert [r.pattern_id for r in pa.select_top(made, 3, ["class"]).orderBy("pattern_id").collect()] == ["p", "q", "s"]


def test_zero_direction(spark):
    rows = spark.createDataFrame([(0.5, 0.5)], "a double, b double")
    r = pa.reference_association(rows, ["a", "b"], [(0.0, 0.0), (1.0, 1.0)]).first()
    assert r.ref == 1 and r.ref_distance == pytest.approx(0.0)


@pytest.fixture(scope="module")
def mined(spark, sf):
    rows = line_rows(spark, sf)
    layout = fz.fit(rows, LINE_NUMERIC)
    return cut(fz.compressed_cube(fz.selectors(rows, layout, "cls"), layout)), layout


def test_generated_patterns_are_usable(spark, mined):
    _, layout = mined
    slots = gn.slots_for(spark, ["high", "low"], 200)
    made = gn.oriented_patterns(layout, slots, 3, pct=0.5).collect()
    assert len(made) == 400
    for r in made:
        taking_part = [m for m in r.masks if m]
        assert 1 <= len(taking_part) <= 2 and all(0 < m < 7 for m in taking_part)
    again = gn.oriented_patterns(layout, slots.repartition(5), 3, pct=0.5).collect()
    assert sorted(r.masks for r in made) == sorted(r.masks for r in again)
    turns = gn.slots_for(spark, ["high", "low"], 5, fixed=False).orderBy("slot").collect()
    assert [r["class"] for r in turns] == ["high", "low", "high", "low", "high"]


def test_seeded_patterns_cover_their_row(spark, sf):
    rows = line_rows(spark, sf, missing=True)
    layout = fz.fit(rows, LINE_NUMERIC)
    masks = fz.selectors(rows, layout, "cls", keep=["l_orderkey"]).withColumnRenamed("l_orderkey", "slot")
    for r in gn.coverage_patterns(layout, masks, 4).collect():
        assert any(r.masks)
        assert all(m == 0 or m & r[f"w{i}"] for i, m in enumerate(r.masks))


def test_crossover_keeps_the_genes_of_both(spark, mined):
    _, layout = mined
    rows = spark.range(300).selectExpr("id", "array(1L,1L,1L,1L) AS mom", "array(2L,2L,2L,2L) AS dad")
    girl, boy = gn.crossover(layout, "mom", "dad", 9, ["id"], p=1.0)
    crossed = 0
    for r in rows.selectExpr(f"{girl} AS girl", f"{boy} AS boy").collect():
        assert all(a + b == 3 for a, b in zip(r.girl, r.boy))
        crossed += len(set(r.girl)) > 1
    assert crossed > 100
    never = gn.crossover(layout, "mom", "dad", 9, ["id"], p=0.0)[0]
    assert {tuple(r[0]) for r in rows.selectExpr(never).collect()} == {(1, 1, 1, 1)}


def test_mutation_changes_one_variable(spark, mined):
    _, layout = mined
    rows = spark.range(500).selectExpr("id", "array(1L,2L,3L,4L) AS m")
    changed = [r for r in rows.selectExpr("m", f"{gn.mutate(layout, 'm', 5, ['id'], 0.5)} AS k").collect() if r.m != r.k]
    assert 100 < len(changed) < 300
    assert all(sum(a != b for a, b in zip(r.m, r.k)) == 1 and all(0 <= v <= 7 for v in r.k) for r in changed)


def test_bounded_crowding_matches_the_definition():
    values = np.array([[0.0, 4.0], [1.0, 3.0], [3.0, 1.0], [4.0, 0.0]])
    assert list(se.crowding_of(values)) == [float("inf"), pytest.approx(1.5), pytest.approx(1.5), float("inf")]


def test_search_finds_the_price_pattern_and_repeats(mined):
    cells, layout = mined
    runs = [
        sorted((r.pattern_id, r.tp, r.fp) for r in se.mine(cells, layout, size=16, evaluations=16 * 4, reinit_pct=0.5, seed=2).collect())
        for _ in range(2)
    ]
    assert runs[0] == runs[1] and runs[0]
    best = ct.evaluate(cells, ct.enumerate_patterns(cells, layout, 1), layout, ["wracc_norm"]).filter("class = 'high'").agg({"o1": "max"}).first()[0]
    assert best > 0.6


def test_the_registered_search_has_the_default_budget(monkeypatch):
    seen = {}

    class Mined:
        def drop(self, *names):
            return self

    monkeypatch.setattr(ranking, "line_cube", lambda spark, sf_dir: ("cells", "layout"))
    monkeypatch.setattr(ranking, "cut", lambda df: df)
    monkeypatch.setattr(se, "mine", lambda cells, layout, **options: seen.update(options) or Mined())
    ranking.mine(None, "")
    default = inspect.signature(se.search).parameters["evaluations"].default
    assert seen.get("evaluations", default) == default == 5000


def test_reinit_rule():
    assert se.needs_reinit({"a": 100, "b": 900}, 1000, 2000) == ["a"]


def test_a_search_scores_each_pattern_once(spark, sf, monkeypatch):
    from tidemark.operators import search as se
    from tidemark.plans.datasets import line_cube
    from tidemark.session import cut

    cells, layout = line_cube(spark, sf)
    met, plain = [], se._score

    def score(cells, candidates, *rest):
        unique = candidates.select("class", "pattern_id").distinct().collect()
        met.extend((r["class"], r["pattern_id"]) for r in unique)
        return plain(cells, candidates, *rest)

    monkeypatch.setattr(se, "_score", score)
    found = se.search(cut(cells), layout, ["high", "low"], size=9, evaluations=54, p_mut=0.0, reinit_pct=2.0).collect()
    assert found and len(met) == len(set(met))
