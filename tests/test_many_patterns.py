"""Bit-column counts, tiled overlaps and fronts at size, against plain numpy."""

import random
import time

import numpy as np
import pytest

from tidemark.operators import contingency as ct
from tidemark.operators import dominance, overlaps, packed
from tidemark.operators import fuzzify as fz
from tidemark.operators import generate as gn
from tidemark.operators import pareto as pa
from tidemark.operators.filters import coverage_ratio_filter
from tidemark.plans.datasets import LINE_NUMERIC, line_rows
from tidemark.session import cut


@pytest.fixture(scope="module")
def mined(spark, sf):
    rows = line_rows(spark, sf)
    layout = fz.fit(rows, LINE_NUMERIC)
    masks = cut(fz.selectors(rows, layout, "cls"))
    return masks, cut(fz.compressed_cube(masks, layout)), layout


def drawn(spark, layout, n, seed):
    made = gn.random_patterns(layout, gn.slots_for(spark, ["high", "low"], n, fixed=False), seed).drop("slot")
    return cut(made.dropDuplicates(["pattern_id"]).select("pattern_id", "class", "masks"))


def plain_coverage(rows, masks, layout):
    hit = np.ones((len(masks), len(rows)), bool)
    for v in range(len(layout.variables)):
        at = list(layout.words_of(v))
        shares = ((rows[None, :, at] & masks[:, None, at]) != 0).any(axis=2)
        hit &= shares | (masks[:, at] == 0).all(axis=1)[:, None]
    return hit


@pytest.mark.parametrize("compressed", [False, True])
def test_counts(spark, mined, compressed):
    masks, cube, layout = mined
    cells = cube if compressed else fz.as_cells(masks)
    patterns = drawn(spark, layout, 300, 3)
    table = cells.toPandas()
    rows = table[layout.words].to_numpy(np.int64)
    listed = patterns.toPandas()
    hit = plain_coverage(rows, np.array(listed["masks"].tolist()), layout)
    n, cls = table["n"].to_numpy(), table["class"].to_numpy()
    want = {}
    for i, (pid, c) in enumerate(zip(listed["pattern_id"], listed["class"], strict=True)):
        if pid != "empty":
            tp, fp = int(n[hit[i] & (cls == c)].sum()), int(n[hit[i] & (cls != c)].sum())
            want[pid] = (tp, fp, int(n[cls != c].sum()) - fp, int(n[cls == c].sum()) - tp)
        else:
            want[pid] = (0, 0, 0, 0)
    got = {r["pattern_id"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in ct.contingency(cells, patterns, layout).collect()}
    assert got == want


def test_counts_read_the_rows_once(spark, mined):
    masks, _, layout = mined
    table = ct.contingency(fz.as_cells(masks), drawn(spark, layout, 50, 4), layout)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "CartesianProduct" not in plan and "Generate" not in plan


def test_bits_of_wide_domains_and_strange_rows():
    """Several words a variable, missing values (all bits), values outside the domain (no bit), weights of many digits."""
    from tidemark.operators.profile import Layout, Variable

    layout = Layout.of([Variable("a", domain=tuple(map(str, range(150)))), Variable("b", domain=("x", "y", "z"))])
    rng = np.random.default_rng(2)
    rows = np.zeros((500, len(layout.words)), np.int64)
    for r in rows:
        for v in range(2):
            words = list(layout.words_of(v))
            kind = rng.random()
            if kind < 0.1:
                r[words] = [layout.full_mask(w) for w in words]
            elif kind < 0.9:
                w = words[rng.integers(len(words))]
                r[w] = 1 << rng.integers(layout.word_width(w))
    masks = np.zeros((70, len(layout.words)), np.int64)
    for m in masks:
        for w in range(len(layout.words)):
            if rng.random() < 0.5:
                m[w] = int(rng.integers(1 << min(layout.word_width(w), 62))) & layout.full_mask(w)
    weight = rng.integers(1, 10**9, 500)
    classes = [["u", "v"][i % 2] for i in range(70)]
    place = rng.integers(-1, 2, 500)
    sums = packed._block_sums(packed.packed_patterns(masks, classes, layout), rows, weight, place)
    hit = plain_coverage(rows, masks, layout)
    for i, c in enumerate(classes):
        own = place == "uv".index(c)
        assert sums[i].tolist() == [weight[hit[i]].sum(), weight[hit[i] & own].sum(), weight[own].sum(), weight.sum()]


def test_too_many_patterns_are_joined(spark, mined, monkeypatch):
    masks, cube, layout = mined
    patterns = drawn(spark, layout, 100, 5)
    want = sorted(map(tuple, ct.contingency(cube, patterns, layout).drop("masks").collect()))
    monkeypatch.setattr(packed, "LIMIT", 10)
    assert packed.packed_counts(cube, patterns, layout) is None
    assert sorted(map(tuple, ct.contingency(cube, patterns, layout).drop("masks").collect())) == want


@pytest.mark.parametrize("together", [64, 1])
@pytest.mark.parametrize("pct", [None, 0.7])
def test_overlaps(spark, mined, monkeypatch, together, pct):
    masks, cube, layout = mined
    monkeypatch.setattr(overlaps, "TILE", 32)
    monkeypatch.setattr(overlaps, "CELLS", 16)
    monkeypatch.setattr(overlaps, "TOGETHER", together)
    patterns = drawn(spark, layout, 120, 6).where("pattern_id <> 'empty'").toPandas()
    patterns["pos"] = range(len(patterns))
    frame = spark.createDataFrame(patterns[["pos", "class", "masks"]], "pos bigint, class string, masks array<bigint>")
    table = cube.toPandas()
    rows, n, cls = table[layout.words].to_numpy(np.int64), table["n"].to_numpy(), table["class"].to_numpy()
    hit = plain_coverage(rows, np.array(patterns["masks"].tolist()), layout)
    want = {}
    for i in range(len(patterns)):
        for j in range(i + 1, len(patterns)):
            c = patterns["class"][i]
            if c == patterns["class"][j]:
                both, one, two = (int(n[h & (cls == c)].sum()) for h in (hit[i] & hit[j], hit[i], hit[j]))
                if both and (pct is None or together == 1 or both >= pct * min(one, two)):
                    want[c, i, j] = both
    got = {(r["class"], r["pos1"], r["pos2"]): r["both"] for r in overlaps.overlap_pairs(cube, frame, layout, pct).collect()}
    assert got == want


def test_filter_of_twenty_thousand_patterns(spark, mined):
    """All pairs of a class are 10^8; only those that share everything become rows."""
    _, cube, layout = mined
    base = drawn(spark, layout, 2000, 7).where("pattern_id <> 'empty'").toPandas()
    many = base.loc[np.arange(20000) % len(base)].reset_index(drop=True)
    many["pattern_id"] = many["pattern_id"] + "#" + (np.arange(20000) // len(base)).astype(str)
    many["pos"] = np.arange(20000)
    frame = cut(spark.createDataFrame(many[["pos", "pattern_id", "class", "masks"]], "pos bigint, pattern_id string, class string, masks array<bigint>"))
    first = frame.where(f"pos < {len(base)}")
    started = time.time()
    kept = coverage_ratio_filter(cube, frame, layout, 1.0).collect()
    assert time.time() - started < 300
    alone = coverage_ratio_filter(cube, first, layout, 1.0).collect()
    # Copies lose to their first holder; those that cover no row of their class share none and are never compared.
    apart = {r["pos"] for r in ct.contingency(cube, first, layout).where("tp = 0").collect()}
    assert {r["pos"] for r in kept if r["pos"] < len(base)} == {r["pos"] for r in alone}
    assert {r["pos"] % len(base) for r in kept if r["pos"] >= len(base)} <= apart


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_fronts_against_peeling(m):
    rng = np.random.default_rng(m)
    for values in (rng.integers(0, 8, (150, m)).astype(float), rng.random((200, m)), np.full((9, m), -np.inf)):
        left, level, want = np.arange(len(values)), 0, np.zeros(len(values), int)
        while len(left):
            part = values[left]
            beaten = np.array([((part >= v).all(axis=1) & (part > v).any(axis=1)).any() for v in part])
            want[left[~beaten]] = level
            left, level = left[beaten], level + 1
        assert dominance.front_numbers(values).tolist() == want.tolist()
        assert dominance.front_mask(values).tolist() == (want == 0).tolist()


def test_fifty_thousand_vectors(spark):
    rng = random.Random(8)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(50000)]
    frame = cut(spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(8))
    for names in (["a", "b"], ["a", "b", "c"]):
        started = time.time()
        ranked = {r["id"]: r["front"] for r in pa.pareto_rank(frame, names).select("id", "front").collect()}
        first = {r["id"] for r in pa.pareto_front(frame, names).select("id").collect()}
        assert time.time() - started < 120
        assert first == {i for i, f in ranked.items() if f == 0} and len(ranked) == 50000
        values = np.array([r[1 : 1 + len(names)] for r in rows])
        for i in rng.sample(range(50000), 60):
            over = ((values >= values[i]).all(axis=1) & (values > values[i]).any(axis=1)).nonzero()[0]
            assert ranked[i] == (max(ranked[int(k)] for k in over) + 1 if len(over) else 0)


def test_a_long_front(spark):
    """50 000 vectors that are all one front, and 50 000 fronts of one."""
    n = 50000
    frame = cut(spark.range(n).selectExpr("id", "double(id) AS up", f"double({n} - id) AS down"))
    assert pa.pareto_front(frame, ["up", "down"]).count() == n
    assert pa.pareto_rank(frame.withColumn("twin", frame["up"]), ["up", "twin"]).selectExpr(f"sum(int(front = {n - 1} - id))").first()[0] == n
