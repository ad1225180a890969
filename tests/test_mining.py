import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contingency as ct
from tidemark.operators import coverage as cv
from tidemark.operators import filters as fl
from tidemark.operators import overlaps
from tidemark.operators import fuzzify as fz
from tidemark.operators import patterns as pt
from tidemark.operators import profile as pr
from tidemark.operators.profile import Layout, Variable
from tidemark.operators.rowindex import chunked, with_row_index

MINI = [(0.0, "red", "pos"), (2.5, "green", "pos"), (5.0, "red", "neg"), (7.6, None, "neg"), (10.0, "blue", "neg"), (None, "red", "pos")]


@pytest.fixture(scope="module")
def mini(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(MINI, 1)], "id int, size double, colour string, class string")
    layout = fz.fit(rows.withColumnRenamed("class", "cls"), ["size"], ["colour"])
    return rows, layout


@pytest.mark.parametrize(
    "low, high, n, centres",
    [(0.0, 10.0, 3, [0.0, 5.0, 10.0]), (0.0, 10.0, 5, [0.0, 2.5, 5.0, 7.5, 10.0]), (1.0, 50.0, 3, [1.0, 25.5, 50.0])],
)
def test_partition(spark, low, high, n, centres):
    bounds = spark.createDataFrame([(0, "x", low, high)], "var int, name string, min double, max double")
    got = fz.partition_table(bounds, n).orderBy("label").collect()
    step = (high - low) / (n - 1)
    assert [r.b for r in got] == centres
    assert got[0].a == low - step and got[-1].c == high + step


def test_mini_labels_and_missing(mini):
    rows, layout = mini
    got = {r.id: (r.w0, r.w1) for r in fz.selectors(rows, layout, "class", keep=["id"]).collect()}
    # domain sorted: blue, green, red
    assert got == {1: (1, 4), 2: (1, 2), 3: (2, 4), 4: (4, 7), 5: (4, 1), 6: (7, 4)}
    tied = {r.id: r.w0 for r in fz.selectors(rows, layout, "class", keep=["id"], ties="all").collect()}
    assert tied[2] == 3 and tied[1] == 1


def test_mini_contingency(spark, mini):
    rows, layout = mini
    pattern = spark.createDataFrame([("pos:1.0", "pos", [1, 0]), ("empty", "pos", [0, 0])], "pattern_id string, class string, masks array<bigint>")
    cells = fz.compressed_cube(fz.selectors(rows, layout, "class"), layout)
    got = {r.pattern_id: (r.tp, r.fp, r.tn, r.fn) for r in ct.contingency(cells, pattern, layout).collect()}
    assert got == {"pos:1.0": (3, 0, 3, 0), "empty": (0, 0, 0, 0)}


def test_thresholds_agree_with_degrees(spark):
    rng = random.Random(3)
    for low, high, n in [(0.0, 0.1, 3), (901.82, 104997.88, 3), (-7.3, 11.1, 6)]:
        bounds = spark.createDataFrame([(0, "x", low, high)], "var int, name string, min double, max double")
        variable = fz.fit_numeric(bounds, n)[0]
        assert fz.thresholds(variable) is not None
        values = [low + (high - low) * k / 40 for k in range(-4, 45)] + [rng.uniform(low, high) for _ in range(500)] + fz.thresholds(variable)
        rows = spark.createDataFrame([(v,) for v in values], "x double").selectExpr("x", f"{fz.label_argmax('x', variable)} AS label")
        for r in rows.collect():
            degrees = [fz._degree(r.x, feet) for feet in variable.labels]
            assert r.label == degrees.index(max(degrees))


def test_flat_column_uses_the_general_form(spark):
    bounds = spark.createDataFrame([(0, "x", 2.0, 2.0)], "var int, name string, min double, max double")
    variable = fz.fit_numeric(bounds, 3)[0]
    assert fz.thresholds(variable) is None
    assert spark.range(1).selectExpr(f"{fz.label_argmax('2D', variable)} AS v").first().v == 0


def test_wide_domains_are_numbered_in_order(spark):
    """A key-like column is numbered by a range sort over tasks, beside a narrow one; no task holds the whole column."""
    rows = spark.range(0, 200_000, 1, 8).selectExpr("concat('k', lpad(id, 7, '0')) key", "if(id % 3 = 0, null, concat('c', id % 3)) cls")
    table = pr.domain_table(pr.nominal_values(rows, ["key", "cls"]))
    assert table.where("name = 'key' AND idx <> cast(substring(value, 2) AS bigint)").count() == 0
    assert table.where("name = 'key'").count() == 200_000
    assert [(r["value"], r["idx"], r["n"]) for r in table.where("name = 'cls'").orderBy("idx").collect()] == [("c1", 0, 66_667), ("c2", 1, 66_666)]
    assert pr.domain_table(pr.nominal_values(rows.limit(0), ["key"])).count() == 0


def test_profile_limits_and_widening(spark, mini):
    rows, _ = mini
    values = pr.nominal_values(rows, ["colour"])
    with pytest.raises(ValueError):
        pr.check_domain_sizes(values, 2)
    one = pr.numeric_bounds(rows.filter("id <= 3"), ["size"])
    two = pr.numeric_bounds(rows.filter("id > 3"), ["size"])
    r = pr.widen_bounds(one, two).first()
    assert (r.min, r.max, r.changed) == (0.0, 10.0, True)


def wide_layout():
    return Layout.of([Variable("a", labels=((-1, 0, 1), (0, 1, 2), (1, 2, 3))), Variable("b", domain=tuple(f"v{i:02d}" for i in range(70))), Variable("c", domain=("x", "y"))])


def random_cells(rng, layout, n):
    out = []
    for i in range(n):
        words = []
        for v, variable in enumerate(layout.variables):
            kind = rng.random()
            picked = set(range(variable.width)) if kind < 0.1 else set(rng.sample(range(variable.width), 2)) if kind < 0.3 else {rng.randrange(variable.width)}
            for w in layout.words_of(v):
                low = layout.word_low[w]
                words.append(sum(1 << (j - low) for j in picked if low <= j < low + layout.word_width(w)))
        out.append((i, *words, rng.choice(["p", "q", "r"]), rng.randrange(1, 5)))
    return out


def random_patterns(rng, layout, n):
    out = []
    for _ in range(n):
        masks = [rng.getrandbits(layout.word_width(w)) if rng.random() < 0.6 else 0 for w in range(len(layout.words))]
        out.append((rng.choice(["p", "q", "r"]), masks))
    return out


def brute_covers(layout, words, masks):
    said = False
    for v in range(len(layout.variables)):
        at = layout.words_of(v)
        if all(masks[w] == 0 for w in at):
            continue
        said = True
        if not any(words[w] & masks[w] for w in at):
            return False
    return said


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(11)
    layout = wide_layout()
    cells = random_cells(rng, layout, 300)
    names = ", ".join(f"{w} long" for w in layout.words)
    frame = spark.createDataFrame(cells, f"id int, {names}, class string, n long").cache()
    raw = spark.createDataFrame(random_patterns(rng, layout, 60), "class string, masks array<bigint>")
    patterns = pt.canonicalise(raw, layout).dropDuplicates(["pattern_id"]).cache()
    return layout, cells, frame, patterns


@pytest.mark.parametrize("budget", [cv.BROADCAST_BYTES, 20_000])
def test_cover_join_against_brute_force(wide, monkeypatch, budget):
    """Both the broadcast and the salted path, with several values per row and two-word domains."""
    monkeypatch.setattr(cv, "BROADCAST_BYTES", budget)
    layout, cells, frame, patterns = wide
    listed = patterns.collect()
    got = sorted((r.id, r.pattern_id) for r in cv.covered_pairs(frame, patterns, layout, ["id"]).collect())
    k = len(layout.words)
    want = sorted((c[0], p.pattern_id) for c in cells for p in listed if brute_covers(layout, c[1 : 1 + k], p.masks))
    assert got == want and len(got) > 500


def test_contingency_adds_up(wide):
    layout, cells, frame, patterns = wide
    total = sum(c[-1] for c in cells)
    for r in ct.contingency(frame, patterns, layout).filter("pattern_id <> 'empty'").collect():
        assert r.tp + r.fp + r.tn + r.fn == total
        assert min(r.tp, r.fp, r.tn, r.fn) >= 0


def test_duplicate_pattern_rows_are_not_counted_twice(wide):
    layout, _, frame, patterns = wide
    once = {r.pattern_id: r.tp for r in ct.contingency(frame, patterns, layout).collect()}
    twice = ct.contingency(frame, patterns.unionByName(patterns), layout).collect()
    assert len(twice) == 2 * len(once) and all(r.tp == once[r.pattern_id] for r in twice)


def sequential_ratio_filter(patterns, overlap, max_pct):
    """The pairwise pass in list order; ``patterns``: (cover, tp, low, high, size)."""
    gone = [p[0] == 0 for p in patterns]
    for i, j in itertools.combinations(range(len(patterns)), 2):
        if gone[j]:
            continue
        a, b = patterns[i], patterns[j]
        if not a[1] or not b[1]:
            continue
        both = overlap.get((i, j), 0)
        if max(both / a[1], both / b[1]) < max_pct:
            continue
        if a[2] > b[3]:
            gone[j] = True
        elif b[2] > a[3]:
            gone[i] = True
        elif a[4] <= b[4]:
            gone[j] = True
        else:
            gone[i] = True
    return [i for i, g in enumerate(gone) if not g]


@pytest.mark.parametrize("max_pct, block", [(1.0, 2048), (0.6, 2048), (0.6, 7)])
def test_coverage_ratio_filter_equals_the_sequential_pass(wide, monkeypatch, max_pct, block):
    from tidemark.functions.measures import with_odds_interval

    monkeypatch.setattr(overlaps, "TILE", block)
    layout, cells, frame, patterns = wide
    ordered = sorted(patterns.collect(), key=lambda r: (r["class"], r.pattern_id))
    spark = frame.sparkSession
    listed = spark.createDataFrame([(i, r.pattern_id, r["class"], r.masks) for i, r in enumerate(ordered)], "pos long, pattern_id string, class string, masks array<bigint>")
    scored = with_odds_interval(ct.contingency(frame, listed, layout)).withColumn("size", F.expr(pt.n_elements(layout)))
    by_pos = {r.pos: r for r in scored.collect()}
    k = len(layout.words)
    kept = []
    for cls in ("p", "q", "r"):
        own = [i for i, r in enumerate(ordered) if r["class"] == cls]
        rows = [c for c in cells if c[-2] == cls]
        hit = {i: {c[0]: c[-1] for c in rows if brute_covers(layout, c[1 : 1 + k], ordered[i].masks)} for i in own}
        overlap = {(x, y): sum(hit[own[x]][c] for c in hit[own[x]].keys() & hit[own[y]].keys()) for x, y in itertools.combinations(range(len(own)), 2)}
        facts = [(by_pos[i].tp + by_pos[i].fp, by_pos[i].tp, by_pos[i].odds_low, by_pos[i].odds_high, by_pos[i].size) for i in own]
        kept += [own[x] for x in sequential_ratio_filter(facts, overlap, max_pct)]
    got = sorted(r.pos for r in fl.coverage_ratio_filter(frame, listed, layout, max_pct).collect())
    assert got == sorted(kept)


def test_token_competition_equals_the_sequential_pass(wide):
    from tidemark.functions.measures import with_measures

    layout, cells, frame, patterns = wide
    scored = with_measures(ct.contingency(frame, patterns, layout), ["wracc_norm"]).withColumn("size", F.expr(pt.n_elements(layout)))
    k = len(layout.words)
    want = []
    for cls in ("p", "q", "r"):
        rows = [c for c in cells if c[-2] == cls]
        ranked = sorted((r for r in scored.collect() if r["class"] == cls), key=lambda r: (-r.wracc_norm, r.size, r.pattern_id))
        taken = set()
        before = len(want)
        for r in ranked:
            mine = {c[0] for c in rows if brute_covers(layout, c[1 : 1 + k], r.masks)}
            if mine - taken:
                want.append(r.pattern_id)
            taken |= mine
        if len(want) == before and ranked:
            want.append(ranked[0].pattern_id)
    got = [r.pattern_id for r in fl.token_competition(frame, patterns, layout).collect()]
    assert sorted(got) == sorted(want)


def test_empty_patterns_are_one(spark):
    layout = wide_layout()
    raw = spark.createDataFrame([("p", [7, 0, 0, 0]), ("q", [0, 0, 0, 3]), ("p", [1, 0, 0, 3])], "class string, masks array<bigint>")
    ids = [r.pattern_id for r in pt.canonicalise(raw, layout).collect()]
    assert ids == ["empty", "empty", "p:1.0.0.0"]


def test_row_index_and_chunks(spark):
    rows = spark.range(0, 1003, 1, 7).selectExpr("id % 10 AS k", "id AS v")
    got = with_row_index(rows, ["k", "v"]).orderBy("k", "v").collect()
    assert [r.row_index for r in got] == list(range(1003))
    sizes = {r.batch_id: r["count"] for r in chunked(rows, 100, ["k", "v"]).groupBy("batch_id").count().collect()}
    assert sizes == {**{i: 100 for i in range(10)}, 10: 3}


def test_set_algebra(spark):
    a, b = spark.range(0, 6), spark.range(4, 9)
    assert sorted(r.id for r in cv.set_xor(a.union(a), b).collect()) == [0, 1, 2, 3, 6, 7, 8]
    assert sorted(r.id for r in cv.set_and(a, b).collect()) == [4, 5]
    assert cv.next_member(b, "id", 6).first().id == 6


def test_class_without_rows_still_gets_counts(spark, mini):
    rows, layout = mini
    cells = fz.compressed_cube(fz.selectors(rows, layout, "class"), layout)
    ghost = spark.createDataFrame([("ghost:1.0", "ghost", [1, 0])], "pattern_id string, class string, masks array<bigint>")
    r = ct.contingency(cells, ghost, layout).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (0, 3, 3, 0)


def test_bitmaps_have_sparks_bits_and_make_no_pairs(spark, sf):
    from pyspark.sql import functions as F

    from tidemark.operators import coverage as cv
    from tidemark.operators.rowindex import with_row_index
    from tidemark.plans.datasets import KEYS, lift_patterns, line_cube, line_masks

    cube, layout = line_cube(spark, sf, missing=True)
    patterns = lift_patterns(cube, layout).cache()
    numbered = with_row_index(line_masks(spark, sf, missing=True)[0], KEYS).withColumn("row_index", F.col("row_index") * 7).cache()
    bit = lambda f: F.call_function(f, F.col("row_index") + 1)

    def brute(pairs, name):
        made = pairs.groupBy(name, bit("bitmap_bucket_number").alias("bucket")).agg(F.call_function("bitmap_construct_agg", bit("bitmap_bit_position")).alias("bitmap"))
        return sorted(map(str, made.collect()))

    got = cv.coverage_bitmaps(numbered, patterns, layout, "row_index")
    assert sorted(map(str, got.collect())) == brute(cv.cover_join(numbered, patterns, layout), "pattern_id")
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    marked = cv.class_bitmaps(numbered, "row_index")
    assert sorted(map(str, marked.collect())) == brute(numbered, "class")
    assert "bitmap_construct_agg" not in marked._jdf.queryExecution().optimizedPlan().toString()
