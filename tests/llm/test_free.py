"""Operators 2, 3, 4, 5, 8, 9 and 10 against brute force, exact round trips or held-out accuracy."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from conftest import CLASHING, make_docs, prose, vocabulary

from tidemark.llm import chat_repair, decontaminate, jaccard_join, packing, private_data, suffix_dedup, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 2 ---------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng, vocab = random.Random(4), vocabulary()
    bad = ["zzbad", "zzworse", "zzvile", "zzugly"]
    texts, grades = [], []
    for _ in range(900):
        grade = rng.choice([0, 0, 0, 1, 2])
        ws = prose(rng, rng.randint(20, 80), vocab).split()
        for w in rng.sample(bad, 2 * grade):
            ws.insert(rng.randrange(len(ws)), w)
        texts.append(" ".join(ws))
        grades.append(grade)
    docs = make_docs(spark, texts)
    labels = spark.createDataFrame([(i, int(g > 0), 1) for i, g in enumerate(grades[:600])], "doc_id bigint, toxic int, quality int")
    rows, toxic = toxicity.labelled_rows(docs, labels)
    made = toxicity.severity_grades(rows, toxic)
    assert ((made > 0) == (toxic > 0)).all() and len(rows) == 600
    out = toxicity.score_severity(docs, toxicity.fit_ordinal(rows, made)).toPandas().sort_values("doc_id")
    held = out[out.doc_id >= 600]
    truth = np.array(grades[600:])
    assert ((held.toxic.values) == (truth > 0)).mean() > 0.97
    assert held.expected_severity.values[truth == 2].mean() > held.expected_severity.values[truth == 1].mean() > 0.5


def test_ordinal_fit_orders_thresholds():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(800)]
    z = np.array([(r < 5).sum() for r in rows])
    grades = (z >= 1).astype(int) + (z >= 2)
    model = toxicity.fit_ordinal(rows, grades)
    assert model.thresholds[0] < model.thresholds[1]
    assert ((model.above(rows) > 0.5).sum(1) == grades).mean() > 0.9


def test_toxicity_edges(spark, hard_docs, no_docs):
    model = toxicity.fit_ordinal([], np.empty(0, np.int64))
    assert toxicity.score_severity(hard_docs, model).where("toxic").count() == 0
    assert toxicity.score_severity(hard_docs, model).count() == hard_docs.count()
    assert toxicity.score_severity(no_docs, model).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert len(toxicity.labelled_rows(hard_docs, none)[0]) == 0


# --- 3 ---------------------------------------------------------------------------------------------------------


def brute_matches(a, b, least):
    """Maximal common stretches of two word lists."""
    out = set()
    for d in range(-len(a) + 1, len(b)):
        i = max(0, -d)
        while i < len(a) and i + d < len(b):
            n = 0
            while i + n < len(a) and i + n + d < len(b) and a[i + n] == b[i + n + d]:
                n += 1
            if n >= least:
                out.add((i, i + d, n))
            i += n + 1
    return out


def test_suffix_matches(spark):
    rng, vocab = random.Random(8), vocabulary()
    passages = [prose(rng, n, vocab) for n in (50, 55, 90, 200, 49)]
    texts = []
    for i in range(12):
        parts = [prose(rng, rng.randint(1, 120), vocab) for _ in range(3)]
        parts.insert(rng.randrange(4), passages[i % 5])
        if i % 4 == 0:
            parts.insert(rng.randrange(5), passages[(i + 2) % 5])
        texts.append("\n".join(parts))
    texts += [texts[0], texts[0], "so " * 200, "so " * 90 + passages[1], None, "", " "]
    docs = make_docs(spark, texts)
    got = suffix_dedup.repeated_passages(docs).collect()
    ws = [split_words(t) for t in texts]
    found, covered = set(), {}
    for r in got:
        assert r["doc_a"] < r["doc_b"]
        a, b = ws[r["doc_a"]], ws[r["doc_b"]]
        assert a[r["start_a"] : r["start_a"] + r["n_words"]] == b[r["start_b"] : r["start_b"] + r["n_words"]]
        found.add((r["doc_a"], r["doc_b"], r["start_a"], r["start_b"], r["n_words"]))
        for d, s in ((r["doc_a"], r["start_a"]), (r["doc_b"], r["start_b"])):
            covered.setdefault(d, set()).update(range(s, s + r["n_words"]))
    truth, must = set(), {}
    for i, j in itertools.combinations(range(len(ws)), 2):
        for s, t, n in brute_matches(ws[i], ws[j], 50):
            truth.add((i, j, s, t, n))
            for d, k in ((i, s), (j, t)):
                must.setdefault(d, set()).update(range(k, k + n))
    spans = suffix_dedup.repeated_spans(suffix_dedup.repeated_passages(docs)).collect()
    assert len(spans) >= len(covered)
    for d, own in covered.items():
        mine = [set(range(s["start"], s["start"] + s["n_words"])) for s in spans if s["doc_id"] == d]
        assert set().union(*mine) == own and sum(map(len, mine)) == len(own)
    longest = {}
    for i, j, s, t, n in truth:
        longest.setdefault((i, j, t - s), []).append((s, s + n))
    for i, j, s, t, n in found:
        assert any(a <= s and s + n <= b for a, b in longest[i, j, t - s])
    assert covered == must


def test_suffix_edges(hard_docs, no_docs):
    got = suffix_dedup.repeated_passages(hard_docs).collect()
    docs = {(r["doc_a"], r["doc_b"]) for r in got}
    assert (5, 6) in docs and any(20 in d for d in docs)
    assert suffix_dedup.repeated_passages(no_docs).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(no_docs, 30)


def test_holders_of_a_passage_are_one_class(spark):
    """However the neighbours fall, all holders of a passage reach its smallest one."""
    rng, vocab = random.Random(21), vocabulary()
    shared = [prose(rng, 60, vocab), prose(rng, 75, vocab), prose(rng, 52, vocab)]
    texts, holds = [], []
    for i in range(300):
        parts = [prose(rng, rng.randint(5, 60), vocab), prose(rng, rng.randint(5, 60), vocab)]
        which = (0,) if i < 200 else (1,) if i < 260 else (2, 2) if i == 270 else () if i < 280 else (2,)
        texts.append("\n".join([parts[0], *(shared[w] + "\n" + parts[1] for w in which)]))
        holds.append(which)
    got = suffix_dedup.repeated_spans(suffix_dedup.repeated_passages(make_docs(spark, texts))).collect()
    least = {0: 0, 1: 200, 2: 270}
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == [(d, least[w]) for d, which in enumerate(holds) for w in which]
    assert all(r["n_words"] >= 50 for r in got)


def test_every_window_has_a_retained_position():
    grams = np.random.default_rng(0).integers(0, 1 << 60, 500).astype(np.uint64)
    at = suffix_dedup.retained(grams)
    assert np.diff(at).max() <= suffix_dedup.WINDOW
    inside = suffix_dedup.retained(grams[100:300]) + 100
    assert set(inside) <= set(at)


# --- 4 ---------------------------------------------------------------------------------------------------------


def brute_padding(lengths, k):
    values = sorted(set(lengths))
    best = None
    for n in range(1, min(k, len(values)) + 1):
        for cut in itertools.combinations(values[:-1], n - 1):
            upper = [*cut, values[-1]]
            pad = sum(next(u for u in upper if x <= u) - x for x in lengths)
            best = pad if best is None else min(best, pad)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(30):
        lengths = [rng.randint(1, 12) for _ in range(rng.randint(1, 25))]
        values, counts = np.unique(lengths, return_counts=True)
        got = packing.best_boundaries(values.astype(float), counts, values * counts, 3)
        assert got.padding == brute_padding(lengths, 3)
        assert sum(next(u for u in got.upper if x <= u) - x for x in lengths) == got.padding


def test_boundaries_of_many_lengths():
    """Long lengths are bins of their own: the plain quadratic recurrence gives the same padding and boundaries."""
    rng = np.random.default_rng(11)
    for n, k in ((700, 7), (333, 16), (5, 9)):
        values = np.sort(rng.choice(np.arange(1, 50_000), n, replace=False))
        counts = rng.integers(1, 10**9, n)
        rows, tokens = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, values * counts))
        cost = [[int(values[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])) for i in range(j)] for j in range(n + 1)]
        layer, ways = [0] + [None] * n, []
        for _ in range(min(k, n)):
            fresh = [None] * (n + 1)
            for j in range(1, n + 1):
                fresh[j] = min((layer[i] + cost[j][i] for i in range(j) if layer[i] is not None), default=None)
            layer = fresh
            ways.append(layer[n])
        got = packing.best_boundaries(values, counts, values * counts, k)
        assert got.padding == min(ways) and len(got.upper) == 1 + ways.index(min(ways))
        at = np.searchsorted(got.upper, values)
        assert int(((np.array(got.upper)[at] - values) * counts).sum()) == got.padding


def test_batches(hard_docs, no_docs):
    out = packing.packed_batches(hard_docs, budget=700, k=4).toPandas()
    assert len(out) == hard_docs.count()
    for _, b in out.groupby("batch"):
        assert b.bucket.nunique() == 1 and b.padded_length.nunique() == 1
        assert len(b) == 1 or len(b) * b.padded_length.iloc[0] <= 700
    assert sorted(out.batch.unique()) == list(range(out.batch.max() + 1))
    for (_, length), b in out.groupby(["bucket", "padded_length"]):
        assert b.n_tokens.max() == length
        assert b.batch.nunique() == -(-len(b) // max(700 // length, 1))
    assert packing.packed_batches(no_docs).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------


def brute_alignment(a, b):
    """Best local score by the plain recurrence."""
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
    return int(h.max())


def test_alignments():
    rng = random.Random(6)
    a = [[rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(60)]
    b = [[rng.choice("abcd") for _ in range(rng.randint(0, 20))] for _ in range(60)]
    for x, y, (score, begin, end) in zip(a, b, decontaminate.local_alignments(a, b), strict=True):
        assert score == brute_alignment(x, y) == brute_alignment(x[begin:end], y)


def test_contamination(spark):
    rng, vocab = random.Random(9), vocabulary()
    items = [prose(rng, n, vocab) for n in (30, 40, 60, 12, 3)]
    bench = spark.createDataFrame([*enumerate(items), (7, None), (8, ""), (2, items[2])], "item_id bigint, text string").selectExpr("*", "'x' words")

    def edited(text, every):
        return " ".join("new" if i % every == every - 1 else w for i, w in enumerate(text.split()))

    texts = [prose(rng, 200, vocab) for _ in range(6)]
    texts += [prose(rng, 50, vocab) + " " + items[i].upper() + ", " + prose(rng, 50, vocab) for i in range(4)]
    texts += [prose(rng, 30, vocab) + " " + edited(items[2], 8) + ". " + prose(rng, 10, vocab), items[1], " ".join(items[1].split()[:10])]
    texts += [items[0] + " gap " * 300 + items[3]] + [prose(rng, 20, vocab) + " " + items[2] for _ in range(5)] + [None, ""]
    got = decontaminate.contamination(make_docs(spark, texts), bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert pairs == {(6, 0), (7, 1), (8, 2), (9, 3), (10, 2), (11, 1), (13, 0), (13, 3), *((k, 2) for k in range(14, 19))}
    for r in got:
        ws = re.findall(r"[^\W_]+", texts[r["doc_id"]].lower())
        part = ws[r["start_word"] : r["end_word"]]
        item = items[r["item_id"]].split()
        assert brute_alignment(part, item) / (2 * len(item)) == pytest.approx(r["score"])
        assert r["score"] == pytest.approx(brute_alignment(ws, item) / (2 * len(item)))


@pytest.mark.parametrize("copies", [0, 3])
def test_edited_copies_are_found(spark, copies):
    """One word of every 5, 6 or 7 changed, at any phase, alone or beside exact copies: a run of 4 equal words is enough."""
    rng, vocab = random.Random(10), vocabulary()
    edits = [(every, phase) for every in (5, 6, 7) for phase in range(every)]
    items = [[f"{w}{k}" for w in rng.sample(vocab, 40)] for k in range(len(edits))]
    texts = [
        prose(rng, 20, vocab) + " " + " ".join("new" if i % every == phase or i == 38 else w for i, w in enumerate(item))
        for item, (every, phase) in zip(items, edits, strict=True)
    ]
    texts += [" ".join(item) for item in items for _ in range(copies)]
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contamination(make_docs(spark, texts), bench).collect()}
    want = {(k, k): brute_alignment(texts[k].split(), item) / 80 for k, item in enumerate(items)}
    assert min(want.values()) >= 0.5
    assert got == pytest.approx(want | {(len(items) + j, j // max(copies, 1)): 1.0 for j in range(len(items) * copies)})


def test_everyday_phrases_are_no_seeds(spark):
    """A phrase of 50 items and 500 clean texts makes no pairs; copies are found, however many there are."""
    rng, vocab = random.Random(11), [f"w{i}" for i in range(5000)]
    phrase = "what is the name of this"
    items = [prose(rng, 12, vocab) + f" {phrase} " + prose(rng, 12, vocab) for _ in range(50)]
    clean = [prose(rng, 20, vocab) + f" {phrase} " + prose(rng, 20, vocab) for _ in range(500)]
    half = [prose(rng, 5, vocab) + " " + " ".join(items[1].split()[:22]) for _ in range(120)]  # many copies of one part
    edited = [" ".join("new" if i % 6 == k else w for i, w in enumerate(items[2].split())) for k in range(6)]
    texts = [*clean, *half, *edited, *[items[2]] * 40]
    bench = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    docs = make_docs(spark, texts)
    listed = bench.select("item_id", decontaminate.normal_words(bench["text"]).alias("item")).selectExpr("*", "size(item) item_words")
    _, pairs = decontaminate._candidates(docs, listed, 4, 0.5)
    assert pairs.where("item_id NOT IN (1, 2)").count() < 50  # of 25 000; those share the word before or after the phrase too
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {*((500 + i, 1) for i in range(120)), *((620 + i, 2) for i in range(46))}


def test_long_texts_come_in_tiles(spark):
    """A long text full of seeds is cut into bounded tiles, and its best alignments are those of the whole text."""
    rng, vocab = random.Random(12), vocabulary()
    items = [prose(rng, n, vocab) for n in (12, 30)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    seeds = [" ".join(item.split()[k : k + 5]) for item in items for k in range(0, 8, 2)]
    text = " ".join(rng.choice(seeds) + " " + rng.choice(vocab) for _ in range(3000)) + " " + " ".join(items[1].split()[:27])
    docs = make_docs(spark, [text, "w " * 1_000_000])
    listed = bench.select("item_id", decontaminate.normal_words(bench["text"]).alias("item")).selectExpr("*", "size(item) item_words")
    passages, _ = decontaminate._candidates(docs, listed, 4, 0.5)
    assert passages.selectExpr("max(size(words))").first()[0] <= 3 * 2 * 30 and passages.count() > 50
    got = {r["item_id"]: r["score"] for r in decontaminate.contamination(docs, bench).where("doc_id = 0").collect()}
    ws = text.split()
    for k, item in enumerate(items):
        (score, _, _), = decontaminate.local_alignments([ws], [item.split()])
        assert got.get(k, 0) == pytest.approx(score / (2 * len(item.split())))
    assert 1 in got


def test_contamination_edges(spark, hard_docs, no_docs, monkeypatch):
    bench = spark.createDataFrame([(i, w) for i, w in enumerate(["a line of text here", "For For For For For", None])], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(hard_docs, bench).collect()}
    assert got == {(13, 0), (14, 0), (11, 1), (12, 1)}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 4)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(hard_docs, bench).collect()} == got
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert decontaminate.contamination(hard_docs, bench.where("item_id > 5")).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("mail jo.doe [at] mail1 [dot] example [dot] com now", ["jo.doe [at] mail1 [dot] example [dot] com"]),
        ("write to anna at mail dot example dot org please", ["anna at mail dot example dot org"]),
        ("name(at)host(dot)com", ["name(at)host(dot)com"]),
        ("call plus one five five five two three four five six seven eight please", ["plus one five five five two three four five six seven eight"]),
        ("ip one nine two dot one six eight dot one dot one", ["one nine two dot one six eight dot one dot one"]),
        ("jо@mail.example.com", ["jо@mail.example.com"]),
        ("１９２．１６８．１．１ ok", ["１９２．１６８．１．１"]),
        ("card 4111–1111–1111–1111.", ["4111–1111–1111–1111"]),
        ("he looked at dot com dot net", []),
        ("one two three and one more of two", []),
        ("look at the dot on it", []),
    ],
)
def test_disguises(text, spans):
    base, found = private_data.private_spans(text)
    assert [text[a:b] for _, a, b in found] == spans
    assert not any(base.values())


def test_base_spans_stay_as_they_are():
    text = "x a.b@c.d.e@f.gh 300.1.1.1 1.2.3.4.5 4111 1111 1111 1112 4111-1111-1111-1111 +1 (212) 555-0100 +123 jо.x@y.zz"
    base, found = private_data.private_spans(text)
    patterns = {k: p.pattern for k, p in private_data.PATTERNS.items()}
    assert [text[a:b] for a, b in base["email"]] == [m[0] for m in re.finditer(patterns["email"], text)]
    assert [text[a:b] for a, b in base["ip"]] == ["1.2.3.4"]
    assert [text[a:b] for a, b in base["card"]] == ["4111-1111-1111-1111"] or len(base["card"]) == 0
    assert {(k, *s) for k in base for s in base[k]} <= set(found)


def test_emails_are_the_patterns(spark):
    rng = random.Random(2)
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(3000):
        text = "".join(rng.choice("a.@-b 1") for _ in range(rng.randint(1, 25)))
        assert private_data.identifiers(text)["email"] == [m.span() for m in pattern.finditer(text)]


def test_base_spans_are_the_patterns():
    """The contract's patterns as they are written, on short random texts."""
    rng = random.Random(5)
    written = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    accept = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 14 <= sum(c.isdigit() for c in m) <= 19 and private_data._luhn(re.sub("[ -]", "", m)),
        "phone": lambda m: 10 <= sum(c.isdigit() for c in m) <= 15,
    }
    for alphabet in ("1.2 a", "12.", "0123456789 -", "+1 2(3)-4.", "a.@-1+ "):
        for _ in range(2000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
            got = private_data.identifiers(text)
            for kind, pattern in written.items():
                assert got[kind] == [m.span() for m in re.finditer(pattern, text) if accept[kind](m[0])], (kind, text)


@pytest.mark.parametrize(
    "unit", ["-", "7", " ", "\n", "[", "(", "[ ", "@", "a@", ".", "1.", "a dot ", "at dot ", "a at ", "one ", "one - ", "plus ", "+1 ", "1 dot ", "a.b dot c ", "%"]
)
def test_long_runs_take_linear_time(unit):
    """A million characters of one kind behind every hint that a transducer looks for."""
    hints = "x dot y 1.1.1 one two [at] @ "
    began = time.monotonic()
    private_data.private_spans(hints + unit * (1_000_000 // len(unit)))
    assert time.monotonic() - began < 15


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("go to 10 dot 0 dot 0  dot 255 now", ["10 dot 0 dot 0  dot 255"]),
        ("300 dot 1 dot 1 dot 1", []),
        ("a1 dot 2 dot 3 dot 4", []),
        ("call jo dot x at y at z dot q dot com.", ["y at z dot q dot com"]),
        ("write a.b dot c @ d dot e dot org, not f at g dot shop", ["a.b dot c @ d dot e dot org"]),
        ("jo [ at ] x (dot) y\n{dot} com", ["jo [ at ] x (dot) y\n{dot} com"]),
    ],
)
def test_bare_words(text, spans):
    assert [text[a:b] for _, a, b in private_data.private_spans(text)[1]] == spans


def test_private_edges(hard_docs, no_docs):
    rows = private_data.private_data(hard_docs).collect()
    assert len(rows) == hard_docs.count()
    assert private_data.private_data(no_docs).count() == 0
    got = next(r for r in rows if r["doc_id"] == 18)
    assert (got["n_email"], got["n_card"], got["n_ip"], got["n_phone"]) == (1, 1, 1, 1)


# --- 9 ---------------------------------------------------------------------------------------------------------


def brute_repair(kinds):
    """Least cost over all plans: breadth first over (turn, state) with every insertion and action."""
    from functools import cache

    c = chat_repair

    @cache
    def least(i, s):
        best = 10**9
        reach = {s: 0}
        for _ in range(2):
            for x, cost in list(reach.items()):
                for y in c.LEGAL[x]:
                    if cost + c.COST_INSERT < reach.get(y, 10**9):
                        reach[y] = cost + c.COST_INSERT
        if i == len(kinds):
            return reach.get(c.ASSISTANT, 10**9)
        kind = kinds[i]
        for x, cost in reach.items():
            for y in c.LEGAL[x]:
                step = c.COST_UNKNOWN if kind == 0 else (0 if y == kind else c.COST_RELABEL)
                best = min(best, cost + step + least(i + 1, y))
        if s != c.START and kind in (0, s):
            best = min(best, c.COST_MERGE + least(i + 1, s))
        return best

    return least(0, c.START)


def plan_cost(kinds, steps):
    cost = 0
    for kind, own in zip(kinds, steps, strict=True):
        for _, action in own:
            cost += {"keep": 0, "insert": chat_repair.COST_INSERT, "merge": chat_repair.COST_MERGE}.get(
                action, chat_repair.COST_UNKNOWN if kind == 0 else chat_repair.COST_RELABEL
            )
    return cost


def legal(steps):
    s = chat_repair.START
    for own in steps:
        for t, action in own:
            if action == "merge":
                assert t == s
            else:
                assert t in chat_repair.LEGAL[s]
            s = t
    return s == chat_repair.ASSISTANT


def test_repairs_are_cheapest():
    for n in range(1, 6):
        for kinds in itertools.product(range(4), repeat=n):
            steps = chat_repair.repair(list(kinds))
            assert legal(steps)
            assert plan_cost(kinds, steps) == brute_repair(kinds)


def test_conversations_over_many_tasks(spark):
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "human", None, "x"]
    rows = [(0, t, rng.choice(roles), f"t{t}") for t in range(400)] + [(c, t, rng.choice(roles), None if t == 1 else f"m{t}") for c in range(1, 30) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "a"), (None, 1, "user", "b"), (5, 0, "user", "twice"), (5, 0, "user", "twice")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'q' part", "'q' task")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat_repair.repaired_turns(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    low = lambda v: (v is not None, v if v is not None else 0)
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (low(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        kinds = [chat_repair.role_state(r[2]) for r in own]
        mine = [r for r in got if r["conv_id"] == conv]
        cost = sum(
            {"keep": 0, "insert": chat_repair.COST_INSERT, "merge": chat_repair.COST_MERGE}.get(
                r["action"], chat_repair.COST_UNKNOWN if chat_repair.role_state(r["source_role"]) == 0 else chat_repair.COST_RELABEL
            )
            for r in mine
        )
        assert cost == plan_cost(kinds, chat_repair.repair(kinds))
        assert sum(r["action"] != "insert" for r in mine) == len(own)
        mine.sort(key=lambda r: (r["position"], r["part"]))
        assert [(r["turn"], r["source_role"]) for r in mine if r["action"] != "insert"] == [(r[1], r[2]) for r in own]
        text = "".join(r["rendered"] for r in mine)
        assert text.count("<|end|>") == sum(r["action"] != "merge" for r in mine)
        assert text.startswith("<|") and text.endswith("<|end|>\n")
        assert re.fullmatch(r"(system)?(userassistant)+", "".join(re.findall(r"<\|(system|user|assistant)\|>", text)))
    assert chat_repair.repaired_turns(frame.where("conv_id < 0")).count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------


def brute_components(rows, n, num, den):
    sets = []
    for i, text in rows:
        ws = split_words((text or "").translate(LOWER))
        s = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())
        sets.append((i, s))
    name = {i: i for i, _ in sets}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
            x, y = sorted((find(i), find(j)))
            name[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


@pytest.mark.parametrize(("frequent", "n", "num"), [(6, 5, 80), (1, 4, 85), (1, 3, 60), (2, 4, 85), (30, 4, 85)])
def test_components(spark, monkeypatch, frequent, n, num):
    """Also with nearly all tokens frequent, so that pairs of tokens decide."""
    monkeypatch.setattr(jaccard_join, "FREQUENT_CLASS", frequent)
    rng, vocab = random.Random(frequent), vocabulary(120)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.choice([3, 8, 30, 120, 400]), vocab).split()
        for _ in range(rng.choice([1, 2, 3, 12])):
            ws = list(base)
            for _ in range(int(len(ws) * rng.choice([0, 0, 0.01, 0.03, 0.06, 0.1]))):
                k = rng.randrange(len(ws))
                ws[k : k + rng.choice([0, 1])] = [rng.choice(vocab)]
            texts.append(" ".join(ws))
    passage = prose(rng, 60, vocab)
    texts += [passage + " " + prose(rng, rng.randint(1, 30), vocab) for _ in range(25)]
    texts += [None, "", " ", "a b", "A B", "a b c", "For " * 50, "For " * 70]
    rng.shuffle(texts)
    ids = list(range(len(texts)))
    ids[3], ids[8] = ids[7], None
    got = jaccard_join.similar_components(make_docs(spark, texts, ids), n, (num, 100)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(list(zip(ids, texts, strict=True)), n, num, 100)


def test_component_edges(hard_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.collect()]
    got = jaccard_join.similar_components(hard_docs).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, 5, 80, 100)
    assert jaccard_join.similar_components(no_docs).count() == 0


def test_extra_columns_are_ignored(hard_docs):
    assert set(CLASHING) < set(hard_docs.columns)
