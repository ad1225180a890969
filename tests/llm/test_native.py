"""Operators 1, 6 and 7 against plain Python."""

import hashlib
import re

import numpy as np
from conftest import make_docs, prose, vocabulary

from tidemark.llm import licenses, line_dedup, outliers

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeat_words(ws):
    windows = {}
    for i in range(len(ws) - 7):
        windows.setdefault(tuple(ws[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(covered)


def test_statistics(hard_docs, hard_texts):
    got = {r["doc_id"]: r for r in outliers.quality_verdicts(hard_docs.where("doc_id <> 5 and doc_id <> 9")).collect()}
    for i, text in enumerate(hard_texts):
        if i in (5, 9):
            continue
        ws = split_words(text)
        lines = [x for x in (text or "").split("\n") if x.strip(WHITE)]
        r = got[i]
        assert r["n_words"] == len(ws)
        assert r["word_chars"] == sum(map(len, ws))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeat_words(ws)
        failed = len(ws) < 20 or 100 * repeat_words(ws) > 30 * len(ws)
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])


def test_every_row_is_judged(hard_docs, no_docs):
    assert outliers.quality_verdicts(hard_docs).count() == hard_docs.count()
    assert outliers.quality_verdicts(no_docs).count() == 0


def test_outliers_go_and_the_rest_stays(spark):
    import random

    rng, vocab = random.Random(1), vocabulary()
    clean = [prose(rng, rng.randint(60, 400), vocab) for _ in range(600)]
    junk = [" ".join(w + "###$$$" for w in prose(rng, 100, vocab).split()) for _ in range(60)]
    docs = make_docs(spark, clean + junk).drop("lang", "source").selectExpr("*", "'en' lang", "'s' source")
    kept = {r["doc_id"] for r in outliers.quality_verdicts(docs).where("kept").collect()}
    assert kept == set(range(600))


def test_short_junk_goes_like_long_junk(spark):
    """Words split by bars, and words said several times over, in texts of any length."""
    import random

    rng, vocab = random.Random(4), vocabulary()
    clean = [prose(rng, rng.randint(25, 400), vocab) for _ in range(600)]
    bars = [" | ".join(rng.sample(vocab, n)) for n in (15, 25, 30, 40, 200) for _ in range(6)]
    said = [" ".join(w for x in rng.sample(vocab, n) for w in [x] * 7) for n in (4, 6, 10, 40) for _ in range(6)]
    docs = make_docs(spark, clean + bars + said).drop("lang", "source").selectExpr("*", "'en' lang", "'s' source")
    got = outliers.quality_verdicts(docs).where("NOT base_failed")
    assert {r["doc_id"] for r in got.where("kept").collect()} == set(range(600))
    assert {r["n_again_words"] for r in got.where(f"doc_id >= {600 + len(bars)}").collect()} == {24, 36, 60, 240}


def test_few_groups_and_many_give_the_same(spark, monkeypatch):
    import random

    rng, vocab = random.Random(2), vocabulary()
    docs = make_docs(spark, [prose(rng, rng.randint(30, 90), vocab) for _ in range(300)])
    a = outliers.quality_verdicts(docs, min_group=40).select("doc_id", "kept", "distance2").toPandas().sort_values("doc_id")
    monkeypatch.setattr(outliers, "FEW_GROUPS", 0)
    b = outliers.quality_verdicts(docs, min_group=40).select("doc_id", "kept", "distance2").toPandas().sort_values("doc_id")
    assert (a["kept"].values == b["kept"].values).all()
    assert np.allclose(a["distance2"].values, b["distance2"].values, equal_nan=True)


def test_distances_are_those_of_a_direct_estimate(spark):
    """The final support is a fixed point: re-estimating from it gives the same distances."""
    import random

    rng, vocab = random.Random(3), vocabulary()
    docs = make_docs(spark, [prose(rng, rng.randint(60, 400), vocab) for _ in range(400)]).drop("lang", "source").selectExpr("*", "'en' lang", "'s' source")
    out = outliers.quality_verdicts(docs).toPandas()
    x = out[list(outliers.FEATURES)].values
    floor = np.diag(np.square(list(outliers.FEATURES.values())))
    bins = np.floor(np.log(np.maximum(out["distance2"].values, 1e-6)) * 32)
    inside = x[bins <= np.ceil(np.percentile(bins, 75))]
    cov = np.cov(inside.T, bias=True) + floor
    d = x - inside.mean(0)
    d2 = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    assert np.corrcoef(out["distance2"].values, d2)[0, 1] > 0.999


def test_license_base(hard_docs, hard_texts, no_docs):
    got = {r["doc_id"]: r for r in licenses.license_scan(hard_docs.where("doc_id <> 5 and doc_id <> 9")).collect()}
    assert licenses.license_scan(no_docs).count() == 0
    assert licenses.license_scan(hard_docs).count() == hard_docs.count()
    for i, text in enumerate(hard_texts):
        if i in (5, 9):
            continue
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        places = sorted(
            (k, label)
            for phrase, label in licenses.BASE.items()
            for k in range(len(ws))
            if ws[k : k + len(phrase.split())] == phrase.split()
        )
        assert got[i]["n_words"] == len(ws)
        assert sorted((b["start"], b["label"]) for b in got[i]["base"]) == places


def test_license_rules_and_suppression(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0 (the License)", "SPDX-License-Identifier: MIT", "CC BY-NC-SA 4.0", "cc by, cc by",
        "permission is hereby granted, free of charge, to any person obtaining a copy of it", "no licence words at all", "Copyright (c) 2020 X. All rights reserved.",
        "GNU GPL v3 and the GNU General Public License version 2", "copyright 2019 2020 " * 30,
    ]
    rows = {r["doc_id"]: r["found"] for r in licenses.license_scan(make_docs(spark, texts)).collect()}
    labels = [sorted({d["label"] for d in rows[i] or []}) for i in range(len(texts))]
    assert labels[0] == ["apache-2.0"] and labels[1] == ["mit"] and labels[2] == ["cc-by-nc-sa-4.0"] and labels[3] == ["cc-by"]
    assert labels[4] == ["mit"] and labels[5] == [] and labels[6] == ["copyright", "reserved"] and labels[7] == ["gpl-2.0", "gpl-3.0"]
    assert len(rows[3]) == 2
    for found in rows.values():
        for a in found or []:
            for b in found or []:
                if a != b:
                    assert not (b["start"] <= a["start"] and a["end"] <= b["end"] and b["priority"] >= a["priority"])


def test_rules_hold_their_keywords():
    listed = list(licenses.rules())
    assert len(listed) >= 300
    for keyword, regex, _, _, _ in listed:
        assert keyword in licenses.KEYWORDS
        assert re.compile(regex)
    assert licenses.anchor(r" (?:a|b(?: c)?) public licen[cs]e v(?:ersion)? ?2") == " public licen"
    assert licenses.anchor(r" no rights? reserved") == " no right"


def brute_lines(rows):
    """kept text per row: keys in at least two documents stay in the smallest one alone."""
    def key(line):
        return line.strip(WHITE).translate(LOWER)

    holders = {}
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        keep = [x for x in (text or "").split("\n") if i is None or len(key(x)) < 10 or min(holders[key(x)]) == i]
        out.append((i, "\n".join(keep)))
    return out


def test_line_dedup(hard_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.collect()]
    marked = line_dedup.deduplicated(hard_docs)
    from pyspark.sql import functions as F

    text = F.when(F.col("keep").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(line_dedup.kept_text(F.col("row.text"), F.col("keep")))
    got = [(r["doc_id"], r["t"]) for r in marked.select("row.doc_id", text.alias("t")).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest())
    assert sorted(got, key=order) == sorted(brute_lines(rows), key=order)
    assert line_dedup.keep_bitmaps(no_docs).count() == 0


def test_bitmaps_round_trip(hard_docs):
    bitmaps = line_dedup.keep_bitmaps(hard_docs.where("doc_id IS NOT NULL")).collect()
    assert all(sum(b["keep"]) == b["n_lines"] for b in bitmaps)
    assert any(len(b["keep"]) > 1 for b in bitmaps)


def test_hot_lines_go_the_other_way(spark, monkeypatch):
    texts = [f"the very common line\nown line number {i} of it\n{'shared by some of them' if i % 3 else 'x'}" for i in range(60)]
    docs = make_docs(spark, texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    for share in (1 / 512, 2.0, 1 / 8):
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        gone = {(r["doc_id"], r["pos"]) for r in line_dedup.dropped_lines(docs).collect()}
        kept = ["\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows]
        assert kept == [t for _, t in brute_lines(rows)]
