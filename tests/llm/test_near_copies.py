"""Verified pairs of the Jaccard join grow with the copies, not with their pairs."""

import random

import numpy as np
from conftest import make_docs, prose, vocabulary

from tidemark.llm import jaccard_join


def verified_pairs(spark, monkeypatch, texts):
    seen = []
    plain = jaccard_join._verified

    def counted(pairs, sets, t):
        seen.append(pairs.count())
        return plain(pairs, sets, t)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(make_docs(spark, texts)).collect()}
    monkeypatch.setattr(jaccard_join, "_verified", plain)
    return sum(seen), got


def test_near_copies(spark, monkeypatch):
    rng, vocab = random.Random(9), vocabulary(4000)
    base = prose(rng, 300, vocab).split()
    figures = []
    for n in (100, 400):
        texts = []
        for _ in range(n):
            words = list(base)
            words[rng.randrange(300)] = f"x{rng.random()}"
            texts.append(" ".join(words))
        pairs, got = verified_pairs(spark, monkeypatch, texts)
        assert set(got.values()) == {0}
        figures.append(pairs)
    # Two others a round at most for each that lies apart; all pairs are 4 950 and 79 800.
    assert figures[1] <= 6 * figures[0] and figures[1] <= 5 * 400, figures


def test_common_blocks_are_not_verified_pair_by_pair(spark, monkeypatch):
    """Texts that share 50 of 55 words at one end: none link, the bounds drop nearly all pairs."""
    rng, vocab = random.Random(10), vocabulary(4000)
    block = prose(rng, 50, vocab)
    texts = [block + " " + " ".join(f"own{rng.random()}" for _ in range(12)) for _ in range(200)]
    pairs, got = verified_pairs(spark, monkeypatch, texts)
    assert got == {i: i for i in range(200)} and pairs < 2000


def test_marks_tell_sets_that_differ_in_little_more_than_a_link_allows():
    """Two sets of 400 tokens that link at 0.85 differ in 64 tokens at most; marks of pairs that differ in 80 have to show it."""
    rng = np.random.default_rng(11)
    base = rng.choice(1 << 48, 400, replace=False).astype(np.uint64)
    for differ, low, high in ((0, 0, 0), (20, 0, 20), (64, 0, 64), (80, 65, 80), (80, 65, 80), (120, 65, 120)):
        part = rng.permutation(base)
        other = np.concatenate([part[differ // 2 :], rng.choice(1 << 48, differ // 2, replace=False).astype(np.uint64)])
        bits = sum(int(x).bit_count() for x in (jaccard_join._marks(base) ^ jaccard_join._marks(other)).view(np.uint64))
        assert low <= bits <= high, (differ, bits)
