"""Components of long chains take few rounds."""

import random

from tidemark.llm import common


def test_chains_stars_and_groups(spark, monkeypatch):
    rng = random.Random(3)
    ids = list(range(0, 12000, 4))
    rng.shuffle(ids)
    chain, star, rest = ids[:1500], ids[1500:2000], ids[2000:]
    links = [*zip(chain, chain[1:], strict=False), *((star[0], x) for x in star[1:]), *((rng.choice(rest), rng.choice(rest)) for _ in range(800)), (5, 5)]
    name = {x: x for link in links[:-1] for x in link if link[0] != link[1]}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((root(a), root(b)))
            name[high] = low
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(3).cache()
    plain, rounds = common.cut, []
    monkeypatch.setattr(common, "cut", lambda df: rounds.append(1) or plain(df))
    for held, most in ((common.HELD, 2), (40, 24)):  # a label that walks from neighbour to neighbour takes over 100 rounds
        monkeypatch.setattr(common, "HELD", held)
        rounds.clear()
        got = common.components(frame).collect()
        assert len(got) == len(name) and {r["node"]: r["component"] for r in got} == {x: root(x) for x in name}
        assert len(rounds) <= most, rounds
    text = frame.where("a <> b").selectExpr("concat('n', a) AS a", "concat('n', b) AS b")
    assert common.components(text).select("component").distinct().count() == len({root(x) for x in name})
    assert common.components(frame.limit(0)).count() == 0
