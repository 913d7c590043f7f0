"""The set-similarity join against all pairs."""

from __future__ import annotations

import random

import pytest

from evispark.operators.graph import connected_components
from evispark.operators.similarity import covering_links, placed_items, verified


def brute(sets, share):
    """Components of all pairs that cover each other."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = sum(w for x, w in sets[a].items() if x in sets[b])
            if both and 100 * both >= share * max(sum(sets[a].values()), sum(sets[b].values())):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def components(spark, sets, share, **options):
    rows = [(i, x, w) for i, s in sets.items() for x, w in s.items()]
    links = covering_links(spark.createDataFrame(rows, "id long, item string, weight long"), share, **options)
    for r in links.collect():  # every link is one
        both = sum(w for x, w in sets[r.a].items() if x in sets[r.b])
        assert r.a < r.b and r.covered == pytest.approx(100 * both / max(sum(sets[r.a].values()), sum(sets[r.b].values()))) and r.covered >= share
    nodes = spark.createDataFrame([(i,) for i in sets], "id long")
    return {r.id: r.component for r in connected_components(nodes, links, "id", "a", "b").collect()}


def weigh(items):
    return {x: 5 + len(x) * 7 % 11 for x in items}


@pytest.mark.parametrize("small", [2, 6, 200])
def test_links_connect_what_all_pairs_connect(spark, small):
    rng = random.Random(3)
    pool = [f"common {i}" for i in range(12)]
    sets = {}
    for i in range(90):  # sets of common items in many mixtures, some with items of their own
        items = rng.sample(pool, rng.randrange(2, 8)) + [f"own {i} {k}" for k in range(rng.choice([0, 0, 1, 4]))]
        sets[i] = weigh(items)
    for group in range(3):  # near copies with an item changed each
        base = [f"g{group} {k}" for k in range(12)]
        for k in range(15):
            sets[200 + 20 * group + k] = weigh([x for n, x in enumerate(base) if n != k % 12] + [f"new {group} {k}"])
    for i in range(10):  # a chain, each linked with the next only
        sets[400 + i] = weigh([f"chain {i + k}" for k in range(4)])
    for share in (60, 80):
        assert components(spark, sets, share, small=small) == brute(sets, share)


def test_one_set_and_none(spark):
    assert components(spark, {1: {"a": 3}}, 60) == {1: 1}
    empty = spark.createDataFrame([], "id long, item string, weight long")
    assert covering_links(empty, 60).count() == 0
    odd = spark.createDataFrame([(1, "a", 2), (1, "a", 3), (1, None, 9), (None, "a", 3), (2, "a", 3), (3, "b", None)], "id long, item string, weight long")
    assert [(r.a, r.b, r.covered) for r in covering_links(odd, 60).collect()] == [(1, 2, 100.0)]


def test_a_hot_item_is_split_instead_of_paired(spark):
    """An item in every third set that makes up most of it: comparisons grow with the sets, not with their pairs."""
    def cost(n):
        sets = [(i, f"pair {i // 2}", 9) for i in range(n)] + [(i, "hot", 10) for i in range(n)] + [(i, f"own {i}", 2) for i in range(n)]
        frame = spark.createDataFrame(sets, "id long, item string, weight long")
        compared = []
        from evispark.operators import similarity

        def counted(pairs, placed, share, real=verified):
            compared.append(pairs.count())
            return real(pairs, placed, share)

        similarity.verified, before = counted, similarity.verified
        try:
            links = {(r.a, r.b) for r in similarity.covering_links(frame, 70, small=20).collect()}
        finally:
            similarity.verified = before
        assert links == {(i, i + 1) for i in range(0, n, 2)}
        return sum(compared)

    assert cost(800) <= 2.5 * cost(400)


def test_placed_items_know_what_is_rarer(spark):
    frame = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (2, "b", 3)], "id long, item string, weight long")
    got = {(r.id, r.item): (r.often, r.rarer, r.total) for r in placed_items(frame).collect()}
    assert got == {(1, "a"): (1, 0, 5), (1, "b"): (2, 2, 5), (2, "b"): (2, 0, 3)}
