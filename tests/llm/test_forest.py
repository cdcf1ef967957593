import random

import pytest

from sparkloom.llm import forest


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {x: find(x) for x in up if find(x) != x}


@pytest.mark.parametrize("each", [50_000, 20])
def test_components_against_plain_union(spark, monkeypatch, each):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 540)]
    edges += [(-7, -7), (2**62, -(2**62)), (2**62, 41), (600, 601), (600, 601)]
    buckets = forest.buckets_for
    monkeypatch.setattr(forest, "buckets_for", lambda df, n: buckets(df, n, each, 60))
    monkeypatch.setattr(forest, "HOLD", 10)
    monkeypatch.setattr(forest, "CHUNK", 7)
    got = {r.node: r.root for r in forest.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == plain(edges)


def test_a_hub_and_a_long_path(spark):
    edges = [(1_000_000, k) for k in range(2000)] + [(5_000 + k, 5_001 + k) for k in range(3000)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in forest.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == plain(edges[:0]) | {k: 0 for k in [*range(1, 2000), 1_000_000]} | {5_000 + k: 5_000 for k in range(1, 3001)}


def test_no_edges(spark):
    assert forest.components(spark.createDataFrame([], "a long, b long")).count() == 0
