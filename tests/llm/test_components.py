import random

import pytest

from auditspark.llm.components import components


def by_hand(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def shapes():
    rnd = random.Random(5)
    star = [(7, k) for k in range(100, 400)]
    path = [(k, k + 1) for k in range(1000, 1060)]
    loose = [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(220)]
    return star + path + loose + [(None, 3), (3, None), (5, 5), (7, 100)]


@pytest.mark.parametrize("limit", ["10485760", "-1"])
def test_components_with_a_hub(spark, limit):
    """Small lookups are broadcast; with -1 the hub and its root are salted keys."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        edges = shapes()
        found = components(spark.createDataFrame(edges, "a long, b long"))
        assert {r["node"]: r["root"] for r in found.collect()} == by_hand(edges)
        assert found.count() == len(by_hand(edges))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_edges(spark):
    assert components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).collect() == []
