import random

import pytest

from scoreloom.llm.components import components


def brute(links):
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    lone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    return {x: find(x) for x in parent if x not in lone}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_same_as_union_find(spark, kind):
    rng = random.Random(1)
    nodes = list(range(60))
    rng.shuffle(nodes)
    links = {
        "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)],
        "chain": [(a, b) for a, b in zip(nodes, nodes[1:])],
        "star": [(nodes[0], x) for x in nodes[1:]] * 2 + [(5, 5)],
    }[kind]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == brute(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "x binary, y binary")).count() == 0
