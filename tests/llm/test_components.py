"""Connected components against plain union-find."""

import random

import pytest

from paneloom.llm import components as module
from paneloom.llm.components import components


def plain(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def shuffled_chain(n, rng):
    names = rng.sample(range(10 * n), n)
    return list(zip(names, names[1:]))


@pytest.mark.parametrize("kind", ["none", "loops", "chain", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(4)
    links = {
        "none": [], "loops": [(1, 1), (5, 5)], "chain": shuffled_chain(150, rng), "star": [(700, i) for i in range(300)],
        "random": [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(350)],
    }[kind]
    found = {r.node: r.root for r in components(spark.createDataFrame(links * 2, "a long, b long")).collect()}
    assert found == plain([x for x in links if x[0] != x[1]])


@pytest.mark.parametrize("most", [0, 20_000])
def test_tables_of_a_round(spark, monkeypatch, most):
    """A star and a chain, by shuffles and by broadcasts; a round writes each table once."""
    monkeypatch.setattr(module, "BROADCAST_LINKS", most)
    links = [(7, i) for i in range(20, 60)] + shuffled_chain(30, random.Random(6))
    rows = spark.createDataFrame(links, "a long, b long")
    written = []

    def counted(df):
        written.append(df.columns)
        return settle(df)

    settle = module.settle
    monkeypatch.setattr(module, "settle", counted)
    found = {r.node: r.root for r in components(rows).collect()}
    assert found == plain(links)
    rounds = written.count(["hi", "lo"]) // 2
    assert len(written) == 1 + rounds * (2 if most else 4)
