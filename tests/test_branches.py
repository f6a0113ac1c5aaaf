"""Roots of abandoned branches and active paths, against walks from node to node."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import graph


def path(start, parents):
    out = []
    while start in parents and start not in out:
        out.append(start)
        start = parents[start]
    return out[::-1]


def root_of(start, active, parents, entry):
    def nearest():
        for node in path(start, parents)[::-1] or [start]:
            if entry.get(node) is not None:
                return entry[node]
        return start

    one, two = path(start, parents), path(active, parents) if active is not None else []
    i = 0
    while i < min(len(one), len(two)) and one[i] == two[i]:
        i += 1
    if not two or not one or i == 0 or i >= len(one):
        return nearest()
    return next((entry[n] for n in one[i:] if entry.get(n) is not None), None) or nearest()


@pytest.mark.parametrize("seed", range(4))
def test_roots_and_paths(spark, seed):
    """Trees, forests, long chains, cycles with tails, missing parents, and nodes that became nothing."""
    rng = random.Random(seed)
    nodes, pairs, leaves = [], [], []
    for s in range(12):
        n = rng.choice([1, 2, 9, 30])
        shape = rng.choice(["tree", "chain", "any", "any"])
        parents = {f"n{i}": (None if i == 0 else f"n{rng.randint(max(0, i - 3), i - 1)}") if shape == "tree" else (f"n{i - 1}" if i else None) if shape == "chain" else rng.choice([None, "gone", *[f"n{rng.randint(0, n - 1)}" for _ in range(8)]]) for i in range(n)}
        share = rng.choice([0.0, 0.3, 1.0])
        entry = {k: f"e{k}" if rng.random() < share else None for k in parents}
        nodes += [(s, k, p, entry[k]) for k, p in parents.items()]
        names = [*parents, "missing"]
        some = {(rng.choice(names), rng.choice([None, *names, *names])) for _ in range(25)}
        pairs += [(s, a, b, root_of(a, b, parents, entry)) for a, b in some]
        leaves += [(s, x, [(y, i) for i, y in enumerate(path(x, parents)[::-1])]) for x in rng.sample(names, min(3, len(names)))]
    df = spark.createDataFrame(nodes, "s int, id string, parent_id string, entry string")
    asked = spark.createDataFrame([p[:3] for p in pairs], "s int, abandoned string, active string")
    assert sorted(map(str, (tuple(r) for r in graph.branch_roots(df, asked, ["s"]).collect()))) == sorted(map(str, pairs))
    got = graph.active_paths(df, spark.createDataFrame([x[:2] for x in leaves], "s int, leaf string"), ["s"]).collect()
    assert sorted(map(tuple, got)) == sorted((s, leaf, y, i) for s, leaf, walk in leaves for y, i in walk)


def test_no_pairs_and_no_parents(spark):
    df = spark.createDataFrame([("a", None, None)], "id string, parent_id string, entry string").selectExpr("1 as s", "*")
    asked = spark.createDataFrame([(1, "a", "a")], "s int, abandoned string, active string")
    assert [r["root"] for r in graph.branch_roots(df, asked, ["s"]).collect()] == ["a"]
    assert graph.branch_roots(df, asked.limit(0), ["s"]).count() == 0 and graph.branch_roots(df.limit(0), asked, ["s"]).first()["root"] == "a"


def test_no_table_of_a_forest_goes_through_the_driver(spark):
    nodes = spark.range(1, 40).select(F.lit(0).alias("tree"), "id", F.expr("nullif(id div 3, 0)").alias("parent_id"))
    forest = graph.Forest(nodes, ["tree"])
    rows = forest.lifted(forest.joined(nodes, "id", forest.depth, depth="d"), "id", "d")
    rows.collect()
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert all(r["id"] in (1, 2) for r in rows.collect())


def test_small_scopes_need_no_forest(spark, monkeypatch):
    """Scopes of up to SMALL nodes are walked; of the same rows larger ones give the same by jumps."""
    rng = random.Random(9)
    nodes = [(s, i, rng.choice([i - 1, i - 2, None, rng.randint(0, n)]), f"e{i}" if i % 3 else None) for s, n in enumerate([1, 3, 12, 12]) for i in range(n)]
    df = spark.createDataFrame(nodes, "s int, id long, parent_id long, entry string")
    asked = df.select("s", F.col("id").alias("abandoned"), F.lit(0).cast("long").alias("active")).unionByName(spark.createDataFrame([(9, 1, 1), (None, 2, 1)], "s int, abandoned long, active long"))
    leaves = df.select("s", F.col("id").alias("leaf"))
    both = lambda: [sorted(map(str, map(tuple, f.collect()))) for f in (graph.branch_roots(df, asked, ["s"]), graph.active_paths(df, leaves, ["s"]))]
    monkeypatch.setattr(graph, "SMALL", 3)
    mixed = both()
    monkeypatch.setattr(graph, "SMALL", 512)
    monkeypatch.setattr(graph, "Forest", None)
    assert both() == mixed
