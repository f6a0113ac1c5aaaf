"""Shared helpers of the subpackage."""

import random

from loomline.llm.common import connected_components, free_name, numbered_columns


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 164)] + [(7, k) for k in range(200, 230)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(70)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(df.limit(0)).count() == 0


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "A int, a_ int")
    assert free_name(df, "a") == "a__" and free_name(df, "b") == "b"
    plain, at = numbered_columns(df)
    assert plain.columns == ["c0", "c1"] and at == {"A": "c0", "a_": "c1"}


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    import time

    from pyspark.sql import functions as F

    from loomline.session import durable

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def blocks():
        found = disk.getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), blocks()
    rows = durable(spark.range(10_000).groupBy((F.col("id") % 1_000).alias("k")).count())
    until = time.time() + 20
    while blocks() - before and time.time() < until:
        time.sleep(0.2)
    assert not blocks() - before
    assert rows.agg(F.sum("count")).first()[0] == 10_000 and spark.conf.get(key) == setting
