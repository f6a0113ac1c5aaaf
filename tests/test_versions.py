"""Versions in order, and the schemas that ranges give them."""

import random
import re

from pyspark.sql import functions as F

from loomline.functions import versions as V

# In order, as published for semantic versions.
ORDERED = ["0.0.1", "0.128.0-alpha", "0.128.0-alpha.1", "0.128.0-alpha.beta", "0.128.0-beta", "0.128.0-beta.2", "0.128.0-beta.11", "0.128.0-rc.1", "0.128.0", "0.128.4", "0.129.0-0", "0.129.0", "1.0.0-synthetic", "1.0.0", "1.2.10", "2.0.0-x", "2.0.0", "3.0.0", "3.9.9", "4.0.0-pre", "4.0.0", "10.0.0"]


def test_order_is_that_of_versions(spark):
    rng = random.Random(1)
    shuffled = rng.sample(ORDERED, len(ORDERED))
    df = spark.createDataFrame([(v,) for v in shuffled], "v string")
    assert [r["v"] for r in df.orderBy(V.parsed("v")).collect()] == ORDERED == sorted(ORDERED, key=V.version)


def test_shapes(spark):
    shapes = {"0.128.4": "v0.128", " v0.128.1 ": "v0.128", "0.128.0-alpha.1": "v0.128", "0.99.0": "v0.128", "codex 0.128": "v0.128", "": "v0.128", "none": "v0.128", "0.128.2+build.5": "v0.128", "99999999999999999.1.1": "v0.128"}
    df = spark.createDataFrame([("codex", v) for v in shapes] + [("codex", None), ("other", "1.0.0"), ("pi", "3"), ("claude-code", "1.0.0-synthetic"), (None, "1")], "a string, v string")
    got = {(r["a"], r["v"]): r["s"] for r in df.withColumn("s", V.schema_version("a", "v")).collect()}
    assert all(got["codex", v] == s for v, s in shapes.items())
    assert (got["codex", None], got["other", "1.0.0"], got["pi", "3"], got["claude-code", "1.0.0-synthetic"], got[None, "1"]) == (None, None, "v1", "v1", None)
    assert spark.range(1).select(V.schema_version(F.lit("pi"), F.lit(3)).alias("s")).first()["s"] == "v1"


def test_many_ranges_equal_a_scan(spark):
    """The first range that holds the version, also where ranges overlap, touch, or leave gaps."""
    rng = random.Random(7)
    ranges = [("a", ">=0.128.0 <0.129.0"), ("b", ">0.128.4 <=1.0.0 || =10.0.0"), ("c", "<0.128.0-beta"), ("d", ">=2.0.0-0 <3.0.0"), ("e", ">=1.2.10"), ("f", "0.129.0")]
    for _ in range(6):
        some = V.Ranges(tuple(rng.sample(ranges, rng.randint(1, len(ranges)))), rng.choice(["z", None]))

        def holds(text, v):
            sign = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "": lambda a, b: a == b}
            return any(all(sign[op](V.version(v), V.version(x)) for op, x in re.findall(r"(>=|<=|>|<|=)?\s*([^\s<>=]+)", clause)) for clause in text.split("||"))

        want = {v: next((s for s, text in some.ranges if holds(text, v)), some.fallback) for v in ORDERED}
        df = spark.createDataFrame([("x", v) for v in ORDERED], "a string, v string")
        assert {r["v"]: r["s"] for r in df.withColumn("s", V.schema_version("a", "v", {"x": some})).collect()} == want
