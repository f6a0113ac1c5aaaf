"""Leaves of records, secrets in them, and redaction that leaves clean records alone."""

import json
import random
import re

from pyspark.sql import functions as F

from loomline.operators import leaves, redact

KEY = "sk-" + "abcdefghij0123456789"


def walk(value, path=""):
    if isinstance(value, (dict, list)) and value:
        for k, x in value.items() if isinstance(value, dict) else enumerate(value):
            yield from walk(x, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}")
    else:
        yield path, value


def some_values(seed, n=60):
    rng = random.Random(seed)

    def value(level):
        x = rng.random()
        if level > 0 and x < 0.35:
            return {rng.choice(["a", "b", "k~/x", "é", "", "q\"[", "{"]) + str(i): value(level - 1) for i in range(rng.randint(0, 4))}
        if level > 0 and x < 0.6:
            return [value(level - 1) for _ in range(rng.randint(0, 4))]
        return rng.choice([None, True, 7, 2.5, "", "plain", "x [y] {z} \"q\"", f"key {KEY}", f"{KEY} and AKIA{'Q' * 16} twice {KEY}", "AKIA\u0041" + "B" * 15, "C:\\Users\\me", "a/b@c.org", "Bearer\n" + "t" * 20])

    return [value(rng.randint(0, 6)) for _ in range(n)]


def test_leaves_equal_a_walk(spark):
    values = some_values(1)
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, "no json")], "i int, t string").withColumn("v", F.try_parse_json("t"))
    got = sorted((r["i"], r["path"], r["j"]) for r in leaves.leaves(df, "v", ["i"], "/r").select("i", "path", F.coalesce(F.to_json("leaf"), F.lit("null")).alias("j")).collect())
    assert [(i, p, json.loads(j)) for i, p, j in got] == sorted(((i, p, x) for i, v in enumerate(values) for p, x in walk(v, "/r")), key=lambda x: x[:2])
    assert leaves.leaves(df.limit(0), "v", ["i"]).count() == 0
    depths = {r["i"]: r["d"] for r in df.select("i", leaves.depth(F.col("t")).alias("d")).collect()}
    deep = lambda v: 1 + max(map(deep, v.values() if isinstance(v, dict) else v), default=0) if isinstance(v, (dict, list)) else 0
    assert all(depths[i] == deep(v) for i, v in enumerate(values))


def test_secrets_equal_a_walk(spark):
    """However a string is written in JSON; clean records, and texts that only look like a match across strings, have none."""
    values = some_values(2) + [{"a": "AKIA", "b": "Q" * 16}]
    texts = [json.dumps(v, ensure_ascii=i % 2 == 0) for i, v in enumerate(values)] + ['{"x":"\\u0041KIA' + "Z" * 16 + '"}', '["hooks.slack.com\\/services\\/' + "T" * 24 + '"]']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("v", F.try_parse_json("t"))
    want = sorted((i, p, name) for i, t in enumerate(texts) for p, x in walk(json.loads(t)) if isinstance(x, str) for name, pattern, _ in redact.CREDENTIALS if re.search(pattern, x))
    assert sorted(map(tuple, leaves.secrets(df, "v", ["i"]).collect())) == want and len(want) > 20


def test_values_are_redacted_where_they_match(spark):
    values = some_values(3)
    texts = [json.dumps(v) + " " for v in values] + ['{"x":"\\u0041KIA' + "Z" * 16 + '"}', "no json sk-" + "a" * 20, None]
    got = {r["i"]: r["t"] for r in leaves.redacted_values(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").collect()}

    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        if isinstance(v, list):
            return [clean(x) for x in v]
        for _, pattern, put in redact.CREDENTIALS if isinstance(v, str) else ():
            v = re.sub(pattern, lambda _, put=put: put, v)
        return v

    for i, v in enumerate(values):
        assert got[i] == texts[i] if clean(v) == v else json.loads(got[i]) == clean(v)
    assert json.loads(got[len(values)]) == {"x": "[AWS_ACCESS_KEY]"} and got[len(values) + 1] == texts[-2] and got[len(values) + 2] is None


def test_records_without_a_find_stay_out_of_python(spark):
    lines = [{"type": "user_message", "payload": {"text": "clean"}}, {"type": "user_message", "payload": {"text": f"my {KEY}"}}, {"type": "session", "vcs": {"remote_url": "https://x/y"}}, {"type": "tool_result", "payload": {"output": "o" * 20_000}}]
    df = spark.createDataFrame([(f"f{i}", json.dumps(r)) for i, r in enumerate(lines)] + [("f4", '{"type": "user_message",  "payload": {"text": "my secret"}}')], "file string, raw string")
    got = {r["file"]: (r["raw"], r["counts"]) for r in redact.redact_records(df, secrets=["my secret"]).collect()}
    assert got["f0"] == (json.dumps(lines[0]), {}) and got["f1"][1] == {"openai_api_key": 1} and got["f2"][1] == {"vcs_remote_url": 1} and got["f3"][1] == {"output_truncated": 1} and got["f4"][1] == {"user_secret": 1}
    asked = df.select("file", redact.suspect("raw", redact.ALL).alias("s")).collect()
    assert {r["file"] for r in asked if r["s"]} == {"f1"}
