"""Profiles of records and what is new in them."""

import json

from pyspark.sql import functions as F

from loomline.operators import drift


def frame(spark, rows):
    return spark.createDataFrame([(a, v, t, json.dumps(r)) for a, v, t, r in rows], "agent string, version string, type string, raw string").withColumn("value", F.try_parse_json("raw"))


def test_one_row_for_a_new_field(spark):
    old = [("x", "1", "m", {"id": i, "body": {"parts": [{"t": "a"}, {"t": "b", "n": 1.5}], "ok": True, "none": None}, "args": {f"k{i}": [1]}}) for i in range(20)] + [("x", "1", "empty", {"list": [], "map": {}})]
    new = [("x", "2", "m", {"id": str(i) if i % 5 == 0 else i, "body": {"parts": [{"t": "a", "late": {"deep": i}}] * 3, "ok": None}, "args": {"other": {"any": "thing"}}}) for i in range(30)] + [("x", "2", "odd", {"a": 1, "b": [2, 3]}), ("x", "3", "empty", {"list": [7]})]
    known = drift.profile(frame(spark, old), "value", ("/args",))
    seen = drift.profile(frame(spark, new), "value", ("/args",))
    got = sorted(map(tuple, drift.drift(seen, known).collect()))
    assert got == [("x", "2", "m", "/body/parts/*/late/deep", "number", 90, "source-unknown-field"), ("x", "2", "m", "/id", "string", 6, "source-type-mismatch"), ("x", "2", "odd", "", "", 3, "source-unknown-type"),
                   ("x", "3", "empty", "/list/*", "number", 1, "source-unknown-field")]
    assert drift.drift(known, known).count() == 0 and drift.drift(seen.limit(0), known).count() == 0
    halves = [drift.profile(frame(spark, new[k::2]), "value", ("/args",)) for k in (0, 1)]
    assert sorted(map(tuple, drift.merged(halves).collect())) == sorted(map(tuple, seen.collect()))
    assert {r["path"] for r in known.filter("path like '/args%'").collect()} == {"/args/**"}


def test_nulls_and_faulty_records(spark):
    df = frame(spark, [("x", None, None, {"a": 1}), ("x", None, None, None)]).unionByName(spark.createDataFrame([("x", "1", "m", "{no")], "agent string, version string, type string, raw string").withColumn("value", F.try_parse_json("raw")))
    assert sorted(map(str, map(tuple, drift.profile(df, "value").collect()))) == ["('x', None, None, '', 'null', 1)", "('x', None, None, '/a', 'number', 1)"]
