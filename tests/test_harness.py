"""Two adapters over many files, hashes of chained readers, and times in raw records."""

import hashlib
import json

import duckdb
from pyspark.sql import functions as F

from loomline import queries as Q
from loomline.functions import scalars as S
from loomline.operators import compare
from loomline.sources import jsonl


def test_harness(spark):
    e = lambda t: json.dumps({"type": "user_message", "id": t + "x", "payload": {"text": t}})
    df = lambda rows: spark.createDataFrame([(f, i, e(t)) for i, (f, t) in enumerate(rows)], "fixture string, i int, raw string")
    old = df([("a", "one"), ("a", "two"), ("b", "one"), ("b", "gone"), ("c", "known")])
    new = df([("a", "two"), ("a", "one"), ("a", "more"), ("b", "one"), ("d", "gone")])
    compared = compare.compare_entries(old, new, ["i"], F.get_json_object("raw", "$.payload.text") == "known", scope=["fixture"])
    errors = spark.createDataFrame([("e", "no file"), ("a", "broke"), ("a", "and again")], "fixture string, error string")
    assert sorted(map(tuple, compare.harness(compared, ["fixture"]).collect())) == [("a", 2, 0, 0, 1, None, False), ("b", 1, 1, 0, 0, None, True), ("c", 0, 0, 1, 0, None, False), ("d", 0, 0, 0, 1, None, False)]
    got = {r["fixture"]: (r["error"], r["blocking"]) for r in compare.harness(compared, ["fixture"], errors).collect()}
    assert got == {"a": ("and again", True), "b": (None, True), "c": (None, False), "d": (None, False), "e": ("no file", True)}


def test_combined_identities(spark):
    one = spark.createDataFrame([("s", "h1"), ("t", "h1")], "source string, identity string")
    two = spark.createDataFrame([("s", "h0"), ("u", "h9")], "source string, identity string")
    sha = lambda *h: hashlib.sha256("\n".join(h).encode()).hexdigest()
    assert [tuple(r) for r in jsonl.combined_identity([one, two], ["source"]).collect()] == [("s", sha("h1", "h0"))]
    assert [tuple(r) for r in jsonl.combined_identity([two, one, two], ["source"]).collect()] == [("s", sha("h0", "h1", "h0"))]


def test_times(spark):
    values = {"1000": "1970-01-01T00:00:01.000Z", '"yesterday"': "yesterday", '""': None, "null": None, "true": None, "-1": "1969-12-31T23:59:59.999Z", "1700000000123.9": "2023-11-14T22:13:20.123Z", "-1.5": "1969-12-31T23:59:59.999Z",
              "8640000000000000": "+275760-09-13T00:00:00.000Z", "8640000000000001": None, "1e300": None, "253402300800000": "+010000-01-01T00:00:00.000Z", "-62198755200000": "-000001-01-01T00:00:00.000Z", '"123"': "123", "{}": None, "no json": None}
    df = spark.createDataFrame([(k,) for k in values], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", S.iso_timestamp(F.try_parse_json("t")).alias("x")).collect()} == values


def _times_by_both(spark, tmp_path, name):
    """Times of a query over events with large ids, after a comparison with its SQL."""
    spark.createDataFrame([(i,) for i in (0, 4, 2_932_892, 2_932_908, 36_000_000)], "event_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = {r["event_id"]: r["ts"] for r in Q.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(Q.SQL[name]).fetchall())
    return got


def test_iso_timestamps_of_long_years(spark, tmp_path):
    assert _times_by_both(spark, tmp_path, "iso_timestamps") == {0: "1970-01-01T00:00:00.000Z", 4: "1970-01-05T00:00:00.492Z", 2_932_892: "9999-12-31T04:12:25.716Z", 2_932_908: "10000-01-16T04:12:27.684Z", 36_000_000: "100534-10-17T06:00:00.000Z"}


def test_record_times_of_long_years(spark, tmp_path):
    assert _times_by_both(spark, tmp_path, "record_times")[2_932_908] == "10000-01-16T04:12:27.684Z"
