"""Reconciled segments, stamped hashes, lines of split files, and places in a total order, against plain Python."""

import hashlib
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomline.operators import compare, hashing, reconcile, redact, rules
from loomline.sources import jsonl, store


def header(uid=None, seq=None, **more):
    h = {"type": "session", "schema_version": "0.1.0", "id": "01ARZ3NDEKTSV4RRFFQ69G0000", "ts": "2024-01-01T00:00:00.000Z", "agent": {"name": "x"}} | more
    if uid is not None:
        h["session_uid"] = uid
    if seq is not None:
        h["segment"] = {"seq": seq}
    return h


def entry(n, kind="user_message", **payload):
    return {"type": kind, "id": f"01ARZ3NDEKTSV4RRFFQ69G{n:04d}", "ts": "2024-01-01T00:00:01.000Z", "payload": payload or {"text": "hi"}}


def frame(spark, files):
    rows = [(name, i + 1, json.dumps(r)) for name, records in files.items() for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "file string, line int, raw string")


def digest(records, pin):
    lines = [hashing.canonical_json(r | {"content_hash": "<pending>"} if i == pin else r) for i, r in enumerate(records)]
    return hashlib.sha256(("\n".join(lines) + "\n").encode()).hexdigest()


def test_reconcile(spark):
    dead = entry(9, "session_terminated", reason="process_terminated")
    files = {
        "b": [header("u", 2, ts="2024-02-02T00:00:00.000Z", cwd="/late", content_hash="x"), entry(2), entry(3), dead],
        "a": [header("u", 1, cwd="/early"), entry(1), entry(2), dead],
        "c": [header("v"), entry(1)],
        "d": [header(), entry(1)],
        "e": [header(None, 3), entry(1)],
        "f": [entry(1)],
        "g": [{"type": "trail", "id": "t"}, header("w"), entry(1), header("u", 4), entry(4)],
        "h": [header("o", 1), entry(1)], "i": [header("o", 2, stream={"state": "open"}, content_hash="z"), entry(2)],
    }
    out = reconcile.reconcile(frame(spark, files))
    groups = {r["session"]: r for r in out.groups.collect()}
    assert set(groups) == {"uid:u", "uid:v", "uid:w", "uid:o", "source:d", "source:e"}
    u = groups["uid:u"]
    assert list(u["segments"]) == ["a", "b", "g#session-1"] and (u["events"], u["events_deduped"]) == (4, 1)
    records = {}
    for r in out.records.orderBy("session", "ord").collect():
        records.setdefault(r["session"], []).append(json.loads(r["raw"]))
    merged = records["uid:u"]
    assert [r["id"][-1] for r in merged[1:]] == ["1", "2", "3", "4"]
    assert "segment" not in merged[0] and merged[0]["ts"] == "2024-01-01T00:00:00.000Z" and "cwd" not in merged[0]
    assert merged[0]["content_hash"] == u["content_hash"] == digest(merged, 0)
    assert "content_hash" not in records["uid:o"][0] and groups["uid:o"]["content_hash"] is None
    assert records["source:d"] == files["d"] and records["uid:w"] == files["g"][1:3]
    assert [r["file"] for r in out.envelopes.collect()] == ["g"]
    warned = {(r["source"], r["code"]) for r in out.warnings.collect()}
    assert warned == {("f", "missing_session_header"), ("e", "missing_session_uid"), ("g#session-1", "segment_seq_gap")}
    empty = reconcile.reconcile(frame(spark, {"x": [entry(1)]}).limit(0))
    assert empty.records.count() == empty.groups.count() == empty.warnings.count() == 0


def test_last_segment_without_entries(spark):
    """The marker of a killed process goes if a segment follows, even an empty one, and is not counted as a repeat."""
    dead = entry(9, "session_terminated", reason="process_terminated")
    files = {"a": [header("u", 1), entry(1), dead], "b": [header("u", 2), entry(1), entry(2), dead], "c": [header("u", 3)], "d": [header("w", 1), entry(1), dead], "e": [header("w", 2), dead]}
    out = reconcile.reconcile(frame(spark, files))
    groups = {r["session"]: r for r in out.groups.collect()}
    assert [(groups[k]["events"], groups[k]["events_deduped"]) for k in ("uid:u", "uid:w")] == [(2, 1), (2, 0)]
    merged = [json.loads(r["raw"]) for r in out.records.filter("session = 'uid:u'").orderBy("ord").collect()]
    assert [r["type"] for r in merged] == ["session", "user_message", "user_message"] and groups["uid:u"]["content_hash"] == digest(merged, 0)


def test_sessions_cut_by_batches_and_plan(spark):
    """Random segments against plain Python, in batches of three lines; a table that is asked for is one plan of two shuffles by key, and nothing runs before."""
    rng = random.Random(6)
    dead = entry(9, "session_terminated", reason="process_terminated")
    files = {}
    for i in range(60):
        body = [rng.choice([entry(rng.randint(0, 6)), entry(rng.randint(0, 6), "session_terminated", reason="x"), dead, {"type": "user_message", "id": 5}]) for _ in range(rng.randint(0, 9))]
        files[f"f{i:02d}"] = [*([{"type": "trail", "id": "t"}] if i % 9 == 0 else []), *([entry(8)] if i % 7 == 0 else []), header(rng.choice([None, "u", "v", "w", f"x{i}"]), rng.choice([None, 1, 2, 2.5, 3]), n=i, **({"stream": {"state": "open"}} if i % 11 == 0 else {})), *body]
    sessions = {}
    for name, records in files.items():
        head = next(r for r in records if r["type"] == "session")
        sessions.setdefault("uid:" + head["session_uid"] if "session_uid" in head else f"source:{name}", []).append((head.get("segment", {}).get("seq", 1.0), name, head, records))
    want, texts = {}, {}
    for key, parts in sessions.items():
        parts.sort(key=lambda p: p[:2])
        entries = [(r, p is parts[-1]) for p in parts for r in p[3] if r["type"] not in ("session", "trail")]
        if len(parts) == 1:
            want[key], texts[key] = (1, len(entries), 0, None), parts[0][3]
            continue
        asked = [r for r, last in entries if last or r != dead]
        kept = [r for i, r in enumerate(asked) if not isinstance(r["id"], str) or r["id"] not in [x["id"] for x in asked[:i]]]
        first, last = parts[0][2], parts[-1][2]
        merged = {k: v for k, v in last.items() if k != "segment"} | {k: first[k] for k in ("ts", "id", "type", "schema_version", "session_uid")}
        sealed = None if "stream" in merged else digest([merged, *kept], 0)
        want[key], texts[key] = (len(parts), len(kept), len(asked) - len(kept), sealed), [merged | ({"content_hash": sealed} if sealed else {}), *kept]
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        lines = frame(spark, files).repartition(3)
        spark.sparkContext.setJobGroup("reconcile", "")
        out = reconcile.reconcile(lines)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (out.groups, out.records)]
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("reconcile")) == [] and [p.count("Exchange hashpartitioning") for p in plans] == [2, 2]
        groups = {r["session"]: (len(r["segments"]), r["events"], r["events_deduped"], r["content_hash"]) for r in out.groups.collect()}
        got = {}
        for r in sorted(out.records.collect()):
            got.setdefault(r["session"], []).append((r["ord"], json.loads(r["raw"])))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert groups == want and len(want["uid:u"]) == 4 and {k: [r for _, r in v] for k, v in got.items()} == texts
    assert all([o for o, _ in v] == list(range(len(v))) for v in got.values())


def test_stamp(spark):
    files = {"a": [{"type": "trail", "id": "01ARZ3NDEKTSV4RRFFQ69G0001", "ts": "2024-01-01T00:00:00.000Z"}, header(fork_from={"content_hash": "<pending>"}), entry(1), header(), entry(2), entry(3)], "b": [header(content_hash="old"), entry(1)]}
    got = {}
    for r in reconcile.stamp(frame(spark, files)).orderBy("file", "line").collect():
        got.setdefault(r["file"], []).append(json.loads(r["raw"]))
    a, b = got["a"], got["b"]
    assert a[1]["content_hash"] == digest(files["a"][1:3], 0) and a[3]["content_hash"] == digest(files["a"][3:], 0)
    assert a[0]["content_hash"] == digest(a, 0) and b[0]["content_hash"] == digest(files["b"], 0)
    assert a[1]["fork_from"] == {"content_hash": "<pending>"} and a[2] == files["a"][2]
    lines = reconcile.stamp(frame(spark, files)).withColumn("raw", F.encode("raw", "UTF-8"))
    assert rules.validate(jsonl.strict(lines)).filter("code like 'content_hash%'").count() == 0


def test_lines_of_split_files(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for name in "abc":
        rows = [bytes(rng.choice(b"xyz\xff\xe9 \t") for _ in range(rng.randint(0, 300))) + rng.choice([b"", b"\r"]) for _ in range(rng.randint(1, 400))]
        (tmp_path / f"{name}.jsonl").write_bytes(b"\n".join(rows) + rng.choice([b"", b"\n"]) if rows[-1] else b"\n".join(rows) + b"\n")
        want[name] = [r.removesuffix(b"\r") for r in rows]
    (tmp_path / "empty.jsonl").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        got = {}
        for r in jsonl.lines(spark, str(tmp_path)).orderBy("file", "line").collect():
            got.setdefault(r["file"].split("/")[-1][0], []).append((r["line"], bytes(r["raw"])))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: list(enumerate(v, 1)) for k, v in want.items()}


@pytest.mark.parametrize("n", [0, 1, 500])
def test_places(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 101).alias("k"), "id")
    got = [(r["place"], r["k"], r["id"]) for r in jsonl.placed(df, F.col("k").desc(), "id").orderBy("place").collect()]
    assert got == [(i + 1, k, x) for i, (k, x) in enumerate(sorted(((x * 7919 % 101, x) for x in range(n)), key=lambda t: (-t[0], t[1])))]


def test_register_export_and_incoming(spark, tmp_path):
    one = [header("u", 1), entry(1), entry(2)]
    two = [{"type": "trail", "schema_version": "0.1.0", "id": "01ARZ3NDEKTSV4RRFFQ69G0001", "ts": "2024-01-01T00:00:00.000Z", "producer": "p"}, header("v"), entry(3), header("w", id="01ARZ3NDEKTSV4RRFFQ69G0007"), entry(4)]
    stamped = {}
    for r in reconcile.stamp(frame(spark, {"one": one, "two": two})).orderBy("file", "line").collect():
        stamped.setdefault(r["file"], []).append(json.loads(r["raw"]))
    files = {**stamped, "pending": [header("x"), entry(1)], "bad": [header("y"), {"type": "user_message"}]}
    rows = frame(spark, files).withColumn("raw", F.encode("raw", "UTF-8"))
    root = str(tmp_path / "store")
    got = {r["file"]: (r["status"], r["content_hash"]) for r in store.register_files(rows, root, "2024-05-05").collect()}
    assert got["one"] == ("finalized", stamped["one"][0]["content_hash"]) and got["pending"] == ("skipped_pending", None) and got["bad"] == ("invalid", None)
    assert got["two"] == ("finalized", stamped["two"][0]["content_hash"])
    again = {r["file"]: r["status"] for r in store.register_files(rows.filter("file in ('one', 'two')"), root, "2024-05-06").collect()}
    assert again == {"one": "already_present", "two": "already_present"}
    cut = store.export_lines(spark, root, stamped["two"][3]["content_hash"][:10]).orderBy("line").collect()
    assert [json.loads(r["text"]) for r in cut] == stamped["two"][3:] and all(r["intact"] for r in cut)
    whole = store.export_lines(spark, root, stamped["one"][0]["content_hash"]).orderBy("line").collect()
    assert [json.loads(r["text"]) for r in whole] == stamped["one"] and whole[0]["intact"] is None
    assert store.by_session_uid(spark, root, "u").count() == 1
    more = store.reconcile_incoming(frame(spark, {"new": [header("u", 2), entry(2), entry(5)], "other": [header("q"), entry(1)]}), root)
    groups = {r["session"]: (r["events"], r["events_deduped"], len(r["segments"])) for r in more.groups.collect()}
    assert groups == {"uid:u": (3, 1, 2), "uid:q": (1, 0, 1)}


def test_compare_entries(spark):
    old = [entry(1, text="a  b"), entry(2, "tool_result", ok=True, for_id="x"), entry(3, text="a b"), entry(4, text="gone"), entry(5, text="known")]
    new = [entry(7, text="a b "), entry(8, "tool_result", ok=True, for_id="y"), entry(9, text="new"), entry(6, text="A B")]
    df = lambda rows: spark.createDataFrame([(i, json.dumps(r | {"parent_id": str(i)})) for i, r in enumerate(rows)], "i int, raw string")
    out = compare.compare_entries(df(old), df(new), ["i"], F.get_json_object("raw", "$.payload.text") == "known")
    got = sorted((r["side"], r["i"], r["verdict"]) for r in out.collect())
    assert got == [("new", 0, "preserved"), ("new", 1, "preserved"), ("new", 2, "addition"), ("new", 3, "addition"),
                   ("old", 0, "preserved"), ("old", 1, "preserved"), ("old", 2, "regression"), ("old", 3, "regression"), ("old", 4, "expected")]


def test_redacted_files_are_cut_and_finalized(spark):
    long = entry(2, "tool_result", ok=True, output="é" * 9000)
    files = {"a": [header(), entry(1, text="mail me at a.person@example.com"), long], "b": [header(), entry(1)]}
    stamped = reconcile.stamp(frame(spark, files))
    clean = redact.redact_records(stamped)
    assert {r["file"]: r["n"] for r in clean.groupBy("file").agg(F.sum(F.coalesce(F.try_element_at("counts", F.lit("output_truncated")), F.lit(0))).alias("n")).collect()} == {"a": 1, "b": 0}
    done = reconcile.finalized(clean)
    verdicts = {r["file"]: r["verdict"] for r in reconcile.claims(done).collect()}
    assert verdicts == {"a": "match", "b": "match"}
    out = [json.loads(r["raw"]) for r in done.filter("file = 'a'").orderBy("line").collect()]
    assert "[EMAIL]" in out[1]["payload"]["text"] and out[2]["payload"]["truncated"] and len(out[2]["payload"]["output"].encode()) <= redact.OUTPUT_BYTES
    assert done.filter("file = 'b'").select("line", "raw").exceptAll(stamped.filter("file = 'b'").select("line", "raw")).count() == 0


def test_share_and_load(spark, tmp_path):
    stamped = reconcile.stamp(frame(spark, {"a": [header("u"), entry(1)]}))
    sent = store.share(stamped)
    got = store.load(sent, str(tmp_path / "s"), "2024-01-01").first()
    assert got["status"] == "finalized" and store.by_session_uid(spark, str(tmp_path / "s"), "u").first()["content_hash"] == got["content_hash"]


def test_empty_files_are_told(spark):
    lines = jsonl.strict(frame(spark, {"a": [header(), entry(1)]}).withColumn("raw", F.encode("raw", "UTF-8")))
    files = spark.createDataFrame([("a",), ("none",)], "file string")
    assert [(r["file"], r["line"], r["code"]) for r in rules.validate(lines, files=files).collect()] == [("none", 0, "missing_header")]


def test_sessions_of_unknown_versions_are_left_out(spark):
    dead = header(schema_version="9.0.0")
    files = {"a": [header(id="01ARZ3NDEKTSV4RRFFQ69G0008"), entry(1, "tool_call", tool="x", args={}), dead, entry(2, "tool_call", tool="x", args={})], "b": [header(schema_version="0.1.4"), entry(1, "tool_call", tool="x", args={})]}
    lines = jsonl.strict(frame(spark, files).withColumn("raw", F.encode("raw", "UTF-8")))
    found = lambda profile: {(r["file"], r["line"], r["code"]) for r in rules.validate(lines, profile).collect()}
    strict, tolerant = found("strict"), found("reader-tolerant")
    assert ("a", 2, "unmatched_tool_call_at_eof") in strict and ("a", 4, "unmatched_tool_call_at_eof") not in strict
    assert ("b", 1, "missing_header") in strict and ("b", 2, "unmatched_tool_call_at_eof") not in strict
    assert ("b", 1, "reader_tolerant_schema_version") in tolerant and ("b", 2, "unmatched_tool_call_at_eof") in tolerant and ("b", 1, "missing_header") not in tolerant


def test_numbers_of_a_frequent_group(spark):
    """A group of half of all rows is numbered in several ranges; null groups and ties of the order are numbered too."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", None, "b"]), i // 2, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, o int, i int").repartition(5)
    got = compare.numbered(df, ["g"], ["o", "i"])
    want, seen = {}, {}
    for g, _, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = seen[g] = seen.get(g, 0) + 1
    assert {r["i"]: r["nth"] for r in got.collect()} == want
    assert compare.numbered(df.limit(0), ["g"], ["o"]).count() == 0


def test_faulty_entries_are_compared(spark):
    df = lambda texts: spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    got = compare.compare_entries(df(['{"a":1}', "{no", None]), df(["{no json", '{"a": 1}']), ["i"])
    assert sorted((r["side"], r["i"], r["verdict"]) for r in got.collect()) == [("new", 0, "preserved"), ("new", 1, "preserved"), ("old", 0, "preserved"), ("old", 1, "preserved"), ("old", 2, "regression")]


def test_lines_of_a_file_over_several_batches(spark):
    """A walk goes on over batches; escapes, long numbers, faulty and null lines, and a null file are as when each line is read by itself."""
    odd = ['{"b":1.0,"a":12345678901234567890}', ' {"b" : "\\u00e9", "a":-0.0}', '{"\\ud83d\\ude00":1,"ﬃ":2}', "{no", None, '"session"', '{"type":"\\u0073ession","id":"x"}', '{"type":"trail"}']
    sessions = {"a": [{"type": "trail", "id": "t"}, entry(0), header("u"), *map(entry, range(1, 8)), header("v"), entry(9)], "b": [entry(1), header("w"), entry(2)], None: [header("n"), entry(3)]}
    rows = [(name, i + 1, json.dumps(r)) for name, records in sessions.items() for i, r in enumerate(records)] + [("a", 100 + i, x) for i, x in enumerate(odd)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        got = []
        for size in (1, 2, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            out = reconcile.stamp(spark.createDataFrame(rows, "file string, line int, raw string")).orderBy("file", "line").collect()
            got.append([tuple(r) for r in out])
            checked = reconcile.claims(spark.createDataFrame(out, "file string, line int, raw string")).collect()
            assert sorted((r["file"] or "", r["group_idx"], r["verdict"]) for r in checked) == [("", 1, "match"), ("a", 0, "match"), ("a", 1, "match"), ("a", 2, "match"), ("a", 3, "match"), ("b", 1, "match")]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    lines = [r[2] for r in got[0] if r[0] == "a"]
    canon = [hashing.canonical_texts(pd.Series([x], dtype=object))[0] for x in odd]
    tail = [json.loads(x) for x in lines[10:12]]
    want = [hashing.canonical_json(tail[0] | {"content_hash": "<pending>"}), hashing.canonical_json(tail[1]), *[c for c in canon[:6] if c is not None]]
    assert tail[0]["content_hash"] == hashlib.sha256(("\n".join(want) + "\n").encode()).hexdigest()
    assert [x for x, old in zip(lines[12:], odd) if x != old] == [lines[18]] and json.loads(lines[18])["type"] == "session"
