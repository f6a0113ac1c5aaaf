"""Checks in a stream against the checks of the finished files."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from loomline.operators import reconcile, rules
from loomline.sources import jsonl
from loomline.streaming import validation
from tests.test_flows import HEADER, entry, ulid

AGENT = HEADER["agent"]


def some_files(spark):
    tool = lambda n, **more: entry(n, "tool_call", {"tool": "x", "args": {}}, **more)
    result = lambda n, **payload: entry(n, "tool_result", {"ok": True} | payload)
    text = lambda n, **more: entry(n, "user_message", {"text": "t"}, **more)
    head = lambda n, **more: HEADER | {"id": ulid(n)} | more
    trail = lambda **more: {"type": "trail", "schema_version": "0.1.0", "id": ulid(900), "ts": HEADER["ts"], "producer": "p"} | more
    files = {
        "leaks": [head(0), text(1, source={"raw": {"a~/b": ["x", {"k": "AKIA" + "Q" * 16}], "t": "sk-" + "a" * 20 + " ghp_" + "b" * 36, "n": 1}}), text(2, source={"raw": "\\u0041 C:\\Users\\me"}), text(3, source={"raw": {"size": "y" * 9000}})],
        "good": [head(0), text(1), tool(2), result(3, for_id=ulid(2)), entry(4, "session_end", {"reason": "complete", "final_message_id": ulid(1)})],
        "graph": [head(0), text(1, parent_id=ulid(3)), text(2, parent_id=ulid(77)), text(3, parent_id=ulid(1)), text(4, parent_id=ulid(3)), text(4), text(5, parent_id=ulid(0)), head(0), text(6, parent_id=ulid(1)), text(7, parent_id=ulid(7)), text(1)],
        "tools": [head(0), tool(1, semantic={"call_id": "a"}), tool(2, semantic={"call_id": "a"}), result(3), result(4, for_id=ulid(99)), tool(5), tool(6), entry(7, "session_terminated", {"reason": "process_terminated", "open_call_ids": [ulid(6)]}),
                  head(8), tool(9), entry(10, "session_end", {"reason": "complete", "final_message_id": ulid(55)}), head(11, schema_version="7"), tool(12), text(13, source={"raw": {"envelope_ref": ulid(12)}})],
        "headers": [text(1), trail(parent_id=None, sessions=[{"id": ulid(2), "agent": "x"}, {"id": "q"}]), head(2, stream={"state": "open"}, content_hash="zz", vcs={"revision": "a"}, ts="2024-02-01T00:00:00.000Z"), entry(3, "session_terminated", {"reason": "x"}), trail(),
                    head(4, parent_id="p", vcs={"revision": "b"}, fork_from={"session_id": ulid(5), "content_hash": "c" * 64}), text(5, source={"raw": {"envelope_ref": ulid(6)}}), text(6), text(7, source={"raw": {"envelope_ref": ulid(6)}}), head(5, content_hash="d" * 64), head(8, schema_version="0.1.7"), text(9)],
        "hashes": [trail(content_hash="e" * 64), head(0, content_hash="f" * 64), text(1), head(2), text(3)],
        "cut": [head(0, content_hash="f" * 64), text(1), "not json", text(1)], "none": [text(1), text(1)], "bare": [trail(), text(2)], "list": ["[1]", head(0)], "odd": [head(0), {"id": ulid(3)}, {"type": 7, "id": ulid(3), "parent_id": ulid(3)}, text(5, parent_id=ulid(3))],
    }
    rows = [(name, i + 1, r if isinstance(r, str) else json.dumps(r)) for name, records in files.items() for i, r in enumerate(records)]
    stamped = reconcile.stamp(spark.createDataFrame([(n, i, r) for n, i, r in rows if n == "good"] + [("bundle", 1, json.dumps(trail()))] + [("bundle", i + 2, json.dumps(r)) for i, r in enumerate([head(1), text(2), head(3), text(4)])], "file string, line int, raw string"))
    return rows + [(f"stamped-{r['file']}", r["line"], r["raw"]) for r in stamped.collect()]


def run(spark, folder, checkpoint, name, profile="strict", idle_ms=None):
    lines = spark.readStream.schema("file string, line int, raw string").option("maxFilesPerTrigger", 1).json(folder)
    return validation.validated(lines, profile, idle_ms).writeStream.format("parquet").option("path", f"{checkpoint}-out").option("checkpointLocation", checkpoint).outputMode("append")


@pytest.mark.parametrize("profile,seed", [("strict", 1), ("reader-tolerant", 2), ("strict", 3)])
def test_files_cut_anywhere_and_restarted(spark, tmp_path, profile, seed):
    rows = some_files(spark)
    want = sorted(map(tuple, rules.validate(jsonl.strict(spark.createDataFrame(rows, "file string, line int, raw string").withColumn("raw", F.encode("raw", "UTF-8"))), profile).collect()))
    rng = random.Random(seed)
    # Every file is cut at its own lines; the marker of its end comes with its last lines or by itself.
    cuts = {name: sorted(rng.sample(range(0, 14), 2)) for name in {r[0] for r in rows}}
    batch_of = lambda name, line: sum(line > c for c in cuts[name])
    most = {name: max(line for n, line, _ in rows if n == name) for name in cuts}
    batches = [[], [], [], []]
    for name, line, raw in rows:
        batches[batch_of(name, line)].append({"file": name, "line": line, "raw": raw})
    for name in cuts:
        batches[batch_of(name, most[name]) if rng.random() < 0.5 else 3].append({"file": name, "line": None, "raw": None})
    folder, checkpoint = tmp_path / "in", str(tmp_path / "cp")
    folder.mkdir()

    def feed(ks):
        for k in ks:
            rng.shuffle(batches[k])
            (folder / f"{k}.json").write_text("".join(json.dumps(x) + "\n" for x in batches[k]))
            os.utime(folder / f"{k}.json", (1000 + k, 1000 + k))  # the source reads files in order of time
        run(spark, str(folder), checkpoint, f"v{seed}", profile).trigger(availableNow=True).start().awaitTermination(300)

    feed([0, 1])
    feed([2, 3])  # a new query from the checkpoint
    got = spark.read.parquet(f"{checkpoint}-out").filter("final").drop("final").collect()
    got = sorted(map(tuple, got))
    assert ([d for d in got if d not in want], [d for d in want if d not in got]) == ([], []) and got == want and len(want) > 30


def test_states_that_outgrow_their_value(spark, tmp_path):
    """Files whose tables leave the value at different lines, from batch to batch and over a restart."""
    rows = some_files(spark)
    want = sorted(map(tuple, rules.validate(jsonl.strict(spark.createDataFrame(rows, "file string, line int, raw string").withColumn("raw", F.encode("raw", "UTF-8")))).collect()))
    folder, checkpoint = tmp_path / "in", str(tmp_path / "cp")
    folder.mkdir()
    ends = [(name, None, None) for name in sorted({r[0] for r in rows})]
    for k, part in enumerate(([r for r in rows if r[1] <= 3], [r for r in rows if 3 < r[1] <= 6], [r for r in rows if r[1] > 6] + ends)):
        (folder / f"{k}.json").write_text("".join(json.dumps(dict(zip(("file", "line", "raw"), r))) + "\n" for r in part))
        lines = spark.readStream.schema("file string, line int, raw string").json(str(folder))
        validation.validated(lines, near=700).writeStream.format("parquet").option("path", f"{checkpoint}-out").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(300)
    assert sorted(map(tuple, spark.read.parquet(f"{checkpoint}-out").filter("final").drop("final").collect())) == want


class _State:
    """A state of one key in memory that counts how often it is asked."""

    calls = 0

    def __init__(self, value=False):
        self.rows, self.value = None, value

    def __getattr__(self, name):
        _State.calls += 1
        rows = self.rows
        if name in ("clear", "update"):
            return lambda *new: setattr(self, "rows", new[0] if new else None)
        if name in ("appendValue", "appendList"):
            return lambda new: setattr(self, "rows", (rows or []) + ([new] if name == "appendValue" else list(new)))
        if name == "updateValue":
            return lambda k, v: setattr(self, "rows", (rows or {}) | {k: v})
        return {"exists": lambda: rows is not None, "get": lambda: rows if self.value else iter(rows or []), "containsKey": lambda k: k in (rows or {}), "getValue": lambda k: rows[k], "iterator": lambda: iter((rows or {}).items())}[name]


class _Handle:
    getMapState = getListState = lambda self, *_: _State()
    getValueState = lambda self, *_: _State(True)


@pytest.mark.parametrize("near", [0, 900, validation.NEAR])
def test_a_small_file_asks_its_state_twice_a_batch(near):
    facts = ["line", "code", "found", "type", "id", "parent_id", "has_parent", "ts", "schema_version", "content_hash", "stream_state", "call_id", "for_id", "revision", "final_message_id", "agent", "forked_from", "forked_hash", "envelope_ref", "sessions", "open_call_ids", "text", "leaky"]
    plain = dict.fromkeys(facts) | {"found": "[]", "has_parent": False, "leaky": False}
    row = lambda **some: validation.Row(*facts)(*(plain | some).values())
    lines = [row(line=1, type="session", id="h", schema_version=rules.SCHEMA_VERSION)] + [row(line=n, type="tool_call", id=f"i{n - n % 5}", parent_id=f"i{n + 1}") for n in range(2, 41)]
    batches = [lines[:4], lines[4:20], lines[20:], [row()]]
    checks = validation.FileChecks("strict", None)
    checks.near = near
    checks.init(_Handle())
    _State.calls = 0
    out = [d for rows in batches for d in checks.handleInputRows(("f",), iter(rows), None)]
    out = [(d["line"], d["code"]) for d in out]
    codes = {c: [line for line, code in out if code == c] for c in {c for _, c in out}}
    assert codes["duplicate_id"] == [n for n in range(3, 41) if n % 5]
    assert sorted(codes["unknown_parent_id"]) == [n for n in range(2, 41) if (n + 1) % 5] and checks.at.rows is None and all(t.state.rows in (None, [], {}) for t in checks.tables.values())
    assert near < validation.NEAR or _State.calls <= 2 * len(batches)


def test_silent_files_are_told_once_and_go_on(spark, tmp_path):
    folder, checkpoint = tmp_path / "in", str(tmp_path / "cp")
    folder.mkdir()
    call = entry(1, "tool_call", {"tool": "x", "args": {}})
    put = lambda k, *rows: (folder / f"{k}.json").write_text("".join(json.dumps({"file": "a", "line": n, "raw": r}) + "\n" for n, r in rows))
    told = lambda: sorted((r["line"], r["code"], r["final"]) for r in spark.read.schema(validation.DIAGNOSTICS).parquet(f"{checkpoint}-out").collect())

    def until(want):
        for _ in range(60):
            time.sleep(1)
            if os.path.isdir(f"{checkpoint}-out") and told() == want:
                return
        raise AssertionError(told())

    put(0, (1, json.dumps(HEADER)), (2, json.dumps(call)))
    q = run(spark, str(folder), checkpoint, "idle", idle_ms=1500).trigger(processingTime="300 milliseconds").start()
    try:
        quiet = (2, "unmatched_tool_call_at_eof", False)
        until([quiet])
        time.sleep(4)
        put(1, (3, json.dumps(entry(2, "tool_result", {"ok": True, "for_id": ulid(1)}))), (4, json.dumps(entry(2, "user_message", {"text": "t"}))), (None, None))
        until([quiet, (4, "duplicate_id", True)])
    finally:
        q.stop()


def test_pairing_and_cycles_equal_the_operators(spark):
    from loomline.operators import graph, pairing

    rng = random.Random(4)
    events, edges = [], []
    for s in range(60):
        for n in range(rng.randint(0, 14)):
            kind = rng.choice(["tool_call", "tool_result"])
            events.append((s, n, kind, f"i{n}", f"i{rng.randint(0, 14)}" if kind == "tool_result" and rng.random() < 0.3 else None, rng.choice([None, "a", "b"])))
        edges += [(s, f"n{k}", f"n{rng.randint(0, 9)}") for k in rng.sample(range(9), rng.randint(1, 9))]
    df = spark.createDataFrame(events, "s int, ord int, kind string, id string, for_id string, call_id string")
    want = sorted((r["s"], r["ord"]) for r in pairing.unmatched_calls(df, ["s"]).collect())
    assert sorted((s, line) for s in range(60) for line, _ in validation.unmatched([e[1:] for e in events if e[0] == s])) == want
    cyclic = graph.cyclic_ids(spark.createDataFrame(edges, "s int, id string, parent_id string"), ["s"], 10)
    assert sorted((s, i) for s in range(60) for i in validation.on_cycles({i: p for k, i, p in edges if k == s})) == sorted(map(tuple, cyclic.collect()))
