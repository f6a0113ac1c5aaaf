"""Files to diagnostics, dialects to entries, the store, and live streams."""

import json
import uuid

from pyspark.sql import functions as F

from loomline.operators import adapters, rules
from loomline.sources import jsonl, store
from loomline.streaming import live


def ulid(n):
    return f"01ARZ3NDEKTSV4RRFFQ69G{n:04d}"


def entry(n, kind, payload, **more):
    return {"type": kind, "id": ulid(n), "ts": f"2024-01-01T00:00:{n % 60:02d}.000Z", "payload": payload} | more


HEADER = {"type": "session", "schema_version": "0.1.0", "id": ulid(0), "ts": "2024-01-01T00:00:00.000Z", "agent": {"name": "x"}}


def codes(spark, tmp_path, name, records):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records))
    found = rules.validate(jsonl.strict(jsonl.lines(spark, str(folder))))
    return sorted((r["line"], r["code"]) for r in found.collect())


def test_valid_file_has_no_diagnostics(spark, tmp_path):
    ok = [HEADER, entry(1, "user_message", {"text": "hi"}), entry(2, "tool_call", {"tool": "x", "args": {}}), entry(3, "tool_result", {"ok": True, "for_id": ulid(2)}), entry(4, "session_end", {"reason": "complete", "final_message_id": ulid(1)})]
    assert codes(spark, tmp_path, "ok", ok) == []


def test_faults_are_reported(spark, tmp_path):
    bad = [
        HEADER | {"stream": {"state": "open"}, "content_hash": "ab"}, entry(1, "user_message", {}), entry(1, "agent_message", {"text": "x"}), entry(3, "user_message", {"text": "y"}, parent_id=ulid(9)),
        entry(4, "user_message", {"text": "a"}, parent_id=ulid(5)), entry(5, "user_message", {"text": "b"}, parent_id=ulid(4)), entry(6, "tool_call", {"tool": "x", "args": {}}),
        entry(7, "nonsense", {}), entry(8, "session_terminated", {"reason": "process_terminated"}), entry(9999, "user_message", {"text": "z"}, source={"raw": {"k": "AKIA" + "ABCDEFGHIJKLMNOP" + "x" * 9000}}),
    ]
    got = codes(spark, tmp_path, "bad", bad)
    for want in [(1, "content_hash_invalid"), (1, "stream_open_with_content_hash"), (2, "required"), (3, "duplicate_id"), (4, "unknown_parent_id"), (5, "parent_cycle"), (6, "parent_cycle"),
                 (7, "unmatched_tool_call_at_eof"), (8, "enum"), (9, "stream_open_with_terminal_event"), (10, "source_raw_oversized"), (10, "source_raw_unredacted_secret")]:
        assert want in got
    assert len(got) == 12
    assert codes(spark, tmp_path, "none", [entry(1, "user_message", {"text": "x"})]) == [(1, "missing_header")]


def test_codex_rules(spark):
    msg = lambda t, p, ty="event_msg": {"timestamp": "2024-01-01T00:00:00.000Z", "type": ty, "payload": {"type": t} | p}
    records = [
        msg("", {"id": "s"}, "session_meta"), msg("user_message", {"message": "hi"}), msg("agent_message", {"message": ""}),
        msg("function_call", {"name": "shell", "arguments": '{"command":["ls","a b"],"workdir":"/x"}', "call_id": "c1"}, "response_item"),
        msg("function_call_output", {"output": "done\n· ", "call_id": "c1"}, "response_item"), msg("reasoning", {"summary": [{"text": "a"}, {"text": "b"}]}, "response_item"), {"type": "mystery", "x": 1},
    ]
    df = spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(records)], "session_uid string, record_idx int, raw string").select("session_uid", "record_idx", F.try_parse_json("raw").alias("v"))
    ns = "e8f4b9a5-af67-4bcd-d156-738f9a0b1c23"
    got = adapters.adapt(df, adapters.codex_rules(), ns, "codex", adapters.codex_known()).orderBy("record_idx").collect()
    assert [(r["record_idx"], r["type"]) for r in got] == [(1, "user_message"), (3, "tool_call"), (4, "tool_result"), (5, "agent_thinking"), (6, "system_event")]
    assert json.loads(got[1]["payload"]) == {"tool": "shell_command", "args": {"command": "ls 'a b'", "cwd": "/x"}}
    assert got[1]["tool_kind"] == "shell_command" and json.loads(got[2]["payload"]) == {"ok": True, "output": "done"} and json.loads(got[3]["payload"]) == {"text": "a\nb"}
    assert json.loads(json.loads(got[4]["payload"])["data"]["raw"]) == records[6]
    assert got[0]["id"] == str(uuid.uuid5(uuid.UUID(ns), "\x1f".join(["s", "1", "user_message", "0"])))


def test_pi_rules(spark):
    records = [
        {"type": "session", "version": 3}, {"type": "message", "timestamp": "t", "message": {"role": "user", "content": [{"type": "text", "text": "q"}]}},
        {"type": "message", "timestamp": "t", "message": {"role": "assistant", "stopReason": "aborted", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "toolCall", "id": "c", "name": "bash", "arguments": {"a": 1}}]}},
        {"type": "message", "timestamp": "t", "message": {"role": "toolResult", "toolCallId": "c", "isError": True, "content": "no"}},
    ]
    df = spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(records)], "session_uid string, record_idx int, raw string").select("session_uid", "record_idx", F.try_parse_json("raw").alias("v"))
    got = adapters.adapt(df, adapters.pi_rules(), "f9a5cab6-b078-4cde-e267-849a0b1c2d34", "pi").orderBy("record_idx", "ordinal").collect()
    assert [r["type"] for r in got] == ["user_message", "agent_thinking", "tool_call", "user_interrupt", "tool_result"]
    assert json.loads(got[4]["payload"]) == {"ok": False, "output": "no", "error": "no"} and got[2]["call_id"] == got[4]["call_id"] == "c"


def test_store(spark, tmp_path):
    h = "a" * 64
    rows = [(h, "x\n", "p", "u", None, 1), ("<pending>", "y", "p", "u", None, 1), ("zz", "y", "p", "u", None, 1)]
    df = spark.createDataFrame(rows, "content_hash string, body string, source_path string, session_uid string, kind string, registered_at int")
    root = str(tmp_path / "store")
    assert {r["content_hash"]: r["status"] for r in store.register(df, root).collect()} == {h: "finalized", "<pending>": "skipped_pending", "zz": "invalid"}
    assert {r["status"] for r in store.register(df.limit(1), root).collect()} == {"already_present"}
    assert store.index(spark, root).first()["kind"] == "session" and store.export(spark, root, "aaaaaaaa").first()["body"] == "x\n"
    assert store.rebuilt_index(spark, root, lambda b: F.sha2(b, 256)).count() == 0


def test_tail_source_reads_appended_lines(spark, tmp_path):
    spark.dataSource.register(live.TailSource)
    folder = tmp_path / "live"
    folder.mkdir()
    file = folder / "a.jsonl"
    file.write_text('{"a":1}\nbad\n{"half')
    stream = live.line_faults(spark.readStream.format("jsonl_tail").option("path", str(folder)).load())
    q = stream.writeStream.format("memory").queryName("faults").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["line"], r["code"]) for r in spark.table("faults").collect()] == [(2, "invalid_json")]


def test_open_calls_stream(spark, tmp_path):
    rows = [("s", 0, "tool_call", "a", None), ("s", 1, "tool_call", "b", None), ("s", 2, "tool_result", "r", "a"), ("s", 3, "session_terminated", "t", None), ("e", 0, "tool_call", "x", None), ("e", 1, "session_end", "z", None)]
    spark.createDataFrame(rows, "session string, ord long, kind string, id string, for_id string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, ord long, kind string, id string, for_id string").parquet(str(tmp_path / "in"))
    from loomline.session import ship

    ship(spark)
    q = live.open_calls(stream).writeStream.format("memory").queryName("open_calls").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["session"], r["id"]) for r in spark.table("open_calls").collect()] == [("s", "b")]


def test_claude_rules_links_and_open_calls(spark):
    a = lambda *blocks, **kw: {"type": "assistant", "timestamp": "t", "message": {"role": "assistant", "model": "m", "content": list(blocks)}} | kw
    u = lambda content, **kw: {"type": "user", "timestamp": "t", "message": {"role": "user", "content": content}} | kw
    records = [
        u("hello"), a({"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "ls"}}),
        u([{"type": "tool_result", "tool_use_id": "c1", "content": [{"type": "text", "text": "x"}]}]), u("hidden", isMeta=True), u("[Request interrupted by user]"),
        a({"type": "tool_use", "id": "c2", "name": "Bash", "input": {}}), {"type": "summary", "summary": "s"}, {"type": "odd"},
    ]
    df = spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(records)], "session_uid string, record_idx int, raw string").select("session_uid", "record_idx", F.try_parse_json("raw").alias("v"))
    out = adapters.link_results(adapters.adapt(df, adapters.claude_rules(), "0a16dbc7-c189-4def-f378-95ab1c2d3e45", "claudecode"))
    got = out.orderBy("record_idx", "ordinal").collect()
    assert [r["type"] for r in got] == ["user_message", "agent_thinking", "agent_message", "tool_call", "tool_result", "user_interrupt", "tool_call", "session_summary", "system_event"]
    assert json.loads(got[3]["payload"]) == {"tool": "shell_command", "args": {"command": "ls"}} and json.loads(got[4]["payload"]) == {"ok": True, "output": "x"}
    assert got[4]["for_id"] == got[3]["id"] and adapters.terminated(out).first()["open_call_ids"] == [got[6]["id"]]


def test_discovery_and_sqlite(spark, tmp_path):
    import sqlite3

    from loomline.session import ship
    from loomline.sources import discovery

    ident = "0a16dbc7-c189-4def-a378-95ab1c2d3e45"
    folder = tmp_path / "2024" / "01"
    folder.mkdir(parents=True)
    (folder / "rollout-a.jsonl").write_text(json.dumps({"type": "session_meta", "payload": {"id": "x1", "cwd": "/w", "cli_version": "0.128.0"}}) + "\n")
    (folder / f"rollout-{ident}.jsonl").write_text("{}\n")
    found = discovery.sessions(spark, str(tmp_path), "codex-cli")
    assert {(r["id"], r["cwd"], r["header_status"]) for r in found.collect()} == {("x1", "/w", "ok"), (ident, None, "no_header")}
    assert discovery.newest_version(found.filter("version is not null")).first()["version"] == "0.128.0"
    file = tmp_path / "s.db"
    con = sqlite3.connect(file)
    con.executescript("PRAGMA user_version = 7; CREATE TABLE t (a INTEGER); INSERT INTO t VALUES (2), (1);")
    con.commit()
    con.close()
    ship(spark)
    spark.dataSource.register(discovery.SqliteSource)
    rows = spark.read.format("sqlite_rows").option("path", str(file)).option("queries", json.dumps({"up": "SELECT a FROM t ORDER BY a", "all": "SELECT a FROM t"})).load().orderBy("reader", "line").collect()
    assert [(r["query"], json.loads(r["raw"])["a"], r["version"]) for r in rows] == [("up", 1, "7"), ("up", 2, "7"), ("all", 2, "7"), ("all", 1, "7")]
