"""Tool kinds, session headers and file checks of the dialects."""

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from loomline.functions.scalars import NAMESPACES
from loomline.operators import adapters, headers, hashing, redact, rules, tools
from loomline.sources import jsonl
from tests.test_flows import HEADER, codes, entry, ulid


def parsed(spark, records):
    df = spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(records)], "session_uid string, record_idx int, raw string")
    return df.select("session_uid", F.col("session_uid").alias("file"), "record_idx", F.try_parse_json("raw").alias("v"))


def calls(spark, table, given):
    df = spark.createDataFrame([(i, n, json.dumps(a)) for i, (n, a) in enumerate(given)], "i int, n string, a string").select("i", "n", F.parse_json("a").alias("a"))
    return [json.loads(r[0]) for r in df.orderBy("i").select(tools.mapped(F.col("n"), F.col("a"), table(F.col("a")))).collect()]


def test_tool_kinds(spark):
    got = calls(spark, tools.claude_tools, [
        ("Bash", {"command": "ls", "timeout": 5}), ("Bash", {"command": 3}), ("Edit", {"file_path": "a", "old_string": "x"}), ("Glob", {"pattern": "*.py"}),
        ("TodoWrite", {"todos": ["a", {"b": 1}]}), ("Task", {"description": "d", "subagent_type": "t"}), ("Other", {"k": [1]}), (None, {})])
    assert got == [
        {"tool": "shell_command", "args": {"command": "ls", "timeout": 5}}, {"tool": "other", "args": {"name": "Bash", "args": {"command": 3}}},
        {"tool": "file_edit", "args": {"path": "a", "diff": "--- a/a\n+++ b/a\n@@\n-x\n+"}}, {"tool": "file_search", "args": {"query": "*.py", "glob": "*.py"}},
        {"tool": "task_plan", "args": {"items": ["a", '{"b":1}']}}, {"tool": "subagent_invoke", "args": {"task": "d", "agent_type": "t"}},
        {"tool": "other", "args": {"name": "Other", "args": {"k": [1]}}}, {"tool": "other", "args": {"name": "unknown", "args": {}}}]
    got = calls(spark, tools.pi_tools, [
        ("edit", {"path": "p", "oldText": "a\nb", "newText": ""}), ("edit", {"path": "p", "edits": [{"oldText": "a"}, {"x": 1}, {"newText": "c"}]}),
        ("edit", {"multi": [{"path": "q", "oldText": "1", "newText": "2"}]}), ("edit", {"multi": [{"path": "q", "oldText": "1"}, {"path": "r", "oldText": "1"}]}),
        ("bash", {"command": ["a b", 1]}), ("ls", {"path": "-x y"}), ("ls", {}), ("grep", {"pattern": "z"})])
    assert got == [
        {"tool": "file_edit", "args": {"path": "p", "diff": "--- a/p\n+++ b/p\n@@ -1,2 +1,0 @@\n-a\n-b"}},
        {"tool": "file_edit", "args": {"path": "p", "diff": "--- a/p\n+++ b/p\n@@ -1,1 +1,0 @@\n-a\n@@ -1,0 +1,1 @@\n+c"}},
        {"tool": "file_edit", "args": {"path": "q", "diff": "--- a/q\n+++ b/q\n@@ -1,1 +1,1 @@\n-1\n+2"}},
        {"tool": "other", "args": {"name": "edit", "args": {"multi": [{"oldText": "1", "path": "q"}, {"oldText": "1", "path": "r"}]}}},
        {"tool": "shell_command", "args": {"command": "'a b'"}}, {"tool": "shell_command", "args": {"command": "ls -- '-x y'"}}, {"tool": "shell_command", "args": {"command": "ls"}}, {"tool": "file_search", "args": {"query": "z"}}]
    got = calls(spark, tools.codex_tools, [("shell", {"command": ["a", 1]}), ("exec_command", {"cmd": "pwd", "cwd": "/"})])
    assert [g["tool"] for g in got] == ["other", "shell_command"]


def test_finer_codex_rules(spark):
    item = lambda kind, **p: {"type": "response_item", "timestamp": "t", "payload": {"type": kind} | p}
    event = lambda kind, **p: {"type": "event_msg", "timestamp": "t", "payload": {"type": kind} | p}
    records = [
        item("custom_tool_call", name="tools.apply_patch", input="*** Begin Patch\n*** Update File: a.py\n*** End Patch", call_id="c"), item("custom_tool_call", name="x", input="y"),
        item("web_search_call", action={"type": "search", "queries": [1, "q"]}), item("web_search_call", action={"type": "open"}), item("tool_search_call", arguments='{"k":1}', call_id="d"),
        item("tool_search_output", tools=[{"n": 1}], call_id="d"), event("mcp_tool_call_end", plugin_id="p", duration={"secs": 1, "nanos": 5_000_000}, result={"Err": 1}),
        event("thread_goal_updated", threadId="a", turn_id="b", goal={"g": 1}), event("web_search_end", query="q", call_id="w"), event("task_complete", turn_id="t", duration_ms=12.9)]
    got = adapters.adapt(parsed(spark, records), adapters.codex_rules(), NAMESPACES["codex/entry"], "codex", adapters.codex_known()).orderBy("record_idx").collect()
    payloads = [json.loads(r["payload"]) for r in got]
    assert payloads[:4] == [
        {"tool": "file_edit", "args": {"path": "a.py", "diff": records[0]["payload"]["input"]}}, {"tool": "other", "args": {"name": "x", "args": {"input": "y"}}},
        {"tool": "web_search", "args": {"query": "q"}}, {"tool": "other", "args": {"name": "web_search_call", "args": {"action": {"type": "open"}}}}]
    assert payloads[4:6] == [{"tool": "other", "args": {"name": "tool_search", "args": {"k": 1}}}, {"ok": True, "output": '[{"n":1}]'}]
    assert payloads[6:] == [
        {"kind": "x-codex/mcp_tool_call_end", "data": {"plugin_id": "p", "duration_ms": 1005, "result_ok": False}}, {"kind": "x-codex/thread_goal_updated", "data": {"thread_id": "a", "turn_id": "b", "goal": {"g": 1}}},
        {"kind": "x-codex/web_search_end", "data": {"query": "q", "call_id": "w"}}, {"kind": "task_completed", "data": {"turn_id": "t", "duration_ms": 12}}]
    assert [r["call_id"] for r in got] == ["c", None, None, None, "d", "d", None, None, None, None] and got[0]["tool_kind"] == "file_edit"


def test_finer_rules_of_the_other_dialects(spark):
    records = [{"type": "thinking_level_change", "thinkingLevel": "high"}, {"type": "session_info"}, {"type": "custom", "customType": "k", "content": " "}, {"type": "custom_message", "content": " x "}, {"type": "compaction", "summary": 3}]
    got = adapters.adapt(parsed(spark, records), adapters.pi_rules(), NAMESPACES["pi/entry"], "pi").orderBy("record_idx").collect()
    assert [json.loads(r["payload"]) for r in got] == [
        {"kind": "x-pi/thinking_level_change", "text": "Thinking level set to high", "data": {"thinking_level": "high"}}, {"kind": "x-pi/session_info", "text": "Session info"},
        {"kind": "x-pi/custom", "text": "Custom: k", "data": {"custom_type": "k"}}, {"kind": "x-pi/custom_message", "text": " x "}]
    records = [
        {"type": "progress", "data": {"type": "hook_progress", "hookEvent": "Stop"}}, {"type": "progress", "data": {"type": "x"}}, {"type": "system", "subtype": "compact_boundary"}, {"type": "system", "subtype": "No!"},
        {"type": "pr-link", "prNumber": 4, "prUrl": "u"}, {"type": "permission-mode", "permissionMode": "plan"}, {"type": "permission-mode", "permissionMode": "default"}, {"type": "summary", "summary": "s", "isCompactSummary": True},
        {"type": "user", "message": {"content": "[Request interrupted by user for tool use]"}}, {"type": "user", "message": {"content": "This session is continued"}}, {"type": "assistant", "message": {"content": [{"type": "redacted_thinking"}]}}]
    out = adapters.adapt(parsed(spark, records), adapters.claude_rules(), NAMESPACES["claude-code/entry"], "claudecode")
    got = [json.loads(r["payload"]) for r in adapters.permission_changes(out).orderBy("record_idx").collect()]
    assert [g.get("kind") for g in got] == ["turn_end", "x-claudecode/progress", "x-claudecode/compact_boundary", "x-claudecode/system", "x-claudecode/pr_link", "permission_mode_change", "permission_mode_change", None, None, "session_start", None]
    assert got[4]["data"] == {"pr_number": 4, "pr_url": "u"} and got[5]["data"] == {"to": "plan"} and got[6]["data"] == {"to": "default", "from": "plan"} and got[6]["text"] == "Permission mode changed: plan → default"
    assert got[7] == {"summary": "s", "trigger": "auto"} and got[8] == {"reason": "user for tool use"} and got[10] == {"text": "[redacted thinking]"}


def test_session_headers(spark):
    claude = [{"type": "ai-title", "aiTitle": "T"}, {"type": "user", "isMeta": True, "timestamp": "0", "sessionId": "no"}, {"type": "user", "sessionId": "s1"}, {"type": "user", "timestamp": "1", "version": "2.0", "cwd": "/w"},
              {"type": "worktree-state", "worktreeSession": {"worktreeName": "n", "worktreePath": "/p", "worktreeBranch": "b", "originalHeadCommit": "zz"}}]
    r = parsed(spark, claude)
    h = headers.session_headers(r, "claude-code").first()
    assert (h["id"], h["ts"], h["version"], h["cwd"], h["status"]) == ("s1", "1", "2.0", "/w", "ok")
    assert h["session_uid"] == str(uuid.uuid5(uuid.UUID(NAMESPACES["claude-code/session"]), "s1"))
    hints = headers.session_hints(r).first()
    assert hints["title"] == "T" and hints["branch"] == "b" and hints["worktree"].asDict() == {"name": "n", "path": "/p", "original_cwd": None, "original_branch": None, "original_head_commit": None}
    codex = headers.session_headers(parsed(spark, [{"type": "session_meta", "timestamp": "t", "payload": {"id": "a", "cli_version": "1"}}]), "codex").first()
    assert (codex["agent"], codex["ts"], codex["status"]) == ("codex-cli", "t", "ok")
    assert headers.session_headers(parsed(spark, [{"type": "event_msg"}, {"type": "session_meta"}]), "codex").first()["status"] == "no_header"
    assert headers.session_headers(parsed(spark, [{"type": "session", "version": 3, "timestamp": "t"}]), "pi").first()["status"] == "missing_id"


def test_file_checks(spark, tmp_path):
    raw = lambda ref: {"raw": {"envelope_ref": ref}}
    body = [entry(1, "user_message", {"text": "a", "more": 1}), entry(2, "agent_message", {"text": "b", "usage": {"input_tokens": 1}}, source=raw(ulid(1))), entry(3, "agent_message", {"text": "b", "usage": {}}, source=raw(ulid(9)))]
    first = HEADER | {"content_hash": "<pending>", "vcs": {"type": "git", "revision": "r", "remote_url": "https://u:%41b@h/x"}}
    first["content_hash"] = hashlib.sha256("".join(hashing.canonical_json(x) + "\n" for x in [first, *body]).encode()).hexdigest()
    second = HEADER | {"id": ulid(20), "content_hash": "0" * 64, "fork_from": {"session_id": ulid(0), "content_hash": "1" * 64}}
    envelope = {"type": "trail", "schema_version": "0.1.0", "id": ulid(30), "ts": HEADER["ts"], "producer": "p", "sessions": [{"id": ulid(0), "agent": "y"}, {"id": ulid(21), "agent": "x"}, {"id": "z"}]}
    records = [envelope, first, *body, second, entry(22, "x_new", {}), entry(23, "session_end", {"reason": "bored"})]
    want = [(1, "envelope_sessions_manifest_drift")] * 3 + [(2, "vcs_remote_url_with_credentials"), (3, "additionalProperties"), (4, "usage_missing_required")] + [(5, "source_raw_envelope_ref_unresolved")] + [(5, "usage_missing_required")] * 2
    want += [(6, "content_hash_mismatch"), (6, "cross_group_fork_from_hash_mismatch"), (7, "enum"), (8, "enum")]
    assert codes(spark, tmp_path, "checks", records) == want
    found = rules.validate(jsonl.strict(jsonl.lines(spark, str(tmp_path / "checks"))), "reader-tolerant")
    soft = {(r["line"], r["code"], r["severity"]) for r in found.collect()}
    assert {(7, "reader_tolerant_unknown_record", "warning"), (3, "reader_tolerant_unknown_payload_field", "warning"), (6, "content_hash_mismatch", "warning"), (2, "vcs_remote_url_with_credentials", "error")} <= soft


def test_redacted_records(spark):
    key = "sk-ant-" + "a" * 20
    dirty = [
        {"type": "session", "id": "me@x.org", "content_hash": "f" * 64, "vcs": {"revision": "r", "remote_url": "https://h/x"}, "cwd": "/home/ann/w"},
        {"type": "tool_call", "id": "1", "payload": {"tool": "t", "args": {"deep": [key, {"k": f"{key} {key} hunter22"}], "n": 5}}},
        {"type": "x-new", "payload": {"text": "mail me@x.org"}}]
    clean = '{"type": "session",  "content_hash":"' + "e" * 64 + '"}'
    rows = [("a", i, json.dumps(r)) for i, r in enumerate(dirty)] + [("b", 0, clean)]
    got = redact.redact_records(spark.createDataFrame(rows, "file string, line int, raw string"), secrets=["hunter22", "hunter"]).orderBy("file", "line").collect()
    a = [json.loads(r["raw"]) for r in got]
    assert a[0] == {"type": "session", "id": "me@x.org", "content_hash": "<pending>", "vcs": {"revision": "r"}, "cwd": "<home>/w"}
    assert a[1]["payload"]["args"] == {"deep": ["[ANTHROPIC_KEY]", {"k": "[ANTHROPIC_KEY] [ANTHROPIC_KEY] [USER_SECRET]"}], "n": 5} and a[2]["payload"]["text"] == "mail [EMAIL]"
    assert [r["counts"] for r in got] == [{"vcs_remote_url": 1, "home_path": 1}, {"anthropic_api_key": 3, "user_secret": 1}, {"email_pii": 1}, {}]
    assert got[3]["raw"] == clean
