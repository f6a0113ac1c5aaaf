"""Session files found by their heads."""

import builtins
import datetime
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from loomline.functions import scalars
from loomline.sources import discovery

IDENT = "0a16dbc7-c189-4def-a378-95ab1c2d3e45"


def put(path, *records, raw=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(raw if raw is not None else "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in records).encode())


@pytest.fixture
def projects(tmp_path):
    put(tmp_path / "-w-a" / "s1.jsonl", {"type": "queue"}, {"cwd": "/w/a", "version": "9"}, {"cwd": "/other"})
    put(tmp_path / "-w-a" / "s2.jsonl", {"version": "1.0.2", "type": "x"})
    put(tmp_path / "-w-a" / "notes.txt", {"cwd": "/w/a"})
    put(tmp_path / "-w-a" / "deeper" / "s9.jsonl", {"cwd": "/w/a"})
    put(tmp_path / "-w-b" / "s3.jsonl", raw=b'not json\n{"cwd": ""}\n[1]\n{"cwd":"/w/b\xc3\xa9"}\n{"cut')
    put(tmp_path / "-w-b" / "s4.jsonl", raw=b"")
    # The line that the limit cuts is left out, though what is cut off would name a directory.
    put(tmp_path / "-w-c" / "s5.jsonl", raw=b'{"a":"' + b"\xc3\xa9" * discovery.HEAD_BYTES + b'"}\n{"cwd":"/w/c"}\n')
    return tmp_path


def test_projects(spark, projects):
    rows = {r["id"]: r for r in discovery.heads(spark, str(projects), "claude-code").collect()}
    assert {(k, r["project"], r["cwd"], r["version"]) for k, r in rows.items()} == {
        ("s1", "-w-a", "/w/a", None), ("s2", "-w-a", None, "1.0.2"), ("s3", "-w-b", "/w/bé", None), ("s4", "-w-b", None, None), ("s5", "-w-c", None, None)}
    assert {r["id"] for r in discovery.detected(spark, str(projects), "claude-code", "/w/a").collect()} == {"s1", "s2"}
    assert [r["id"] for r in discovery.heads(spark, str(projects), "claude-code").filter("cwd = '/w/a'").collect()] == ["s1"]
    assert discovery.heads(spark, str(projects / "none"), "pi").count() == 0 and discovery.detected(spark, str(projects), "claude-code", "/nowhere").count() == 0
    newest = discovery.newest_version(discovery.detected(spark, str(projects), "claude-code", "/w/a").filter("version is not null")).first()
    assert newest["version"] == "1.0.2"


def test_what_is_filtered_is_never_opened(projects, monkeypatch):
    """Folders of other directories are not listed, files are read no further than their head."""
    opened, listed, read = [], [], []
    real, scan = builtins.open, os.scandir

    def spy(path, *a, **k):
        f = real(path, *a, **k)
        opened.append(os.path.basename(path))

        class Counted:
            def __enter__(self):
                return self

            def __exit__(self, *e):
                f.close()

            def read(self, n):
                read.append(n)
                return f.read(n)

        return Counted()

    monkeypatch.setattr(builtins, "open", spy)
    monkeypatch.setattr(os, "scandir", lambda p: listed.append(os.path.basename(p)) or scan(p))

    def ids(*filters):
        opened.clear(), listed.clear(), read.clear()
        reader = discovery.HeadsReader({"path": str(projects), "agent": "claude-code"})
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return sorted(r[1] for p in reader.partitions() for r in reader.read(p))

    assert ids(EqualTo(("cwd",), "/w/a")) == ["s1", "s2"] and sorted(opened) == ["s1.jsonl", "s2.jsonl"] and listed == ["-w-a"] and set(read) == {discovery.HEAD_BYTES}
    assert ids(In(("project",), ("-w-b", "-w-c"))) == ["s3", "s4", "s5"] and "-w-a" not in listed
    assert ids(EqualTo(("cwd",), "/w/a"), EqualTo(("project",), "-w-b")) == [] and not opened
    os.utime(projects / "-w-a" / "s1.jsonl", (1000, 1000))
    assert "s1" not in ids(GreaterThan(("modified_at",), datetime.datetime(2001, 1, 1, tzinfo=datetime.timezone.utc))) and "s1.jsonl" not in opened
    assert ids(EqualTo(("project",), "../x")) == []


def test_dates_and_wrapped_folders(spark, tmp_path):
    root = tmp_path / "dates"
    put(root / "2024" / "01" / "02" / "rollout-a.jsonl", {"type": "session_meta", "payload": {"id": "x1", "cwd": "/w", "cli_version": "0.128.0"}})
    put(root / "2024" / "01" / "03" / "more" / f"rollout-b-{IDENT}.jsonl", {}, {"cwd": "/v"})
    put(root / "2024" / f"{IDENT}.jsonl", {"id": "flat", "payload": {"originator": "o"}})
    put(root / "rollout-c.jsonl", raw=b"??\n")
    got = {(r["id"].split("/")[-1], r["cwd"], r["version"], r["header_status"]) for r in discovery.heads(spark, str(root), "codex").collect()}
    assert got == {("x1", "/w", "0.128.0", "header"), (IDENT, "/v", None, "filename-fallback"), ("flat", None, "o", "header"), ("rollout-c.jsonl", None, None, "filename-fallback")}
    assert {r["id"].split("/")[-1] for r in discovery.detected(spark, str(root), "codex", "/w").collect()} == {"x1", "flat", "rollout-c.jsonl"}
    put(tmp_path / "pi" / "--w-a--" / "p.jsonl", {"type": "session", "version": 3, "cwd": "/w/a"})
    assert [tuple(r)[1:6:2] for r in discovery.heads(spark, str(tmp_path / "pi"), "pi").filter("cwd = '/w/a'").select("agent", "id", "path", "cwd", "project", "version").collect()] == [("p", "/w/a", "3")]
    paths = ["/w/a", "C:\\w\\a", "w", ""]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", scalars.mangled_cwd("p").alias("a"), scalars.mangled_cwd("p", wrapped=True).alias("b"))
    assert all((r["a"], r["b"]) == (discovery.mangled(r["p"], "claude-code"), discovery.mangled(r["p"], "pi")) for r in df.collect())
    with pytest.raises(Exception, match="no agent"):
        spark.read.format("session_heads").option("path", "x").option("agent", "?").load().filter(F.lit(True)).count()
