"""Index files that are read, and indexes that are rebuilt from objects, good and bad ones."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomline.operators import reconcile
from loomline.sources import store
from tests.test_reconcile import entry, frame, header

A, B = "a" * 64, "b" * 64


def test_index_files(spark, tmp_path):
    path = tmp_path / "objects.json"
    assert store.read_index(spark, str(path)).count() == 0
    path.write_text(json.dumps({"version": 1, "entries": {A: {"registered_at": "t", "source_path": None, "session_uid": "u"}, B: {"registered_at": "t2", "source_path": "p", "kind": "trail"}}}))
    assert sorted(map(tuple, store.read_index(spark, str(path)).collect())) == [(A, "t", None, "u", "session"), (B, "t2", "p", None, "trail")]
    path.write_text('{"version": 1, "entries": {}}')
    assert store.read_index(spark, str(path)).count() == 0
    for text, error in (('{"version": 2, "entries": {}}', store.IndexVersion), ('{"entries": {}}', store.IndexVersion), ('{"version": 1', store.IndexCorrupt), ("[]", store.IndexCorrupt), ('{"version": 1, "entries": [1]}', store.IndexCorrupt), ("", store.IndexCorrupt)):
        path.write_text(text)
        with pytest.raises(error):
            store.read_index(spark, str(path))


def test_rebuild(spark, tmp_path):
    one, two = [header("u"), entry(1)], [{"type": "trail", "schema_version": "0.1.0", "id": "01ARZ3NDEKTSV4RRFFQ69G0001", "ts": "2024-01-01T00:00:00.000Z", "producer": "p"}, header("v"), entry(2), header("w", id="01ARZ3NDEKTSV4RRFFQ69G0007"), entry(3)]
    done = {}
    for r in reconcile.stamp(frame(spark, {"one": one, "two": two})).orderBy("file", "line").collect():
        done.setdefault(r["file"], []).append(r["raw"])
    claim = lambda text: json.loads(text)["content_hash"]
    name = lambda h: f"{h}.trail.jsonl"
    good, whole = claim(done["one"][0]), claim(done["two"][0])
    files = {
        name(good): "\n".join(done["one"]) + "\n", name(whole): "\n".join(done["two"]) + "\n", "readme.txt": "x\n", name("1" * 64): "\n".join(done["one"]) + "\n",
        name("2" * 64): done["one"][0] + "\n" + done["one"][1][:20] + "\n", name("3" * 64): "", name("4" * 64): json.dumps(header("x")) + "\n",
        name("5" * 64): done["one"][0] + "\n" + json.dumps(entry(8)) + "\n", name("6" * 64): json.dumps(entry(1)) + "\n", "UPPER.trail.jsonl": "\n".join(done["one"]) + "\n",
    }
    for k, text in files.items():
        (tmp_path / k).write_text(text)
        os.utime(tmp_path / k, (1_700_000_000, 1_700_000_000))
    rebuilt = store.rebuild(spark, str(tmp_path))
    rows = {r["file"].split("/")[-1]: r for r in rebuilt.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {
        name(good): "indexed", name(whole): "indexed", "readme.txt": "not_an_object", name("1" * 64): "renamed", name("2" * 64): "unreadable",
        name("4" * 64): "no_hash", name("5" * 64): "mismatch", name("6" * 64): "no_header", "UPPER.trail.jsonl": "not_an_object"}
    assert (rows[name(good)]["content_hash"], rows[name(good)]["session_uid"], rows[name(good)]["kind"]) == (good, "u", "session") and rows[name(whole)]["kind"] == "trail"
    assert rows[name("2" * 64)]["detail"] == "line 2 invalid_json" and len(rows[name("5" * 64)]["detail"]) == 64
    assert rebuilt.filter("status = 'indexed'").select(F.unix_timestamp("registered_at").alias("t")).first()["t"] == 1_700_000_000
    assert {r["status"]: r["files"] for r in store.rebuild_counters(rebuilt).collect()} == {"indexed": 2, "not_an_object": 2, "renamed": 1, "unreadable": 1, "no_header": 1, "no_hash": 1, "mismatch": 1}
