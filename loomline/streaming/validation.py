"""Checks of session files while they are written, as state of a stream.

Each line's own rules are columns. What needs the lines before it is state of the file:
which ids were seen and where, the session the line stands in and whether its header is of
a known version, the latest header time, the first revision. A finding is told as soon as it
is certain: a repeated id with its line, an unknown parent when its session ends, a wrong
hash when the file does. A file ends with a marker row, a line number that is null; a file
that only falls silent is told by a timer, with findings marked as not final.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomline.operators import rules
from loomline.operators.hashing import PENDING, canonical_json
from loomline.operators.redact import CREDENTIALS, suspect
from loomline.session import ship
from loomline.sources.jsonl import parsed

DIAGNOSTICS = "file string, line int, path string, severity string, code string, message string, final boolean"
#: What the state remembers of a file besides its tables; JSON in one value, so that a field more needs no new schema.
START = {"first": None, "grp": 0, "valid": False, "opened": False, "ended": False, "claim": None, "latest": None, "revision": None, "headers": 0, "envelopes": 0, "listed": None, "sealed": None, "bad_first": None, "fault": False, "seen": 0, "quiet": False, "far": False, "near": {}}
#: Characters of JSON up to which the tables of a file stay in the value that is read and written once a batch.
NEAR = 1 << 15
_DIAGNOSTIC = Row("file", "line", "path", "severity", "code", "message", "final")
_HEX = frozenset("0123456789abcdef")


def _is_hash(text) -> bool:
    return isinstance(text, str) and len(text) == 64 and set(text) <= _HEX


def unmatched(events: list[tuple]) -> list[tuple[int, str]]:
    """(line, id) of calls without a result among a session's (line, kind, id, for_id, call_id): by name, then in order by call_id, then the nearest before."""
    calls, results = [e for e in events if e[1] == "tool_call"], [e for e in events if e[1] == "tool_result"]
    named, known = {r[3] for r in results if r[3] is not None}, {c[2] for c in calls if c[2] is not None}
    calls, results = [c for c in calls if c[2] not in named], [r for r in results if r[3] not in known]
    by_call: dict[str, list[list]] = defaultdict(lambda: [[], []])
    for side, some in enumerate((calls, results)):
        for e in some:
            if e[4] is not None:
                by_call[e[4]][side].append(e)
    paired = {e[0] for two in by_call.values() for some in two for e in some[:min(map(len, two))]}
    open_: list[tuple] = []
    for e in sorted((e for e in (*calls, *results) if e[0] not in paired), key=lambda e: e[0]):
        if e[1] == "tool_call":
            open_.append(e)
        elif open_:
            open_.pop()
    return [(c[0], c[2]) for c in open_]


def on_cycles(parents: dict[str, str]) -> set[str]:
    """Ids that their own chain of parents comes back to."""
    done: set[str] = set()
    found: set[str] = set()
    for start in parents:
        path: dict[str, int] = {}
        at = start
        while at in parents and at not in done and at not in path:
            path[at] = len(path)
            at = parents[at]
        if at in path:
            found |= {k for k, n in path.items() if n >= path[at]}
        done |= path.keys()
    return found


def leaf_secrets(value, root: str) -> Iterator[tuple[str, str]]:
    """(path, pattern) of each string of a record with each credential in it; for the few lines that may hold one."""
    stack = [(value, root)]
    while stack:
        at, path = stack.pop()
        if isinstance(at, str):
            yield from ((path, name) for name, pattern, _ in CREDENTIALS if re.search(pattern, at))
        elif isinstance(at, (dict, list)):
            stack += [(x, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}") for k, x in (at.items() if isinstance(at, dict) else enumerate(at))]


class _List:
    """A list state, or a list in memory while its file is small."""

    def __init__(self, state):
        self.state, self.near = state, None

    def load(self, near: list | None) -> None:
        self.near = None if near is None else list(map(tuple, near))

    def get(self) -> Iterator[tuple]:
        return self.state.get() if self.near is None else iter(self.near)

    def appendValue(self, row: tuple) -> None:
        self.state.appendValue(row) if self.near is None else self.near.append(row)

    def clear(self) -> None:
        if self.near is None:
            self.state.clear()
        else:
            self.near.clear()

    def move(self) -> None:
        if self.near:
            self.state.appendList(self.near)


class _Map(_List):
    """A map state with keys of one field, or a dict in memory while its file is small."""

    def load(self, near: list | None) -> None:
        self.near = None if near is None else {k: tuple(v) for k, v in near}

    def containsKey(self, key: tuple) -> bool:
        return self.state.containsKey(key) if self.near is None else key[0] in self.near

    def getValue(self, key: tuple) -> tuple:
        return self.state.getValue(key) if self.near is None else self.near[key[0]]

    def updateValue(self, key: tuple, value: tuple) -> None:
        if self.near is None:
            self.state.updateValue(key, value)
        else:
            self.near[key[0]] = value

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        return self.state.iterator() if self.near is None else (((k,), v) for k, v in self.near.items())

    def move(self) -> None:
        for k, v in self.near.items():
            self.state.updateValue((k,), v)


class _Table:
    """A map state that is asked once a key and batch."""

    def __init__(self, state):
        self.state, self.kept, self.changed = state, {}, set()

    def get(self, key):
        if key not in self.kept:
            self.kept[key] = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
        return self.kept[key]

    def put(self, key, value) -> None:
        self.kept[key] = value
        self.changed.add(key)

    def save(self) -> None:
        for key in self.changed:
            self.state.updateValue((key,), self.kept[key])
        self.changed.clear()


class FileChecks(StatefulProcessor):
    """The state of one file; rows are its lines, in any order within a batch, batches in order.

    What a small file has come to is one value, read and written once a batch. A file that
    outgrows it goes to tables, which are asked by key; a file that ends in the batch it
    began in is never written.
    """

    def __init__(self, profile: str, idle_ms: int | None, near: int = NEAR):
        self.profile, self.idle_ms, self.near = profile, idle_ms, near

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "value string")
        # First line in the file; the last session in which it is an event's id, and its first line there; first line as an event of a session of a known version.
        self.ids = _Map(handle.getMapState("ids", "id string", "first int, grp int, line int, event int"))
        self.parents = _Map(handle.getMapState("parents", "id string", "parent string, line int"))
        self.waiting = _Map(handle.getMapState("waiting", "line int", "parent string"))
        self.tools = _List(handle.getListState("tools", "line int, kind string, id string, for_id string, call_id string"))
        self.declared = _List(handle.getListState("declared", "id string"))
        self.orphans = _List(handle.getListState("orphans", "line int"))
        self.heads = _List(handle.getListState("heads", "line int, id string, agent string, content_hash string, forked_from string, forked_hash string, valid boolean"))
        self.wrong = _List(handle.getListState("wrong", "line int, actual string"))
        # Canonical lines, only while a header or an envelope claims a hash of them.
        self.group_text = _List(handle.getListState("group_text", "text string"))
        self.file_text = _List(handle.getListState("file_text", "text string"))
        self.tables = {name: x for name, x in vars(self).items() if isinstance(x, _List)}

    def close(self) -> None:
        pass

    def _load(self, kept: tuple | None) -> dict:
        """Where the file stands; states written before there was a near value have tables only."""
        at = json.loads(json.dumps(START)) if kept is None else START | {"far": True} | json.loads(kept[0])
        near = at.pop("near")
        for name, table in self.tables.items():
            table.load(None if at["far"] else near.get(name, []))
        return at

    def _save(self, at: dict) -> None:
        """Keep what `_load` reads; a file whose tables have grown moves them out of the value, for good."""
        near = {}
        if not at["far"]:
            near = {name: list(t.near.items()) if isinstance(t, _Map) else t.near for name, t in self.tables.items() if t.near}
        text = json.dumps(at | {"near": near})
        if len(text) > self.near and not at["far"]:
            for table in self.tables.values():
                table.move()
                table.load(None)
            at["far"] = True
            text = json.dumps(at | {"near": {}})
        self.at.update((text,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at = self._load(self.at.get())
        out: list[tuple] = []
        ids, new = _Table(self.ids), True
        for r in sorted(rows, key=lambda r: (r.line is None, r.line or 0)):
            if r.line is None:
                ids.save()
                out += [(*d, True) for d in (*self._end_of_session(at), *self._end_of_file(at))]
                self._forget(every=True)
                self.at.clear()
                at, ids, new = self._load(None), _Table(self.ids), True
            else:
                new = False
                if not at["fault"]:
                    out += [(*d, True) for d in self._line(r, at, ids)]
        ids.save()
        if not new:
            at["seen"], at["quiet"] = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0, False
            self._save(at)
            if self.idle_ms:
                self.handle.registerTimer(at["seen"] + self.idle_ms)
        for d in out:
            yield _DIAGNOSTIC(key[0], *d)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.at.exists():
            at = self._load(self.at.get())
            # Timers of earlier batches run out too; only the one after the last line counts.
            if not at["quiet"] and expiredTimerInfo.getExpiryTimeInMs() >= at["seen"] + self.idle_ms:
                for d in (*self._end_of_session(at, keep=True), *self._end_of_file(at)):
                    yield _DIAGNOSTIC(key[0], *d, False)
                self._save(at | {"quiet": True})

    def _line(self, r, at: dict, ids: _Table) -> Iterator[tuple]:
        line = r.line
        if r.code is not None:
            at["fault"] = True
            yield line, "", "error", "parse", r.code
            return
        for d in json.loads(r.found):
            yield line, d["path"], d["severity"], d["code"], d["message"]
        if r.leaky:
            for path, name in leaf_secrets(json.loads(r.text)["source"]["raw"], "/source/raw"):
                yield line, path, "warning", "source_raw_unredacted_secret", name
        at["first"] = line if at["first"] is None else at["first"]
        if r.type == "session":
            ids.save()
            yield from self._end_of_session(at)
            yield from self._header(r, at)
        elif r.type == "trail":
            at["envelopes"] += 1
            if at["envelopes"] > 1:
                yield line, "", "error", "multiple_envelopes", "a file has one envelope"
            else:
                at["listed"] = [line, r.sessions]
            if line > 1:
                yield line, "", "error", "envelope_not_at_line_1", "the envelope is the first line"
            if r.has_parent:
                yield line, "/parent_id", "error", "envelope_has_parent_id", "an envelope has no parent"
            if line == 1 and _is_hash(r.content_hash):
                at["sealed"] = [line, r.content_hash]
        if at["grp"] == 0 and not (r.type == "trail" and line == 1):
            self.orphans.appendValue((line,))
        known = ids.get(r.id) if r.id is not None else None
        if known:
            yield line, "/id", "error", "duplicate_id", f"first on line {known[0]}"
        if at["grp"] and r.type not in ("session", None):
            yield from self._event(r, at, ids, known)
        elif r.id is not None and not known:
            ids.put(r.id, (line, -1, -1, -1))
        if at["claim"] or at["sealed"]:
            value = json.loads(r.text)
            pinned = canonical_json(value | {"content_hash": PENDING})
            own = r.content_hash is not None
            if at["claim"]:
                self.group_text.appendValue((pinned if r.type == "session" and own else canonical_json(value),))
            if at["sealed"]:
                self.file_text.appendValue((pinned if r.type == "trail" and line == 1 else canonical_json(value),))

    def _header(self, r, at: dict) -> Iterator[tuple]:
        line, version = r.line, r.schema_version
        patch = version is not None and version.startswith("0.1.") and version[4:].isascii() and version[4:].isdigit()
        valid = version == rules.SCHEMA_VERSION or self.profile == "reader-tolerant" and patch
        if not at["headers"]:
            for o in self.orphans.get():
                yield o[0], "", "error", "events_before_first_session_header", "an event before the first header"
            self.orphans.clear()
            at["bad_first"] = None if valid else line
        at |= {"headers": at["headers"] + 1, "grp": at["grp"] + 1, "valid": valid, "opened": valid and r.stream_state == "open", "ended": False, "claim": [line, r.content_hash] if _is_hash(r.content_hash) else None}
        if r.has_parent:
            yield line, "/parent_id", "error", "header_has_parent_id", "a header has no parent"
        if self.profile == "reader-tolerant" and patch and version != rules.SCHEMA_VERSION:
            yield line, "/schema_version", "warning", "reader_tolerant_schema_version", version
        if r.content_hash is not None and not _is_hash(r.content_hash) and r.content_hash != PENDING:
            yield line, "/content_hash", "error", "content_hash_invalid", r.content_hash
        self.heads.appendValue((line, r.id, r.agent, r.content_hash, r.forked_from, r.forked_hash, bool(valid)))
        if not valid:
            return
        if r.stream_state == "open" and r.content_hash is not None:
            yield line, "/content_hash", "warning", "stream_open_with_content_hash", "an open stream has no hash"
        if r.ts is not None:
            if at["latest"] is not None and r.ts < at["latest"]:
                yield line, "/ts", "warning", "out_of_order_session_headers", r.ts
            at["latest"] = max(r.ts, at["latest"] or r.ts)
        if r.revision is not None:
            if at["revision"] is not None and r.revision != at["revision"]:
                yield line, "/vcs/revision", "warning", "vcs_revision_divergence", r.revision
            at["revision"] = at["revision"] or r.revision

    def _event(self, r, at: dict, ids: _Table, known) -> Iterator[tuple]:
        """A line of a session that is no header; `known` is where its id was seen before."""
        line, grp = r.line, at["grp"]
        inside = at["valid"] and r.type != "trail"
        here = known and known[1] == grp
        if inside:
            if at["opened"] and r.type in ("session_end", "session_terminated"):
                yield line, "/type", "warning", "stream_open_with_terminal_event", r.type
            if r.type == "session_end" and r.final_message_id is not None and not ids.get(r.final_message_id):
                yield line, "/payload/final_message_id", "warning", "unknown_final_message_id", r.final_message_id
            if r.envelope_ref is not None and not ((ref := ids.get(r.envelope_ref)) and ref[3] >= 0):
                yield line, "/source/raw/envelope_ref", "error", "source_raw_envelope_ref_unresolved", r.envelope_ref
            if r.type in ("tool_call", "tool_result"):
                self.tools.appendValue((line, r.type, r.id, r.for_id, r.call_id))
            at["ended"] = at["ended"] or r.type == "session_end"
        if r.type == "session_terminated" and r.open_call_ids is not None:
            for x in json.loads(r.open_call_ids):
                if x is not None:
                    self.declared.appendValue((x,))
        if r.id is not None:
            event = known[3] if known and known[3] >= 0 else line if inside else -1
            ids.put(r.id, (known[0] if known else line, grp, known[2] if here else line, event))
        if r.parent_id is not None:
            parent = ids.get(r.parent_id)
            if not (parent and parent[1] == grp):
                self.waiting.updateValue((line,), (r.parent_id,))
            if r.id is not None and not here:
                self.parents.updateValue((r.id,), (r.parent_id, line))

    def _end_of_session(self, at: dict, keep: bool = False) -> list[tuple]:
        """What only the whole session shows; its state goes unless it is kept."""
        out: list[tuple] = []
        if not at["grp"]:
            return out
        for (line,), (parent,) in self.waiting.iterator():
            found = self.ids.getValue((parent,)) if self.ids.containsKey((parent,)) else None
            if not (found and found[1] == at["grp"]):
                out.append((line, "/parent_id", "error", "unknown_parent_id", parent))
        chain = {k[0]: v for k, v in self.parents.iterator()}
        out += [(chain[k][1], "/parent_id", "error", "parent_cycle", k) for k in on_cycles({k: v[0] for k, v in chain.items()})]
        if at["valid"] and not at["ended"]:
            declared = {x[0] for x in self.declared.get()}
            out += [(line, "/id", "warning", "unmatched_tool_call_at_eof", f'tool_call "{i}" has no matching tool_result at EOF') for line, i in unmatched([tuple(t) for t in self.tools.get()]) if i not in declared]
        if at["claim"] and (actual := self._digest(self.group_text)) != at["claim"][1] and not keep:
            self.wrong.appendValue((at["claim"][0], actual))
        if not keep:
            self._forget()
            at["claim"] = None
        return out

    def _end_of_file(self, at: dict) -> Iterator[tuple]:
        if at["first"] is None:
            return
        code = "missing_header_after_envelope" if at["envelopes"] else "missing_header"
        if not at["headers"]:
            yield at["first"], "", "error", code, "no session header"
        elif at["bad_first"] is not None:
            yield at["bad_first"], "", "error", code, "the first header is of no known version"
        heads = [tuple(h) for h in self.heads.get()]
        sealed = {h[1]: h[3] for h in heads if h[6] and h[1] is not None and h[3] is not None and h[3] != PENDING}
        for line, _, _, _, source, claim, valid in heads:
            if valid and claim is not None and source in sealed and claim != sealed[source]:
                yield line, "/fork_from/content_hash", "warning", "cross_group_fork_from_hash_mismatch", sealed[source]
        if at["listed"] and at["listed"][1] is not None:
            line, listed = at["listed"][0], json.loads(at["listed"][1])
            if len(listed) != len(heads):
                yield line, "/sessions", "warning", "envelope_sessions_manifest_drift", f"{len(listed)} sessions listed, {len(heads)} in the file"
            for k, (one, h) in enumerate(zip(listed, heads)):
                for name, own in (("id", h[1]), ("agent", h[2])):
                    if one.get(name) is not None and one[name] != own:
                        yield line, f"/sessions/{k}/{name}", "warning", "envelope_sessions_manifest_drift", one[name]
        if not at["fault"]:
            wrong = [tuple(w) for w in self.wrong.get()]
            if at["claim"] and (actual := self._digest(self.group_text)) != at["claim"][1]:
                wrong.append((at["claim"][0], actual))
            if at["sealed"] and (actual := self._digest(self.file_text)) != at["sealed"][1]:
                wrong.append((at["sealed"][0], actual))
            for line, actual in wrong:
                yield line, "/content_hash", "warning" if self.profile == "reader-tolerant" else "error", "content_hash_mismatch", actual

    @staticmethod
    def _digest(texts) -> str:
        sha = hashlib.sha256()
        for t in texts.get():
            sha.update(t[0].encode() + b"\n")
        return sha.hexdigest()

    def _forget(self, every: bool = False) -> None:
        for state in (self.parents, self.waiting, self.tools, self.declared, self.group_text, *((self.ids, self.orphans, self.heads, self.wrong, self.file_text) if every else ())):
            state.clear()


def validated(lines: DataFrame, profile: str = "strict", idle_ms: int | None = None, near: int = NEAR) -> DataFrame:
    """(file, line, path, severity, code, message, final) of a stream (file, line, raw), raw text or bytes.

    A row with a null line ends its file; its state goes then. The final diagnostics of a
    file that has ended are those of `rules.validate` on its lines, however they were cut into
    batches; a file's lines come in order from batch to batch. A file from which nothing came
    for `idle_ms` is told what its end would show, with `final` false, once for each silence.
    The state of a file of up to `near` characters is one value, above it tables.
    Needs the RocksDB state store, which is set here.
    """
    if profile not in rules.PROFILES:
        raise TypeError(f"no profile: {profile}")
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ship(spark)
    rows = rules.record_findings(rules.fields(parsed(lines.select("file", "line", F.col("raw").cast("binary").alias("raw")))), profile)
    listed = F.transform(rules.field("$.sessions", "array<variant>"), lambda s: F.struct(F.try_variant_get(s, "$.id", "string").alias("id"), F.try_variant_get(s, "$.agent", "string").alias("agent")))
    facts = rows.select(
        "file", "line", F.when(F.col("line").isNotNull(), F.col("code")).alias("code"), F.to_json("found").alias("found"), "type", "id", "parent_id", "has_parent", "ts", "schema_version", "content_hash", "stream_state", "call_id", "for_id",
        "revision", "final_message_id", "agent", "forked_from", "forked_hash", "envelope_ref", F.to_json(listed).alias("sessions"), F.to_json(rules.field("$.payload.open_call_ids", "array<string>")).alias("open_call_ids"), F.to_json("value").alias("text"), F.coalesce(suspect(F.to_json(rules.source_raw()), CREDENTIALS), F.lit(False)).alias("leaky"))
    return facts.groupBy("file").transformWithState(FileChecks(profile, idle_ms, near), DIAGNOSTICS, "Append", "ProcessingTime" if idle_ms else "None")
