"""Live sessions as streams: growing files, checks of each line, and open tool calls as state."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Tail(InputPartition):
    def __init__(self, path: str, lo: int, hi: int, line: int):
        self.path, self.lo, self.hi, self.line = path, lo, hi, line


#: Bytes that the driver looks at together when it counts the lines of what is new.
BLOCK = 1 << 20


class TailReader(DataSourceStreamReader):
    """Complete lines that were appended to the files of a folder, which driver and executors both see.

    The offset holds bytes and lines of each file. Only what was appended since the last
    look is read to find its last line feed; a restarted query looks once from the start.
    A file that has become shorter is a new file.
    """

    def __init__(self, options):
        self.folder = options["path"]
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        for name in sorted(os.listdir(self.folder)):
            if name.endswith(".jsonl"):
                path = os.path.join(self.folder, name)
                end, lines = self.known.get(name, [0, 0])
                if os.path.getsize(path) < end:
                    end, lines = 0, 0
                with open(path, "rb") as f:
                    f.seek(end)
                    at = end
                    while data := f.read(BLOCK):
                        if (last := data.rfind(b"\n")) >= 0:
                            end, lines = at + last + 1, lines + data.count(b"\n")
                        at += len(data)
                self.known[name] = [end, lines]
        return {"files": json.dumps(self.known)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        return [Tail(name, *[old.get(name, [0, 0])[0], at], old.get(name, [0, 0])[1]) for name, (at, _) in new.items() if at > old.get(name, [0, 0])[0]]

    def read(self, partition: Tail) -> Iterator[tuple]:
        with open(os.path.join(self.folder, partition.path), "rb") as f:
            f.seek(partition.lo)
            data = f.read(partition.hi - partition.lo)
        for k, raw in enumerate(data.split(b"\n")[:-1]):
            yield partition.path, partition.line + k + 1, raw.removesuffix(b"\r").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """spark.readStream.format("jsonl_tail").option("path", folder): (file, line, raw) of files that grow."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "file string, line int, raw string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def line_faults(lines: DataFrame) -> DataFrame:
    """(file, line, code) of faulty lines as they arrive; works on streams and tables."""
    value = F.try_parse_json("raw")
    code = F.when(F.trim("raw") == "", "empty_line").when(value.isNull(), "invalid_json").when(~F.schema_of_variant(value).startswith("OBJECT"), "non_object")
    return lines.withColumn("code", code).filter("code is not null").select("file", "line", "code")


def _step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the open calls of a session, oldest first.

    A result closes the call it names; else the oldest one with its call_id; else the
    latest one. The frames of a batch are one stretch of the session, in order of ord.
    """
    calls = [list(c) for c in zip(*state.get)] if state.exists else []
    out = []
    rows = pd.concat(list(frames)).sort_values("ord", kind="stable")
    for r in rows.itertuples():
        if r.kind == "tool_call":
            calls.append([r.id, r.call_id, r.ord])
        elif r.kind == "tool_result" and calls:
            named = [c for c in calls if r.for_id is not None and c[0] == r.for_id]
            alike = [c for c in calls if r.call_id is not None and c[1] == r.call_id]
            calls.remove((named or alike or calls[-1:])[0])
        elif r.kind == "session_end":
            calls = []
        elif r.kind == "session_terminated":
            out += [(key[0], c[0], c[2]) for c in calls]
            calls = []
    state.update(([c[0] for c in calls], [c[1] for c in calls], [int(c[2]) for c in calls]))
    yield pd.DataFrame(out, columns=["session", "id", "ord"])


def open_calls(entries: DataFrame) -> DataFrame:
    """Calls still open when their session terminates, from a stream (session, ord, kind, id, for_id, and call_id if there is one).

    The state of a session is its open calls; it empties when the session ends.
    """
    call_id = F.col("call_id").cast("string") if "call_id" in entries.columns else F.lit(None).cast("string")
    rows = entries.select("session", "ord", "kind", "id", "for_id", call_id.alias("call_id"))
    return rows.groupBy("session").applyInPandasWithState(_step, "session string, id string, ord long", "ids array<string>, call_ids array<string>, ords array<long>", "append", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events of resumed sessions once each, within the lateness."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(["id"])
