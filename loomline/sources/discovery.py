"""Finding session files by their heads, and reading sessions kept in SQLite files."""

from __future__ import annotations

import datetime
import json
import os
import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from loomline.session import ship

#: Bytes at the start of a file in which its header is looked for.
HEAD_BYTES = 16_384
UUID = r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"


def _first(lines: Column, path: str) -> Column:
    """The first value of a field in the lines of a head."""
    values = F.transform(lines, lambda x: F.try_variant_get(F.try_parse_json(x), path, "string"))
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(1))


def sessions(spark: SparkSession, root: str, agent: str) -> DataFrame:
    """(agent, id, path, cwd, version, modified_at, header_status) of the JSONL files below a folder.

    id is the header's, else the one in the file's name; a file without either has the
    status no_header. Only the head of a file is parsed.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root))
    head = F.split(F.decode(F.substring("content", 1, HEAD_BYTES), "ISO-8859-1"), "\n")
    rows = files.select("path", F.col("modificationTime").alias("modified_at"), head.alias("head"))
    inner = F.coalesce(_first(F.col("head"), "$.payload.id"), _first(F.col("head"), "$.sessionId"), F.when(_first(F.slice("head", 1, 1), "$.type") == "session", _first(F.slice("head", 1, 1), "$.id")))
    named = F.regexp_extract("path", UUID + r"\.jsonl$", 1)
    out = rows.select(
        F.lit(agent).alias("agent"), F.coalesce(inner, F.when(named != "", named)).alias("id"), "path",
        F.coalesce(_first(F.col("head"), "$.payload.cwd"), _first(F.col("head"), "$.cwd")).alias("cwd"),
        F.coalesce(_first(F.col("head"), "$.payload.cli_version"), _first(F.col("head"), "$.version")).alias("version"), "modified_at", inner.isNotNull().alias("found"))
    return out.withColumn("header_status", F.when(F.col("found"), "ok").otherwise("no_header")).drop("found")


def newest_version(found: DataFrame) -> DataFrame:
    """(agent, version) of the file changed last; ties go to the greatest path."""
    return found.groupBy("agent").agg(F.max_by("version", F.struct("modified_at", "path")).alias("version"))


def mangled(cwd: str, agent: str) -> str:
    """The folder of a working directory's sessions; see scalars.mangled_cwd."""
    plain = cwd.replace("\\", "/")
    return re.sub("[/:]", "-", plain) if agent == "claude-code" else "--" + re.sub("[/:]", "-", plain.removeprefix("/")) + "--"


def read_head(path: str, most: int = HEAD_BYTES) -> list[dict]:
    """The objects on the whole lines of a file's first bytes; a line that the limit cuts, and what is no JSON object, is left out."""
    with open(path, "rb", buffering=0) as f:
        raw = f.read(most)
    if len(raw) == most:
        raw = raw[:raw.rfind(b"\n") + 1]
    out = []
    for line in raw.split(b"\n"):
        try:
            value = json.loads(line.decode("utf-8", "replace"))
        except ValueError:
            continue
        if isinstance(value, dict):
            out.append(value)
    return out


def _text(value, *path) -> str | None:
    for name in path:
        value = value.get(name) if isinstance(value, dict) else None
    return value if isinstance(value, str) and value else None


def _described(agent: str, path: str, head: list[dict]) -> tuple[str, str | None, str | None, str]:
    """(id, cwd, version, header_status) of a session file: one agent writes its id into the first record, the others name the file by it."""
    name, first = os.path.basename(path).removesuffix(".jsonl"), head[0] if head else {}
    if agent == "codex":
        own = _text(first, "payload", "id") or _text(first, "id")
        named = re.search(r"-([0-9a-f-]{36})$", name, re.IGNORECASE)
        cwd = next((c for r in head if (c := _text(r, "payload", "cwd") or _text(r, "cwd"))), None)
        return own or (named[1] if named else path), cwd, _text(first, "payload", "cli_version") or _text(first, "payload", "originator"), "header" if own else "filename-fallback"
    version = first.get("version")
    version = str(version) if agent == "pi" and isinstance(version, (int, float)) and not isinstance(version, bool) else version
    return name, next((c for r in head if (c := _text(r, "cwd"))), None), version if isinstance(version, str) else None, "filename"


class Folders(InputPartition):
    """Folders that one task lists, each with whether it goes into subfolders."""

    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class HeadsReader(DataSourceReader):
    """Filters on `cwd` and `project` choose folders before any is listed, one on `modified_at` spares files before they are opened; all are checked again on the rows."""

    #: Folders of a task.
    FOLDERS = 64

    def __init__(self, options):
        self.root, self.agent = options["path"], options["agent"]
        if self.agent not in LAYOUTS:
            raise ValueError(f"no agent: {self.agent}")
        self.wanted: set[str] | None = None
        self.since: float | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            at = getattr(f, "attribute", None)
            names = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if names is not None and at in (("cwd",), ("project",)) and LAYOUTS[self.agent] == "projects":
                folders = {mangled(x, self.agent) if at == ("cwd",) else x for x in names if x is not None}
                self.wanted = folders if self.wanted is None else self.wanted & folders
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and at == ("modified_at",) and isinstance(f.value, datetime.datetime):
                self.since = max(self.since or 0.0, f.value.timestamp())
            yield f

    def partitions(self) -> list[InputPartition]:
        try:
            if self.wanted is not None:
                names = sorted(x for x in self.wanted if "/" not in x and os.path.isdir(os.path.join(self.root, x)))
            else:
                names = sorted(e.name for e in os.scandir(self.root) if e.is_dir())
        except OSError:
            return [Folders([])]
        folders = [(os.path.join(self.root, x), LAYOUTS[self.agent] == "dates") for x in names]
        if LAYOUTS[self.agent] == "dates":
            # Years and months are few; their days are what the tasks share.
            for _ in range(2):
                folders = [(e.path, True) for top, _ in folders for e in os.scandir(top) if e.is_dir()] + [(top, False) for top, _ in folders] if folders else []
            folders.append((self.root, False))
        folders = sorted(set(folders))
        return [Folders(folders[k:k + self.FOLDERS]) for k in range(0, len(folders), self.FOLDERS)] or [Folders([])]

    def _files(self, folder: str, deep: bool) -> Iterator[os.DirEntry]:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            if e.is_dir():
                if deep:
                    yield from self._files(e.path, True)
            elif e.name.endswith(".jsonl") and e.is_file():
                yield e

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder, deep in partition.folders:
            for e in self._files(folder, deep):
                try:
                    at = e.stat().st_mtime
                    if self.since is not None and at < self.since:
                        continue
                    head = read_head(e.path)
                except OSError:
                    continue
                ident, cwd, version, status = _described(self.agent, e.path, head)
                yield self.agent, ident, e.path, os.path.basename(os.path.dirname(e.path)), cwd, version, datetime.datetime.fromtimestamp(at, datetime.timezone.utc), status


# Agents, and whether their files lie in a folder for each working directory or in folders by date.
LAYOUTS = {"claude-code": "projects", "pi": "projects", "codex": "dates"}


class HeadsSource(DataSource):
    """spark.read.format("session_heads").option("path", root).option("agent", name): a row for each session file, from its first HEAD_BYTES.

    (agent, id, path, project, cwd, version, modified_at, header_status); `project` is the
    file's folder. Where files lie by working directory, a filter `cwd = ..` reads the folder
    that this directory gives and no other. Driver and executors must see the folder; for
    stores that only Spark reads there is `sessions`. A missing folder has no rows, a file
    that can't be read is left out, an empty file has a name and nothing else.
    """

    @classmethod
    def name(cls) -> str:
        return "session_heads"

    def schema(self) -> str:
        return "agent string, id string, path string, project string, cwd string, version string, modified_at timestamp, header_status string"

    def reader(self, schema) -> HeadsReader:
        return HeadsReader(self.options)


def heads(spark: SparkSession, root: str, agent: str) -> DataFrame:
    """All session files of an agent below a folder, by their heads; filters on cwd, project and modified_at are pushed down."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HeadsSource)
    return spark.read.format("session_heads").option("path", root).option("agent", agent).load()


def detected(spark: SparkSession, root: str, agent: str, cwd: str | None = None) -> DataFrame:
    """Session files of a working directory, or of all: those of its folder, or where files lie by date those that name it or no directory at all."""
    found = heads(spark, root, agent)
    if cwd is None:
        return found
    return found.filter(F.col("project") == mangled(cwd, agent)) if LAYOUTS[agent] == "projects" else found.filter(F.col("cwd").isNull() | (F.col("cwd") == cwd))


class _Query(InputPartition):
    def __init__(self, nth: int, name: str, sql: str):
        self.nth, self.name, self.sql = nth, name, sql


class _SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.queries = options["path"], json.loads(options["queries"])

    def partitions(self) -> list[InputPartition]:
        return [_Query(i, name, sql) for i, (name, sql) in enumerate(self.queries.items())]

    def read(self, partition: _Query) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            con.row_factory = sqlite3.Row
            version = str(con.execute("PRAGMA user_version").fetchone()[0])
            for line, row in enumerate(con.execute(partition.sql), 1):
                yield partition.nth, partition.name, line, version, json.dumps(dict(row), ensure_ascii=False)


class SqliteSource(DataSource):
    """spark.read.format("sqlite_rows").option("path", file).option("queries", JSON object of name to SQL).

    Queries keep the order they have in the object and rows the order of their query:
    sort by (reader, line). The file must be visible to the executors.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> str:
        return "reader int, query string, line int, version string, raw string"

    def reader(self, schema) -> _SqliteReader:
        return _SqliteReader(self.options)
