"""Session files in segments to whole sessions, and stamping of content hashes.

Lines are (file, line, raw): the JSON text of one object each. What belongs together is
found by windows over a file or a session. Hashes of files are taken in a walk over their
sorted lines: one shuffle brings a file's lines together, and Python, in Arrow batches,
puts them into canonical form, hashes them as they pass and rewrites headers.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomline.operators import hashing, segments
from loomline.session import durable, ship

# A pinned hash is the first field, where it can be told from the same text further in.
_PINNED = f'{{"content_hash":"{hashing.PENDING}"'


def _pinned(text: str) -> str:
    """A JSON object with a pending content hash as its first field."""
    value = json.loads(text)
    value.pop("content_hash", None)
    pinned = json.dumps({"content_hash": hashing.PENDING} | value, ensure_ascii=False, separators=(",", ":"))
    return pinned.encode("utf-8", "backslashreplace").decode()


def _merged_header(first: str, last: str) -> str:
    """The header of a merged session: the last segment's without `segment`, the first one's time and stable fields.

    A session whose stream is still open carries no hash, others get a pending one.
    """
    a, b = json.loads(first), json.loads(last)
    b.pop("segment", None)
    b.pop("content_hash", None)
    if isinstance(a.get("ts"), str):
        b["ts"] = a["ts"]
    b |= {k: a[k] for k in segments.STABLE_FIELDS if k in a}
    stream = b.get("stream")
    still_open = isinstance(stream, dict) and stream.get("state") == "open"
    text = json.dumps(b if still_open else {"content_hash": hashing.PENDING} | b, ensure_ascii=False, separators=(",", ":"))
    return text.encode("utf-8", "backslashreplace").decode()


def _sealed(raw: str, digest: str) -> str:
    """A pinned header with its hash in place."""
    return f'{{"content_hash":"{digest}"{raw[len(_PINNED):]}'


def grouped_lines(lines: DataFrame) -> DataFrame:
    """`lines` with value, type, is_envelope (a trail record that opens its file) and group_idx (sessions of a file from 1, 0 before the first)."""
    rows = lines.withColumn("value", F.try_parse_json("raw"))
    rows = rows.withColumn("type", F.try_variant_get("value", "$.type", "string"))
    place = W.partitionBy("file").orderBy("line")
    return (rows.withColumn("is_envelope", (F.row_number().over(place) == 1) & F.coalesce(F.col("type") == "trail", F.lit(False)))
            .withColumn("group_idx", F.sum((F.coalesce(F.col("type"), F.lit("")) == "session").cast("int")).over(place.rowsBetween(W.unboundedPreceding, 0))))


def _maybe_head() -> Column:
    """The value of a line that can hold the type of a header or an envelope as a JSON string, else null."""
    raw = F.col("raw")
    return F.when(raw.contains('"session"') | raw.contains('"trail"') | raw.contains("\\u"), F.try_parse_json("raw"))


def _whole_files(lines: DataFrame) -> DataFrame:
    """(file, line, raw, head) with the lines of a file together and in order; head: session or trail, else null.

    Only a line that can hold the word as a JSON string is parsed for its type.
    """
    kind = F.try_variant_get(_maybe_head(), "$.type", "string")
    rows = lines.select("file", "line", "raw").repartition("file").sortWithinPartitions("file", "line", "raw")
    return rows.withColumn("head", F.when(kind.isin("session", "trail"), kind))


class _Scope:
    """The hash of a session or a whole file as its canonical lines pass, each ended by a line feed; faulty lines count for nothing."""

    def __init__(self, group: int, at: int, raw: str):
        self.group, self.at, self.raw, self.pinned = group, at, raw, _pinned(raw)
        self.sha, self.empty, self.held = hashlib.sha256(), True, []

    def add(self, canon: list[str]) -> None:
        if canon:
            self.sha.update(("\n".join(canon) + "\n").encode("utf-8", "backslashreplace"))
            self.empty = False

    def digest(self) -> str | None:
        return None if self.empty else self.sha.hexdigest()


def _walked(batches: Iterator[pa.RecordBatch], stamped: bool) -> Iterator[tuple[pa.RecordBatch | None, list[bool], list[tuple]]]:
    """Each batch of _whole_files, which of its lines are no headers, and the scopes that ended: (file, line, scope, digest); at last those that are still open.

    A file's hash covers its headers as they stand, or `stamped`: with their new hashes.
    Then a session's canonical lines are held back until its header is known, in a file
    with an envelope; nothing else is held.
    """
    file, whole, session, ended = None, None, None, []

    def end(scope: _Scope | None) -> None:
        if scope is not None:
            ended.append((file[0], scope.at, scope, scope.digest()))
            if stamped and whole is not None and scope is not whole:
                whole.add(_canonical([_resealed(scope)]))
                whole.add(scope.held)

    for batch in batches:
        names, at, heads = batch.column(0), batch.column(1), batch.column(3)
        raw = batch.column(2).to_pylist()
        # Lines between the starts of files and headers are put into canonical form together.
        marks = set(pc.indices_nonzero(pc.is_valid(heads)).to_pylist())
        changes = pc.fill_null(pc.equal(names.slice(1), names.slice(0, max(len(raw) - 1, 0))), False)
        starts = [0, *(i + 1 for i in pc.indices_nonzero(pc.invert(changes)).to_pylist())]
        plain = [True] * len(raw)
        cuts = sorted(marks.union(starts))
        starts = set(starts)
        for i, until in zip(cuts, [*cuts[1:], len(raw)]):
            head = heads[i].as_py() if i in marks else None
            first = False
            if i in starts:
                name = names[i].as_py()
                first = file is None or file[0] != name
            if first:
                end(session)
                end(whole)
                file, whole, session, group = (name,), None, None, 0
            if head == "session":
                end(session)
                group += 1
                session = _Scope(group, at[i].as_py(), raw[i])
                session.add(_canonical([session.pinned]))
                if whole is not None and not stamped:
                    whole.add(_canonical([raw[i]]))
            elif head == "trail" and first:
                whole = _Scope(0, at[i].as_py(), raw[i])
                whole.add(_canonical([whole.pinned]))
            else:
                head = None
            plain[i] = head is None
            if session is None and whole is None:
                continue
            canon = _canonical(raw[i if head is None else i + 1:until])
            if session is not None:
                session.add(canon)
            if whole is not None and (session is None or not stamped):
                whole.add(canon)
            elif whole is not None:
                session.held += canon
        yield batch, plain, ended[:]
        ended.clear()
    end(session)
    end(whole)
    yield None, [], ended


def _canonical(texts: list[str | None]) -> list[str]:
    return [c for c in map(hashing.canonical_text, texts) if c is not None]


def _resealed(scope: _Scope) -> str:
    """The header of a scope with its hash in place; as it was, if no line of the scope has a canonical form."""
    digest = scope.digest()
    return scope.raw if digest is None else _sealed(scope.pinned, digest)


def stamp(lines: DataFrame) -> DataFrame:
    """`lines` with content hashes: of each session in its header, then of the file in its envelope, if it has one.

    A session's hash covers its header, with its own hash pending, and its entries; the
    file's hash covers all lines with the stamped headers and its own hash pending. Other
    lines stay byte for byte. Empty input gives no rows; a null or faulty line has no
    canonical form and counts for nothing.
    """
    rows = _whole_files(lines)
    schema = rows.drop("head").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = None
        for batch, plain, ended in _walked(batches, True):
            if batch is not None:
                batch = batch.select([0, 1, 2])
                like = batch.schema
                yield batch.filter(pa.array(plain, pa.bool_()))
            if ended:
                columns = zip(*[(file, line, _resealed(scope)) for file, line, scope, _ in ended])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, like.types)], schema=like)

    ship(lines.sparkSession)
    return rows.mapInArrow(run, schema)


def finalized(lines: DataFrame) -> DataFrame:
    """`lines` with new hashes in files where redaction has left one pending; other files stay byte for byte."""
    value = F.try_parse_json("raw")
    head = F.try_variant_get(value, "$.type", "string").isin("session", "trail") & (F.try_variant_get(value, "$.content_hash", "string") == hashing.PENDING)
    rows = lines.select("file", "line", "raw")
    changed = durable(rows.filter(F.coalesce(head, F.lit(False))).select("file").distinct())
    return stamp(rows.join(changed, "file", "left_semi")).unionByName(rows.join(changed, "file", "left_anti"))


def claims(lines: DataFrame) -> DataFrame:
    """(file, group_idx, session_uid, claim, actual, verdict) of every session header, and of an envelope as group 0.

    verdict is hashing.verdict of the hash that a header carries against the one that its
    session, or an envelope's file, has.
    """
    rows = _whole_files(lines)
    schema = T.StructType([rows.schema["file"], *T.StructType.fromDDL("group_idx long, session_uid string, claim string, actual string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch, _, ended in _walked(batches, False):
            kind = kind if batch is None else batch.schema.types[0]
            out = []
            for file, _, scope, digest in ended:
                value = json.loads(scope.raw)
                texts = [value.get(k) for k in ("session_uid", "content_hash")]
                if digest is not None:
                    out.append((file, scope.group, *[x if isinstance(x, str) else None for x in texts], digest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [kind, pa.int64(), *[pa.string()] * 3])], schema.names)

    ship(lines.sparkSession)
    out = rows.mapInArrow(run, schema)
    return out.withColumn("verdict", hashing.verdict(F.col("claim"), F.col("actual")))


def _text(value: str, path: str) -> Column:
    """The string at a path of a variant; null for what is no string."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def _sourced(lines: DataFrame) -> DataFrame:
    """(file, line, raw, head, value, several, first, source, session, session_uid, own_seq, seq) of all lines.

    A file with several sessions is a source for each; any other file is one source.
    session is null before the first of several headers and in a file without one. One shuffle brings a file's lines together; only headers and envelopes have a
    value.
    """
    number = F.schema_of_variant(F.try_variant_get("value", "$.segment.seq", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    kind = F.try_variant_get("value", "$.type", "string")
    file = W.partitionBy("file")
    upto = file.orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.select("file", "line", "raw").withColumn("value", _maybe_head()).withColumn("head", F.when(kind.isin("session", "trail"), kind))
    rows = rows.withColumn("value", F.when(F.col("head").isNotNull(), F.col("value")))
    own = F.when(F.col("head") == "session", F.struct(F.lit(True).alias("any"), _text("value", "$.session_uid").alias("session_uid"), F.when(number, F.try_variant_get("value", "$.segment.seq", "double")).alias("own_seq")))
    rows = rows.withColumn("own", own)
    rows = rows.withColumn("group_idx", F.count("own").over(upto)).withColumn("first", F.row_number().over(file.orderBy("line")) == 1).withColumn("before", F.last("own", ignorenulls=True).over(upto))
    rows = rows.withColumn("several", F.count("own").over(file) > 1).withColumn("only", F.max("own").over(file))
    rows = rows.withColumn("source", F.when(F.col("several"), F.concat("file", F.lit("#session-"), F.col("group_idx") - 1)).otherwise(F.col("file").cast("string"))).withColumn("own", F.when(F.col("several"), F.col("before")).otherwise(F.col("only")))
    session = F.when(F.col("own.any"), F.when(F.col("own.session_uid").isNull(), F.concat(F.lit("source:"), "source")).otherwise(F.concat(F.lit("uid:"), "own.session_uid")))
    return rows.select("file", "line", "raw", "head", "value", "several", "first", "source", session.alias("session"), "own.session_uid", "own.own_seq", F.coalesce("own.own_seq", F.lit(1.0)).alias("seq"))


class _Session:
    """What a session comes to as its lines pass; of a merged one the hash, unless its stream is open.

    Known before the lines are the session's headers, in order of their segments.
    """

    def __init__(self, name: str):
        self.name, self.heads, self.begun = name, [], False
        self.asked, self.events, self.ord, self.seen, self.sha, self.header = 0, 0, 0, set(), None, None

    def begin(self) -> None:
        self.begun, self.merged = True, len(self.heads) > 1
        self.last = self.heads[-1][0]
        if self.merged:
            self.ord = 1  # the header's is 0, and it comes when its hash is known
            self.header = _merged_header(self.heads[0][2], self.heads[-1][2])
            self.sha = hashlib.sha256() if self.header.startswith(_PINNED) else None
            self.add([hashing.canonical_text(self.header)])

    def add(self, canon: list[str]) -> None:
        if canon and self.sha is not None:
            self.sha.update(("\n".join(canon) + "\n").encode("utf-8", "backslashreplace"))

    def merge(self, sources: list[str], texts: list[str | None]) -> list[str | None]:
        """The entries that stay: of one id the first, and no marker of a killed process that a further segment followed; the rest by their hash.

        What has no canonical form has no id and is no marker.
        """
        kept, canon = [], []
        for source, text in zip(sources, texts):
            value, plain = hashing.with_value(text)
            known = None
            if plain is not None:
                if isinstance(value, dict):
                    if value.get("type") == "session_terminated" and source != self.last:
                        payload = value.get("payload")
                        if isinstance(payload, dict) and payload.get("reason") == "process_terminated":
                            continue
                    known = value.get("id")
            self.asked += 1
            if isinstance(known, str):
                if known in self.seen:
                    continue
                self.seen.add(known)
            kept.append(text)
            if plain is not None:
                canon.append(plain)
        self.events += len(kept)
        self.add(canon)
        return kept

    def end(self) -> tuple[str | None, str | None]:
        """Its content hash, and the header of a merged session."""
        if not self.merged:
            claim = json.loads(self.heads[0][2]).get("content_hash")
            return claim if isinstance(claim, str) else None, None
        digest = None if self.sha is None else self.sha.hexdigest()
        return digest, self.header if digest is None else _sealed(self.header, digest)


def _reconciled(batches: Iterator[pa.RecordBatch], records: bool) -> Iterator[pa.RecordBatch]:
    """Rows of `Reconciled.records`, or else of its groups, from the batches of `_by_session`.

    Held are the ids and headers of one session, never its entries.
    """
    now, out = None, []

    def end() -> None:
        if now is None:
            return
        if not now.begun:
            now.begin()
        digest, header = now.end()
        if not records:
            out.append((now.name, now.heads[0][1], [h[0] for h in now.heads], now.events, now.asked - now.events, digest))
        elif now.merged:
            out.append((now.name, 0, header))

    types = [pa.string(), pa.int32(), pa.string()] if records else [pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
    names = ["session", "ord", "raw"] if records else ["session", "session_uid", "segments", "events", "events_deduped", "content_hash"]
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    for batch in batches:
        session, early, n = batch["session"], batch["early"], batch.num_rows
        differs = lambda c: pc.not_equal(c.slice(1), c.slice(0, max(n - 1, 0)))
        cuts = [0, *(i + 1 for i in pc.indices_nonzero(pc.or_(differs(session), differs(early))).to_pylist())][:n]
        for at, until in zip(cuts, [*cuts[1:], n]):
            name = session[at].as_py()
            if now is None or name != now.name:
                end()
                now = _Session(name)
            part = batch.slice(at, until - at)
            if early[at].as_py():
                now.heads += zip(*(part[c].to_pylist() for c in ("source", "session_uid", "raw")))
                continue
            if not now.begun:
                now.begin()
            kept = part["raw"].to_pylist()
            if now.merged:
                part = part if not records else part.filter(part["entry"])
                kept = now.merge(part["source"].to_pylist(), part["raw"].to_pylist())
            else:
                now.asked += pc.sum(part["entry"]).as_py()
                now.events = now.asked
            if records:
                out.extend((now.name, now.ord + k, text) for k, text in enumerate(kept))
                now.ord += len(kept)
        if out:
            yield made()
            out.clear()
    end()
    if out:
        yield made()


def _by_session(rows: DataFrame, records: bool) -> DataFrame:
    """(session, source, session_uid, raw, early, entry): the lines of each session together, one shuffle, first its headers and then all lines, in order of seq, source and line.

    Not `records`: only what is counted or hashed.
    """
    is_head, entry = F.coalesce(F.col("head") == "session", F.lit(False)), F.col("head").isNull()
    rows = rows.filter("session is not null")
    if records:
        rows = rows.withColumn("early", F.explode(F.when(is_head, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    else:
        rows = rows.filter(is_head | entry).withColumn("early", is_head)
    rows = rows.select("session", "seq", "source", "line", "early", entry.alias("entry"), "raw", F.when(F.col("early"), F.col("session_uid")).alias("session_uid"))
    return rows.repartition("session").sortWithinPartitions("session", F.col("early").desc(), "seq", "source", "line").select("session", "source", "session_uid", "raw", "early", "entry")


class Reconciled:
    """Sessions of lines, in four tables; each is a plan of its own, and what nobody reads is never run.

    records(session, ord, raw), groups(session, session_uid, segments, events, events_deduped,
    content_hash), warnings(session_uid, source, code), envelopes(file, raw).
    """

    def __init__(self, lines: DataFrame):
        self.rows = _sourced(lines)

    @cached_property
    def envelopes(self) -> DataFrame:
        return self.rows.filter("several and first and head = 'trail'").select("file", "raw")

    @cached_property
    def records(self) -> DataFrame:
        ship(self.rows.sparkSession)
        return _by_session(self.rows, True).mapInArrow(lambda batches: _reconciled(batches, True), "session string, ord int, raw string")

    @cached_property
    def groups(self) -> DataFrame:
        ship(self.rows.sparkSession)
        return _by_session(self.rows, False).mapInArrow(lambda batches: _reconciled(batches, False), "session string, session_uid string, segments array<string>, events long, events_deduped long, content_hash string")

    @cached_property
    def warnings(self) -> DataFrame:
        heads = durable(_headers(self.rows).withColumn("members", F.count("*").over(W.partitionBy("session"))))
        merged = heads.filter("members > 1")
        lost = self.rows.filter("session is null and not several").select("source").distinct()
        say = lambda df, code: df.select(F.col("session_uid").cast("string").alias("session_uid"), "source", F.lit(code).alias("code") if isinstance(code, str) else code)
        stable = tuple(f"h_{f}" for f in segments.STABLE_FIELDS)
        return reduce(DataFrame.unionByName, [
            say(lost.withColumn("session_uid", F.lit(None)), "missing_session_header"),
            say(heads.filter("session_uid is null and own_seq >= 2"), "missing_session_uid"),
            say(segments.seq_warnings(merged.select("session_uid", F.col("seq").cast("long").alias("seq"), "source")), F.col("code")),
            say(segments.chain_warnings(merged.select("session_uid", "seq", "source", "content_hash", "prev_content_hash", "has_prev")), F.col("code")),
            say(segments.stable_field_warnings(merged.select("session_uid", "seq", "source", *stable), stable), "stable_field_divergence")])


def _headers(rows: DataFrame) -> DataFrame:
    """(source, session, session_uid, own_seq, seq, prev_content_hash, has_prev, content_hash, and the stable fields) of each source."""
    prev = F.schema_of_variant(F.try_variant_get("value", "$.segment.prev_content_hash", "variant"))
    return rows.filter("head = 'session'").select(
        "source", "session", "session_uid", "own_seq", "seq", _text("value", "$.segment.prev_content_hash").alias("prev_content_hash"), F.coalesce(prev.isin("STRING", "VOID"), F.lit(False)).alias("has_prev"),
        _text("value", "$.content_hash").alias("content_hash"), *[F.to_json(F.try_variant_get("value", f"$.{f}", "variant")).alias(f"h_{f}") for f in segments.STABLE_FIELDS])


def reconcile(lines: DataFrame) -> Reconciled:
    """Sessions from files that may hold several sessions, or segments of one.

    A file with several sessions is taken apart, its envelope goes to `envelopes`. What
    names the same session_uid is one session: its segments in order of their seq, then
    source; a null or missing uid is a session by itself. One segment passes through as
    it is. Several are merged: entries with a known id once, markers of a killed process
    only from the last segment, one header, stamped anew unless its stream is open.
    Files without a header are left out with a warning.
    """
    return Reconciled(lines)
