"""Layered checks of session files: each rule is a frame of diagnostics, and a check is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.functions.scalars import has_embedded_credentials, pointer_escape
from loomline.operators import graph, hashing, leaves, pairing, sequences
from loomline.session import durable

# Fixed values of the format.
SCHEMA_VERSION = "0.1.0"
READABLE = r"^0\.1\.[0-9]+$"
ID = r"^(?:[0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{26}|[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12})$"
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$"
EVENT_TYPES = (
    "user_message", "agent_message", "tool_call", "tool_result", "session_summary", "system_event", "agent_thinking", "user_interrupt",
    "context_compact", "branch_point", "branch_summary", "model_change", "session_terminated", "session_end", "command_invoke",
)
# Payload fields that an event of a type must have.
REQUIRED = {
    "user_message": ("text",), "agent_message": ("text",), "tool_call": ("tool", "args"), "tool_result": ("ok",), "session_summary": ("scope", "text"),
    "system_event": ("kind",), "agent_thinking": ("text",), "context_compact": ("summary",), "branch_point": ("from_id",), "branch_summary": ("abandoned_branch_id", "summary"),
    "model_change": ("to_model",), "session_terminated": ("reason",), "session_end": ("reason",), "command_invoke": ("name", "kind", "via"),
}
# All payload fields that an event of a type may have.
PAYLOAD_FIELDS = {
    "user_message": ("text", "attachments"),
    "agent_message": ("text", "model", "stop_reason", "usage", "attachments"),
    "tool_call": ("tool", "args"),
    "tool_result": ("for_id", "ok", "output", "truncated", "overflow_ref", "error", "attachments", "meta"),
    "session_summary": ("scope", "text", "model"),
    "system_event": ("kind", "text", "data"),
    "agent_thinking": ("text", "model", "level"),
    "user_interrupt": ("reason",),
    "context_compact": ("summary", "trigger", "tokens_before", "tokens_after"),
    "branch_point": ("from_id", "reason"),
    "branch_summary": ("abandoned_branch_id", "summary", "model"),
    "model_change": ("from_model", "to_model"),
    "session_terminated": ("reason", "open_call_ids"),
    "session_end": ("reason", "final_message_id"),
    "command_invoke": ("name", "kind", "via", "args", "expansion_text", "result_action"),
}
# Payload fields with a closed set of values.
ENUMS = {
    "session_summary": {"scope": ("session",)},
    "agent_thinking": {"level": ("low", "medium", "high", "xhigh")},
    "context_compact": {"trigger": ("manual", "auto")},
    "session_end": {"reason": ("complete", "user_quit", "agent_idle")},
}
PROFILES = ("strict", "reader-tolerant")
RAW_HARD, RAW_SOFT = 32_768, 8_192


def field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("value", path, kind)


def present(path: str) -> Column:
    """Whether a field is there, null or not."""
    return F.try_variant_get("value", path, "variant").isNotNull()


def fields(lines: DataFrame) -> DataFrame:
    """The fields that rules look at, of parsed lines (file, line, value, ..); works on streams."""
    return lines.select(
        *lines.columns, field("$.type").alias("type"), field("$.id").alias("id"), field("$.parent_id").alias("parent_id"), field("$.ts").alias("ts"),
        field("$.schema_version").alias("schema_version"), field("$.content_hash").alias("content_hash"), field("$.stream.state").alias("stream_state"),
        field("$.semantic.call_id").alias("call_id"), field("$.payload.for_id").alias("for_id"), field("$.vcs.revision").alias("revision"), field("$.vcs.remote_url").alias("remote_url"),
        field("$.payload.final_message_id").alias("final_message_id"), present("$.parent_id").alias("has_parent"),
        field("$.agent.name").alias("agent"), field("$.fork_from.session_id").alias("forked_from"), field("$.fork_from.content_hash").alias("forked_hash"),
        field("$.source.raw.envelope_ref").alias("envelope_ref"))


def promoted(lines: DataFrame) -> DataFrame:
    """The fields of the lines that hold an object, with the session that each belongs to."""
    return sequences.session_groups(fields(lines.filter("value is not null").select("file", "line", "value")), ["file"])


DIAGNOSTIC = "struct<path: string, severity: string, code: string, message: string>"


def _diagnostic(path: Column, severity: str, code: str, message: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))


def _say(df: DataFrame, severity: str, code: str, path: str, message: Column) -> DataFrame:
    return df.select("file", "line", F.lit(path).alias("path"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))


def record_findings(r: DataFrame, profile: str = "strict") -> DataFrame:
    """`r` with `found`, the diagnostics of rules that look at one line, all in one pass over the lines; works on streams.

    A tolerant reader is only warned of unknown types and payload fields.
    """
    tolerant = profile == "reader-tolerant"
    kind, none = F.col("type"), F.array().cast(f"array<{DIAGNOSTIC}>")
    found: list[Column] = []

    def say(when: Column, severity: str, code: str, path: str, message) -> None:
        message = F.lit(message) if isinstance(message, str) else message
        found.append(F.when(when, _diagnostic(F.lit(path), severity, code, message)))

    entry = ~kind.isin("trail", "session") | kind.isNull()
    for name in ("type", "id", "ts"):
        say(F.col(name).isNull(), "error", "required", f"/{name}", f"must have required property '{name}'")
    say(~F.col("id").rlike(ID), "error", "pattern", "/id", F.concat(F.lit("no id: "), "id"))
    say(~F.col("ts").rlike(TIMESTAMP), "error", "pattern", "/ts", F.concat(F.lit("no timestamp: "), "ts"))
    say(entry & ~kind.isin(*EVENT_TYPES), "warning" if tolerant else "error", "reader_tolerant_unknown_record" if tolerant else "enum", "/type", F.concat(F.lit("unknown type: "), kind))
    for t, names in REQUIRED.items():
        for name in names:
            say((kind == t) & ~present(f"$.payload.{name}"), "error", "required", f"/payload/{name}", f"must have required property '{name}'")
    for t, fields in ENUMS.items():
        for name, values in fields.items():
            say((kind == t) & ~field(f"$.payload.{name}").isin(*values), "error", "enum", f"/payload/{name}", "must be one of " + ", ".join(values))
    usage = (kind == "agent_message") & F.schema_of_variant(F.try_variant_get("value", "$.payload.usage", "variant")).startswith("OBJECT")
    for side in ("input", "output"):
        names = [f"{side}_tokens", f"{side}_tokens_cumulative"]
        some = F.coalesce(*[field(f"$.payload.usage.{n}", "double") for n in names]).isNotNull()
        say(usage & ~some, "warning", "usage_missing_required", "/payload/usage", f"usage must have {names[0]} or {names[1]}")
    size = F.octet_length("raw")
    say(size > RAW_HARD, "error", "source_raw_oversized_hard", "/source/raw", F.concat(size, F.lit(" bytes")))
    say((size > RAW_SOFT) & (size <= RAW_HARD), "warning", "source_raw_oversized", "/source/raw", F.concat(size, F.lit(" bytes")))
    # A password with percent-encoded bytes was put there on purpose.
    encoded = F.regexp_extract("remote_url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/@\s]*:([^/@\s]+)@", 1).rlike("%[0-9A-Fa-f]{2}")
    say(has_embedded_credentials("remote_url") & ~encoded, "warning", "vcs_remote_url_with_credentials", "/vcs/remote_url", "the address holds credentials")
    say(has_embedded_credentials("remote_url") & encoded, "error", "vcs_remote_url_with_credentials", "/vcs/remote_url", "the address holds an encoded password")
    allowed = F.create_map(*[x for k, names in PAYLOAD_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, names)))])
    unknown = F.array_except(F.json_object_keys(F.to_json(F.try_variant_get("value", "$.payload", "variant"))), F.try_element_at(allowed, kind))
    extra = F.transform(unknown, lambda name: _diagnostic(
        F.concat(F.lit("/payload/"), pointer_escape(name)), "warning" if tolerant else "error",
        "reader_tolerant_unknown_payload_field" if tolerant else "additionalProperties", F.concat(F.lit("unknown payload field: "), name)))
    every = F.concat(F.filter(F.array(*found), lambda d: d.isNotNull()), F.coalesce(extra, none))
    kept = [c for c in r.columns if c != "raw"]
    return r.withColumn("raw", F.to_json(F.try_variant_get("value", "$.source.raw", "variant"))).select(*kept, every.alias("found"))


def record_rules(r: DataFrame, profile: str = "strict") -> DataFrame:
    """The findings of single lines, one a row."""
    return record_findings(r, profile).select("file", "line", F.explode("found").alias("d")).select("file", "line", "d.*")


def source_raw() -> Column:
    """The raw source record of an entry; headers and envelopes have none that counts."""
    return F.when(~F.coalesce(F.col("type").isin("trail", "session"), F.lit(False)), F.try_variant_get("value", "$.source.raw", "variant"))


def secret_rules(r: DataFrame) -> DataFrame:
    """A warning for each string in a raw source record and each credential in it, at the string's own path."""
    found = leaves.secrets(r.select("file", "line", source_raw().alias("_raw")), "_raw", ["file", "line"], "/source/raw")
    return found.select("file", "line", "path", F.lit("warning").alias("severity"), F.lit("source_raw_unredacted_secret").alias("code"), F.col("pattern").alias("message"))


def fork_mismatches(headers: DataFrame) -> DataFrame:
    """Headers(file, line, id, content_hash, forked_from, forked_hash) that name another hash than the sibling they are forked from has, with that `sibling` hash."""
    siblings = headers.filter("content_hash <> '<pending>'").select("file", F.col("id").alias("forked_from"), "content_hash", "line").groupBy("file", "forked_from").agg(F.max_by("content_hash", "line").alias("sibling"))
    return headers.filter("forked_hash is not null").join(siblings, ["file", "forked_from"]).filter("forked_hash <> sibling")


def file_rules(r: DataFrame, profile: str = "strict") -> list[DataFrame]:
    """Rules that look at the lines of a file together; a file is one window.

    A session whose header is of no known version is left out of the rules that look
    into sessions or compare them; its siblings are not.
    """
    header, envelope = F.col("type") == "session", F.col("type") == "trail"
    events = r.filter(~(F.col("type").isin("trail", "session")) & (F.col("group_idx") > 0))
    session = ["file", "group_idx"]
    some = r.groupBy("file").agg(F.min("line").alias("line"), F.count_if(header).alias("headers"), F.count_if(envelope).alias("envelopes"))
    headers = r.filter(header)
    nth = W.partitionBy("file").orderBy("line")
    valid = F.coalesce((F.col("schema_version") == SCHEMA_VERSION) | (F.lit(profile == "reader-tolerant") & F.col("schema_version").rlike(READABLE)), F.lit(False))
    first = headers.filter("group_idx = 1").filter(~valid).join(some.select("file", "envelopes"), "file")
    told = headers.filter((F.col("schema_version") != SCHEMA_VERSION) & F.col("schema_version").rlike(READABLE))
    every = headers
    headers = headers.filter(valid)
    events = events.join(headers.select(*session), session, "left_semi")
    out = [
        _say(first.filter("envelopes = 0"), "error", "missing_header", "", F.lit("the first header is of no known version")),
        _say(first.filter("envelopes > 0"), "error", "missing_header_after_envelope", "", F.lit("the first header is of no known version")),
        _say(r.filter(envelope).withColumn("n", F.row_number().over(nth)).filter("n > 1"), "error", "multiple_envelopes", "", F.lit("a file has one envelope")),
        _say(r.filter(envelope & (F.col("line") > 1)), "error", "envelope_not_at_line_1", "", F.lit("the envelope is the first line")),
        _say(some.filter("headers = 0 and envelopes = 0"), "error", "missing_header", "", F.lit("no session header")),
        _say(some.filter("headers = 0 and envelopes > 0"), "error", "missing_header_after_envelope", "", F.lit("no session header")),
        _say(every.filter("has_parent"), "error", "header_has_parent_id", "/parent_id", F.lit("a header has no parent")),
        _say(r.filter(envelope & F.col("has_parent")), "error", "envelope_has_parent_id", "/parent_id", F.lit("an envelope has no parent")),
        _say(r.filter("orphan").join(some.filter("headers > 0").select("file"), "file", "left_semi"), "error", "events_before_first_session_header", "", F.lit("an event before the first header")),
        _say(told.filter(F.lit(profile == "reader-tolerant")), "warning", "reader_tolerant_schema_version", "/schema_version", F.col("schema_version")),
        _say(graph.duplicate_ids(r, ["file"]), "error", "duplicate_id", "/id", F.concat(F.lit("first on line "), "first_line")),
        _say(graph.unknown_parents(r.filter("group_idx > 0 and type <> 'session'"), session), "error", "unknown_parent_id", "/parent_id", F.col("parent_id")),
        _say(headers.filter("stream_state = 'open' and content_hash is not null"), "warning", "stream_open_with_content_hash", "/content_hash", F.lit("an open stream has no hash")),
        _say(sequences.out_of_order(headers, ["file"]), "warning", "out_of_order_session_headers", "/ts", F.col("ts")),
        _say(sequences.diverging(headers, ["file"], "revision"), "warning", "vcs_revision_divergence", "/vcs/revision", F.col("revision")),
        _say(every.filter(F.col("content_hash").isNotNull() & ~F.col("content_hash").rlike("^(?:[a-f0-9]{64}|<pending>)$")), "error", "content_hash_invalid", "/content_hash", F.col("content_hash")),
    ]
    opened = headers.filter("stream_state = 'open'").select(*session)
    out.append(_say(events.filter(F.col("type").isin("session_end", "session_terminated")).join(opened, session, "left_semi"), "warning", "stream_open_with_terminal_event", "/type", F.col("type")))
    calls = events.select(*session, F.col("line").alias("ord"), "line", F.col("type").alias("kind"), "id", "for_id", "call_id")
    terminated = r.filter("type = 'session_terminated'").select(*session, F.explode(field("$.payload.open_call_ids", "array<string>")).alias("id")).distinct()
    loose = pairing.unmatched_calls(calls, session, suppressed=terminated).withColumnRenamed("ord", "line")
    out.append(_say(loose, "warning", "unmatched_tool_call_at_eof", "/id", F.concat(F.lit('tool_call "'), "id", F.lit('" has no matching tool_result at EOF'))))
    known = r.select("file", F.col("id").alias("final_message_id"), F.col("line").alias("at"))
    ends = events.filter("type = 'session_end' and final_message_id is not null")
    missing = ends.join(known, (ends["file"] == known["file"]) & (ends["final_message_id"] == known["final_message_id"]) & (known["at"] < ends["line"]), "left_anti")
    out.append(_say(missing, "warning", "unknown_final_message_id", "/payload/final_message_id", F.col("final_message_id")))
    first = events.filter("id is not null").groupBy("file", F.col("id").alias("envelope_ref")).agg(F.min("line").alias("at"))
    refs = events.filter("envelope_ref is not null").join(first, ["file", "envelope_ref"], "left").filter("at is null or at >= line")
    out.append(_say(refs, "error", "source_raw_envelope_ref_unresolved", "/source/raw/envelope_ref", F.col("envelope_ref")))
    out.append(_say(fork_mismatches(headers), "warning", "cross_group_fork_from_hash_mismatch", "/fork_from/content_hash", F.col("sibling")))
    return [*out, manifest_drift(r)]


def manifest_drift(r: DataFrame) -> DataFrame:
    """Where an envelope's list of sessions differs from the headers that follow: in length, or in id or agent of the part both have."""
    listed = r.filter(F.col("type") == "trail").groupBy("file").agg(F.min_by(F.struct("line", field("$.sessions", "array<variant>").alias("sessions")), "line").alias("e")).select("file", "e.*").filter("sessions is not null")
    headers = r.filter(F.col("type") == "session").select("file", "group_idx", F.col("id").alias("own_id"), F.col("agent").alias("own_agent"))
    n = headers.groupBy("file").agg(F.count("*").alias("n"))
    length = listed.join(n, "file", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.size("sessions") != F.col("n"))
    told = _say(length, "warning", "envelope_sessions_manifest_drift", "/sessions", F.format_string("%d sessions listed, %d in the file", F.size("sessions"), "n"))
    one = listed.select("file", "line", F.posexplode("sessions").alias("at", "s")).withColumn("group_idx", F.col("at") + 1).join(headers, ["file", "group_idx"])
    sides = F.array(*[F.struct(F.lit(k).alias("k"), F.try_variant_get("s", f"$.{k}", "string").alias("listed"), F.col(f"own_{k}").alias("own")) for k in ("id", "agent")])
    wrong = F.filter(sides, lambda x: x["listed"].isNotNull() & ~x["listed"].eqNullSafe(x["own"]))
    each = one.select("file", "line", "at", F.explode(wrong).alias("w")).select(
        "file", "line", F.concat_ws("/", F.lit("/sessions"), "at", "w.k").alias("path"), F.lit("warning").alias("severity"), F.lit("envelope_sessions_manifest_drift").alias("code"), F.col("w.listed").alias("message"))
    return told.unionByName(each)


def hash_rules(lines: DataFrame, r: DataFrame, profile: str = "strict") -> DataFrame:
    """content_hash_mismatch of headers and envelopes, in files that could be read to their end.

    A header's hash covers its session with the header's own hash pending; an envelope's
    covers the file with its own hash pending and those of the headers as they stand.
    """
    whole = lines.groupBy("file").agg(F.max("code").alias("fault")).filter("fault is null").select("file")
    text = F.to_json("value")
    claim = '"content_hash":'
    # Only lines that carry a claim of their own are hashed in two forms.
    pending = F.when(F.col("content_hash").isNotNull() & F.col("type").isin("session", "trail"), F.replace(text, F.concat(F.lit(claim), F.to_json(F.try_variant_get("value", "$.content_hash", "variant"))), F.lit(f'{claim}"{hashing.PENDING}"'))).otherwise(text)
    rows = r.join(whole, "file", "left_semi").withColumn("plain", text).withColumn("pinned", F.when(F.col("type") == "session", pending).otherwise(text)).withColumn("sealed", F.when((F.col("type") == "trail") & (F.col("line") == 1), pending).otherwise(text))
    claimed = F.col("content_hash").rlike("^[a-f0-9]{64}$")
    by_group = rows.filter("group_idx > 0").join(rows.filter((F.col("type") == "session") & claimed).select("file", "group_idx"), ["file", "group_idx"], "left_semi")
    by_file = rows.join(rows.filter((F.col("type") == "trail") & (F.col("line") == 1) & claimed).select("file"), "file", "left_semi")
    sessions = hashing.content_hash(hashing.with_canonical(by_group.select("file", "group_idx", "line", "pinned"), "pinned"), ["file", "group_idx"])
    files = hashing.content_hash(hashing.with_canonical(by_file.select("file", "line", "sealed"), "sealed"), ["file"])
    heads = rows.filter((F.col("type") == "session") & claimed).select("file", "group_idx", "line", F.col("content_hash").alias("claim")).join(sessions, ["file", "group_idx"]).drop("group_idx")
    envelopes = rows.filter((F.col("type") == "trail") & (F.col("line") == 1) & claimed).select("file", "line", F.col("content_hash").alias("claim")).join(files, "file")
    bad = heads.unionByName(envelopes).filter("claim <> content_hash")
    return _say(bad, "warning" if profile == "reader-tolerant" else "error", "content_hash_mismatch", "/content_hash", F.col("content_hash"))


def cycles(r: DataFrame, most: int) -> DataFrame:
    """parent_cycle diagnostics; `most`: events of the longest session."""
    events = r.filter("group_idx > 0 and type <> 'session'")
    first = events.withColumn("n", F.row_number().over(W.partitionBy("file", "group_idx", "id").orderBy("line"))).filter("n = 1")
    on = graph.cyclic_ids(first.select("file", "group_idx", "id", "parent_id"), ["file", "group_idx"], most)
    return _say(first.join(on, ["file", "group_idx", "id"]), "error", "parent_cycle", "/parent_id", F.col("id"))


def validate(lines: DataFrame, profile: str = "strict", files: DataFrame | None = None) -> DataFrame:
    """(file, line, path, severity, code, message) of parsed lines; parse errors come first and end their file. profile: strict or reader-tolerant.

    `files(file)` names the files that were read, so that those without lines are told too, at line 0.
    """
    if profile not in PROFILES:
        raise TypeError(f"no profile: {profile}")
    # Some thirty rules read the parsed lines: they are parsed once and kept where a lost executor does not take them.
    r = durable(promoted(lines.filter("code is null")))
    faults = _say(lines.filter("code is not null"), "error", "parse", "", F.col("code"))
    longest = r.groupBy("file", "group_idx").count().agg(F.max("count")).first()[0] or 1
    if files is not None:
        blank = files.select("file").join(lines.select("file").distinct(), "file", "left_anti").withColumn("line", F.lit(0))
        faults = faults.unionByName(_say(blank, "error", "missing_header", "", F.lit("the file has no lines")))
    return reduce(DataFrame.unionByName, [faults, record_rules(r, profile), secret_rules(r), *file_rules(r, profile), hash_rules(lines, r, profile), cycles(r, longest)])


def rendered(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics as lines of text, control characters escaped."""
    safe = F.regexp_replace("message", r"[\x00-\x1F\x7F]", "?")
    where = F.when(F.col("path") == "", "<root>").otherwise(F.col("path"))
    return diagnostics.select("file", "line", F.concat_ws(" ", "severity", "code", F.lit("line"), "line", F.concat(where, F.lit(":")), safe).alias("text"))
