"""From the dialects of agents to one vocabulary: ordered rules, one pass, deterministic ids.

A rule is a pair of columns over the source record `v` (a variant): when it applies, and
the drafts (an array of structs) that it emits. Records take the first rule that
applies; what no rule knows is quarantined without loss.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.functions import scalars as S
from loomline.operators import tools
from loomline.operators.tools import text_at

# Events of hooks and the kinds they become; openings of a continued conversation.
HOOK_KINDS = {
    "SessionStart": "session_start",
    "SessionEnd": "session_end",
    "Stop": "turn_end",
    "SubagentStop": "subagent_end",
    "PreToolUse": "pre_tool_use",
    "PostToolUse": "post_tool_use",
    "Notification": "permission_request",
}
PREAMBLE = "^(?:This session is|Here is the conversation so far|Here's the conversation so far)"
DRAFT = "struct<type: string, ts: string, payload: string, call_id: string, tool_kind: string>"


@dataclass(frozen=True)
class Rule:
    name: str
    match: Column
    drafts: Column


def get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def json(path: str) -> Column:
    return F.to_json(F.try_variant_get("v", path, "variant"))


def draft(kind: str, payload: Column, ts: Column, call_id: Column | None = None, tool_kind: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit(kind).alias("type"), ts.alias("ts"), payload.alias("payload"), (none if call_id is None else call_id).alias("call_id"), (none if tool_kind is None else tool_kind).alias("tool_kind")))


def obj(**fields: Column) -> Column:
    """JSON text of an object; null fields are absent."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def adapt(records: DataFrame, rules: list[Rule], namespace: str, vendor: str, known: Column | None = None) -> DataFrame:
    """Entries of source records(session_uid, record_idx, v).

    Columns: session_uid, record_idx, ordinal, rule, id, type, ts, payload (JSON text),
    call_id, tool_kind. Times are carried forward from earlier records of the session.
    Records for which `known` is false are quarantined before any rule.
    """
    lost = draft("system_event", F.to_json(F.struct(F.lit(f"x-{vendor}/unknown_record").alias("kind"), F.struct(F.to_json("v").alias("raw")).alias("data"))), get("$.timestamp"))
    if known is not None:
        rules = [Rule("quarantine", ~F.coalesce(known, F.lit(False)), lost), *rules]
    name, drafts = F.lit("quarantine"), lost
    for r in reversed(rules):
        name = F.when(r.match, F.lit(r.name)).otherwise(name)
        drafts = F.when(r.match, r.drafts).otherwise(drafts)
    out = records.select("session_uid", "record_idx", name.alias("rule"), F.posexplode(drafts).alias("ordinal", "d"))
    out = out.select("session_uid", "record_idx", "ordinal", "rule", "d.*").filter("payload is not null")
    return out.withColumn("id", S.entry_id(namespace, "session_uid", "record_idx", "type", "ordinal"))


_P = "$.payload"


def _ts() -> Column:
    return get("$.timestamp")


def _event(kind: str) -> Column:
    return (get("$.type") == "event_msg") & (get(f"{_P}.type") == kind)


def _item(kind: str) -> Column:
    return (get("$.type") == "response_item") & (get(f"{_P}.type") == kind)


def text(*paths: str) -> Column:
    """The first of the paths of a record that holds a string."""
    return text_at(F.col("v"), *paths)


def _whole(path: str) -> Column:
    """The object at a path, or null."""
    at = F.try_variant_get("v", path, "variant")
    return F.when(F.schema_of_variant(at).startswith("OBJECT"), at)


def _call(kind: str, **args: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("tool"), F.struct(*[c.alias(k) for k, c in args.items()]).alias("args")))


def _text(*paths: str) -> Column:
    said = text(*paths)
    return F.when(said != "", obj(text=said))


def codex_rules() -> list[Rule]:
    """Rules for rollout records of the Codex dialect."""
    tool = get(f"{_P}.name")
    given = F.when(F.schema_of_variant(F.try_variant_get("v", f"{_P}.arguments", "variant")) == "STRING", F.try_parse_json(get(f"{_P}.arguments"))).otherwise(F.try_variant_get("v", f"{_P}.arguments", "variant"))
    args = F.coalesce(F.when(F.schema_of_variant(given).startswith("OBJECT"), given), F.parse_json(F.lit("{}")))
    call = tools.mapped(tool, args, tools.codex_tools(args))
    patch, path = F.coalesce(text(f"{_P}.input"), F.lit("")), S.patch_path(text(f"{_P}.input"))
    name = F.coalesce(S.canonical_tool_name(text(f"{_P}.name")), F.lit("unknown"))
    custom = F.when((name == "apply_patch") & path.isNotNull(), _call("file_edit", path=path, diff=patch)).otherwise(_call("other", name=name, args=F.struct(patch.alias("input"))))
    queries = F.filter(F.try_variant_get("v", f"{_P}.action.queries", "array<variant>"), lambda q: F.schema_of_variant(q) == "STRING")
    query = F.coalesce(F.try_variant_get(F.try_element_at(queries, F.lit(1)), "$", "string"), text(f"{_P}.action.query"))
    action = F.coalesce(_whole(f"{_P}.action"), F.parse_json(F.lit("{}")))
    search = F.when((get(f"{_P}.action.type") == "search") & query.isNotNull(), _call("web_search", query=query)).otherwise(_call("other", name=F.lit("web_search_call"), args=F.struct(action.alias("action"))))
    found = F.coalesce(F.when(F.schema_of_variant(F.try_variant_get("v", f"{_P}.tools", "variant")).startswith("ARRAY"), json(f"{_P}.tools")), text(f"{_P}.output"), F.lit(""))
    number = lambda p: get(f"{_P}.{p}", "double")
    whole = lambda p: F.when(number(p).isNotNull(), F.when(number(p) < 0, F.ceil(number(p))).otherwise(F.floor(number(p))).cast("long"))
    output = S.strip_spinner(F.coalesce(get(f"{_P}.output"), json(f"{_P}.output")))
    ok = F.coalesce(get(f"{_P}.success", "boolean"), F.lit(True))
    summarised = text(f"{_P}.message", f"{_P}.summary")
    summary = F.array_join(F.transform(get(f"{_P}.summary", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string")), "\n")

    def system(kind: str, linked: bool = True, **f: Column) -> Column:
        return draft("system_event", obj(kind=F.lit(kind), data=F.struct(*[c.alias(k) for k, c in f.items()])), _ts(), get(f"{_P}.call_id") if linked else None)

    took = S.duration_ms(number("duration"), get(f"{_P}.duration.secs", "long"), get(f"{_P}.duration.nanos", "long"))
    duration = F.when(number("duration").isNotNull() | get(f"{_P}.duration.secs", "long").isNotNull(), took)
    result = _whole(f"{_P}.result")
    result_ok = F.when(result.isNotNull(), F.try_variant_get(result, "$.Ok", "variant").isNotNull())
    return [
        Rule("user_message", _event("user_message"), draft("user_message", _text(f"{_P}.message", f"{_P}.text"), _ts())),
        Rule("agent_message", _event("agent_message"), draft("agent_message", _text(f"{_P}.message", f"{_P}.text"), _ts())),
        Rule("function_call", _item("function_call"), draft("tool_call", call, _ts(), get(f"{_P}.call_id"), tools.kind_of(call))),
        Rule("custom_tool_call", _item("custom_tool_call"), draft("tool_call", custom, _ts(), get(f"{_P}.call_id"), tools.kind_of(custom))),
        Rule("call_output", _item("function_call_output") | _item("custom_tool_call_output"), draft("tool_result", obj(ok=ok, output=output), _ts(), get(f"{_P}.call_id"))),
        Rule("web_search_call", _item("web_search_call"), draft("tool_call", search, _ts(), None, tools.kind_of(search))),
        Rule("tool_search_call", _item("tool_search_call"), draft("tool_call", _call("other", name=F.lit("tool_search"), args=args), _ts(), get(f"{_P}.call_id"), F.lit("other"))),
        Rule("tool_search_output", _item("tool_search_output"), draft("tool_result", obj(ok=F.lit(True), output=found), _ts(), get(f"{_P}.call_id"))),
        Rule("reasoning", _item("reasoning"), draft("agent_thinking", F.when(summary != "", obj(text=summary)), _ts())),
        Rule("agent_reasoning", _event("agent_reasoning") | _event("agent_reasoning_raw_content"), draft("agent_thinking", _text(f"{_P}.text", f"{_P}.message"), _ts())),
        Rule("compacted", get("$.type") == "compacted", draft("context_compact", F.when(summarised != "", obj(summary=summarised, trigger=F.lit("auto"), tokens_before=whole("tokens_before"), tokens_after=whole("tokens_after"))), _ts())),
        Rule("task_started", _event("task_started"), system("task_started", turn_id=text(f"{_P}.turn_id"), started_at=number("started_at"), model_context_window=whole("model_context_window"), collaboration_mode_kind=text(f"{_P}.collaboration_mode_kind"))),
        Rule("task_complete", _event("task_complete"), system("task_completed", turn_id=text(f"{_P}.turn_id"), completed_at=number("completed_at"), duration_ms=whole("duration_ms"), time_to_first_token_ms=whole("time_to_first_token_ms"), last_agent_message=text(f"{_P}.last_agent_message"))),
        Rule("exec_command_end", _event("exec_command_end"), system("x-codex/exec_command_end", exit_code=get(f"{_P}.exit_code", "long"), stdout_excerpt=S.excerpt(text(f"{_P}.stdout")), stderr_excerpt=S.excerpt(text(f"{_P}.stderr")), duration_ms=duration)),
        Rule("patch_apply_end", _event("patch_apply_end"), system("x-codex/patch_apply_end", success=get(f"{_P}.success", "boolean"), changes=_whole(f"{_P}.changes"), stdout_excerpt=S.excerpt(text(f"{_P}.stdout")), stderr_excerpt=S.excerpt(text(f"{_P}.stderr")), status=text(f"{_P}.status"))),
        Rule("mcp_tool_call_end", _event("mcp_tool_call_end"), system("x-codex/mcp_tool_call_end", plugin_id=text(f"{_P}.plugin_id"), invocation=_whole(f"{_P}.invocation"), duration_ms=duration, result_ok=result_ok)),
        Rule("thread_goal_updated", _event("thread_goal_updated"), system("x-codex/thread_goal_updated", False, thread_id=text(f"{_P}.threadId", f"{_P}.thread_id"), turn_id=text(f"{_P}.turnId", f"{_P}.turn_id"), goal=_whole(f"{_P}.goal"))),
        Rule("web_search_end", _event("web_search_end"), system("x-codex/web_search_end", False, query=text(f"{_P}.query"), action=_whole(f"{_P}.action"), call_id=text(f"{_P}.call_id"))),
        Rule("token_count", _event("token_count"), draft("token_count", json(f"{_P}.info"), _ts())),
        Rule("silent", get("$.type").isin("session_meta", "turn_context") | _item("message"), draft("none", F.lit(None).cast("string"), _ts())),
    ]


def codex_known() -> Column:
    return get("$.type").isin("session_meta", "turn_context", "event_msg", "response_item", "compacted")


def pi_rules() -> list[Rule]:
    """Rules for records of the Pi dialect; a message's blocks become one entry each."""
    role = get("$.message.role")
    is_message = get("$.type") == "message"
    said = F.coalesce(text("$.message.content"), F.array_join(F.transform(get("$.message.content", "array<variant>"), lambda b: F.try_variant_get(b, "$.text", "string")), "\n"))
    none = F.lit(None).cast("string")

    def block(b: Column) -> Column:
        kind = F.try_variant_get(b, "$.type", "string")
        part = lambda p: F.try_variant_get(b, p, "string")
        args = F.try_variant_get(b, "$.arguments", "variant")
        call = tools.mapped(part("$.name"), args, tools.pi_tools(args))
        return F.struct(
            F.when(kind == "thinking", "agent_thinking").when(kind == "toolCall", "tool_call").otherwise("agent_message").alias("type"), _ts().alias("ts"),
            F.when(kind == "toolCall", call).when(kind == "thinking", obj(text=part("$.thinking"))).otherwise(obj(text=part("$.text"), model=get("$.message.model"))).alias("payload"),
            F.when(kind == "toolCall", part("$.id")).alias("call_id"), F.when(kind == "toolCall", tools.kind_of(call)).alias("tool_kind"))

    blocks = F.transform(get("$.message.content", "array<variant>"), block)
    whole = draft("agent_message", obj(text=get("$.message.content"), model=get("$.message.model"), stop_reason=get("$.message.stopReason")), _ts())
    stopped = F.when(get("$.message.stopReason") == "aborted", draft("user_interrupt", obj(reason=F.lit("stop_reason_aborted")), _ts())).otherwise(F.array().cast(f"array<{DRAFT}>"))
    ok = ~F.coalesce(get("$.message.isError", "boolean"), F.lit(False))
    level, name, custom, inner = text("$.thinkingLevel"), text("$.name"), text("$.customType"), _whole("$.data")

    def system(kind: str, words: Column, data: Column) -> Column:
        return draft("system_event", obj(kind=F.lit(kind), text=words, data=data), _ts())

    def plugin(kind: str, label: str, bare: str) -> Column:
        """A plug-in's record keeps its words as they are, blank ones give way to its type."""
        own = F.when(F.trim(text("$.content")) != "", text("$.content"))
        data = F.when(custom.isNotNull() | inner.isNotNull(), F.struct(custom.alias("custom_type"), inner.alias("custom_data")))
        return system(kind, F.coalesce(own, F.concat(F.lit(f"{label}: "), custom), F.lit(bare)), data)

    return [
        Rule("user", is_message & (role == "user"), draft("user_message", obj(text=said), _ts())),
        Rule("assistant", is_message & (role == "assistant"), F.concat(F.coalesce(blocks, whole), stopped)),
        Rule("tool_result", is_message & (role == "toolResult"), draft("tool_result", obj(ok=ok, output=said, error=F.when(~ok, said)), _ts(), get("$.message.toolCallId"))),
        Rule("branch_summary", get("$.type") == "branch_summary", draft("branch_summary", obj(abandoned_branch_id=get("$.fromId"), summary=get("$.summary")), _ts())),
        Rule("compaction", get("$.type") == "compaction", draft("context_compact", F.when(text("$.summary").isNotNull(), obj(summary=text("$.summary"), tokens_before=get("$.tokensBefore", "long"), trigger=F.lit("auto"))), _ts())),
        Rule("model_change", get("$.type") == "model_change", draft("model_change", F.when(text("$.modelId").isNotNull(), obj(to_model=text("$.modelId"))), _ts())),
        Rule("thinking_level_change", get("$.type") == "thinking_level_change", system("x-pi/thinking_level_change", F.coalesce(F.concat(F.lit("Thinking level set to "), level), F.lit("Thinking level change")), F.when(level.isNotNull(), F.struct(level.alias("thinking_level"))))),
        Rule("session_info", get("$.type") == "session_info", system("x-pi/session_info", F.coalesce(F.concat(F.lit("Session info: "), name), F.lit("Session info")), F.when(name.isNotNull(), F.struct(name.alias("name"))))),
        Rule("custom_message", get("$.type") == "custom_message", plugin("x-pi/custom_message", "Custom message", "Custom message")),
        Rule("custom", get("$.type") == "custom", plugin("x-pi/custom", "Custom", "Custom event")),
        Rule("silent", get("$.type") == "session", draft("none", none, _ts())),
    ]


def claude_rules() -> list[Rule]:
    """Rules for transcript records of the Claude Code dialect; blocks become one entry each."""
    blocks = get("$.message.content", "array<variant>")
    plain = F.when(F.schema_of_variant(F.try_variant_get("v", "$.message.content", "variant")) == "STRING", get("$.message.content"))
    none = F.lit(None).cast("string")
    part = lambda b, p: F.try_variant_get(b, p, "string")
    joined = lambda b: F.coalesce(F.array_join(F.transform(F.try_variant_get(b, "$.content", "array<variant>"), lambda x: part(x, "$.text")), "\n"), part(b, "$.content"))

    def entry(b: Column, kind: Column, payload: Column, call_id: Column, tool_kind: Column = none) -> Column:
        return F.struct(kind.alias("type"), _ts().alias("ts"), payload.alias("payload"), call_id.alias("call_id"), tool_kind.alias("tool_kind"))

    def assistant(b: Column) -> Column:
        kind = part(b, "$.type")
        args = F.try_variant_get(b, "$.input", "variant")
        call = tools.mapped(part(b, "$.name"), args, tools.claude_tools(args))
        thought = F.coalesce(text_at(b, "$.thinking", "$.data"), F.when(kind == "redacted_thinking", "[redacted thinking]").otherwise(""))
        return entry(b, F.when(kind.isin("thinking", "redacted_thinking"), "agent_thinking").when(kind == "tool_use", "tool_call").otherwise("agent_message"),
                     F.when(kind == "tool_use", call).when(kind.isin("thinking", "redacted_thinking"), obj(text=thought, model=text("$.message.model")))
                     .when((kind == "text") & text_at(b, "$.text").isNotNull(), obj(text=part(b, "$.text"), model=text("$.message.model"), stop_reason=text("$.message.stop_reason"))),
                     F.when(kind == "tool_use", part(b, "$.id")), F.when(kind == "tool_use", tools.kind_of(call)))

    def user(b: Column) -> Column:
        result = part(b, "$.type") == "tool_result"
        bad = F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False))
        return entry(b, F.when(result, "tool_result").otherwise("user_message"), F.when(result, obj(ok=~bad, output=joined(b), error=F.when(bad, joined(b)))).otherwise(obj(text=part(b, "$.text"))), F.when(result, part(b, "$.tool_use_id")))

    kind = get("$.type")
    hidden = F.coalesce(get("$.isSidechain", "boolean"), F.lit(False)) | F.coalesce(get("$.isMeta", "boolean"), F.lit(False))
    by = lambda t: F.regexp_extract(F.trim(t), r"^\[Request interrupted by (.+)\]$", 1)
    stopped = F.when(plain.isNotNull(), by(plain)).otherwise(by(F.coalesce(part(blocks[0], "$.text"), F.lit(""))))
    preamble = F.trim(plain).rlike(PREAMBLE)
    subtype = text("$.subtype")
    hook = F.create_map(*[F.lit(x) for pair in HOOK_KINDS.items() for x in pair])
    event = (F.when(kind == "queue-operation", "queue_operation").when(kind == "pr-link", "x-claudecode/pr_link")
             .when((kind == "progress") & (get("$.data.type") == "hook_progress"), F.coalesce(F.try_element_at(hook, text("$.data.hookEvent")), F.lit("hook_fired")))
             .when(kind == "progress", "x-claudecode/progress").when(subtype == "stop_hook_summary", "turn_end")
             .when(subtype.rlike("^[a-z0-9][a-z0-9_]*$"), F.concat(F.lit("x-claudecode/"), subtype)).otherwise("x-claudecode/system"))
    link = F.to_json(F.struct(get("$.prNumber", "long").alias("pr_number"), text("$.prUrl").alias("pr_url"), text("$.prRepository").alias("pr_repository")))
    data = F.when(kind == "progress", _whole("$.data")).when((kind == "pr-link") & (link != "{}"), F.parse_json(link))
    mode = text("$.permissionMode")
    summary = F.coalesce(text("$.summary", "$.message.content"), json("$.message.content"), F.lit(""))
    compact = F.coalesce(get("$.isCompactSummary", "boolean"), F.lit(False))
    return [
        Rule("hidden", hidden | kind.isin("attachment", "file-history-snapshot"), draft("none", none, _ts())),
        Rule("interrupt", (kind == "user") & (stopped != ""), draft("user_interrupt", obj(reason=stopped), _ts())),
        Rule("continued", (kind == "user") & preamble, draft("system_event", obj(kind=F.lit("session_start"), text=plain), _ts())),
        Rule("user_text", (kind == "user") & plain.isNotNull(), draft("user_message", obj(text=plain), _ts())),
        Rule("user_blocks", (kind == "user") & blocks.isNotNull(), F.transform(blocks, user)),
        Rule("assistant", (kind == "assistant") & blocks.isNotNull(), F.transform(blocks, assistant)),
        Rule("compact_summary", (kind == "summary") & compact, draft("context_compact", obj(summary=summary, trigger=F.lit("auto")), _ts())),
        Rule("summary", kind == "summary", draft("session_summary", obj(scope=F.lit("session"), text=summary), _ts())),
        Rule("permission_mode", kind == "permission-mode", draft("system_event", F.when(mode.isNotNull(), obj(kind=F.lit("permission_mode_change"), text=F.concat(F.lit("Permission mode: "), mode), data=F.struct(mode.alias("to")))), _ts())),
        Rule("system", kind.isin("system", "progress", "queue-operation", "pr-link"), draft("system_event", obj(kind=event, text=text("$.content"), data=data), _ts())),
    ]


def link_results(entries: DataFrame) -> DataFrame:
    """Entries with for_id: the id of the latest call with the same call_id before a result."""
    before = W.partitionBy("session_uid", "call_id").orderBy("record_idx", "ordinal").rowsBetween(W.unboundedPreceding, -1)
    call = F.last(F.when(F.col("type") == "tool_call", F.col("id")), True).over(before)
    return entries.withColumn("for_id", F.when((F.col("type") == "tool_result") & F.col("call_id").isNotNull(), call))


def terminated(entries: DataFrame) -> DataFrame:
    """(session_uid, open_call_ids): sessions that end with calls that no result was linked to."""
    results = entries.filter("for_id is not null").select("session_uid", F.col("for_id").alias("id")).distinct()
    loose = entries.filter("type = 'tool_call'").join(results, ["session_uid", "id"], "left_anti")
    ids = F.array_sort(F.collect_list(F.struct("record_idx", "ordinal", "id")))
    return loose.groupBy("session_uid").agg(F.transform(ids, lambda x: x["id"]).alias("open_call_ids"))


def permission_changes(entries: DataFrame) -> DataFrame:
    """Entries whose permission mode differs from the one before say so: data.from and the text."""
    mode = F.when(F.col("rule") == "permission_mode", F.get_json_object("payload", "$.data.to"))
    before = F.last(mode, True).over(W.partitionBy("session_uid").orderBy("record_idx", "ordinal").rowsBetween(W.unboundedPreceding, -1))
    out = entries.withColumn("_mode", mode).withColumn("_before", before)
    said = obj(kind=F.lit("permission_mode_change"), text=F.concat(F.lit("Permission mode changed: "), F.col("_before"), F.lit(" → "), F.col("_mode")), data=F.struct(F.col("_mode").alias("to"), F.col("_before").alias("from")))
    return out.withColumn("payload", F.when(F.col("_mode") != F.col("_before"), said).otherwise(F.col("payload"))).drop("_mode", "_before")
