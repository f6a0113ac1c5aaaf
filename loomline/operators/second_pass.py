"""The second pass over adapted entries: usage, links, parents, running totals, model changes and open calls.

Entries come from `adapters.adapt`: session_uid, record_idx, ordinal, rule, id, type, ts,
payload, call_id, tool_kind. Each step is a window over a session, or a join of records
with entries by the session and a record's own id; sessions with a null id are not
followed, as their records cannot be told apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomline.functions import scalars as S
from loomline.operators import adapters, graph, sequences
from loomline.operators.adapters import get, json, obj, text
from loomline.session import durable

PLACE = ["record_idx", "ordinal"]


def with_field(payload: Column, name: str, value: Column) -> Column:
    """A payload with one more field, whose JSON text is `value`; as it is where that is null."""
    body = F.substring(payload, 1, F.length(payload) - 1)
    return F.when(value.isNotNull(), F.concat(body, F.when(payload == "{}", "").otherwise(","), F.lit(f'"{name}":'), value, F.lit("}"))).otherwise(payload)


def codex_usage(info: Column) -> Column:
    """Counts of a token report of the Codex dialect, `last_token_usage` and `total_token_usage`, under the common names; null without any."""
    part = lambda path: F.try_variant_get(info, path, "long")
    number = lambda path: F.when(F.schema_of_variant(F.try_variant_get(info, path, "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)"), part(path))
    names = {"input_tokens": "$.last_token_usage.input_tokens", "output_tokens": "$.last_token_usage.output_tokens", "input_tokens_cumulative": "$.total_token_usage.input_tokens",
             "output_tokens_cumulative": "$.total_token_usage.output_tokens", "cache_read_tokens": "$.last_token_usage.cached_input_tokens", "reasoning_tokens": "$.last_token_usage.reasoning_output_tokens"}
    found = {k: F.when(number(p) >= 0, number(p)) for k, p in names.items()}
    every = {k: found.get(k, F.lit(None).cast("long")) for k in S.USAGE_NAMES}
    return F.when(F.coalesce(*found.values()).isNotNull(), F.struct(*[c.alias(k) for k, c in every.items()]))


def with_usage(entries: DataFrame, records: DataFrame, usage: Column) -> DataFrame:
    """`entries` with `usage`: a record's counts on the first agent message that it became, null elsewhere."""
    said = records.select("session_uid", "record_idx", usage.alias("_usage")).filter("_usage is not null")
    first = F.min(F.when(F.col("type") == "agent_message", F.col("ordinal"))).over(W.partitionBy("session_uid", "record_idx"))
    out = entries.withColumn("_first", first).join(said, ["session_uid", "record_idx"], "left")
    here = (F.col("type") == "agent_message") & (F.col("ordinal") == F.col("_first"))
    return out.withColumn("usage", F.when(here, F.col("_usage"))).drop("_usage", "_first")


def reported_usage(entries: DataFrame, info: str = "payload") -> DataFrame:
    """`entries` with `usage` from later token reports of the turn, the last one counts; the reports leave."""
    at = F.struct(*PLACE)
    flat = entries.withColumn("_at", at).withColumn("kind", F.col("type")).withColumn("usage", F.when(F.col("type") == "token_count", codex_usage(F.try_parse_json(info))))
    flat = flat.withColumn("kind", F.when((F.col("kind") == "token_count") & F.col("usage").isNull(), "none").otherwise(F.col("kind")))
    found = sequences.rollup_usage(flat, ["session_uid"], "_at").select("session_uid", *PLACE, "usage")
    return entries.filter("type <> 'token_count'").join(found, ["session_uid", *PLACE], "left")


def with_totals(entries: DataFrame) -> DataFrame:
    """`entries` whose payload carries `usage`, running totals included; the column leaves."""
    names = list(S.USAGE_NAMES)
    flat = entries.withColumn("_at", F.struct(*PLACE)).select("*", *[F.col(f"usage.{n}").alias(n) for n in names])
    summed = sequences.cumulative_tokens(flat, ["session_uid"], "_at")
    value = F.when(F.col("usage").isNotNull(), F.to_json(F.struct(*names)))
    return summed.withColumn("payload", with_field(F.col("payload"), "usage", value)).drop("_at", "usage", *names)


def with_result_kinds(entries: DataFrame) -> DataFrame:
    """`entries` with for_id, and with the tool kind of a call on its result."""
    linked = adapters.link_results(entries)
    before = W.partitionBy("session_uid", "call_id").orderBy(*PLACE).rowsBetween(W.unboundedPreceding, -1)
    kind = F.last(F.when(F.col("type") == "tool_call", F.col("tool_kind")), True).over(before)
    return linked.withColumn("tool_kind", F.when(F.col("for_id").isNotNull(), kind).otherwise(F.col("tool_kind")))


def model_changes(entries: DataFrame, records: DataFrame, model: Column, namespace: str) -> DataFrame:
    """`entries` with an entry before the first one of each record whose model differs from the one before.

    `model`: of a record that names one, else null. Only records that became entries count.
    """
    starts = entries.groupBy("session_uid", "record_idx").agg(F.min("ts").alias("ts"))
    named = records.select("session_uid", "record_idx", model.alias("model")).filter("model is not null").join(starts, ["session_uid", "record_idx"])
    found = sequences.changes(named, ["session_uid"], "model", "record_idx")
    new = found.select(
        "session_uid", "record_idx", F.lit(-1).alias("ordinal"), F.lit("model_change").alias("rule"), F.lit("model_change").alias("type"), "ts",
        obj(from_model=F.col("previous"), to_model=F.col("model")).alias("payload"),
        S.entry_id(namespace, "session_uid", F.lit("model_change"), "record_idx", "previous", "model").alias("id"))
    return entries.unionByName(new, allowMissingColumns=True)


def linear_parents(entries: DataFrame) -> DataFrame:
    """`entries` with parent_id: the entry before."""
    return entries.withColumn("parent_id", F.lag("id").over(W.partitionBy("session_uid").orderBy(*PLACE)))


def tree_parents(entries: DataFrame, records: DataFrame, own: Column, parent: Column) -> DataFrame:
    """`entries` with parent_id by the tree of records.

    Within a record an entry follows the one before it. The first one, and a synthesised
    one, follows the last entry of the nearest ancestor of its record that has entries.
    Of records with one id the first counts.
    """
    key = lambda c: F.concat_ws("\x1f", "session_uid", c)
    named = records.select("session_uid", "record_idx", own.alias("own"), parent.alias("parent")).filter("own is not null and session_uid is not null")
    named = named.withColumn("nth", F.row_number().over(W.partitionBy("session_uid", "own").orderBy("record_idx"))).filter("nth = 1")
    last = entries.filter("ordinal >= 0").groupBy("session_uid", "record_idx").agg(F.max_by("id", "ordinal").alias("last_id"))
    nodes = durable(named.join(last, ["session_uid", "record_idx"], "left").select(
        "session_uid", "record_idx", key("own").alias("id"), F.when(F.col("parent").isNotNull(), key("parent")).alias("parent_id"), F.col("last_id").isNotNull().alias("mapped"), "last_id"))
    above = graph.nearest_ancestors(nodes.select("id", "parent_id", "mapped"))
    ends = nodes.select(F.col("id").alias("ancestor"), F.col("last_id").alias("_up"))
    up = nodes.select("session_uid", "record_idx", "id").join(above, "id").join(ends, "ancestor").select("session_uid", "record_idx", "_up")
    before = F.lag(F.when(F.col("ordinal") >= 0, F.col("id"))).over(W.partitionBy("session_uid", "record_idx").orderBy("ordinal"))
    return entries.withColumn("_before", before).join(up, ["session_uid", "record_idx"], "left").withColumn("parent_id", F.coalesce("_before", "_up")).drop("_before", "_up")


def with_terminated(entries: DataFrame, namespace: str) -> DataFrame:
    """`entries` with a last one in sessions that stop with open calls: the process was killed."""
    end = entries.groupBy("session_uid").agg(F.max("record_idx").alias("last"), F.max_by("ts", F.struct(*PLACE)).alias("ts"), F.max_by("id", F.struct(*PLACE)).alias("parent_id"))
    ended = entries.filter("type = 'session_end'").select("session_uid").distinct()
    new = adapters.terminated(entries).join(end, "session_uid").join(ended, "session_uid", "left_anti").select(
        "session_uid", (F.col("last") + 1).alias("record_idx"), F.lit(0).alias("ordinal"), F.lit("session_terminated").alias("rule"), F.lit("session_terminated").alias("type"), "ts", "parent_id",
        obj(reason=F.lit("process_terminated"), open_call_ids=F.col("open_call_ids")).alias("payload"),
        S.entry_id(namespace, "session_uid", F.lit("session_terminated"), F.col("last") + 1).alias("id"))
    return entries.unionByName(new, allowMissingColumns=True)


def _piped(df: DataFrame, *steps) -> DataFrame:
    return reduce(lambda x, f: f(x), steps, df)


def claude_session(records: DataFrame, namespace: str) -> DataFrame:
    """Entries of records(session_uid, record_idx, v) of the Claude Code dialect, both passes."""
    model = F.when(get("$.type") == "assistant", text("$.message.model"))
    first = durable(adapters.adapt(records, adapters.claude_rules(), namespace, "claudecode"))
    return _piped(first, lambda e: with_usage(e, records, S.usage(json("$.message.usage"))), with_totals, with_result_kinds, adapters.permission_changes,
                  lambda e: model_changes(e, records, model, namespace), durable,
                  lambda e: tree_parents(e, records, text("$.uuid"), text("$.parentUuid")), lambda e: with_terminated(e, namespace))


def pi_session(records: DataFrame, namespace: str) -> DataFrame:
    """Entries of the Pi dialect, both passes; its records tell changes of the model themselves."""
    first = durable(adapters.adapt(records, adapters.pi_rules(), namespace, "pi"))
    usage = F.coalesce(S.usage(json("$.message.usage")), _pi_usage())
    return _piped(first, lambda e: with_usage(e, records, usage), with_totals, with_result_kinds, durable,
                  lambda e: tree_parents(e, records, text("$.id"), text("$.parentId")), lambda e: with_terminated(e, namespace))


def _pi_usage() -> Column:
    """Counts under the short names of the Pi dialect."""
    part = lambda n: get(f"$.message.usage.{n}", "long")
    short = {"input_tokens": part("input"), "output_tokens": part("output"), "cache_read_tokens": part("cacheRead"), "cache_creation_tokens": part("cacheWrite")}
    kept = {k: F.when(c >= 0, c) for k, c in short.items()}
    return F.when(F.coalesce(*kept.values()).isNotNull(), F.struct(*[kept.get(k, F.lit(None).cast(T.LongType())).alias(k) for k in S.USAGE_NAMES]))


def codex_session(records: DataFrame, namespace: str) -> DataFrame:
    """Entries of the Codex dialect, both passes: a linear history with token reports and models in the context of a turn."""
    first = durable(adapters.adapt(records, adapters.codex_rules(), namespace, "codex", adapters.codex_known()))
    model = F.when(get("$.type") == "turn_context", text("$.payload.model"))
    # A turn's context becomes no entry; the change is told where the next entry stands.
    seen = records.select("session_uid", "record_idx", model.alias("m")).withColumn("m", F.last("m", True).over(W.partitionBy("session_uid").orderBy("record_idx").rowsBetween(W.unboundedPreceding, 0)))
    return _piped(first, reported_usage, with_totals, with_result_kinds, lambda e: model_changes(e, seen, F.col("m"), namespace), durable, linear_parents, lambda e: with_terminated(e, namespace))
