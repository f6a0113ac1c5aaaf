"""Which tool results belong to which tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def pair_calls(entries: DataFrame, session: list[str], order: str = "ord") -> DataFrame:
    """Calls with the method that paired them: by_id, by_call_id, nearest, or null.

    entries: session columns, `order`, kind (tool_call, tool_result or anything else), id,
    for_id, call_id. A result that names a call is used up, whether the call is free or
    not. Then calls and results with equal call_id pair in order, wherever they stand.
    The rest pair like brackets: a result takes the nearest free call before it, which
    running sums find without a loop. A session is one window and one sort.
    """
    keys = [*session]
    calls = entries.filter("kind = 'tool_call'")
    results = entries.filter("kind = 'tool_result'")
    named = results.filter("for_id is not null").select(*keys, F.col("for_id").alias("id")).distinct().withColumn("named", F.lit(True))
    calls = calls.join(named, [*keys, "id"], "left")
    known = calls.select(*keys, F.col("id").alias("for_id")).distinct().withColumn("used", F.lit(True))
    results = results.join(known, [*keys, "for_id"], "left").filter("used is null").drop("used")
    free = calls.filter("named is null")
    both = free.select(*keys, order, "id", "call_id", F.lit(1).alias("step")).unionByName(results.select(*keys, order, "id", "call_id", F.lit(-1).alias("step")))
    many = W.partitionBy(*keys, "call_id")
    both = both.withColumn("nth", F.row_number().over(W.partitionBy(*keys, "call_id", "step").orderBy(order)))
    both = both.withColumn("pairs", F.least(F.sum(F.when(F.col("step") == 1, 1).otherwise(0)).over(many), F.sum(F.when(F.col("step") == -1, 1).otherwise(0)).over(many)))
    by_call = F.col("call_id").isNotNull() & (F.col("nth") <= F.col("pairs"))
    rest = both.filter(~by_call)
    upto = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*keys).orderBy(order).rowsBetween(1, W.unboundedFollowing)
    rest = rest.withColumn("raw", F.sum("step").over(upto))
    rest = rest.withColumn("depth", F.col("raw") - F.least(F.lit(0), F.min("raw").over(upto)))
    rest = rest.withColumn("low", F.min("depth").over(after))
    alone = F.col("low").isNull() | (F.col("low") >= F.col("depth"))
    out = calls.filter("named").select(*keys, order, "id", F.lit("by_id").alias("method"))
    out = out.unionByName(both.filter(by_call & (F.col("step") == 1)).select(*keys, order, "id", F.lit("by_call_id").alias("method")))
    return out.unionByName(rest.filter("step = 1").select(*keys, order, "id", F.when(~alone, F.lit("nearest")).alias("method")))


def unmatched_calls(entries: DataFrame, session: list[str], order: str = "ord", suppressed: DataFrame | None = None) -> DataFrame:
    """Warnings for calls without a result, in sessions without a session_end; `suppressed` has (session, id) declared open."""
    ended = entries.filter("kind = 'session_end'").select(*session).distinct()
    open_sessions = entries.join(ended, session, "left_anti")
    out = pair_calls(open_sessions, session, order).filter("method is null").drop("method")
    if suppressed is not None:
        out = out.join(suppressed, [*session, "id"], "left_anti")
    return out.withColumn("code", F.lit("unmatched_tool_call_at_eof"))


def link_calls(results: DataFrame, calls: DataFrame, session: list[str], order: str = "ord") -> DataFrame:
    """Results with the id of the last call of the same call_id that came before them (an as-of join)."""
    both = calls.select(*session, order, "call_id", F.col("id").alias("c_id"), F.lit(None).cast("string").alias("r_id"))
    both = both.unionByName(results.select(*session, order, "call_id", F.lit(None).cast(calls.schema["id"].dataType).alias("c_id"), F.col("id").cast("string").alias("r_id")))
    before = W.partitionBy(*session, "call_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return both.withColumn("for_id", F.when(F.col("call_id").isNotNull(), F.last("c_id", True).over(before))).filter("r_id is not null").select(*session, order, "r_id", "call_id", "for_id")


def link_last(entries: DataFrame, session: list[str], order: str = "ord") -> DataFrame:
    """`entries(session, order, kind, id, linker, ..)` with for_id and call_id of calls and results that carry a linker's id.

    A result gets the id of the last call of its session with the same linker, wherever that
    stands; without one it keeps its call_id and gets no for_id. The last call is found by an
    aggregation that combines before the shuffle. Other entries, and null linkers, have neither.
    """
    linked = F.col("kind").isin("tool_call", "tool_result") & F.col("linker").isNotNull()
    last = entries.filter("kind = 'tool_call' and linker is not null").groupBy(*session, "linker").agg(F.max_by("id", order).alias("last_id"))
    out = entries.join(last, [*session, "linker"], "left")
    return out.select(*entries.columns, F.when(linked & (F.col("kind") == "tool_result"), F.col("last_id")).alias("for_id"), F.when(linked, F.col("linker")).alias("call_id"))
