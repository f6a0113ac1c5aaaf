"""Operators that carry state along the records of a session, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _before(session: list[str], order: str):
    return W.partitionBy(*session).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def _upto(session: list[str], order: str):
    return W.partitionBy(*session).orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def session_groups(lines: DataFrame, file: list[str], line: str = "line") -> DataFrame:
    """`lines` with group_idx, the number of session headers up to the line, and orphan: before the first header and no envelope on line 1."""
    headers = F.sum(F.when(F.col("type") == "session", 1).otherwise(0)).over(_upto(file, line))
    out = lines.withColumn("group_idx", headers.cast("long"))
    envelope = (F.col("type") == "trail") & (F.col(line) == 1)
    return out.withColumn("orphan", (F.col("group_idx") == 0) & ~envelope)


def out_of_order(headers: DataFrame, file: list[str], line: str = "line") -> DataFrame:
    """Headers whose time, as text, is before the latest one so far."""
    return headers.withColumn("latest", F.max("ts").over(_before(file, line))).filter("ts < latest")


def diverging(records: DataFrame, scope: list[str], value: str, order: str = "line") -> DataFrame:
    """Records whose value differs from the first non-null value of the scope."""
    first = F.first(value, ignorenulls=True).over(W.partitionBy(*scope).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return records.withColumn("first_value", first).filter(F.col(value) != F.col("first_value"))


def cumulative_tokens(turns: DataFrame, session: list[str], order: str = "ord") -> DataFrame:
    """Running token totals of messages that have counts of their turn only.

    turns: input_tokens, output_tokens and the two *_cumulative columns, all nullable.
    A row with any cumulative count stays as it is; a total it carries restarts the sum.
    A row without counts stays null.
    """
    given = F.col("input_tokens_cumulative").isNotNull() | F.col("output_tokens_cumulative").isNotNull()
    some = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    out = turns
    for side in ("input", "output"):
        total, delta, epoch = f"{side}_tokens_cumulative", f"{side}_tokens", f"_{side}_epoch"
        out = out.withColumn(epoch, F.count(total).over(_upto(session, order)))
        step = F.when(F.col(total).isNotNull(), F.col(total)).otherwise(F.coalesce(F.col(delta), F.lit(0)))
        run = F.sum(step).over(W.partitionBy(*session, epoch).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
        out = out.withColumn(f"_{side}", run)
    return out.select(
        *[c for c in turns.columns if not c.endswith("_cumulative")],
        *[F.when(given, F.col(f"{s}_tokens_cumulative")).when(some, F.col(f"_{s}")).alias(f"{s}_tokens_cumulative") for s in ("input", "output")])


def rollup_usage(entries: DataFrame, session: list[str], order: str = "ord") -> DataFrame:
    """Agent messages with the last usage reported before the next message: reports go to the latest agent message since the last user message."""
    turn = F.sum(F.when(F.col("kind") == "user_message", 1).otherwise(0)).over(_upto(session, order))
    out = entries.withColumn("turn", turn)
    target = F.last(F.when(F.col("kind") == "agent_message", F.col(order)), True).over(_upto([*session, "turn"], order))
    out = out.withColumn("target", target)
    last = out.filter("kind = 'token_count' and target is not null").groupBy(*session, "target").agg(F.max_by("usage", order).alias("usage"))
    messages = entries.filter("kind = 'agent_message'").drop("usage")
    return messages.join(last.withColumnRenamed("target", order), [*session, order], "left")


def changes(records: DataFrame, session: list[str], value: str, order: str = "ord") -> DataFrame:
    """Records where the value differs from the last non-null one before, which is `previous`; the first value is no change."""
    previous = F.last(value, True).over(_before(session, order))
    return records.withColumn("previous", previous).filter(F.col("previous").isNotNull() & (F.col(value) != F.col("previous")))


def carried_forward(records: DataFrame, session: list[str], value: str, default: Column, order: str = "ord") -> DataFrame:
    """`records` with nulls of `value` filled with the last value before, else the default."""
    return records.withColumn(value, F.coalesce(F.last(value, True).over(_upto(session, order)), default))


def first_in_epoch(records: DataFrame, session: list[str], epoch_value: str, key: Column, order: str = "ord") -> DataFrame:
    """The first record of each key in each epoch; an epoch ends when the value changes, so A, B, A are three."""
    previous = F.lag(epoch_value).over(W.partitionBy(*session).orderBy(order))
    starts = F.when(previous.isNull() | (F.col(epoch_value) != previous), 1).otherwise(0)
    out = records.withColumn("_starts", starts).withColumn("epoch", F.sum("_starts").over(_upto(session, order))).withColumn("_key", key)
    nth = F.row_number().over(W.partitionBy(*session, "epoch", "_key").orderBy(order))
    return out.withColumn("_nth", nth).filter("_nth = 1").drop("_nth", "_starts", "_key")


def parent_chain(entries: DataFrame, session: list[str], order: str = "ord") -> DataFrame:
    """Entries without a parent get the entry before them; `has_parent` tells an explicit null from an absent one."""
    previous = F.lag("id").over(W.partitionBy(*session).orderBy(order))
    return entries.withColumn("parent_id", F.when(F.col("has_parent"), F.col("parent_id")).otherwise(previous))


def recent(records: DataFrame, session: list[str], value: str, n: int, order: str = "ord") -> DataFrame:
    """`records` with the last n values before each."""
    return records.withColumn("recent", F.collect_list(value).over(W.partitionBy(*session).orderBy(order).rowsBetween(-n, -1)))
