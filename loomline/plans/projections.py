"""Record-shaped projections of the driver's tables, as DataFrames and as the same CTEs in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KINDS = {"click": "tool_call", "view": "tool_result", "purchase": "agent_message", "signup": "session_end"}


def tool_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of tool calls and results: user_id, day, ord, id, kind, call_id, value."""
    e = read(spark, sf_dir, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in KINDS.items()], F.lit("session_terminated"))
    return e.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("ord"), F.col("event_id").alias("id"), "ts",
                    kind.alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("call_id"), "value")


TOOL_STREAM = """ev AS (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id AS ord, event_id AS id, ts,
    CASE event_type WHEN 'click' THEN 'tool_call' WHEN 'view' THEN 'tool_result' WHEN 'purchase' THEN 'agent_message' WHEN 'signup' THEN 'session_end' ELSE 'session_terminated' END AS kind,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS call_id, value
  FROM events)"""


def with_for_id(entries: DataFrame, session: list[str]) -> DataFrame:
    """Results whose call_id is a multiple of 5 name the latest call before them."""
    before = W.partitionBy(*session).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    last = F.max(F.when(F.col("kind") == "tool_call", F.col("id"))).over(before)
    return entries.withColumn("for_id", F.when((F.col("kind") == "tool_result") & (F.col("call_id") % 5 == 0), last))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as files of 20 sessions: file, line, type, conv_id, turn, role, text."""
    c = read(spark, sf_dir, "conversations").withColumn("file", F.expr("conv_id div 20"))
    line = F.row_number().over(W.partitionBy("file").orderBy("conv_id", "turn"))
    kind = F.when((F.col("turn") == 0) & (F.col("conv_id") % 20 != 0), "session").otherwise("entry")
    return c.withColumn("line", line).withColumn("type", kind)


MESSAGES = """msg AS (
  SELECT *, conv_id // 20 AS file, row_number() OVER (PARTITION BY conv_id // 20 ORDER BY conv_id, turn) AS line,
    CASE WHEN turn = 0 AND conv_id % 20 <> 0 THEN 'session' ELSE 'entry' END AS type
  FROM conversations)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as segments of a customer's session, with gaps, repeats and broken chains."""
    o = read(spark, sf_dir, "orders")
    nth = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    sha = lambda c: F.sha2(c.cast("string"), 256)
    o = o.withColumn("nth", nth).withColumn("before", F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    k = F.col("o_orderkey") % 7
    return o.select(
        F.col("o_custkey").alias("session_uid"), F.col("o_orderkey").alias("source"),
        (F.col("nth") + F.when(k == 1, 1).otherwise(0)).cast("long").alias("seq"),
        F.when(k != 2, sha(F.col("o_orderkey"))).alias("content_hash"),
        F.when(k == 3, None).when(k == 4, sha(F.col("o_orderkey"))).otherwise(sha(F.col("before"))).alias("prev_content_hash"),
        (k != 5).alias("has_prev"), F.when(k == 6, "other").otherwise("same").alias("agent"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("revision"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"))


SEGMENTS = """o1 AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, o_orderkey % 7 AS k FROM orders),
seg AS (
  SELECT o_custkey AS session_uid, o_orderkey AS source, CAST(nth + CASE WHEN k = 1 THEN 1 ELSE 0 END AS BIGINT) AS seq,
    CASE WHEN k <> 2 THEN sha256(CAST(o_orderkey AS VARCHAR)) END AS content_hash,
    CASE WHEN k = 3 THEN NULL WHEN k = 4 THEN sha256(CAST(o_orderkey AS VARCHAR)) ELSE sha256(CAST(before AS VARCHAR)) END AS prev_content_hash,
    k <> 5 AS has_prev, CASE WHEN k = 6 THEN 'other' ELSE 'same' END AS agent,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS revision, strftime(o_orderdate, '%Y-%m-%d') AS ts
  FROM o1)"""


def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as session files (file, line, raw), lineitems as their entries: the segments of a customer's session."""
    o = read(spark, sf_dir, "orders")
    name, seq = F.concat(F.lit("c"), "o_custkey"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    head = F.to_json(F.struct(
        F.lit("session").alias("type"), F.lit("0.1.0").alias("schema_version"), name.alias("id"), F.when(F.col("o_custkey") % 10 != 0, name).alias("session_uid"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"), F.struct(F.col("seq")).alias("segment")))
    heads = o.withColumn("seq", seq).select(F.col("o_orderkey").cast("string").alias("file"), F.lit(1).alias("line"), head.alias("raw"))
    killed = F.col("l_linenumber") == 3
    entry = F.to_json(F.struct(F.when(killed, "session_terminated").otherwise("user_message").alias("type"), F.concat(F.lit("p"), F.col("l_partkey") % 40).alias("id"),
                               F.when(killed, F.struct(F.lit("process_terminated").alias("reason"))).alias("payload")))
    line = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) + 1
    entries = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), line.alias("line"), entry.alias("raw"))
    return heads.unionByName(entries)
