"""Listing of stored sessions: bounds, filters, order, lookups by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.sources.jsonl import placed


def bounded(df: DataFrame, ts: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows with since <= ts < until; rows without a valid time leave once any bound is set."""
    at = F.try_to_timestamp(F.col(ts).cast("string"))
    for bound, keep in ((since, lambda b: at >= b), (until, lambda b: at < b)):
        if bound is not None:
            df = df.filter(keep(F.to_timestamp(F.lit(bound))))
    return df


def select_sessions(df: DataFrame, agent: str | None = None, cwd: str | None = None, kind: str | None = None, lenient_cwd: bool = False) -> DataFrame:
    """Exact filters; with lenient_cwd a session without a directory passes."""
    for name, value in (("agent", agent), ("cwd", cwd), ("kind", kind)):
        if value is not None:
            same = F.col(name) == value
            df = df.filter(same | F.col(name).isNull() if name == "cwd" and lenient_cwd else same)
    return df


def latest_first(df: DataFrame, ts: str, tie: str) -> DataFrame:
    """`df` with its `place`: newest first, without a time last, then by the tie column."""
    return placed(df, F.col(ts).desc_nulls_last(), F.col(tie).asc())


def by_prefix(df: DataFrame, hash_col: str, prefix: str) -> DataFrame:
    """The rows of a hash, or of the only hash that starts with a prefix of 8 hex digits or more."""
    if not (8 <= len(prefix) <= 64 and all(c in "0123456789abcdef" for c in prefix)):
        raise ValueError("a prefix has 8 to 64 lower-case hex digits")
    found = df.filter(F.col(hash_col).startswith(prefix))
    several = found.agg(F.min(hash_col).alias("a"), F.max(hash_col).alias("b")).first()
    if several["a"] != several["b"]:
        raise LookupError(f"more than one object starts with {prefix}")
    return found


def latest_index(entries: DataFrame) -> DataFrame:
    """Of an append-only index, the last row of each hash: entries(content_hash, registered_at, source_path, session_uid, kind)."""
    last = F.max(F.struct("registered_at", "source_path", "session_uid", "kind")).alias("x")
    valid = entries.filter(F.col("content_hash").rlike("^[a-f0-9]{64}$"))
    return valid.groupBy("content_hash").agg(last).select("content_hash", "x.registered_at", "x.source_path", "x.session_uid", F.coalesce("x.kind", F.lit("session")).alias("kind"))
