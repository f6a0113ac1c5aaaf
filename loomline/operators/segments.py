"""Sessions in several segments: order, chain, and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Header fields that all segments of a session share.
STABLE_FIELDS = ("id", "type", "schema_version", "session_uid")


def _ordered():
    return W.partitionBy("session_uid").orderBy("seq", "source")


def seq_warnings(segments: DataFrame) -> DataFrame:
    """Gaps and repeats of seq(session_uid, seq, source); a null seq counts as 1."""
    s = segments.withColumn("seq", F.coalesce("seq", F.lit(1)))
    before = F.max("seq").over(_ordered().rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("expected", F.greatest(F.lit(1), F.coalesce(before + 1, F.lit(1))))
    code = F.when(F.col("seq") > F.col("expected"), "segment_seq_gap").when(F.col("seq") < F.col("expected"), "segment_seq_duplicate")
    return s.withColumn("code", code).filter("code is not null").select("session_uid", "source", "seq", "expected", "code")


def chain_warnings(segments: DataFrame) -> DataFrame:
    """Where a segment's prev_content_hash does not continue the one before.

    segments: session_uid, seq, source, content_hash, prev_content_hash, has_prev (the
    field is present, null or not). A null claim, and a claim after a segment without a
    hash, cannot be verified; an absent claim says nothing.
    """
    s = segments.withColumn("seq", F.coalesce("seq", F.lit(1)))
    s = s.withColumn("nth", F.row_number().over(_ordered())).withColumn("before", F.lag("content_hash").over(_ordered()))
    claim = F.col("prev_content_hash")
    code = F.when(~F.col("has_prev"), None).when(claim.isNull() | F.col("before").isNull(), "segment_chain_unverifiable").when(claim != F.col("before"), "segment_chain_mismatch")
    return s.withColumn("code", code).filter("nth > 1 and code is not null").select("session_uid", "source", "seq", "code")


def stable_field_warnings(headers: DataFrame, fields: tuple[str, ...] = STABLE_FIELDS) -> DataFrame:
    """(session_uid, source, field): header fields that differ from the first segment's, both being present."""
    every = _ordered().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = headers
    for f in fields:
        out = out.withColumn(f"_{f}", F.first(f).over(every))
    bad = F.filter(F.array(*[F.when(F.col(f) != F.col(f"_{f}"), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return out.select("session_uid", "source", F.explode(bad).alias("field"))


def with_last(segments: DataFrame, session: str = "session_uid") -> DataFrame:
    """`segments(<session>, seq, source, ..)` with is_last: no segment of the session comes after it, whether it has events or not."""
    return segments.withColumn("is_last", F.struct("seq", "source") == F.max(F.struct("seq", "source")).over(W.partitionBy(session)))


#: Events that a merge drops before it looks at ids: markers of a killed process that was followed by a further segment.
OVERTAKEN = "not is_last and coalesce(type, '') = 'session_terminated' and coalesce(reason, '') = 'process_terminated'"


def merge_events(events: DataFrame) -> DataFrame:
    """The events that a merge keeps, with `ord`, their place in the merged session.

    events: session_uid, seq, source, line, id, type, reason, and is_last of their segment
    (`with_last`; events alone can't tell, for the last segment may be empty; without the
    column there are no segments but theirs). process_terminated markers stay in the last
    segment only. Of events with one id the first stays; a null id never repeats.
    """
    e = (events if "is_last" in events.columns else with_last(events)).filter(f"not ({OVERTAKEN})")
    place = ["seq", "source", "line"]
    e = e.withColumn("nth", F.when(F.col("id").isNull(), 1).otherwise(F.row_number().over(W.partitionBy("session_uid", "id").orderBy(*place)))).filter("nth = 1").drop("nth", "is_last")
    return e.withColumn("ord", F.row_number().over(W.partitionBy("session_uid").orderBy(*place)))


def merged_headers(headers: DataFrame, first: list[str], last: list[str]) -> DataFrame:
    """One header for each session: some fields from its first segment, others from its last non-null one."""
    place = F.struct("seq", "source")
    return headers.groupBy("session_uid").agg(
        F.count("*").alias("segments"),
        *[F.min_by(c, place).alias(c) for c in first],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in last])
