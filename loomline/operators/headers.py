"""Session headers from the source records of a dialect, one for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import scalars as S
from loomline.operators.tools import text_at

# Record types of a transcript that make entries.
TRACER_TYPES = ("user", "assistant", "summary", "system", "progress", "queue-operation", "pr-link", "permission-mode")


def _v(*paths: str) -> Column:
    return text_at(F.col("v"), *paths)


def _first(value: Column, where: Column) -> Column:
    return F.min_by(F.when(where, value), F.when(where, F.col("record_idx")))


def tracer() -> Column:
    """Whether a transcript's record counts: of a known type, neither of a side chain nor hidden."""
    flag = lambda p: F.coalesce(F.try_variant_get("v", p, "boolean"), F.lit(False))
    return F.coalesce(F.try_variant_get("v", "$.type", "string").isin(*TRACER_TYPES), F.lit(False)) & ~flag("$.isSidechain") & ~flag("$.isMeta")


def session_headers(records: DataFrame, dialect: str) -> DataFrame:
    """(file, id, session_uid, ts, agent, version, cwd, status) of records(file, record_idx, v); dialect: codex, pi or claude-code.

    status is ok, or what the file lacks: no_header, missing_id or missing_timestamp.
    Aggregates combine before the shuffle; a file's records are not gathered.
    """
    kind = F.try_variant_get("v", "$.type", "string")
    if dialect == "claude-code":
        timed, named = tracer() & _v("$.timestamp").isNotNull(), tracer() & _v("$.sessionId").isNotNull()
        first = F.struct(_v("$.timestamp").alias("ts"), _v("$.version").alias("version"), _v("$.cwd").alias("cwd"))
        h = records.groupBy("file").agg(_first(first, timed).alias("h"), _first(F.struct(_v("$.sessionId").alias("id"), _v("$.version").alias("version")), named).alias("s"), F.bool_or(tracer()).alias("some"))
        h = h.select("file", "some", F.col("s.id").alias("id"), F.col("h.ts").alias("ts"), F.coalesce("h.version", "s.version").alias("version"), F.col("h.cwd").alias("cwd"))
    elif dialect == "codex":
        first = F.struct((kind == "session_meta").alias("some"), _v("$.payload.id").alias("id"), F.coalesce(_v("$.payload.timestamp"), _v("$.timestamp")).alias("ts"), _v("$.payload.cli_version").alias("version"), _v("$.payload.cwd").alias("cwd"))
        h = records.groupBy("file").agg(F.min_by(first, "record_idx").alias("h")).select("file", "h.*")
    elif dialect == "pi":
        number = F.try_variant_get("v", "$.version", "string")
        first = F.struct(F.lit(True).alias("some"), _v("$.id").alias("id"), _v("$.timestamp").alias("ts"), number.alias("version"), _v("$.cwd").alias("cwd"))
        h = records.groupBy("file").agg(_first(first, kind == "session").alias("h")).select("file", "h.*")
    else:
        raise ValueError(f"no dialect: {dialect}")
    status = F.when(~F.coalesce("some", F.lit(False)), "no_header").when(F.col("id").isNull(), "missing_id").when(F.col("ts").isNull(), "missing_timestamp").otherwise("ok")
    agent = "codex-cli" if dialect == "codex" else dialect
    return h.select("file", "id", S.uuid5(S.NAMESPACES[f"{dialect}/session"], "id").alias("session_uid"), "ts", F.lit(agent).alias("agent"), "version", "cwd", status.alias("status"))


def session_hints(records: DataFrame) -> DataFrame:
    """(file, title, agent_name, worktree, branch): what a transcript's first records of these kinds say; an overlay on live version control."""
    kind = F.try_variant_get("v", "$.type", "string")
    tree = F.struct(_v("$.worktreeSession.worktreeName").alias("name"), _v("$.worktreeSession.worktreePath").alias("path"), _v("$.worktreeSession.originalCwd").alias("original_cwd"),
                    _v("$.worktreeSession.originalBranch").alias("original_branch"), F.regexp_extract(_v("$.worktreeSession.originalHeadCommit"), "^[a-f0-9]{7,64}$", 0).alias("original_head_commit"))
    tree = F.struct(*[tree[c].alias(c) for c in ("name", "path", "original_cwd", "original_branch")], F.when(tree["original_head_commit"] != "", tree["original_head_commit"]).alias("original_head_commit"))
    whole = F.when(tree["name"].isNotNull() & tree["path"].isNotNull(), tree)
    return records.groupBy("file").agg(
        _first(_v("$.aiTitle"), kind == "ai-title").alias("title"), _first(_v("$.agentName"), kind == "agent-name").alias("agent_name"),
        _first(whole, kind == "worktree-state").alias("worktree"), _first(_v("$.worktreeSession.worktreeBranch"), kind == "worktree-state").alias("branch"))
