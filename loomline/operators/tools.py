"""Tool calls of the dialects in one vocabulary: a table of kinds for each dialect.

A call takes the first kind of its table that has its name and finds what it needs;
every other call is of kind "other" and keeps its name and arguments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions import scalars as S


@dataclass(frozen=True)
class Tool:
    names: tuple[str, ...]
    kind: str
    args: dict[str, Column]  # null arguments are absent
    needs: Column


def text_at(value: Column, *paths: str) -> Column:
    """The first of the paths that holds a string; numbers and objects are no strings."""
    at = lambda p: F.try_variant_get(value, p, "variant")
    return F.coalesce(*[F.when(F.schema_of_variant(at(p)) == "STRING", F.try_variant_get(value, p, "string")) for p in paths])


def _object(value: Column) -> Column:
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def mapped(name: Column, args: Column, table: list[Tool]) -> Column:
    """JSON text {tool, args} of a call with this name and these arguments (a variant)."""
    out = F.to_json(F.struct(F.lit("other").alias("tool"), F.struct(F.coalesce(name, F.lit("unknown")).alias("name"), _object(args).alias("args")).alias("args")))
    for t in reversed(table):
        hit = F.coalesce(name.isin(*t.names) & t.needs, F.lit(False))
        out = F.when(hit, F.to_json(F.struct(F.lit(t.kind).alias("tool"), F.struct(*[c.alias(k) for k, c in t.args.items()]).alias("args")))).otherwise(out)
    return out


def kind_of(payload: Column) -> Column:
    return F.get_json_object(payload, "$.tool")


def _command(args: Column, *paths: str, whole: bool) -> Column:
    """A command as text, or its argument array quoted; `whole`: an array with anything but strings is none."""
    argv = F.try_variant_get(args, "$.command", "array<variant>")
    words = F.filter(F.transform(argv, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda x: x.isNotNull())
    good = (F.size(words) > 0) & ((F.size(words) == F.size(argv)) | F.lit(not whole))
    return F.coalesce(text_at(args, *paths), F.when(good, F.array_join(F.transform(words, S.shell_quote), " ")))


def _lines(text: Column, sign: str) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit(sign), x)))


def hunks_diff(path: Column, hunks: Column) -> Column:
    """A unified diff of hunks(old, new) that have line counts but no places."""
    one = lambda h: F.concat(
        F.array(F.concat(F.lit("@@ -1,"), F.size(_lines(h["old"], "-")), F.lit(" +1,"), F.size(_lines(h["new"], "+")), F.lit(" @@"))), _lines(h["old"], "-"), _lines(h["new"], "+"))
    return F.array_join(F.concat(F.array(F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path)), F.flatten(F.transform(hunks, one))), "\n")


def codex_tools(args: Column) -> list[Tool]:
    command, path = _command(args, "$.cmd", "$.command", whole=True), text_at(args, "$.path")
    return [
        Tool(("exec_command", "shell", "container.exec"), "shell_command", {"command": command, "cwd": text_at(args, "$.workdir", "$.cwd")}, command.isNotNull()),
        Tool(("read",), "file_read", {"path": path}, path.isNotNull()),
    ]


def claude_tools(args: Column) -> list[Tool]:
    at = lambda *p: text_at(args, *[f"$.{x}" for x in p])
    path, content, old, new = at("file_path", "path"), at("content"), at("old_string"), at("new_string")
    none = F.lit("")
    diff = F.concat_ws("\n", F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path), F.lit("@@"), F.concat(F.lit("-"), F.coalesce(old, none)), F.concat(F.lit("+"), F.coalesce(new, none)))
    book, query, task = at("notebook_path", "file_path", "path"), at("pattern", "query"), at("prompt", "description", "name")
    todos = F.transform(F.try_variant_get(args, "$.todos", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x)))
    return [
        Tool(("Bash",), "shell_command", {"command": at("command"), "cwd": at("cwd"), "timeout": F.try_variant_get(args, "$.timeout", "long")}, at("command").isNotNull()),
        Tool(("Read",), "file_read", {"path": path}, path.isNotNull()),
        Tool(("Write",), "file_write", {"path": path, "content": content}, path.isNotNull() & content.isNotNull()),
        Tool(("Edit",), "file_edit", {"path": path, "diff": diff}, path.isNotNull() & (old.isNotNull() | new.isNotNull())),
        Tool(("NotebookEdit",), "notebook_edit", {"path": book, "cell_id": at("cell_id"), "content": at("new_source")}, book.isNotNull()),
        Tool(("Grep",), "file_search", {"query": query, "path": at("path"), "glob": at("glob")}, query.isNotNull()),
        Tool(("Glob",), "file_search", {"query": at("pattern"), "glob": at("pattern")}, at("pattern").isNotNull()),
        Tool(("WebFetch",), "web_fetch", {"url": at("url")}, at("url").isNotNull()),
        Tool(("WebSearch",), "web_search", {"query": at("query")}, at("query").isNotNull()),
        Tool(("TodoWrite",), "task_plan", {"items": todos}, F.lit(True)),
        Tool(("Task",), "subagent_invoke", {"task": task, "agent_type": at("subagent_type"), "session_id": at("session_id")}, task.isNotNull()),
    ]


def pi_tools(args: Column) -> list[Tool]:
    at = lambda *p: text_at(args, *[f"$.{x}" for x in p])
    path, content, command = at("path", "file_path"), at("content"), _command(args, "$.command", "$.cmd", whole=False)
    none = F.lit("")

    def hunk(v: Column, top: Column) -> Column:
        old, new = text_at(v, "$.oldText", "$.old_text"), text_at(v, "$.newText", "$.new_text")
        some = old.isNotNull() | new.isNotNull()
        return F.struct(F.coalesce(text_at(v, "$.path"), top).alias("path"), F.when(some, F.coalesce(old, none)).alias("old"), F.when(some, F.coalesce(new, none)).alias("new"))

    changed = lambda hunks: F.filter(hunks, lambda h: h["old"].isNotNull())
    listed = F.try_variant_get(args, "$.edits", "array<variant>")
    multi = F.try_variant_get(args, "$.multi", "array<variant>")
    edits = changed(F.transform(listed, lambda v: hunk(v, path)))
    several = F.transform(multi, lambda v: hunk(v, path))
    apart = changed(several)
    one_file = F.forall(several, lambda h: h["path"].isNotNull()) & (F.size(F.array_distinct(F.transform(apart, lambda h: h["path"]))) == 1)
    old, new = at("oldText", "oldString"), at("newText", "newString")
    single = F.array(F.struct(path.alias("path"), F.coalesce(old, none).alias("old"), F.coalesce(new, none).alias("new")))
    by_list = listed.isNotNull() & path.isNotNull()
    by_multi = ~by_list & F.coalesce(F.size(multi) > 0, F.lit(False))
    listing = F.concat(F.lit("ls"), F.when(at("path").isNull(), none).otherwise(F.concat(F.lit(" -- "), S.shell_quote(at("path")))))
    return [
        Tool(("read",), "file_read", {"path": path}, path.isNotNull()),
        Tool(("write",), "file_write", {"path": path, "content": content}, path.isNotNull() & content.isNotNull()),
        Tool(("edit",), "file_edit", {"path": path, "diff": hunks_diff(path, edits)}, by_list & (F.size(edits) > 0)),
        Tool(("edit",), "file_edit", {"path": apart[0]["path"], "diff": hunks_diff(apart[0]["path"], apart)}, by_multi & one_file),
        Tool(("edit",), "file_edit", {"path": path, "diff": hunks_diff(path, single)}, ~by_list & ~by_multi & path.isNotNull() & (old.isNotNull() | new.isNotNull())),
        Tool(("bash",), "shell_command", {"command": command, "cwd": at("cwd"), "timeout": F.try_variant_get(args, "$.timeout", "long")}, command.isNotNull()),
        Tool(("grep",), "file_search", {"query": at("pattern"), "path": at("path"), "glob": at("glob")}, at("pattern").isNotNull()),
        Tool(("find",), "file_search", {"query": at("pattern"), "path": at("path")}, at("pattern").isNotNull()),
        Tool(("ls",), "shell_command", {"command": listing}, F.lit(True)),
    ]
