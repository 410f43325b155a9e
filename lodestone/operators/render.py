"""Results as text for people or as JSON, one cell for each row, so that large results are rendered where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import UsageError


def checked_format(form: str | None) -> str:
    form = form or "text"
    if form not in ("text", "json"):
        raise UsageError("format must be text or json")
    return form


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _json(command: str, *columns: Column | str) -> Column:
    return F.to_json(F.struct(F.lit(True).alias("ok"), F.lit(command).alias("command"), *columns))


def render_read(rows: DataFrame, form: str | None = None) -> DataFrame:
    """(path, rendered) of what `read` returns."""
    if checked_format(form) == "json":
        span = F.struct("start", "end", "total").alias("range")
        return rows.select("path", _json("read", "path", span, "truncated", "content").alias("rendered"))
    head = F.concat(F.lit("path: "), "path", F.lit("\nlines: "), _s("start"), F.lit("-"), _s("end"), F.lit("/"), _s("total"), F.lit("\ntruncated: "), _s("truncated"))
    return rows.select("path", F.concat(head, F.lit("\n\n"), "numbered_text", F.lit("\n")).alias("rendered"))


def render_grep(rows: DataFrame, form: str | None = None) -> DataFrame:
    """(path, line, rendered) of what `grep` returns: a match with its context, `path:line` then `-`, `:` or `+`."""
    if checked_format(form) == "json":
        return rows.select("path", "line", F.to_json(F.struct("path", "line", "text", F.col("context_before").alias("contextBefore"), F.col("context_after").alias("contextAfter"))).alias("rendered"))
    near = lambda c, mark: F.transform(c, lambda s: F.concat(F.col("path"), F.lit(":"), s["line"].cast("string"), F.lit(f"{mark} | "), s["text"]))
    own = F.array(F.concat(F.col("path"), F.lit(":"), _s("line"), F.lit(": | "), F.col("text")))
    return rows.select("path", "line", F.array_join(F.concat(near("context_before", "-"), own, near("context_after", "+")), "\n").alias("rendered"))


def render_search(rows: DataFrame, form: str | None = None) -> DataFrame:
    """(position, rendered) of what `search` returns with explain=True."""
    if checked_format(form) == "json":
        return rows.select("position", F.to_json(F.struct("path", "title", "tags", "snippets")).alias("rendered"))
    some = lambda c, cells: F.when(F.size(c) > 0, cells).otherwise(F.array().cast("array<string>"))
    tags = some("tags", F.array(F.concat(F.lit("tags: "), F.array_join("tags", ", "))))
    snippets = some("snippets", F.concat(F.array(F.lit("snippets:")), F.transform("snippets", lambda s: F.concat(F.lit("  "), s["line"].cast("string"), F.lit(" | "), s["text"]))))
    head = F.array(F.concat(_s("position"), F.lit(". "), F.col("path")), F.concat(F.lit("title: "), F.col("title")))
    return rows.select("position", F.concat(F.array_join(F.concat(head, tags, snippets), "\n"), F.lit("\n")).alias("rendered"))


def render_changes(changes: DataFrame, form: str | None = None, dry: bool = True) -> DataFrame:
    """(path, rendered) of a change set: code and path, then the diff in a dry run; the reason where there is one."""
    if checked_format(form) == "json":
        shown = [c for c in ("code", "path", "from_path", "before", "after", "diff", "error") if c in changes.columns]
        return changes.select("path", F.to_json(F.struct(F.lit(dry).alias("dryRun"), *shown)).alias("rendered"))
    diff = F.when(F.col("diff") != "", F.concat(F.lit("\n"), "diff")).otherwise(F.lit("")) if dry and "diff" in changes.columns else F.lit("")
    return changes.select("path", F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).otherwise(F.concat("code", F.lit(" "), "path", F.coalesce(diff, F.lit("")))).alias("rendered"))


def render_index(ready: bool, action: str = "status") -> str:
    if action == "status":
        return "Index ready.\n" if ready else "Index missing.\n"
    return "Index rebuilt.\n" if action == "rebuild" else "Index cleared.\n"
