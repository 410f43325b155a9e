"""Edits of whole texts as change sets: (code, path, before, after, diff, error). A change set is the dry run; writing it is the sink's.

A row that an edit can't serve has its reason in `error` and no `after`; `strict` turns the first into a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import SAID, UsageError, line_range, positive
from lodestone.functions.patterns import checked_pattern
from lodestone.functions.text import diff, join_lines, lines_of, occurrences


def changes(files: DataFrame, after: Column, error: Column | None = None, strict: bool = False, code: str = "M") -> DataFrame:
    """A change set from files(path, content), a new content, and a reason (null: none) against it. No change is a reason too."""
    error = F.lit(None).cast("string") if error is None else error
    at = files.select("path", F.col("content").alias("before"), error.alias("error"), after.alias("_after"))
    at = at.withColumn("error", F.coalesce("error", F.when(F.col("before").isNull(), SAID["not readable"]), F.when(F.col("_after").eqNullSafe(F.col("before")), SAID["no changes"])))
    if strict:
        at = at.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "error"))).cast("string"))
    at = at.withColumn("after", F.when(F.col("error").isNull(), F.col("_after")))
    return at.select(F.lit(code).alias("code"), "path", "before", "after", F.when(F.col("after").isNotNull(), diff("path", "before", "after")).alias("diff"), "error")


def _cardinality(n: Column, every: bool, what: str, missing: str) -> Column:
    many = F.lit(None).cast("string") if every else F.when(n > 1, F.concat(F.lit(SAID["matched"].format(what)), n.cast("string"), F.lit(SAID["times"])))
    return F.when(n == 0, F.lit(missing)).otherwise(many)


def replace(files: DataFrame, needle: str, replacement: str, every: bool = False, strict: bool = False) -> DataFrame:
    """A literal, once, or all of them; the replacement is literal too."""
    if not needle:
        raise UsageError("an empty text can't be replaced")
    return changes(files, F.replace(F.col("content"), F.lit(needle), F.lit(replacement)), _cardinality(occurrences("content", needle), every, "replace text", SAID["not found"]), strict)


def replace_first(files: DataFrame, needle: str, replacement: str) -> DataFrame:
    """The first of any number of occurrences."""
    c, at = F.col("content"), F.instr(F.col("content"), needle)
    text = F.concat(F.substring(c, F.lit(1), at - 1), F.lit(replacement), F.substring(c, at + len(needle), F.length(c)))
    return changes(files, F.when(at > 0, text).otherwise(c), F.when(at == 0, SAID["not found"]))


def replace_regex(files: DataFrame, pattern: str, replacement: str, every: bool = False, strict: bool = False) -> DataFrame:
    """Matches of a pattern whose ^ and $ are the whole text's ends; the replacement is literal."""
    literal, own = replacement.replace("\\", "\\\\").replace("$", "\\$"), checked_pattern(pattern)
    return changes(files, F.regexp_replace("content", own, literal), _cardinality(F.regexp_count("content", F.lit(own)).cast("long"), every, "regex", SAID["no match"]), strict)


def replace_line(files: DataFrame, line: int, replacement: str, strict: bool = False) -> DataFrame:
    """One line, verbatim. Line ends become those that the text mostly has: CRLF if any."""
    positive(line, "line")
    lines = lines_of("content")
    text = join_lines(F.transform(lines, lambda x, i: F.when(i == line - 1, F.lit(replacement)).otherwise(x)), "content")
    return changes(files, text, F.when(F.size(lines) < line, F.concat(F.lit(SAID["line"].format(line)), F.size(lines).cast("string"), F.lit(")"))), strict)


def replace_range(files: DataFrame, start: int, end: int, replacement: str, strict: bool = False) -> DataFrame:
    """A range of lines by the replacement's own lines."""
    line_range((start, end), "range")
    lines, new = lines_of("content"), lines_of(F.lit(replacement))
    text = join_lines(F.concat(F.slice(lines, 1, start - 1), new, F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))), "content")
    return changes(files, text, F.when(F.size(lines) < end, F.concat(F.lit(SAID["range"].format(end)), F.size(lines).cast("string"), F.lit(")"))), strict)


def write(files: DataFrame, wanted: DataFrame, overwrite: bool = False, strict: bool = False) -> DataFrame:
    """wanted (path, content) against existing files(path, content): A for new paths, M for others, which need overwrite."""
    joined = wanted.select("path", F.col("content").alias("after")).join(files.select("path", F.col("content").alias("before"), F.lit(True).alias("there")), "path", "left")
    error = F.lit(None).cast("string") if overwrite else F.when(F.col("there"), F.concat(F.lit(SAID["file"]), "path"))
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error)).cast("string")
    at = joined.select(F.when(F.col("there"), "M").otherwise("A").alias("code"), "path", F.coalesce("before", F.lit("")).alias("before"), F.when(error.isNull(), F.col("after")).alias("after"), error.alias("error"))
    return at.select("code", "path", "before", "after", F.when(F.col("after").isNotNull(), diff("path", "before", "after")).alias("diff"), "error")


def copy(files: DataFrame, source: str, to: str, recursive: bool = False, overwrite: bool = False) -> DataFrame:
    """(code, path, from_path, after, error): a file, or what is below a folder, under another path."""
    source, to = source.strip("/"), to.strip("/")
    if recursive and (to == source or to.startswith(f"{source}/")):
        raise UsageError("a folder can't be copied into itself")
    own = F.col("path") == source
    chosen = files.where(own | F.col("path").startswith(f"{source}/")) if recursive else files.where(own)
    moved = chosen.select(F.concat(F.lit(to), F.substring("path", F.lit(len(source) + 1), F.length("path"))).alias("path"), F.col("path").alias("from_path"), F.col("content").alias("after"))
    there = files.select("path", F.lit(True).alias("there"))
    at = moved.join(there, "path", "left")
    error = F.lit(None).cast("string") if overwrite else F.when(F.col("there"), F.concat(F.lit(SAID["path"]), "path"))
    return at.select(F.when(F.col("there"), "M").otherwise("A").alias("code"), "path", "from_path", F.when(error.isNull(), F.col("after")).alias("after"), error.alias("error"))
