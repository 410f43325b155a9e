"""Lines that hold a literal or match a pattern, with the lines around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import not_negative, positive
from lodestone.functions.patterns import checked_pattern
from lodestone.functions.text import lines_of, walk_key, within


def matcher(query: str, regex: bool = False, case_sensitive: bool = False) -> object:
    """A condition on a line. Patterns are unanchored."""
    if regex:
        pattern = checked_pattern(query, not case_sensitive)
        return lambda line: line.rlike(pattern)
    return (lambda line: line.contains(query)) if case_sensitive else (lambda line: F.lower(line).contains(query.lower()))


def grep(files: DataFrame, query: str, path: str | None = None, context: int = 0, limit: int | None = 50, regex: bool = False, case_sensitive: bool = False, folder: bool = True) -> DataFrame:
    """(path, line, text, context_before, context_after) of files(path, content), the first `limit` in walk order.

    Files of null content are skipped. Only matching lines leave their file, context comes by slicing the file's own lines, and the limit is a top-k: there is no shuffle
    of lines. limit None gives all.
    """
    not_negative(context, "context")
    if limit is not None:
        positive(limit, "limit")
    hit = matcher(query, regex, case_sensitive)
    scoped = files.select("path", "content").where(F.col("content").isNotNull())
    if path is not None:
        scoped = scoped.where(within("path", path, folder))
    if not regex and query:  # most files are out before they are split
        scoped = scoped.where(hit(F.col("content"))) if "\n" not in query and "\r" not in query else scoped
    lined = scoped.select("path", lines_of("content").alias("lines"))
    found = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda s: hit(s["text"]))
    rows = lined.select("path", "lines", F.explode(found).alias("m"))

    def around(first: Column, count: Column) -> Column:
        return F.transform(F.slice("lines", first, count), lambda x, i: F.struct((first + i).alias("line"), x.alias("text")))

    line = F.col("m.line")
    before = around(F.greatest(line - context, F.lit(1)), F.least(line - 1, F.lit(context)))
    after = around(line + 1, F.least(F.size("lines") - line, F.lit(context)))
    out = rows.select("path", line.alias("line"), F.col("m.text").alias("text"), before.alias("context_before"), after.alias("context_after"))
    return out if limit is None else out.orderBy(walk_key("path"), "line").limit(limit)
