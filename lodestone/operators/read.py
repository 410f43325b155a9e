"""Ranges of lines of each file, numbered and capped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.errors import UsageError, line_range, not_negative, positive
from lodestone.functions.text import lines_of, numbered

MAX_CHARS = 20_000
MARK = "\n... truncated ..."


def read(files: DataFrame, lines: tuple[int, int] | None = None, head: int | None = None, tail: int | None = None, around: str | None = None, context: int = 3, max_chars: int = MAX_CHARS, strict: bool = False) -> DataFrame:
    """(path, start, end, total, truncated, content, numbered_text) of files(path, content), one row each.

    At most one of lines, head, tail and around (the first line that holds a literal) selects. Files that the selection
    can't serve (start beyond the end, nothing found, null content) are left out, or fail the job if strict. Both texts are capped at
    max_chars on their own; truncated tells about the numbered one.
    """
    if sum(x is not None for x in (lines, head, tail, around)) > 1:
        raise UsageError("lines, head, tail and around exclude each other")
    not_negative(context, "context")
    positive(max_chars, "max_chars")
    at = files.select("path", lines_of("content").alias("all")).where(F.col("all").isNotNull()).withColumn("total", F.size("all"))
    total = F.col("total")
    start, end, ok = F.lit(1), total, F.lit(True)
    if lines is not None:
        a, b = line_range(lines, "lines")
        start, end, ok = F.lit(a), F.least(F.lit(b), total), F.lit(a) <= total
    elif head is not None:
        end = F.least(F.lit(positive(head, "head")), total)
    elif tail is not None:
        start = F.greatest(F.lit(1), total - positive(tail, "tail") + 1)
    elif around is not None:
        at = at.withColumn("hit", F.array_position(F.transform("all", lambda x: x.contains(around)), True).cast("int"))
        start, end, ok = F.greatest(F.lit(1), F.col("hit") - context), F.least(total, F.col("hit") + context), F.col("hit") > 0
    at = at.withColumn("start", start).withColumn("end", end)
    if strict:
        at = at.withColumn("total", F.when(ok, total).otherwise(F.raise_error(F.concat(F.lit("selection not in "), "path"))))
    else:
        at = at.where(ok)
    at = at.select("path", "start", "end", "total", F.slice("all", F.col("start"), F.greatest(F.col("end") - F.col("start") + 1, F.lit(0))).alias("some"))
    at = at.select("path", "start", "end", "total", F.array_join("some", "\n").alias("_c"), numbered(F.col("some"), F.col("start")).alias("_n"))
    cap = lambda c: F.when(F.length(c) > max_chars, F.concat(F.substring(c, 1, max_chars), F.lit(MARK))).otherwise(F.col(c))
    return at.select("path", "start", "end", "total", (F.length("_n") > max_chars).alias("truncated"), cap("_c").alias("content"), cap("_n").alias("numbered_text"))
