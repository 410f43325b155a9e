"""Patterns as callers write them, and as Java's engine runs them."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession

from lodestone.errors import UsageError


def java(pattern: str) -> str:
    """$ is the text's very end, not the place before a last line end, and brackets and && within a class are themselves; escapes and all else stay."""
    out, at, inside, n = [], 0, False, len(pattern)
    while at < n:
        c = pattern[at]
        if c == "\\" and at + 1 < n:
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if inside:
            inside = c != "]"
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            inside = True
            out.append(c)
            if pattern[at + 1 : at + 2] == "^":
                out.append("^")
                at += 1
        else:
            out.append("\\z" if c == "$" else c)
        at += 1
    return "".join(out)


def checked_pattern(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for Java, which has to accept it; letters of any script fold where case is ignored."""
    own = ("(?iu)" if ignore_case else "") + java(pattern)
    spark = SparkSession.active()
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(own)
    except IllegalArgumentException as error:
        raise UsageError(f"pattern {pattern!r}: {error}") from None
    return own
