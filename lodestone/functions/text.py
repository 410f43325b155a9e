"""Lines, normalised identities, paths and diffs, as expressions that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, as regular expressions of Java and RE2 both have it, and the same one by one.
SPACE = r"[\s\p{Z}\x{FEFF}]"
SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(_col(c), F.lit(SPACES))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which the value is worked out once however often it is named. The optimizer copies named columns into the expressions that use them, but not what a lambda is given."""
    return F.transform(F.array(value), use)[0]


def lines_of(text: Column | str) -> Column:
    """An array of lines; LF and CRLF end lines, an empty text has none, and an end of line at the end opens no further one."""
    text = _col(text)
    parts = F.split(text, "\r?\n", -1)
    some = let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(some)


def eol_of(text: Column | str) -> Column:
    """CRLF if the text has any, else LF."""
    return F.when(_col(text).contains("\r\n"), F.lit("\r\n")).otherwise(F.lit("\n"))


def join_lines(lines: Column, like: Column | str) -> Column:
    """Lines as one text, with the line ends of the text `like`, and one at the end if that has one."""
    eol = eol_of(like)
    return F.concat(_join(lines, eol), F.when(_col(like).endswith("\n"), eol).otherwise(F.lit("")))


def _join(lines: Column, eol: Column) -> Column:
    return F.when(eol == "\r\n", F.array_join(lines, "\r\n")).otherwise(F.array_join(lines, "\n"))


def numbered(lines: Column, start: Column | int) -> Column:
    """`12 | text` for each line, numbers padded to the last one's width, joined by LF."""
    first = (F.lit(start) if isinstance(start, int) else start).cast("int")
    width = F.length(F.greatest(first + F.size(lines) - 1, F.lit(1)).cast("string"))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((first + i).cast("string"), width, " "), F.lit(" | "), x)), "\n")


def identity(c: Column | str) -> Column:
    """Lower case without quotes; #, runs of . _ / \\ - and of white space are one space; trimmed."""
    bare = F.regexp_replace(F.lower(_col(c)), "[\"']", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[#]|[._/\\-]+", " "), rf"{SPACE}+", " "))


def identity_of(value: str) -> str:
    """The same for a parameter."""
    import re

    bare = re.sub(r"[\"']", "", value.lower())
    return re.sub(r"[\s﻿]+", " ", re.sub(r"#|[._/\\-]+", " ", bare)).strip(" ")


def stem(path: Column | str) -> Column:
    """A path's last part without its extension; a dot in front begins none."""
    return F.regexp_extract(_col(path), r"(?s)^(?:.*/)?(.+?)(\.[^.]*)?\z", 1)


def folders(path: Column | str) -> Column:
    """A path's parts before the last."""
    parts = F.filter(F.split(_col(path), r"[\\/]+"), lambda x: (x != "") & (x != "."))
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def walk_key(path: Column | str) -> Column:
    """Sorts like a walk through folders in which names follow each other by the rules of language: the path's parts, collated."""
    return F.transform(F.split(_col(path), "/"), lambda x: F.collate(x, "UNICODE"))


def within(path: Column | str, scope: str, folder: bool = True) -> Column:
    """Whether a path is `scope` or, if that is a folder, below it; '' and '.' are the root."""
    path, scope = _col(path), scope.strip("/")
    if scope in ("", "."):
        return F.lit(True)
    return (path == scope) | path.startswith(f"{scope}/") if folder else path == scope


def occurrences(text: Column | str, needle: str) -> Column:
    """How often a literal occurs without overlap."""
    text = _col(text)
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("long")


def diff(label: Column | str, before: Column | str, after: Column | str, context: int = 3) -> Column:
    """One hunk under `---`, `+++` and `@@` lines: what differs between the common first and last lines, with context; '' for equal texts.

    Where the new lines are more than the old ones, as many more lines of context follow.
    """
    before, after = _col(before), _col(after)

    def common(x: Column, y: Column) -> Column:
        same = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return let(same, lambda at: F.when(at == 0, F.least(F.size(x), F.size(y))).otherwise(at - 1).cast("int"))

    def hunk(x: Column, y: Column, head: Column, tail: Column) -> Column:
        n, m = F.size(x) - tail, F.size(y) - tail  # where the differing lines end
        start = F.greatest(F.lit(0), head - context)
        said = F.concat(
            F.array(F.concat(F.lit("--- "), _col(label)), F.concat(F.lit("+++ "), _col(label)), F.lit("@@")),
            F.transform(F.slice(x, start + 1, head - start), lambda s: F.concat(F.lit(" "), s)),
            F.transform(F.slice(x, head + 1, n - head), lambda s: F.concat(F.lit("-"), s)),
            F.transform(F.slice(y, head + 1, m - head), lambda s: F.concat(F.lit("+"), s)),
            F.transform(F.slice(x, n + 1, F.least(tail, F.least(F.lit(context), tail) + F.greatest(F.lit(0), m - n))), lambda s: F.concat(F.lit(" "), s)),
        )
        return F.array_join(said, "\n")

    def tails(d: Column, head: Column) -> Column:
        x, y = d["a"], d["b"]
        back = F.least(common(F.reverse(x), F.reverse(y)), F.size(x) - head, F.size(y) - head)
        return let(back, lambda tail: hunk(x, y, head, tail))

    both = F.struct(lines_of(before).alias("a"), lines_of(after).alias("b"))
    return F.when(before == after, F.lit("")).otherwise(let(both, lambda d: let(common(d["a"], d["b"]), lambda head: tails(d, head))))
