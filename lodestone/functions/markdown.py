"""What notes say about themselves: frontmatter, titles, aliases, tags and headings, as expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import let, stem, trim

#: Fixed patterns. A tag follows the text's start, white space or one of ( [ > {.
TAG = r"(^|[\s(\[>{])#([\p{L}\p{N}_/-]+)"
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*\z"


def all_lines(text: Column) -> Column:
    """Lines with what follows the last line end as one more."""
    return F.split(text, "\r?\n", -1)


def closing_line(lines: Column) -> Column:
    """The number of the line, after the first, that closes a block opened on the first; 0 if none."""
    return F.array_position(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: trim(x).isin("---", "...")), True).cast("int")


def frontmatter_split(content: Column) -> Column:
    """(yaml, body): the lines of a frontmatter block (LF between them), '' if there is none; and the body.

    A block opens with `---` and a line end at the very start and ends with a line that is `---` or `...` but for white space.
    The body after a block has LF line ends; without a block it is the whole content.
    """
    whole = F.struct(F.lit("").alias("yaml"), content.alias("body"))

    def cut(lines: Column, closer: Column) -> Column:
        yaml, body = F.slice(lines, 2, F.greatest(closer - 1, F.lit(0))), F.slice(lines, closer + 2, F.size(lines))
        return F.when(closer > 0, F.struct(F.array_join(yaml, "\n").alias("yaml"), F.array_join(body, "\n").alias("body"))).otherwise(whole)

    opened = content.startswith("---\n") | content.startswith("---\r\n")
    return F.when(opened, let(all_lines(content), lambda lines: let(closing_line(lines), lambda closer: cut(lines, closer)))).otherwise(whole)


def unquoted(c: Column) -> Column:
    """Trimmed, without a pair of equal quotes around it."""

    def bare(c: Column) -> Column:
        paired = (c.startswith('"') & c.endswith('"')) | (c.startswith("'") & c.endswith("'"))
        return F.when(paired, trim(F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0))))).otherwise(c)

    return let(trim(c), bare)


def tag_of(c: Column) -> Column:
    return trim(F.regexp_replace(unquoted(c), "^#+", ""))


def _some(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x != ""))


def _listed(yaml: Column, keys: str, item: object) -> Column:
    """Values of list keys: those of a block list below the key, else those of the line, with or without brackets."""
    pattern = rf"(?im)^(?:{keys}):[ \t]*(.*)((?:\n[ \t]+-[ \t]+.*)*)"
    inline, block = F.regexp_extract_all(yaml, F.lit(pattern), 1), F.regexp_extract_all(yaml, F.lit(pattern), 2)

    def split(raw: Column) -> Column:
        bare = F.when(raw.startswith("[") & raw.endswith("]"), F.substring(raw, F.lit(2), F.greatest(F.length(raw) - 2, F.lit(0)))).otherwise(raw)
        return F.filter(F.transform(F.split(bare, ","), unquoted), lambda x: x != "")

    def values(raw: Column, items: Column) -> Column:
        below = F.transform(F.filter(F.split(items, "\n"), lambda x: x != ""), lambda x: F.regexp_replace(x, r"^\s+-\s+", ""))
        return F.transform(F.when(items != "", below).otherwise(let(trim(raw), split)), item)

    found = _some(F.flatten(F.zip_with(inline, block, values)))
    return F.when(yaml == "", F.array().cast("array<string>")).otherwise(found)


def headings(body: Column) -> Column:
    """(level, text) of each heading line, those in code blocks too."""
    found = F.filter(all_lines(body), lambda x: x.rlike(HEADING))
    return F.transform(found, lambda x: F.struct(F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), trim(F.regexp_extract(x, HEADING, 2)).alias("text")))


def inline_tags(body: Column) -> Column:
    return _some(F.regexp_extract_all(body, F.lit(TAG), 2))


def file_title(path: Column) -> Column:
    return F.coalesce(F.nullif(trim(F.regexp_replace(stem(path), "[_-]+", " ")), F.lit("")), path)


def parse_notes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, title, aliases, tags, headings, body, content) of each note; rows of null content are dropped.

    title is the last one that frontmatter gives, else the first heading of level 1, else the file's name.
    """
    at = files.select(F.col(path).alias("path"), F.col(content).alias("content")).where(F.col("content").isNotNull())
    titles = F.filter(F.transform(F.regexp_extract_all("_yaml", F.lit(r"(?im)^title:[ \t]*(.*)"), 1), trim), lambda x: x != "")
    given = F.when(F.col("_yaml") == "", F.lit(None).cast("string")).otherwise(let(titles, lambda t: F.when(F.size(t) > 0, unquoted(F.element_at(t, -1)))))
    at = at.select("path", "content", let(frontmatter_split(F.col("content")), lambda d: d).alias("_parts")).select("path", "content", F.col("_parts.yaml").alias("_yaml"), F.col("_parts.body").alias("body"))
    tags = F.array_distinct(F.concat(_listed(F.col("_yaml"), "tags", tag_of), inline_tags(F.col("body"))))

    def named(heads: Column) -> Column:
        h1 = F.get(F.filter(heads, lambda x: x["level"] == 1), F.lit(0))["text"]
        title = F.coalesce(F.nullif(given, F.lit("")), F.nullif(h1, F.lit("")), file_title(F.col("path")))
        return F.struct(title.alias("title"), F.transform(heads, lambda h: h["text"]).alias("headings"))

    at = at.select("path", let(headings(F.col("body")), named).alias("_named"), _listed(F.col("_yaml"), "aliases|alias", unquoted).alias("aliases"), tags.alias("tags"), "body", "content")
    return at.select("path", F.col("_named.title").alias("title"), "aliases", "tags", F.col("_named.headings").alias("headings"), "body", "content")
