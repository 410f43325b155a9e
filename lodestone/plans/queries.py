"""Queries over the tables of a folder, each over all of its rows; limits only where they are the operator's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.markdown import headings, inline_tags, parse_notes
from lodestone.operators import edit, frontmatter, index
from lodestone.operators.grep import grep
from lodestone.operators.read import read
from lodestone.operators.render import render_changes, render_grep, render_read, render_search
from lodestone.operators.search import bm25, checked, features, has_tags, search
from lodestone.sources.folders import stored, work_dir
from lodestone.sources.notes import PATH, notes
from lodestone.sources.patches import apply_patch

Query = Callable[[SparkSession, str], DataFrame]

#: Parameters of the registered queries.
SEARCH = "alpha checklist en"
#: {n} is the path of the note of document n.
PATCH = """*** Begin Patch
*** Add File: added/note.md
+# New
+Text with $HOME and `code`
*** Update File: {0}
@@
+appended at the end
*** Update File: {1}
*** Move to: moved/one.md
@@
 ---
-title: "Note 1 of {source}"
+title: Moved
*** Delete File: {5}
*** Update File: {2}
@@
-no such line
+anything
*** Add File: added/never.md
+since the one before failed
*** End Patch"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files(path, content)."""
    return table(spark, sf_dir, "documents").selectExpr(f"{PATH} AS path", "text AS content")


def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(table(spark, sf_dir, "documents"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_notes(note_files(spark, sf_dir))


def docs_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed notes that a query reads several times, parsed once and written as a table."""
    return stored(docs(spark, sf_dir), "notes")


def joined(c: Column | str) -> Column:
    return F.array_join(c, "\n")


def numbered_lines(c: str) -> Column:
    """(line, text) cells as `line:text`, one to a line."""
    return joined(F.transform(c, lambda s: F.concat(s["line"].cast("string"), F.lit(":"), s["text"])))


def _read(**how: object) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = read(texts(spark, sf_dir), **how)
        return out.select("path", *[F.col(c).cast("long").alias(c) for c in ("start", "end", "total")], "truncated", "content", "numbered_text").withColumnsRenamed({"start": "first_line", "end": "last_line"})

    return run


def _grep(source: Callable[[SparkSession, str], DataFrame], query: str, **how: object) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = grep(source(spark, sf_dir), query, **how).select("path", F.col("line").cast("long").alias("line"), "text", numbered_lines("context_before").alias("context_before"), numbered_lines("context_after").alias("context_after"))
        return found if how.get("context") else found.drop("context_before", "context_after")

    return run


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("CAST(conv_id AS STRING) || '/' || CAST(turn AS STRING) AS path", "text AS content")


def _docs(column: Callable[[], Column]) -> Query:
    return lambda spark, sf_dir: docs(spark, sf_dir).select("path", column())


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = note_files(spark, sf_dir).select(F.explode(headings(F.col("content"))).alias("h"))
    return cells.groupBy(F.col("h.level").cast("long").alias("level")).agg(F.count("*").alias("n"), F.countDistinct("h.text").alias("texts"))


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return note_files(spark, sf_dir).select(F.explode(inline_tags(F.col("content"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def tag_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = checked(tags=["#PROJECT", "en"])
    return docs(spark, sf_dir).where(has_tags(F.col("tags"), q.tags)).select("path", "title")


def tag_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(docs_kept(spark, sf_dir), tags=["project", "en"]).select("path", "title", joined("tags").alias("tags"), numbered_lines("snippets").alias("snippets"))


def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = docs_kept(spark, sf_dir)
    post = index.postings(own)
    each = post.groupBy("field").agg(F.count("*").alias("entries"), F.sum("tf").alias("tokens"), F.countDistinct("token").alias("different"))
    return each.join(index.field_stats(own), "field").select("field", "entries", "tokens", "different", "n", F.round("avg_len", 6).alias("avg_len"))


def _bm25(fields: tuple[str, ...], limit: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokens = checked(SEARCH).tokens
        own = stored(index.matches(docs(spark, sf_dir), tokens, list(fields)), "matches")
        scored = bm25(index.matched_postings(own), index.matched_stats(own), tokens, fields)
        return scored.orderBy(F.desc("score"), "path").limit(limit)

    return run


def _features(*columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features(docs(spark, sf_dir), checked(SEARCH)).select("path", *[F.col(c).cast("long").alias(c) for c in columns])

    return run


def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(docs(spark, sf_dir), checked(SEARCH)).groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def _found(found: DataFrame) -> DataFrame:
    whole = [F.col(c).cast("long").alias(c) for c in ("position", "bucket", "base_rank")]
    return found.select("path", "title", *whole, joined("tags").alias("tags"), numbered_lines("snippets").alias("snippets"), "score", F.round("rrf", 6).alias("rrf"))


def _search(**how: object) -> Query:
    return lambda spark, sf_dir: _found(search(docs(spark, sf_dir), SEARCH, explain=True, **how))


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index of the first of two states, brought to the second by what differs, and searched."""
    old, new = snapshots(spark, sf_dir)
    own = index.Index(spark, work_dir(spark, "index"))
    own.build(old)
    own.refresh(new)
    return _found(own.search(SEARCH, explain=True))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the notes: the first lacks one source, the second another, and notes in German are longer in it."""
    at = table(spark, sf_dir, "documents").selectExpr(f"{PATH} AS path", "text", "lang", "source", "CAST(doc_id AS DOUBLE) AS mtime_ms")
    old = at.where("source <> 'src5'").select("path", "mtime_ms", F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"))
    new = at.where("source <> 'src3'").withColumn("content", F.when(F.col("lang") == "de", F.concat("text", F.lit("\n#changed"))).otherwise(F.col("text")))
    return old, new.select("path", "mtime_ms", F.octet_length("content").cast("long").alias("size"), "content")


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return index.manifest_diff(index.manifest(old), index.manifest(new))


def index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    changes = index.manifest_diff(index.manifest(old), index.manifest(new))
    return index.merge(parse_notes(old), changes, parse_notes(new)).select("path", "title", joined("tags").alias("tags"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


def _edit(function: Callable[..., DataFrame], *args: object, **how: object) -> Query:
    return lambda spark, sf_dir: function(texts(spark, sf_dir), *args, **how).select("code", "path", F.md5(F.col("after").cast("binary")).alias("after_md5"), "error")


def simple_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit.replace(texts(spark, sf_dir), "the", "THE", every=True).where("after is not null").select("path", "diff")


def write_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return edit.write(old, new, overwrite=True).select("code", "path", F.md5(F.col("before").cast("binary")).alias("before_md5"), F.md5(F.col("after").cast("binary")).alias("after_md5"))


def copy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit.copy(texts(spark, sf_dir), "src1", "src2", recursive=True).select("code", "path", "from_path", "error", F.md5(F.col("after").cast("binary")).alias("after_md5"))


def _frontmatter(function: Callable[..., DataFrame], *args: object) -> Query:
    """Reasons without what the YAML library says."""
    return lambda spark, sf_dir: function(note_files(spark, sf_dir), *args).select("code", "path", "after", "diff", F.substring_index("error", ":", 1).alias("error"))


def frontmatter_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontmatter.read_frontmatter(note_files(spark, sf_dir)).select("path", "has_frontmatter", F.col("frontmatter").cast("string").alias("frontmatter"), F.when(F.col("error").isNotNull(), F.lit(True)).otherwise(F.lit(False)).alias("failed"))


def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").where(F.col("doc_id").isin(0, 1, 2, 5)).selectExpr("doc_id", f"{PATH} AS path", "source").collect()  # the four that the patch names
    said = PATCH.replace("{source}", next(r["source"] for r in own if r["doc_id"] == 1))
    for r in own:
        said = said.replace(f"{{{r['doc_id']}}}", r["path"])
    return apply_patch(note_files(spark, sf_dir), said).select("seq", "code", "path", "from_path", "before", "after", "diff", F.col("error").isNotNull().alias("failed"))


def regex_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An escaped $ and one that is the very end, in texts of which some end in a line break."""
    files = table(spark, sf_dir, "documents").selectExpr(f"{PATH} AS path", "text || chr(10) || 'cost $' || CAST(doc_id AS STRING) || CASE doc_id % 3 WHEN 0 THEN '' ELSE chr(10) END AS content")
    return edit.replace_regex(files, r"(cost \$\d+$|zzz$)", "$0 [END]").select("code", "path", F.md5(F.col("after").cast("binary")).alias("after_md5"), "error")


def rendered_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_read(read(texts(spark, sf_dir), head=3))


def rendered_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_grep(grep(texts(spark, sf_dir), "license", context=1, limit=None)).select("path", F.col("line").cast("long").alias("line"), "rendered")


def rendered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_search(search(docs(spark, sf_dir), SEARCH, explain=True), "json")


def rendered_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_changes(edit.replace_line(texts(spark, sf_dir), 2, "new second line"), "text", dry=False)


def line_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each note splits into lines and joins again."""
    lines = T.lines_of("content")
    return note_files(spark, sf_dir).select("path", F.size(lines).cast("long").alias("n_lines"), (T.eol_of("content") == "\r\n").alias("crlf"), F.col("content").endswith("\n").alias("final_newline"), F.md5(T.join_lines(lines, "content").cast("binary")).alias("joined_md5"))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised identities of paths, and what they are made of."""
    return note_files(spark, sf_dir).select("path", T.identity("path").alias("identity"), T.stem("path").alias("stem"), F.array_join(T.folders("path"), "|").alias("folders"))


QUERIES: dict[str, Query] = {
    "grep_literal": _grep(texts, "license"),
    "grep_literal_case": _grep(texts, "The and", case_sensitive=True, limit=None),
    "grep_context": _grep(texts, "license", context=2, limit=None),
    "grep_regex": _grep(turns, "(the|of) [a-z]{3}[.,]", regex=True, limit=None),
    "grep_regex_named": _grep(texts, r"(?<first>È[a-zéè]+) ", regex=True, limit=None),
    "grep_path_scope": _grep(note_files, "plan for", path="src3/en", limit=None),
    "read_head": _read(head=5),
    "read_tail": _read(tail=3),
    "read_range": _read(lines=(2, 4)),
    "read_around": _read(around="the", context=1),
    "read_capped": _read(max_chars=200),
    "line_numbered": _read(),
    "render_read": rendered_read,
    "render_grep": rendered_grep,
    "render_search": rendered_search,
    "render_changes": rendered_changes,
    "line_shapes": line_shapes,
    "identities": identities,
    "note_titles": _docs(lambda: F.col("title")),
    "note_headings": _docs(lambda: joined("headings").alias("headings")),
    "note_tags": _docs(lambda: joined("tags").alias("tags")),
    "note_aliases": _docs(lambda: joined("aliases").alias("aliases")),
    "note_bodies": _docs(lambda: F.md5(F.col("body").cast("binary")).alias("body_md5")),
    "heading_levels": heading_levels,
    "inline_tags": tag_counts,
    "tag_filter_all": tag_filter_all,
    "tag_search_topk": tag_search_topk,
    "postings_stats": postings_stats,
    "bm25_topk": _bm25(("body",), 50),
    "bm25_fielded": _bm25(tuple(index.BOOSTS), 50),
    "exact_priority": _features("exact_priority"),
    "phrase_priority": _features("phrase_priority"),
    "coverage_score": _features("coverage_terms", "coverage_score"),
    "rank_buckets": bucket_counts,
    "search_rrf": _search(),
    "search_scoped": _search(path="src4", tags=["project"]),
    "search_field_restricted": _search(fields=["title", "path"]),
    "index_search": index_search,
    "manifest_diff": manifest_diff,
    "index_merge": index_merge,
    "edit_replace_all": _edit(edit.replace, "the", "$& <the>", every=True),
    "edit_replace_once": _edit(edit.replace, "license", "LICENSE"),
    "edit_replace_first": _edit(edit.replace_first, "the", "$1"),
    "edit_regex": _edit(edit.replace_regex, "[aeiou]{3,}", "$0\\", every=True),
    "edit_regex_end": regex_end,
    "edit_line": _edit(edit.replace_line, 2, "new second line"),
    "edit_range": _edit(edit.replace_range, 2, 3, "one\ntwo\n"),
    "simple_diff": simple_diff,
    "write_changes": write_changes,
    "copy_tree": copy_tree,
    "frontmatter_read": frontmatter_read,
    "frontmatter_set": _frontmatter(frontmatter.set_frontmatter, "status", {"state": "active", "n": 3}),
    "frontmatter_add": _frontmatter(frontmatter.add_frontmatter_value, "tags", "new tag"),
    "frontmatter_remove": _frontmatter(frontmatter.remove_frontmatter_value, "tags", "en"),
    "frontmatter_delete": _frontmatter(frontmatter.delete_frontmatter, "tags"),
    "apply_patch": patch,
}
