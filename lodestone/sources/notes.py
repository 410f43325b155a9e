"""Notes derived from the documents table, by one expression that Spark and other SQL engines read alike.

By doc_id they have no frontmatter, block lists with a quoted title, inline lists with `alias` and CRLF line ends, a block that
never closes, one that `...` closes, or just inline tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

NL, CR = "chr(10)", "chr(13)"
PATH = "source || '/' || lang || '/doc_' || lpad(CAST(doc_id AS STRING), 10, '0') || '.md'"
_HEAD = "replace(replace(substr(text, 1, 40), chr(10), ' '), chr(13), ' ')"
CONTENT = f"""CASE doc_id % 6
  WHEN 0 THEN text
  WHEN 1 THEN '---' || {NL} || 'title: "Note ' || CAST(doc_id AS STRING) || ' of ' || source || '"' || {NL} || 'tags:' || {NL} || '  - ' || lang || {NL} || '  - ''#' || source || '''' || {NL} || 'aliases:' || {NL} || '  - Project ' || lang || {NL} || '---' || {NL} || '# ' || {_HEAD} || {NL} || {NL} || text || {NL} || {NL} || '#' || lang || '/inline' || {NL}
  WHEN 2 THEN replace('---' || {NL} || 'tags: [' || lang || ', "' || source || '"]' || {NL} || 'alias: ''Launch ' || source || ''', Second' || {NL} || '---' || {NL} || '## Details ##' || {NL} || '# ' || {_HEAD} || ' #' || {NL} || text || {NL}, {NL}, {CR} || {NL})
  WHEN 3 THEN '---' || {NL} || 'title: never closed' || {NL} || '# Open ' || lang || {NL} || text
  WHEN 4 THEN '---' || {NL} || 'Title:' || {NL} || 'title: Alpha checklist ' || lang || {NL} || 'tags: project, ' || lang || ',' || {NL} || '...' || {NL} || text || ' (#Project) x#no ' || {NL}
  ELSE '# Plan for ' || source || {NL} || {NL} || text || {NL} || 'see #' || lang || ' and #roadmap' END"""
SQL = f"SELECT {PATH} AS path, {CONTENT} AS content FROM documents"


def notes(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(f"{PATH} AS path", f"{CONTENT} AS content")
