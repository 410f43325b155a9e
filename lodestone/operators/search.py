"""Ranked search: BM25 over fields, then buckets and reciprocal-rank fusion over the best candidates, then snippets of the winners.

The base score is BM25 (k1 = 1.2, b = 0.75) summed over fields with their boosts; a note is a hit if any query token is in an
allowed field. The pool of candidates is taken before path and tag filters, unless `prefilter`. Only the pool, at most max(10 * limit,
50) rows, is ranked, so windows without partitions never see more.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.errors import UsageError, positive
from lodestone.functions.markdown import closing_line
from lodestone.functions.text import folders, identity, identity_of, lines_of, stem, trim, walk_key, within
from lodestone.operators.index import BOOSTS, field_stats, matched_postings, matched_stats, matches
from lodestone.sources.folders import stored

#: Fixed values of the ranking.
POOL_TIMES, POOL_LEAST = 10, 50
RRF_K = 10
RRF_IDENTITY, RRF_PHRASE, RRF_COVERAGE, RRF_BASE = 4.0, 3.0, 2.0, 1.0
EXACT = {"title": 0, "aliases": 1, "stem": 2}
PHRASE = {"title": 0, "aliases": 1, "stem": 2, "headings": 3, "folders": 4}
COVERAGE = {"title": 5, "aliases": 4, "tags": 3, "headings": 2, "path": 1}
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Query:
    text: str | None
    tags: tuple[str, ...] | None
    fields: tuple[str, ...]
    limit: int

    @property
    def phrase(self) -> str:
        return identity_of(self.text or "")

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys(filter(None, self.phrase.split(" "))))

    @property
    def tokens(self) -> list[str]:
        return list(dict.fromkeys(re.findall(r"[^\W_]+", (self.text or "").replace("#", " ").strip().lower())))

    @property
    def pool(self) -> int:
        return max(POOL_TIMES * self.limit, POOL_LEAST)


def checked(query: str | None = None, tags: list[str] | None = None, fields: list[str] | None = None, limit: int = 10) -> Query:
    """Parameters in normal form."""
    positive(limit, "limit")
    text = query.strip() if query is not None else None
    if query is not None and not text:
        raise UsageError("an empty query finds nothing")
    if tags is not None:
        tags = list(dict.fromkeys(t for t in (x.lstrip("#").strip().lower() for x in tags) if t))
        if not tags:
            raise UsageError("tags without any name")
    if fields is not None:
        fields = list(dict.fromkeys(f for f in (x.strip().lower() for x in fields) if f))
        if not fields or any(f not in BOOSTS for f in fields):
            raise UsageError(f"fields are {', '.join(BOOSTS)}")
        if not text:
            raise UsageError("fields restrict a query, and there is none")
    if not text and not tags:
        raise UsageError("a query or tags are needed")
    return Query(text, tuple(tags) if tags else None, tuple(fields or BOOSTS), limit)


def bm25(post: DataFrame, stats: DataFrame, tokens: list[str], fields: tuple[str, ...] = tuple(BOOSTS)) -> DataFrame:
    """(path, score, rounded to 6 places) of notes with any of the tokens in any of the fields.

    Only the postings of those tokens and fields are read; document frequencies are a table of tokens times fields.
    """
    hit = post.where(F.col("token").isin(tokens) & F.col("field").isin(*fields)) if tokens else post.limit(0)
    df = hit.groupBy("field", "token").agg(F.count("*").alias("df"))
    both = hit.join(F.broadcast(df), ["field", "token"]).join(F.broadcast(stats), "field")  # tokens x fields rows, and one for each field
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("len") / F.col("avg_len")))
    boost = F.lit(0.0)
    for f in fields:
        boost = F.when(F.col("field") == f, F.lit(BOOSTS[f])).otherwise(boost)
    return both.select("path", (boost * idf * norm).alias("part")).groupBy("path").agg(F.round(F.sum("part"), 6).alias("score"))


def pool_of(post: DataFrame, stats: DataFrame, query: str, tags: list[str] | None = None, fields: list[str] | None = None, limit: int = 10) -> list[str]:
    """The paths of the best notes by their base score, at most the pool's number."""
    q = checked(query, tags, fields, limit)
    return [r["path"] for r in bm25(post, stats, q.tokens, q.fields).orderBy(F.desc("score"), "path").limit(q.pool).collect()]


def has_tags(tags: Column, wanted: tuple[str, ...] | None) -> Column:
    """Whether all wanted tags are there, whatever their case."""
    if not wanted:
        return F.lit(True)
    lower = F.transform(tags, F.lower)
    return F.forall(F.array(*map(F.lit, wanted)), lambda t: F.array_contains(lower, t))


def features(docs: DataFrame, q: Query) -> DataFrame:
    """docs with exact_priority, phrase_priority (null: none), coverage_terms, coverage_score and bucket (0 exact, 1 phrase, 2 coverage, 3 base)."""
    phrase, terms = F.lit(q.phrase), q.terms
    allowed = lambda f: f in q.fields
    none = F.array().cast("array<string>")
    texts = {
        "title": F.array("title") if allowed("title") else none, "aliases": F.col("aliases") if allowed("aliases") else none, "tags": F.col("tags") if allowed("tags") else none,
        "headings": F.col("headings") if allowed("headings") else none, "stem": F.array(stem("path")) if allowed("path") else none, "folders": folders("path") if allowed("path") else none,
    }
    at = docs.withColumns({f"_{k}": F.transform(v, identity) for k, v in texts.items()})
    first = lambda ranks, test: F.least(*[F.when(F.exists(f"_{k}", test), F.lit(r)) for k, r in ranks.items()])
    exact = first(EXACT, lambda x: x == phrase)
    within_phrase = first(PHRASE, lambda x: (x != "") & x.contains(phrase)) if q.phrase else F.lit(None).cast("int")
    found = {k: (lambda t, k=k: F.exists(f"_{k}", lambda x: x.contains(t))) for k in ("title", "aliases", "tags", "headings")}
    found["path"] = lambda t: F.exists("_stem", lambda x: x.contains(t)) | F.exists("_folders", lambda x: x.contains(t))
    n, score = F.lit(0), F.lit(0)
    for t in map(F.lit, terms):
        hits = {k: f(t) for k, f in found.items()}
        any_ = F.lit(False)
        for k, h in hits.items():
            any_ = any_ | h
            score = score + F.when(h, F.lit(COVERAGE[k])).otherwise(F.lit(0))
        n = n + any_.cast("int")
    at = at.withColumns({"exact_priority": exact, "phrase_priority": within_phrase, "coverage_terms": n, "coverage_score": score}).drop(*[f"_{k}" for k in texts])
    return at.withColumn("bucket", F.when(F.col("exact_priority").isNotNull(), 0).when(F.col("phrase_priority").isNotNull(), 1).when(F.col("coverage_terms") > 0, 2).otherwise(3))


def rerank(candidates: DataFrame, q: Query) -> DataFrame:
    """candidates (path, title, aliases, tags, headings, score) with base_rank, bucket and rrf. They must be few: ranks are over all of them."""
    at = features(candidates.withColumn("base_rank", F.row_number().over(Window.orderBy(F.desc("score"), "path"))), q)
    by_coverage = [F.desc("coverage_terms"), F.desc("coverage_score"), "base_rank", "path"]
    rank = lambda part, *order: F.row_number().over(Window.partitionBy(part).orderBy(*order))
    at = at.withColumn("_identity", rank(F.col("bucket") == 0, "exact_priority", "base_rank", "path"))
    at = at.withColumn("_phrase", rank(F.col("bucket") == 1, "phrase_priority", *by_coverage))
    at = at.withColumn("_coverage", rank(F.col("bucket").isin(1, 2), *by_coverage))
    part = lambda weight, r: F.lit(weight) / (F.lit(float(RRF_K)) + F.col(r))
    own = F.when(F.col("bucket") == 0, part(RRF_IDENTITY, "_identity")).when(F.col("bucket") == 1, part(RRF_PHRASE, "_phrase") + part(RRF_COVERAGE, "_coverage")).when(F.col("bucket") == 2, part(RRF_COVERAGE, "_coverage")).otherwise(F.lit(0.0))
    return at.withColumn("rrf", part(RRF_BASE, "base_rank") + own).drop("_identity", "_phrase", "_coverage")


def snippets(content: Column | str, terms: list[str]) -> Column:
    """Up to three (line, text): lines of the body that hold any term, one heading of them at most if others do; else the first heading, else the first line that isn't blank."""
    lines = lines_of(content)
    heading = r"^#{1,6}\s+"

    def pick(d: Column) -> Column:
        lines = d["lines"]
        closer = closing_line(lines)
        start = F.when((F.size(lines) > 0) & (trim(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))) == "---") & (closer > 0), closer + 1).otherwise(0)
        body = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda s: s["line"] > start)
        holds = lambda s: F.exists(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: F.lower(s["text"]).contains(t))
        heads = F.filter(body, lambda s: s["text"].rlike(heading) & holds(s))
        rest = F.filter(body, lambda s: ~s["text"].rlike(heading) & holds(s))
        found = F.slice(F.when(F.size(rest) > 0, F.concat(F.slice(heads, 1, 1), rest)).otherwise(heads), 1, 3)
        some_head = F.slice(F.filter(body, lambda s: s["text"].rlike(heading)), 1, 1)
        some = F.slice(F.filter(body, lambda s: trim(s["text"]) != ""), 1, 1)
        return F.when(F.size(found) > 0, found).when(F.size(some_head) > 0, some_head).otherwise(some)

    return F.transform(F.array(F.struct(lines.alias("lines"))), pick)[0]


def search(docs: DataFrame, query: str | None = None, path: str | None = None, tags: list[str] | None = None, fields: list[str] | None = None, limit: int = 10, post: DataFrame | None = None, stats: DataFrame | None = None, folder: bool = True, prefilter: bool = False, explain: bool = False) -> DataFrame:
    """(path, title, tags, snippets) of the best notes, in order.

    docs: parsed notes with content. post and stats: their postings and field statistics, best from a persisted index. Without postings the notes are gone through once, at the call, and what
    the query needs of them, without their texts, is written to the work folder; for the winners' texts docs is read again.
    With tags alone all notes with them count, by path. explain adds position, bucket, base_rank, score and rrf.
    """
    q = checked(query, tags, fields, limit)
    scope = within("path", path, folder) if path is not None else F.lit(True)
    keep = scope & has_tags(F.col("tags"), q.tags)
    if q.text is None:
        best = docs.select("path", "title", "tags").where(keep).orderBy(walk_key("path")).limit(q.limit)
        order = [walk_key("path")]
    else:
        meta = docs.select("path", "title", "aliases", "tags", "headings")
        if post is None:
            meta = stored(matches(docs, q.tokens, list(q.fields), ("title", "aliases", "tags", "headings")), "matches")
            post, stats = matched_postings(meta), matched_stats(meta) if stats is None else stats
            meta = meta.drop("cells")
        scored = bm25(post, field_stats(docs, list(q.fields)) if stats is None else stats, q.tokens, q.fields)
        if prefilter:
            scored = scored.join(meta.where(keep).select("path"), "path", "left_semi")
        pool = scored.orderBy(F.desc("score"), "path").limit(q.pool)
        best = rerank(meta.join(F.broadcast(pool), "path").where(keep), q)  # the pool has at most q.pool rows
        order = ["bucket", F.desc("rrf"), walk_key("path")]
        best = best.orderBy(*order).limit(q.limit)
    shown = docs.select("path", "content").join(F.broadcast(best), "path")  # best has at most q.limit rows
    shown = shown.withColumn("snippets", snippets("content", q.terms)).drop("content").orderBy(*order)
    if not explain or q.text is None:
        return shown.select("path", "title", "tags", "snippets")
    return shown.withColumn("position", F.row_number().over(Window.orderBy(*order))).select("position", "path", "title", "tags", "snippets", "bucket", "base_rank", "score", "rrf")
