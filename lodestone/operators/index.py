"""The search index: notes, postings and lengths of fields as tables, and their maintenance by snapshot difference."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import VaultError
from lodestone.functions.markdown import parse_notes
from lodestone.functions.text import let

#: Fields, and how much a hit in each weighs in the full-text score (fixed values).
BOOSTS = {"title": 8.0, "tags": 7.0, "aliases": 6.0, "headings": 4.0, "path": 2.0, "body": 1.0}
TOKEN = r"[a-z0-9\p{L}\p{N}]+"  # a-z and 0-9 are tried first, by a table; they are letters and digits anyway
VERSION = 2
#: The end of a marker file's name, changed paths that are broadcast, and bytes of a row group of postings.
MARK, FEW, ROW_GROUP = ".whole", 200_000, 16 << 20
#: Of the stored tables, so that empty ones can be read.
SCHEMAS = {
    "docs": "path string, title string, aliases array<string>, tags array<string>, headings array<string>, body string, content string",
    "postings": "path string, token string, tf long, len long, field string",
    "manifest": "path string, mtime_ms double, size long",
}


def _values(docs: DataFrame, fields: list[str] | None) -> dict[str, Column]:
    """Each field as text; lists are joined by line ends."""
    kinds = dict(docs.dtypes)
    return {f: F.array_join(f, "\n") if kinds[f].startswith("array") else F.col(f) for f in fields or BOOSTS}


def field_texts(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(path, field, value): a row for each field; lists are joined by line ends."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in _values(docs, fields).items()])
    return docs.select("path", F.explode(cells).alias("c")).select("path", "c.field", "c.value")


def _counted(rows: DataFrame, tokens: Column) -> DataFrame:
    """(path, field, token, tf, len): a row for each different one of a row's tokens.

    The tokens are sorted and joined, and one pattern takes each with its repeats, `a a a`, so that no function is called token by token. It is possessive: repeats take no stack.
    """
    runs = F.regexp_extract_all(F.array_join(F.sort_array(tokens), " "), F.lit(r"([^ ]++)(?: \1(?= |\z))*+"), 0)
    each = rows.select("path", "field", "len", F.explode(runs).alias("run")).select("path", "field", F.substring_index("run", " ", 1).alias("token"), "run", "len")
    tf = F.floor((F.octet_length("run") + 1) / (F.octet_length("token") + 1)).cast("long")
    return each.select("path", "field", "token", tf.alias("tf"), "len")


def postings(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(path, field, token, tf, len): tokens are lower-cased runs of letters and digits; len is the number of tokens of that field of the note.

    A field's tokens are counted within its row, so nothing is shuffled. A path has one row in docs.
    """
    tokens = field_texts(docs, fields).select("path", "field", F.regexp_extract_all(F.lower("value"), F.lit(TOKEN), 0).alias("tokens"))
    return _counted(tokens.select("path", "field", F.size("tokens").cast("long").alias("len"), "tokens"), F.col("tokens"))


def matches(docs: DataFrame, tokens: list[str], fields: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, cells) and the columns to keep: of each field its number of tokens and those of the given ones it has, repeats and all.

    This is all that a search for these tokens needs of the texts, so they are gone through once; see `matched_postings` and `matched_stats`.
    """

    def cell(field: str, value: Column) -> Column:
        own = lambda found: F.struct(F.lit(field).alias("field"), F.size(found).cast("long").alias("len"), F.filter(found, lambda x: x.isin(tokens)).alias("hits"))
        return let(F.regexp_extract_all(F.lower(value), F.lit(TOKEN), 0), own)

    cells = [cell(f, v) for f, v in _values(docs, fields).items()]
    return docs.select("path", *keep, F.array(*cells).alias("cells"))


def matched_postings(matched: DataFrame) -> DataFrame:
    """`postings` of the tokens that `matches` was given."""
    each = matched.select("path", F.explode("cells").alias("c")).where(F.size("c.hits") > 0)
    return _counted(each.select("path", "c.field", "c.len", "c.hits"), F.col("hits"))


def matched_stats(matched: DataFrame) -> DataFrame:
    """`field_stats` of what `matches` went through."""
    lengths = matched.select(F.explode("cells").alias("c")).select("c.field", "c.len")
    return lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def field_stats(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(field, n, avg_len): over all notes, those with an empty field too."""
    lengths = field_texts(docs, fields).select("field", F.regexp_count(F.lower("value"), F.lit(TOKEN)).alias("len"))
    return lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def manifest(files: DataFrame) -> DataFrame:
    return files.select("path", "mtime_ms", "size")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, deleted or changed (size or time differ) between two manifests; unchanged paths have no row."""
    joined = old.select("path", F.col("mtime_ms").alias("m0"), F.col("size").alias("s0"), F.lit(True).alias("o")).join(new.select("path", F.col("mtime_ms").alias("m1"), F.col("size").alias("s1"), F.lit(True).alias("n")), "path", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when((F.col("m0") != F.col("m1")) | (F.col("s0") != F.col("s1")), "changed")
    return joined.select("path", change.alias("change")).where(F.col("change").isNotNull())


def merge(docs: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """docs without deleted and changed paths, and the fresh rows of added and changed ones (those that couldn't be read have none)."""
    kept = docs.join(changes.where(F.col("change").isin("deleted", "changed")).select("path"), "path", "left_anti")
    return kept.unionByName(fresh.join(changes.where(F.col("change").isin("added", "changed")).select("path"), "path", "left_semi"))


def cache_key(root: str) -> str:
    """A short name for an index of a root."""
    import hashlib

    return hashlib.sha256(root.encode()).hexdigest()[:16]


#: Commits from which on, or share of rows replaced above which, a refresh writes the whole index anew.
COMMITS, REPLACED = 16, 0.3


@dataclass
class Index:
    """An index as commits below a folder: a base, and what changed since.

    A commit has docs (by path), postings (each file by token and field, so that a search reads few row groups of each), sums of field lengths, the manifest's new rows and `gone`, the paths of earlier commits
    that it replaces or deletes. It counts once its marker file is there, which is made last and at once; a reader takes the last base with a marker and the marked commits after it, so it
    never sees half of one. Commits that the newest base has made useless go with the next base but one.
    """

    spark: SparkSession
    where: str

    def _store(self) -> tuple[object, object]:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.where)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), sc._jvm.org.apache.hadoop.fs.Path

    def commits(self) -> list[str]:
        """The names of the last whole base and the whole commits after it; [] if there is none of this version."""
        store, path = self._store()
        if not store.exists(path(self.where)):
            return []
        names = sorted(s.getPath().getName() for s in store.listStatus(path(self.where)))
        marked = [n.removesuffix(MARK) for n in names if n.endswith(MARK)]
        bases = [k for k, n in enumerate(marked) if n.endswith("base")]
        return marked[bases[-1] :] if bases else []

    def build(self, files: DataFrame) -> None:
        """files: (path, mtime_ms, size, content as text; null if unreadable)."""
        self._commit("base", None, files, manifest(files), None)

    def _commit(self, kind: str, notes: DataFrame | None, files: DataFrame | None, listed: DataFrame, gone: DataFrame | None) -> None:
        """notes: parsed ones; files: those to be parsed; listed: the manifest's rows.

        Files are dealt to ranges of paths before they are parsed, since the ranges are found by going through the rows once more. Postings stay in their notes' partition: nothing is shuffled.
        """
        store, path = self._store()
        name = f"v{VERSION}-{time.time_ns():020d}-{kind}"
        at = f"{self.where}/{name}"
        by_path = lambda rows: rows.repartitionByRange("path").sortWithinPartitions("path")
        for part in ([] if notes is None else [by_path(notes)]) + ([] if files is None else [parse_notes(by_path(files.select("path", "content")))]):
            part.write.mode("append").parquet(f"{at}/docs")
        own = self.spark.read.schema(SCHEMAS["docs"]).parquet(f"{at}/docs")
        postings(own).sortWithinPartitions("token", "field").write.option("parquet.block.size", ROW_GROUP).parquet(f"{at}/postings")
        sums = self._sums(at)
        if gone is not None:
            gone.write.parquet(f"{at}/gone")
            old = self.table("docs").join(self.spark.read.schema("path string").parquet(f"{at}/gone"), "path", "left_semi")
            sums = sums.unionByName(_field_sums(old).select("field", (-F.col("n")).alias("n"), (-F.col("tokens")).alias("tokens")))
        sums.coalesce(1).write.parquet(f"{at}/sums")
        listed.write.parquet(f"{at}/manifest")
        before = self.commits()
        store.create(path(f"{at}{MARK}"), False).close()
        if kind == "base":
            for old_name in sorted(s.getPath().getName() for s in store.listStatus(path(self.where))):
                bare = old_name.removesuffix(MARK)
                if bare < (before[0] if before else name) and bare.startswith("v"):  # readers may still have the base before this one open
                    store.delete(path(f"{self.where}/{old_name}"), True)

    def _sums(self, at: str) -> DataFrame:
        """(field, n, tokens) of a commit, from what is written of it."""
        read = lambda part: self.spark.read.schema(SCHEMAS[part]).parquet(f"{at}/{part}")
        n, tokens = read("docs").count(), {r["field"]: r["n"] for r in read("postings").groupBy("field").agg(F.sum("tf").alias("n")).collect()}
        rows = ", ".join(f"('{f}', {n}L, {tokens.get(f, 0)}L)" for f in BOOSTS)
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(field, n, tokens) WHERE n > 0")

    def table(self, name: str) -> DataFrame:
        """docs, postings, stats or manifest as they are now."""
        commits = self.commits()
        if not commits:
            raise VaultError(f"no index at {self.where}")
        read = lambda part, k, schema: self.spark.read.schema(schema).parquet(f"{self.where}/{commits[k]}/{part}")
        every = range(len(commits))
        if name == "stats":
            sums = reduce(DataFrame.unionByName, [read("sums", k, "field string, n long, tokens long") for k in every])
            return sums.groupBy("field").agg(F.sum("n").alias("n"), (F.sum("tokens") / F.sum("n")).alias("avg_len"))
        if len(commits) == 1:
            return read(name, 0, SCHEMAS[name])
        rows = reduce(DataFrame.unionByName, [read(name, k, SCHEMAS[name]).withColumn("_at", F.lit(k)) for k in every])
        gone = reduce(DataFrame.unionByName, [read("gone", k, "path string").withColumn("_by", F.lit(k)) for k in every[1:]])
        last = gone.groupBy(F.col("path").alias("_path")).agg(F.max("_by").alias("_by"))
        return rows.join(last, (F.col("path") == F.col("_path")) & (F.col("_at") < F.col("_by")), "left_anti").drop("_at")

    def ready(self) -> bool:
        """Whether a whole build of this version is there; it may be stale."""
        return any(c.startswith(f"v{VERSION}-") for c in self.commits()[:1])

    def refresh(self, files: DataFrame, listing: DataFrame | None = None) -> str:
        """Brings the index up to date: 'fresh', 'merged', or 'rebuilt' if it was missing or of another version.

        Only files that are new or changed are parsed, and only they are written. listing: (path, mtime_ms, size) where files would have to be opened for these.
        """
        if not self.ready():
            self.build(files)
            return "rebuilt"
        now = manifest(files if listing is None else listing)
        return self.apply(manifest_diff(self.table("manifest"), now), now, files)

    def apply(self, changes: DataFrame, now: DataFrame, files: DataFrame) -> str:
        """Adds (path, change) as a commit: 'merged', or 'fresh' if there is none. now: at least the manifest rows of added and changed paths; files: their content."""
        changes = changes.persist()
        try:
            counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
            if not counts:
                return "fresh"
            new = changes.where(F.col("change") != "deleted").select("path")
            if counts.get("added", 0) + counts.get("changed", 0) <= FEW:
                new = F.broadcast(new)
            gone = changes.where(F.col("change") != "added").select("path")
            fresh, listed = files.join(new, "path", "left_semi"), now.join(new, "path", "left_semi")
            paths = self.table("manifest").count() + counts.get("added", 0) - counts.get("deleted", 0)
            if sum(counts.values()) > REPLACED * max(1, paths):  # one base at once, instead of a commit that is merged into one
                kept = lambda rows: rows.join(gone, "path", "left_anti")
                self._commit("base", kept(self.table("docs")), fresh, kept(self.table("manifest")).unionByName(listed), None)
                return "merged"
            self._commit("more", None, fresh, listed, gone)
            if len(self.commits()) > COMMITS:
                self.compact()
            return "merged"
        finally:
            changes.unpersist()

    def compact(self) -> None:
        """One base of what the commits say."""
        self._commit("base", self.table("docs"), None, self.table("manifest"), None)

    def search(self, query: str | None = None, **how: object) -> DataFrame:
        """`search` over the stored tables. The pool's paths, max(10 * limit, 50) at most, come to the driver, so that of docs, which are sorted by path, few row groups are read."""
        from lodestone.operators.search import pool_of, search

        docs, post, stats = self.table("docs"), self.table("postings"), self.table("stats")
        paths = pool_of(post, stats, query, **{k: v for k, v in how.items() if k in ("tags", "fields", "limit")}) if query is not None and not how.get("prefilter") else None
        if paths is not None:
            docs = docs.where(F.col("path").isin(paths)) if paths else docs.limit(0)
        return search(docs, query, post=post, stats=stats, **how)

    def clear(self) -> None:
        store, path = self._store()
        store.delete(path(self.where), True)


def _field_sums(docs: DataFrame) -> DataFrame:
    """(field, n, tokens): notes and tokens of each field."""
    lengths = field_texts(docs).select("field", F.regexp_count(F.lower("value"), F.lit(TOKEN)).alias("len"))
    return lengths.groupBy("field").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("tokens"))
