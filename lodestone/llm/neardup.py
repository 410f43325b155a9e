"""Operator 2: near-duplicate groups by MinHash with tensored banding, every link confirmed on full shingle sets.

Each set of shingles gets two small collections of sub-keys, u_1..u_m and v_1..v_m, of `t` minhashes each. The keys of the
m * m tables are the pairs (u_i, v_j), so that 2 * m * t minhashes serve m * m tables of 2 * t minhashes each. Sets of
likeness s meet in no table with probability of at most 2 * (1 - s**t)**m: 2.2e-5 at 0.85 with the defaults, less above. `exact`
leaves the tables out and compares by prefixes alone, which miss nothing.

A sub-key that one set alone has can't be part of a shared key; such sub-keys go before pairs are formed. Sets that meet
in a table are joined to the table entry's smallest (a star, not all pairs), first in m tables, then, cluster by cluster, in all; the connected components of these
stars, the candidate clusters, are where links can be.

A cluster of up to `LARGE` sets is compared in pairs of blocks of at most `SMALL` sets, by counting shared shingles. A larger one, in which most pairs may be far from any
link, is narrowed first, as often as that helps: its sets are dealt into blocks, each with the same few sets of the cluster
as pivots. A set linked to a pivot joins its group. Of each set the prefix is taken, the |s| - ceil(percent / 100 * |s|) + 1 shingles that come first when
shingles of fewer pivots come before those of more: linked sets share one of these, whatever the order, and in this one most sets share none. Only sets
that share one with a set of another group go on, in new clusters of those that do. What no longer shrinks is compared
block by block, but for blocks of one and the same group. Components of the links are the result. No task grows with a cluster.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import hashing
from lodestone.llm.components import components
from lodestone.llm.shared import cut, sized

U = np.uint64
#: Sets of a block, those of a cluster that is compared block by block at once, the pivots of a larger one (in expectation), and shingles of a block.
SMALL, LARGE, PIVOTS, MOST_SHINGLES = 256, 4_096, 24, 4_000_000


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, the distinct sorted shingle hashes of all, and where each row's begin."""
    for i, j, _, runs, first in hashing.grouped(column, hashing.SPACED, width):
        own = [np.unique(runs[first[k] : first[k + 1]]) for k in range(j - i)]
        yield i, np.concatenate([np.zeros(0, U), *own]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def sketches(docs: DataFrame, m: int = 12, t: int = 3, width: int = 5, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_shingles, sig1, sig2, keys): the size and a 128-bit digest of each text's full set, and its 2 * m sub-keys; on request the text too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = hashing.stream(41, 2 * m * t)
        for batch in batches:
            for i, s, first in _sets(batch.column("text"), width):
                n = len(first) - 1
                size = np.diff(first)
                some = np.flatnonzero(size)
                keys = np.zeros((n, 2 * m), U)
                if len(some):
                    with np.errstate(over="ignore"):
                        for k in range(2 * m):
                            own = np.zeros(len(some), U)
                            for x in range(t):
                                salt = salts[k * t + x]
                                own = own * U(0xD6E8FEB86659FD93) + np.minimum.reduceat((s ^ salt) * (salt | U(1)), first[some])
                            keys[some, k] = hashing.mix(own)
                sig = np.array([np.frombuffer(hashlib.blake2b(s[first[k] : first[k + 1]].tobytes(), digest_size=16).digest(), np.int64) for k in range(n)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), pa.array(size.astype(np.int64)), pa.array(sig[:, 0]), pa.array(sig[:, 1]), pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), 2 * m).cast(pa.list_(pa.int64())), *[batch.column("text").slice(i, n)][: int(keep_text)]],
                    ["doc_id", "n_shingles", "sig1", "sig2", "keys", *["text"][: int(keep_text)]],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, sig1 long, sig2 long, keys array<long>" + (", text string" if keep_text else ""))


def _stars(met: DataFrame) -> DataFrame:
    """(a, b): of (entry, id), ids that share an entry, each with the entry's smallest id."""
    centre = met.groupBy("entry").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("entry", "a")
    return met.join(centre, "entry").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def candidate_clusters(reps: DataFrame, m: int) -> DataFrame:
    """(id, cluster): of (id, keys), sets that meet in a table, directly or by way of others, share a cluster; sets that meet none have no row.

    First only the tables (u_i, v_i) are joined, m stars for a set at most. In all m * m tables sets of one such cluster then count once for an
    entry, so that a large group of near copies is a few rows there, not a row for each set and table.
    """
    sub = reps.select("id", F.posexplode("keys").alias("k", "key"))
    shared = sub.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1").select("k", "key")
    own = cut(sub.join(shared, ["k", "key"]).groupBy("id").agg(F.collect_set(F.struct("k", "key")).alias("own")))
    u, v = F.filter("own", lambda x: x["k"] < m), F.filter("own", lambda x: x["k"] >= m)
    pair = lambda x, y: F.xxhash64(x["k"], x["key"], y["k"], y["key"])
    straight = F.flatten(F.transform(u, lambda x: F.transform(F.filter(v, lambda y: y["k"] == x["k"] + m), lambda y: pair(x, y))))
    first = components(_stars(own.select("id", F.explode(straight).alias("entry"))))
    named = cut(own.join(first, "id", "left").select("id", F.coalesce("component", "id").alias("name"), "own"))
    every = F.flatten(F.transform(u, lambda x: F.transform(v, lambda y: pair(x, y))))
    met = cut(named.select(F.col("name").alias("id"), F.explode(every).alias("entry")).distinct())
    second = components(_stars(met)).select(F.col("id").alias("name"), "component")
    found = named.join(second, "name", "left").select("id", F.coalesce("component", "name").alias("cluster"))
    several = found.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    return cut(found.join(several, "cluster").select("id", "cluster"))


def _links(own: list[np.ndarray], other: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked sets: within `own`, or between `own` and `other` (numbered on from own's)."""
    sets = own + (other or [])
    terms, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    first = np.concatenate([[0], np.cumsum(sizes)])
    n, base = len(sets), len(own) if other is not None else 0
    # postings of the sets that are looked up
    at, doc = inverse[first[base] :], np.repeat(np.arange(base, n), sizes[base:])
    order = np.argsort(at, kind="stable")
    doc = doc[order]
    df = np.bincount(at, minlength=len(terms))
    begin = np.concatenate([[0], np.cumsum(df)])
    a_out, b_out = [], []
    for a in range(len(own)):
        t = inverse[first[a] : first[a + 1]]
        t = t[df[t] > 0]
        if not len(t):
            continue
        lengths = df[t]
        upto = np.cumsum(lengths)
        idx = np.arange(upto[-1]) + np.repeat(begin[t] - (upto - lengths), lengths)
        both = np.bincount(doc[idx], minlength=n)
        b = np.flatnonzero(100 * both >= percent * (sizes[a] + sizes - both))
        b = b[(b > a) & (both[b] > 0)]
        a_out.append(np.full(len(b), a))
        b_out.append(b)
    cat = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
    return cat(a_out), cat(b_out)


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id that the links join to a smaller one, and the smallest that they join it to."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    label, x, y = np.arange(len(ids)), rank[a], rank[b]
    while True:
        was = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == was).all():
            break
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[order][moved], ids[order][label[moved]]


def _rows(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """members (id, node, ...) with the shingles of each, 64-bit numbers in a binary column. A task passes repeated rows on once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()
        for batch in batches:
            for i, s, first in _sets(batch.column("text"), width):
                ids, nodes, raws = [], [], []
                for k, own in enumerate(batch.column("id").slice(i, len(first) - 1).to_pylist()):
                    raw = s[first[k] : first[k + 1]].tobytes()
                    digest = hashlib.blake2b(raw, digest_size=16).digest()
                    if raw and (own, digest) not in seen:
                        seen.add((own, digest))
                        ids.append(own)
                        nodes.append(int(np.frombuffer(digest, np.int64)[0]))
                        raws.append(raw)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(raws, pa.binary())], ["id", "node", "shingles"])

    n = members.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(sized(members.select("id").distinct(), n), "id")
    return texts.mapInArrow(sets, "id long, node long, shingles binary").join(sized(members, n), ["id", "node"])


def _unpacked(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, U) for x in table.column("shingles").to_pylist()]


def prefixes(sets: list[np.ndarray], pivots: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Of each set the shingles of which linked sets share one: the first in the order of (how many pivots have it, hash), as many as can be missing from a linked set, and one more."""
    terms, counts = np.unique(np.concatenate([np.zeros(0, U), *pivots]), return_counts=True)
    out = []
    for s in sets:
        at = np.searchsorted(terms, s)
        at[at == len(terms)] = 0
        count = np.where(terms[at] == s, counts[at], 0) if len(terms) else np.zeros(len(s), np.int64)
        out.append(s[np.lexsort((s, count))[: len(s) - -(-percent * len(s) // 100) + 1]])
    return out


def narrowed(docs: DataFrame, members: DataFrame, percent: int, width: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) to pivots within large clusters (id, node, n_shingles, cluster, n), and the members that may have others: (id, node, n_shingles, cluster, group)."""
    draw = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30))
    dealt = _rows(docs, members, width).withColumn("blocks", F.ceil(F.col("n") / SMALL).cast("int")).withColumn("pivot", draw < F.lit(PIVOTS << 30) / F.col("n"))
    whole = dealt.select("cluster", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "id", "node", "n_shingles", "shingles", F.lit(False).alias("pivot"))
    copies = dealt.where("pivot").select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "node", "n_shingles", "shingles", "pivot")

    def peel(table: pa.Table) -> pa.Table:
        pivot = np.asarray(table.column("pivot").to_pylist(), bool)
        sets, (own, by) = _unpacked(table), (np.flatnonzero(~pivot), np.flatnonzero(pivot))
        ids = table.column("id").to_numpy()
        linked: list[list[int]] = [[] for _ in own]
        if len(own) and len(by):
            for a, b in zip(*_links([sets[i] for i in own], [sets[i] for i in by], percent), strict=True):
                if ids[own[a]] != ids[by[b - len(own)]]:
                    linked[a].append(int(ids[by[b - len(own)]]))
        first = prefixes([sets[i] for i in own], [sets[i] for i in by], percent)
        part = table.select(["id", "node", "n_shingles", "cluster"]).take(pa.array(own))
        return pa.table([*part.columns, pa.array(linked, pa.list_(pa.int64())), pa.array([x.view(np.int64) for x in first], pa.list_(pa.int64()))], ["id", "node", "n_shingles", "cluster", "linked", "prefix"])

    peeled = cut(whole.unionByName(copies).groupBy("cluster", "block").applyInArrow(peel, "id long, node long, n_shingles long, cluster long, linked array<long>, prefix array<long>"))
    links = peeled.select(F.col("id").alias("a"), F.explode("linked").alias("b"))
    grouped = peeled.join(components(links), "id", "left").withColumn("group", F.coalesce("component", "id"))
    entries = grouped.select("cluster", "id", "node", "n_shingles", "group", F.explode("prefix").alias("shingle"))
    mixed = cut(entries.groupBy("cluster", "shingle").agg(F.min("group").alias("least"), F.max("group").alias("z")).where("least <> z").select("cluster", "shingle", "least"))
    met = cut(entries.join(sized(mixed, mixed.count()), ["cluster", "shingle"]).select("id", "node", "n_shingles", "group", "least").distinct())
    parts = components(met.select(F.col("group").alias("a"), F.col("least").alias("b"))).select(F.col("id").alias("group"), F.col("component").alias("cluster"))
    return links, cut(met.select("id", "node", "n_shingles", "group").distinct().join(parts, "group"))


def compared(docs: DataFrame, members: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each cluster. members: (id, node, n_shingles, cluster, group); sets of one group count as linked already.

    A cluster of up to 64 sets is one block, others have about 32, until blocks are full. A group that would fill blocks has blocks of its own, which aren't compared with each other.
    """
    groups = members.groupBy("cluster", "group").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    full = lambda n, size: F.ceil(F.greatest(n / F.lit(SMALL), size / F.lit(MOST_SHINGLES)))
    large = groups.where(F.col("n") >= SMALL).select("cluster", "group", full(F.col("n"), F.col("size")).cast("int").alias("many"))
    rest = groups.where(F.col("n") < SMALL).groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    by_count = F.when(F.col("n") <= 64, 1).otherwise(F.ceil(F.col("n") / F.least(F.lit(SMALL), F.greatest(F.lit(32), F.ceil(F.col("n") / 32)))))
    rest = rest.select("cluster", F.greatest(by_count, F.ceil(F.col("size") / MOST_SHINGLES)).cast("int").alias("mixed"))
    if large.limit(1).count():
        upto = Window.partitionBy("cluster").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
        large = large.join(rest, "cluster", "left").withColumn("low", (F.coalesce("mixed", F.lit(0)) + F.coalesce(F.sum("many").over(upto), F.lit(0))).cast("int"))
        large = cut(large.select("cluster", "group", "low", (F.col("low") + F.col("many")).alias("high")))
        total = large.groupBy("cluster").agg(F.max("high").alias("above"))
        at = members.join(rest, "cluster", "left").join(total, "cluster", "left").join(large, ["cluster", "group"], "left")
        at = at.withColumn("blocks", F.coalesce("above", "mixed")).withColumn("own", F.when(F.col("low").isNotNull(), F.col("low") + F.pmod(F.xxhash64("node"), F.col("high") - F.col("low"))).otherwise(F.pmod(F.xxhash64("group"), "mixed")).cast("int"))
    else:
        at = members.join(rest, "cluster").withColumn("blocks", F.col("mixed")).withColumn("own", F.pmod(F.xxhash64("group"), "mixed").cast("int")).withColumn("low", F.lit(None).cast("int")).withColumn("high", F.lit(None).cast("int"))
    rows = _rows(docs, cut(at.select("id", "node", "cluster", "blocks", "own", "low", "high")), width)
    paired = rows.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("low IS NULL OR partner < low OR partner >= high")
    paired = paired.select("id", "cluster", "shingles", F.least("own", "partner").alias("x"), F.greatest("own", "partner").alias("y"), (F.col("own") > F.col("partner")).alias("second"))

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        second = np.asarray(table.column("second").to_pylist(), bool)
        one, two = np.flatnonzero(~second), np.flatnonzero(second)
        across = table.column("x")[0] != table.column("y")[0]
        if len(ids) < 2 or across and not (len(one) and len(two)):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        s = _unpacked(table)
        a, b = _links([s[i] for i in one], [s[i] for i in two] if across else None, percent)
        child, root = _forest(ids[np.concatenate([one, two])], a, b)
        return pa.table({"a": pa.array(root), "b": pa.array(child)})

    return paired.groupBy("cluster", "x", "y").applyInArrow(compare, "a long, b long")


def confirmed_links(docs: DataFrame, members: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b): links that connect all that are linked within each cluster. members: (id, node, n_shingles, cluster); a node is one text's set, and the first half of its digest."""
    wait, before, done, found = members.withColumn("group", F.col("id")), None, None, []
    largest = members.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) <= LARGE:
        return compared(docs, wait, percent, width)
    for seed in itertools.count():  # what goes on is at most half as large, so the rounds are few
        now = cut(wait.join(wait.groupBy("cluster").agg(F.count("*").alias("n")), "cluster"))
        again = F.col("n") > LARGE if before is None else (F.col("n") > LARGE) & (2 * F.col("n") <= before)
        # a cluster is numbered by its round too; that two fall together costs comparisons, nothing else
        part = now.where(~again).select("id", "node", "n_shingles", F.xxhash64(F.lit(seed), "cluster").alias("cluster"), "group")
        done = part if done is None else done.unionByName(part)
        large = now.where(again).select("id", "node", "n_shingles", "cluster", "n")
        before = large.agg(F.max("n")).first()[0]
        if before is None:
            break
        links, wait = narrowed(docs, large, percent, width, seed)
        found.append(links)
    out = compared(docs, done, percent, width)
    for links in found:
        out = out.unionByName(links)
    return out


def _classes(got: DataFrame) -> DataFrame:
    """(n_shingles, sig1, sig2, id): each different set with words, and the smallest doc_id that has it (null: none has an id)."""
    return got.where("n_shingles > 0").groupBy("n_shingles", "sig1", "sig2").agg(F.min("doc_id").alias("id"))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, m: int = 12, t: int = 3, exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text, ...).

    Texts with equal sets are one class, of which the smallest doc_id stands for all. Null and empty texts, and those without
    words, have no set and are linked with nothing; their component is their own doc_id. Repeated rows and equal texts
    share a component. A row without doc_id is no node: it gets its class's component, null if no row of the class has an id. Rows that repeat a doc_id with
    another text count as one node of the graph, with the links of all its texts. An empty table gives none. Other columns are not read. With exact all pairs that are linked are found by
    prefixes of the sets, without MinHash.
    """
    return _grouped(docs, percent, width, m, t, exact)[0]


def _grouped(docs: DataFrame, percent: int, width: int, m: int, t: int, exact: bool) -> tuple[DataFrame, DataFrame]:
    """near_duplicates, and the classes."""
    got = cut(sketches(docs, m, t, width))
    classes = _classes(got)
    named = got.join(classes.select("id", "sig1", "sig2"), ["sig1", "sig2"])
    reps = named.where("id = doc_id").select("id", F.col("sig1").alias("node"), "n_shingles", "keys").dropDuplicates(["id", "node"])
    if exact:
        members = reps.select("id", "node", "n_shingles", F.lit(0).cast("long").alias("cluster"))
    else:
        clusters = candidate_clusters(reps.select(F.col("node").alias("id"), "keys"), m)
        members = cut(reps.drop("keys").join(clusters.select(F.col("id").alias("node"), "cluster"), "node"))
    links = confirmed_links(docs, members, percent, width)
    # a doc_id in several classes joins them
    several = cut(got.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("sig1").alias("x"), F.max("sig1").alias("y")).where("x <> y").select("doc_id"))
    if n := several.count():
        own = cut(named.join(sized(several, n), "doc_id").select("doc_id", "id").distinct())
        links = links.unionByName(own.join(own.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("id <> a").select("a", F.col("id").alias("b")))
    found = classes.join(components(links), "id", "left").select("sig1", "sig2", F.coalesce("component", "id").alias("component_id"))
    out = got.drop("keys").join(found, ["sig1", "sig2"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), classes


def _one_each(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each value of `by`: that of the least text, then the least of its other columns as text. Partial minima leave the tasks, so a value may have any number of rows."""
    rest = [c for c in rows.columns if c not in by]
    order = F.struct(F.col("text").cast("string"), F.to_json(F.struct(*[F.col(c) for c in rest if c != "text"])))
    picked = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*by, "_row.*").select(*rows.columns)


def drop_near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, m: int = 12, t: int = 3) -> DataFrame:
    """docs with one row of each group, that of its smallest doc_id; all columns stay. The ids that go are broadcast only if few.

    Of a doc_id's rows one stays: of several texts the least. Of rows without doc_id those go whose words some row with an id has, or another row
    without one (the row of the least text stays); those without words stay.
    """
    found, classes = _grouped(docs, percent, width, m, t, False)
    found = cut(found)
    gone = cut(found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct())
    left = docs.where("doc_id is not null").join(sized(gone, gone.count()), F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    again = cut(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_again")))
    if n := again.count():
        twice = F.col("doc_id").cast("long") == F.col("_again")
        once = left.join(sized(again, n), twice, "left_anti")
        left = once.unionByName(_one_each(left.join(sized(again, n), twice, "left_semi"), ["doc_id"]))
    if found.where("doc_id is null").limit(1).count():
        loose = docs.where("doc_id is null")
        signed = sketches(loose.select(F.lit(0).alias("doc_id"), "text").distinct(), m, t, width, keep_text=True).select("n_shingles", "sig1", "sig2", F.col("text").alias("_text"))
        signed = signed.join(classes.where("id is not null").select("sig1", "sig2"), ["sig1", "sig2"], "left_anti").groupBy("n_shingles", "sig1", "sig2")
        stay = signed.agg(F.min("_text").alias("_text")).where("n_shingles > 0").select("_text")
        worded = _one_each(loose.join(stay, F.col("text").cast("string") == F.col("_text"), "left_semi"), ["text"])
        left = left.unionByName(worded.select(*docs.columns)).unionByName(loose.where(~_has_words(F.col("text"))))
    return left


def _has_words(text: Column) -> Column:
    return F.coalesce(text.cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def op2_query(docs: DataFrame) -> DataFrame:
    """Groups at 85 in 100 over all documents; nulls, empties, repeats and ties as in near_duplicates."""
    return near_duplicates(docs)


OP2_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM tokens
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS h FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_common FROM items a JOIN items b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_common >= 85 * (x.n + y.n - n_common)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.seen)
SELECT s.doc_id, s.n AS n_shingles, min(r.seen) AS component_id, s.doc_id = min(r.seen) AS kept
FROM sizes s JOIN reach r ON r.id = s.doc_id GROUP BY s.doc_id, s.n
"""
