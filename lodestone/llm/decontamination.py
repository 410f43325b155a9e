"""Operator 7: benchmark decontamination by an FM-index per training shard.

A shard is a run of documents of `SHARD_BYTES` at most, or one longer document, as they come from a scan; nothing is shuffled. All its words become symbols of the shard's own vocabulary, with a
0 between documents; the FM-index over them has the Burrows-Wheeler transform in a wavelet tree (bit vectors with sampled rank counts) and every
fourth suffix position, and those where documents begin. It knows nothing of the phrases, so it can be asked any. All phrases whose words the shard has are searched backwards
at once; occurrences are located by walking to a sampled position; the spans they cover are merged for each document.

Phrases come in blocks of at most `block_words` words, which the tasks hold one at a time: a single block of up to `BROADCAST_ROWS` windows goes
with the code, others are written to the shared folder and read from there, so memory doesn't grow with the benchmark. The driver streams the benchmark's texts, block by block.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import hashing
from lodestone.llm.shared import BROADCAST_ROWS
from lodestone.llm.stores import new_store, open_store

U = np.uint64
SHARD_BYTES = 4 << 20


class Bits:
    """A bit vector that tells how many of its first k bits are set."""

    def __init__(self, bits: np.ndarray):
        self.packed = np.packbits(np.concatenate([bits, np.zeros(72, bool)]), bitorder="little")
        words = len(bits) // 64 + 1
        self.words = self.packed[: words * 8].view(U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, k: np.ndarray) -> np.ndarray:
        word, rest = k >> 6, (k & 63).astype(U)
        return self.before[word] + np.bitwise_count(self.words[word] & ((U(1) << rest) - U(1)))


class Wavelet:
    """Ranks of symbols in a sequence: one bit vector for each bit of the symbols, high bit first, zeros before ones at every level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        for d in reversed(range(self.depth)):
            bit = ((sequence >> d) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def rank(self, symbol: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first k."""
        low, high = np.zeros_like(k), k
        for n, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = ((symbol >> (self.depth - 1 - n)) & 1).astype(bool)
            a, b = level.rank(low), level.rank(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def access(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it is before that position."""
        low, high, symbol = np.zeros_like(k), k, np.zeros_like(k)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            a, b = level.rank(low), level.rank(high)
            one = (level.rank(high + 1) - b).astype(bool)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
            symbol = symbol * 2 + one
        return symbol, high - low


def _places(n: int) -> type:
    """The type for places in n symbols and their doubles: half the memory wherever that does."""
    return np.int32 if n < 1 << 29 else np.int64


def _heads(new: np.ndarray, kind: type) -> np.ndarray:
    """For each position of a sorted run the place of the first that is equal; new: where it differs from the one before."""
    group = np.cumsum(new, dtype=kind)
    group -= 1
    return np.flatnonzero(new).astype(kind)[group]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of text in order, by doubling; only suffixes not yet told apart are sorted again."""
    n = len(text)
    kind = _places(n)
    order = np.argsort(text, kind="stable").astype(kind)
    new = np.ones(n, bool)
    sorted_ = text[order]
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    del sorted_
    # a rank is the place of the first of equal suffixes, so that parts can be refined in place; past the end there is less than any
    place = _heads(new, kind)
    rank = np.empty(n + 1, kind)
    rank[order], rank[n] = place, -1
    step = 1
    while True:
        alike = place[1:] == place[:-1]
        unsure = np.zeros(n, bool)
        unsure[1:] = alike
        unsure[:-1] |= alike
        open_ = np.flatnonzero(unsure).astype(kind)
        del alike, unsure
        if not len(open_):
            return order
        suffix = order[open_]
        key = place[open_].astype(np.int64)
        key *= n + 1
        key += rank[np.minimum(suffix + kind(step), kind(n))]
        key += 1
        by = np.argsort(key, kind="stable")
        order[open_] = suffix = suffix[by]
        key = key[by]
        del by
        new = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        del key
        place[open_] = open_[_heads(new, kind)]
        rank[suffix] = place[open_]
        step *= 2


class FMIndex:
    """Counts and locates words sequences in a sequence of symbols above 0; 0 parts its stretches."""

    def __init__(self, stretches: np.ndarray, symbols: int, every: int = 4):
        self.n, self.every = len(stretches) + 1, every
        text = np.zeros(self.n, _places(max(self.n, symbols)))
        text[:-1] = stretches
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        order = suffix_order(text)
        before = text[order - 1]
        # where a stretch begins there is a sample too, so that no walk goes on through a 0
        marked = (order % every == 0) | (before == 0)
        self.marked, self.sampled = Bits(marked), order[marked]
        del order, marked
        self.wavelet = Wavelet(before, symbols)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the end row of the suffixes that begin with each phrase. phrases: a row each, right-aligned."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > k) & (low < high))
            s = phrases[live, phrases.shape[1] - 1 - k]
            low[live] = self.below[s] + self.wavelet.rank(s, low[live])
            high[live] = self.below[s] + self.wavelet.rank(s, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows begin."""
        out, at, walked = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = at[live]
            before = self.marked.rank(r)
            hit = self.marked.rank(r + 1) > before
            out[live[hit]] = self.sampled[before[hit]] + walked[live[hit]]
            live, r = live[~hit], r[~hit]
            symbol, upto = self.wavelet.access(r)
            at[live] = self.below[symbol] + upto
            walked[live] += 1
        return out


class Phrases:
    """Windows of items: word hashes become symbols from 1."""

    def __init__(self, windows: dict[tuple[int, ...], list[int]], width: int):
        keys = [*windows]
        self.lengths = np.array([len(k) for k in keys], np.int64)
        flat = np.array([h for k in keys for h in k], U)
        self.vocabulary = np.unique(flat)
        ids = np.searchsorted(self.vocabulary, flat) + 1
        first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.table = np.zeros((len(keys), width), np.int64)
        for n in np.unique(self.lengths):
            own = np.flatnonzero(self.lengths == n)
            self.table[own, width - n :] = ids[first[own][:, None] + np.arange(n)]
        self.items = [windows[k] for k in keys]


def windows_of(items: Iterator[tuple[object, str | None]], width: int, block_words: int) -> Iterator[Phrases]:
    """Blocks of the different windows of (id, text) items; an item of fewer words than width, but not none, is one window. Windows of null ids have no id."""
    windows: dict[tuple[int, ...], list] = {}
    size = 0
    for i, text in items:
        data, offsets = hashing.flat(pa.array([text], pa.large_string()))
        h = hashing.word_hashes(data, offsets, hashing.ALNUM)[0].tolist()
        for k in range(max(1, len(h) - width + 1) if h else 0):
            size += width * (tuple(h[k : k + width]) not in windows)
            own = windows.setdefault(tuple(h[k : k + width]), [])
            if i is not None and (not own or own[-1] != i):
                own.append(i)
        if size >= block_words:
            yield Phrases(windows, width)
            windows, size = {}, 0
    if windows:
        yield Phrases(windows, width)


def _numbered(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted vocabulary of words, and the number in it of each word, from 1."""
    kind = _places(len(words))
    order = np.argsort(words).astype(kind)
    sorted_ = words[order]
    new = np.ones(len(words), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    vocabulary = sorted_[new]
    del sorted_
    symbol = np.empty(len(words), kind)
    symbol[order] = np.cumsum(new, dtype=kind)
    return vocabulary, symbol


class Shard:
    """The FM-index of a run of documents, given as word hashes, and where each begins (one more entry than documents)."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        #: where documents begin in the indexed text, in which each has a 0 at its end
        self.begin = first[:-1] + np.arange(len(first) - 1)
        text = np.zeros(len(words) + len(first) - 1, _places(len(words) + len(first)))
        inside = np.ones(len(text), bool)
        inside[first[1:] + np.arange(len(first) - 1)] = False
        self.vocabulary, text[inside] = _numbered(words)
        del inside
        self.index = FMIndex(text, len(self.vocabulary) + 1)

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences: first word, end word, and the window's number."""
        at = np.searchsorted(self.vocabulary, phrases.vocabulary)
        at[at == len(self.vocabulary)] = 0
        # a phrase's symbols as the shard's; 0 stands for no word, a word that the shard lacks leaves its phrases out
        known = np.concatenate([[True], self.vocabulary[at] == phrases.vocabulary]) if len(self.vocabulary) else np.zeros(len(at) + 1, bool)
        wanted = np.flatnonzero(known[phrases.table].all(axis=1))
        if not len(wanted):
            return (np.zeros(0, np.int64),) * 3
        low, high = self.index.search(np.concatenate([[0], at + 1])[phrases.table[wanted]], phrases.lengths[wanted])
        n = np.maximum(high - low, 0)
        found = np.repeat(wanted, n)
        rows = np.arange(n.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        place = self.index.locate(rows)
        begin = place - (np.searchsorted(self.begin, place, side="right") - 1)
        return begin, begin + phrases.lengths[found], found


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 8, block_words: int = 2_000_000, item: str = "item_id") -> DataFrame:
    """(doc_id, n_words, spans, items) of each row of docs: merged spans of hit words (first, end) and the ids of items with occurring windows, ascending.

    Words are runs of ASCII letters and digits (capitals as small letters) and characters beyond ASCII. Null and empty texts have no words, items of null text
    no windows; without a benchmark nothing is hit. Ids may be of any type that can be ordered, and keep it. Repeated items count as they are named: equal ids once; words
    that items without id hit are in spans, but there is no id to list. Repeated rows of docs are rows like any other.
    """
    return _scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text")), benchmark, width, block_words, item).drop("_text")


def _scanned(docs: DataFrame, benchmark: DataFrame, width: int = 8, block_words: int = 2_000_000, item: str = "item_id") -> DataFrame:
    """docs (with `_text`, and no columns of the names that follow) and n_words, spans, items."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    source = benchmark.select(F.col(item), F.col("text").cast("string").alias("text")).toLocalIterator()
    blocks = windows_of(((r[0], r[1]) for r in source), width, block_words)
    head, second = next(blocks, None), next(blocks, None)
    inline, paths = ([head] if head is not None else []), []
    if second is not None or head is not None and len(head.table) > BROADCAST_ROWS:
        where = new_store(spark, "benchmark")
        store, base = open_store(where)
        for k, block in enumerate(itertools.chain(filter(None, [head, second]), blocks)):
            with store.open_output_stream(f"{base}/{k}.pickle") as f:
                f.write(pickle.dumps(block))
            paths.append(f"{where}/{k}.pickle")
        inline = []

    def load() -> Iterator[Phrases]:
        yield from inline
        for path in paths:
            store, at = open_store(path)
            with store.open_input_stream(at) as f:
                yield pickle.loads(f.read())  # noqa: S301  written by this job

    kind = benchmark.schema[item].dataType
    id_type = to_arrow_type(kind)
    def search(rows: list[pa.RecordBatch], texts: list[pa.Array]) -> pa.RecordBatch:
        column, names = pa.chunked_array(texts), pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        data, offsets = hashing.flat(column)
        parts = [(i, *hashing.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hashing.ALNUM)) for i, j in hashing.ranges(offsets)]
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(f) for *_, f in parts)])
        first = np.concatenate([[0], np.cumsum(sizes)])
        words = np.concatenate([np.zeros(0, U), *(w for _, w, _ in parts)])
        del parts
        n, begins, ends, hit_items = len(words), [], [], [set() for _ in range(names.num_rows)]
        shard = Shard(words, first)
        del words
        for phrases in load():
            begin, end, found = shard.search(phrases)
            begins.append(begin)
            ends.append(end)
            for d, w in {*zip((np.searchsorted(first, begin, side="right") - 1).tolist(), found.tolist(), strict=True)}:
                hit_items[d].update(phrases.items[w])
        cover = np.zeros(n + 1, np.int64)
        for begin, end in zip(begins, ends, strict=True):
            np.add.at(cover, begin, 1)
            np.add.at(cover, end, -1)
        hit = np.cumsum(cover)[:-1] > 0
        doc = np.repeat(np.arange(len(sizes)), sizes)
        left = hit & ~np.concatenate([[False], hit[:-1] & (doc[1:] == doc[:-1])]) if len(hit) else hit
        right = hit & ~np.concatenate([hit[1:] & (doc[1:] == doc[:-1]), [False]]) if len(hit) else hit
        a, b = np.flatnonzero(left), np.flatnonzero(right) + 1
        spans: list[list] = [[] for _ in range(names.num_rows)]
        for d, x, y in zip(doc[a].tolist(), a.tolist(), b.tolist(), strict=True):
            spans[d].append({"first": x - int(first[d]), "end": y - int(first[d])})
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([*names.columns, pa.array(sizes), pa.array(spans, span), pa.array([sorted(s) for s in hit_items], pa.list_(id_type))], [*names.schema.names, "n_words", "spans", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, size = [], [], 0
        for batch in batches:
            column = batch.column("_text").cast(pa.large_string())
            _, offsets = hashing.flat(column)
            i = 0
            while i < batch.num_rows:
                j = int(np.searchsorted(offsets, offsets[i] + SHARD_BYTES - size, side="right")) - 1
                if rows and (j <= i or len(rows) > 1000):
                    yield search(rows, texts)
                    rows, texts, size = [], [], 0
                    continue
                j = max(j, i + 1)
                rows.append(batch.slice(i, j - i))
                texts.append(column.slice(i, j - i))
                size += int(offsets[j] - offsets[i])
                i = j
            if rows:  # what waits for the next batch is copied, so that it doesn't keep this one
                rows[-1] = rows[-1].take(pa.array(np.arange(rows[-1].num_rows)))
                texts[-1] = rows[-1].column("_text").cast(pa.large_string())
        if rows:
            yield search(rows, texts)

    more = T._parse_datatype_string("n_words long, spans array<struct<first: long, end: long>>").fields
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more, T.StructField("items", T.ArrayType(kind))]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, items: int = 1) -> DataFrame:
    """docs without those in which windows of at least `items` items occur (of 1: any window), row by row, with or without doc_id. All columns stay."""
    names = docs.columns
    numbered = docs.select(*[F.col(f"`{c}`").alias("_text" if c == "text" else f"_{k}") for k, c in enumerate(names)])
    hit = F.size("items") >= items if items > 1 else F.size("spans") > 0
    left = _scanned(numbered.withColumn("_text", F.col("_text").cast("string")), benchmark).where(~hit)
    return left.select(*[F.col("_text" if c == "text" else f"_{k}").alias(c) for k, c in enumerate(names)])


def op7_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hit words and items of every document. Null and empty texts have no words; an item without id hits words but isn't counted or listed; repeated rows and null doc_ids are rows like any other."""
    found = contamination(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])
    joined = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n.alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


OP7_SQL = r"""
WITH w AS (SELECT 0 AS bench, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
phrases AS (SELECT DISTINCT id AS item, least(len(w), 8) AS n, array_to_string(w[i:i + 7], ' ') AS p FROM w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS t(i) WHERE bench = 1 AND len(w) > 0),
lengths AS (SELECT DISTINCT n FROM phrases),
places AS (SELECT id, i, l.n, array_to_string(w[i:i + l.n - 1], ' ') AS p FROM w, lengths l, unnest(range(1, len(w) - l.n + 2)) AS t(i) WHERE bench = 0),
hits AS (SELECT id, i, places.n, item FROM places JOIN phrases ON places.p = phrases.p AND places.n = phrases.n),
cover AS (SELECT id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS t(k) GROUP BY id),
found AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR)) AS items FROM hits GROUP BY id)
SELECT w.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN cover ON cover.id = w.id LEFT JOIN found ON found.id = w.id WHERE bench = 0
"""
