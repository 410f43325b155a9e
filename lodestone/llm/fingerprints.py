"""Operator 1: document fingerprints by one-permutation MinHash.

Every 5-word shingle is hashed once. The high bits of the hash choose one of `bins` bins, the rest competes for the bin's
minimum. An empty bin takes over the minimum of the first bin with one in a fixed random order of its own (optimal
densification, drawn without replacement, so that it always ends). Of each bin's value `bits` low-order bits are kept, after
mixing it with the bin's number, and packed. Two fingerprints agree in a bin with probability J + (1 - J) / 2**bits, which
`likeness` inverts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import hashing
from lodestone.llm.shared import range_buckets, schema_with

U = np.uint64


class Sketcher:
    """Packed fingerprints of texts. `bins` is a power of two, `bits` divides 8."""

    def __init__(self, bins: int = 512, bits: int = 4, width: int = 5):
        if bins & (bins - 1) or bins < 8 or 8 % bits:
            raise ValueError("bins must be a power of two of 8 or more, bits 1, 2, 4 or 8")
        self.bins, self.bits, self.width = bins, bits, width
        self.order = np.argsort(hashing.stream(23, bins * bins).reshape(bins, bins), axis=1, kind="stable")
        self.own = hashing.stream(29, bins)

    def minima(self, runs: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row for each text with the least hash of each bin; all bits set where none fell into it."""
        n, empty = len(first) - 1, U(0xFFFFFFFFFFFFFFFF)
        low = np.full(n * self.bins, empty)
        h = hashing.mix(runs)
        bin_of = (h >> U(64 - int(self.bins).bit_length() + 1)).astype(np.int64)
        with np.errstate(over="ignore"):
            rest = hashing.mix(h * U(0x9FB21C651E98DF25)) >> U(1)
        np.minimum.at(low, np.repeat(np.arange(n) * self.bins, np.diff(first)) + bin_of, rest)
        return low.reshape(n, self.bins)

    def pack(self, low: np.ndarray) -> np.ndarray:
        """Fills the empty bins of texts that have any shingle, and packs the low-order bits: a row of bytes for each text."""
        full = low != U(0xFFFFFFFFFFFFFFFF)
        source = np.where(full, np.arange(self.bins), -1)
        row, col = np.nonzero(~full & full.any(axis=1, keepdims=True))
        for attempt in range(self.bins):
            if not len(row):
                break
            donor = self.order[col, attempt]
            good = full[row, donor]
            source[row[good], col[good]] = donor[good]
            row, col = row[~good], col[~good]
        value = np.take_along_axis(low, np.maximum(source, 0), axis=1)
        small = (hashing.mix(value ^ self.own) & U((1 << self.bits) - 1)).astype(np.uint8)
        per = 8 // self.bits
        small = small.reshape(len(low), -1, per)
        out = np.zeros(small.shape[:2], np.uint8)
        for k in range(per):
            out |= small[:, :, k] << np.uint8(k * self.bits)
        return out

    def packed(self, texts: list[str]) -> list[bytes]:
        """Empty bytes for texts without words."""
        out: list[bytes] = []
        for _, _, _, runs, first in hashing.grouped(pa.array(texts, pa.large_string()), hashing.SPACED, self.width):
            rows = self.pack(self.minima(runs, first))
            out += [r.tobytes() if some else b"" for r, some in zip(rows, np.diff(first) > 0, strict=True)]
        return out

    def likeness(self, a: bytes, b: bytes) -> float:
        """The estimated Jaccard likeness, from 0 to 1, free of chance agreements; that of texts without words is 1 with each other and else 0."""
        if not a or not b:
            return float(a == b)
        x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
        per, mask = 8 // self.bits, np.uint8((1 << self.bits) - 1)
        same = sum(int(np.count_nonzero(((x >> np.uint8(k * self.bits)) & mask) == 0)) for k in range(per)) / self.bins
        chance = 0.5**self.bits
        return min(1.0, max(0.0, (same - chance) / (1.0 - chance)))


def text_of(packed: bytes) -> str:
    return base64.b64encode(packed).decode()


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", **kind: int) -> DataFrame:
    """docs with a column of fingerprints (Base64; '' for null, empty or word-less texts). A column of that name is replaced."""
    rest = docs.drop(name) if name != text else docs
    schema = schema_with(rest, **{name: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(**kind)
        for b in batches:
            got = sketcher.packed(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([text_of(x) for x in got], pa.string())], [*b.schema.names, name])

    return rest.mapInArrow(run, schema)


def with_next(docs: DataFrame, function: Callable[[Iterator[tuple[int, str, int, str]]], Iterator[tuple]], schema: str) -> DataFrame:
    """Runs `function` over (doc_id, text, next doc_id, next text) in ascending doc_id, each row with its successor's text; the last row's successor is the first row.

    Ranges of doc_id are shuffled once, each with a copy of the first row of the following range as its last row, so rows
    stream by and no task holds more than two texts. Equal doc_ids follow each other by text; null ids come first; null texts are empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bucket, n = range_buckets(rows, "doc_id", least=docs.sparkSession.sparkContext.defaultParallelism)
    heads = sorted((r["b"], r["d"]) for r in rows.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), bucket(F.col("doc_id")).alias("b")).groupBy("b").agg(F.min("d").alias("d")).collect())
    before = {d: heads[i - 1][0] for i, (_, d) in enumerate(heads)}  # of a range's first row: the range before, around the end
    placed = rows.select("doc_id", "text", bucket(F.col("doc_id")).alias("b"), F.lit(0).alias("tail"))
    if heads:
        lookup = F.create_map(*[F.lit(int(x)) for kv in before.items() for x in kv])
        firsts = rows.where(F.coalesce("doc_id", F.lit(-(2**63))).isin(list(before))).groupBy("doc_id").agg(F.min("text").alias("text"))
        tails = firsts.select("doc_id", "text", F.element_at(lookup, F.coalesce("doc_id", F.lit(-(2**63)))).cast("int").alias("b"), F.lit(1).alias("tail"))
        placed = placed.unionByName(tails)
    dealt = placed.repartition(n, "b").sortWithinPartitions("b", "tail", F.asc_nulls_first("doc_id"), "text")
    names = [f.strip().split()[0] for f in schema.split(",")]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, int, str]]:
        last = None
        for batch in batches:
            for i, t, b, tail in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "b", "tail")), strict=True):
                if last is not None and last[2] == b:
                    yield last[0], last[1], i, t
                last = None if tail else (i, t, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in function(pairs(batches)):
            out.append(row)
            if len(out) >= 500:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)), arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)), arrow)

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    arrow = pa.schema([(f.strip().split()[0], kinds[f.strip().split()[1]]) for f in schema.split(",")])
    return dealt.mapInArrow(run, schema)


def op1_query(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is replaced by the beginning of the next document's."""

    def run(rows: Iterator[tuple[int, str, int, str]]) -> Iterator[tuple]:
        sketcher = Sketcher()
        held: list[tuple] = []

        def done() -> Iterator[tuple]:
            edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for _, t, _, nxt in held]
            # a row's next text is fingerprinted with the row after it, unless the rows end here
            alone = [k for k in range(len(held)) if k + 1 == len(held) or held[k + 1][0] != held[k][2] or held[k + 1][1] != held[k][3]]
            got = sketcher.packed([t for _, t, _, _ in held] + edited + [held[k][3] for k in alone])
            n = len(held)
            after = dict(zip(alone, got[2 * n :], strict=True))
            for k, (i, t, _, _) in enumerate(held):
                own, changed, nxt = got[k], got[n + k], after[k] if k in after else got[k + 1]
                yield i, len(t), hashlib.sha256(edited[k].encode()).hexdigest(), text_of(own), text_of(changed), sketcher.likeness(own, changed), sketcher.likeness(own, nxt)

        size = 0
        for row in rows:
            held.append(row)
            size += len(row[1])
            if size > 1_000_000 or len(held) >= 1000:
                yield from done()
                held, size = [], 0
        if held:
            yield from done()

    return with_next(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
