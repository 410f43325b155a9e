"""Operator 8: document quality by a linear-chain conditional random field over lines.

Each line has features of its own and those of the lines before and after it. The field labels every line good or bad;
forward-backward gives each line's marginal of good, and a document's quality is their mean, weighted by the lines' lengths. It is
fitted by gradient ascent on the likelihood of whole documents whose lines all have the document's label. The score is the
probability of label 1 given that quality, by a logistic curve fitted on the same documents at the labels' true shares.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import hashing
from lodestone.llm.samples import sample
from lodestone.llm.shared import schema_with

#: Labelled documents that the field is fitted on, shared equally between both labels, and the lines that one of them teaches at most, a run of its own.
SAMPLE, SAMPLE_LINES = 2_400, 2_000
_KINDS = [lambda b: 97 <= b <= 122, lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: b in b" \t", lambda b: b in b".,;:?'\"()-", lambda b: b in b"!", lambda b: b in b"|", lambda b: b in b"#$%&*@^~=+<>[]{}_\\/`", lambda b: b > 127]
_KIND = np.array([next((k for k, f in enumerate(_KINDS) if f(b)), len(_KINDS)) for b in range(256)])
#: Features of a line, without its neighbours'.
WIDTH = 15


Stats = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _stats(data: np.ndarray, offsets: np.ndarray) -> tuple[Stats, np.ndarray, tuple[int, int]]:
    """Of each line of the texts: bytes by kind, length in bytes, words, and words equal to the one before; each text's first line; and the first and last word of all."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # a text that ends in a line break begins a line where the next text does: lines there belong to texts by their order
    at_text = np.searchsorted(breaks + 1, offsets[:-1], side="right") + np.arange(n)
    first = np.append(at_text, len(start))
    stop = np.append(start[1:], len(data))
    line_of = np.repeat(np.arange(len(start)), stop - start)
    kinds = len(_KINDS) + 1
    counts = np.bincount(line_of * kinds + _KIND[data], minlength=len(start) * kinds).reshape(-1, kinds).astype(float)
    ends_break = np.zeros(len(start))
    np.add.at(ends_break, line_of[breaks], 1)
    counts[:, -1] -= ends_break
    length = (stop - start) - ends_break
    words, word_first = hashing._hash_piece(data, start[start < len(data)], hashing.SPACED)
    of = line_of[word_first] if len(words) else np.zeros(0, np.int64)
    same = np.zeros(len(words))
    if len(words) > 1:
        same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    n_words = np.bincount(of, minlength=len(start)).astype(float)
    repeats = np.bincount(of, weights=same, minlength=len(start))
    return (counts, length, n_words, repeats), first, (int(words[0]), int(words[-1])) if len(words) else (0, 0)


def _features(stats: Stats) -> np.ndarray:
    counts, length, n_words, repeats = stats
    size, letters = np.maximum(length, 1), np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 8], 1)
    some = lambda x, sharp: np.tanh(sharp * x)
    return np.column_stack([
        np.log1p(length) / 8, counts[:, 1] / letters, counts[:, 2] / size, counts[:, 3] / size, counts[:, 4] / size, some(counts[:, 5] / size, 20), some(counts[:, 6] / size, 20), some(counts[:, 7] / size, 20),
        counts[:, 8] / size, some(counts[:, 9] / size, 20), np.minimum(length / np.maximum(n_words, 1), 40) / 10, some(repeats / np.maximum(n_words, 1), 8), n_words == 0, n_words < 4, np.ones(len(length)),
    ])


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of features for each line of the texts, its length in bytes, and each text's first line. Empty texts have one empty line."""
    stats, first, _ = _stats(data, offsets)
    return _features(stats), stats[1], first


def long_lines(data: np.ndarray, piece: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, lengths) of the lines of one long text, as `lines` has them, from pieces of it: a line that goes on in the next piece waits for its rest."""
    held: Stats | None = None
    last, at = 0, 0
    while at < len(data):
        end = min(at + piece, len(data))
        while end < len(data) and hashing.SPACED[data[end - 1]]:  # not within a word
            outside = np.flatnonzero(~hashing.SPACED[data[end : end + 4096]])
            end = end + int(outside[0]) + 1 if len(outside) else min(end + 4096, len(data))
        stats, _, (head, tail) = _stats(data[at:end], np.array([0, end - at]))
        worded = stats[2][-1] > 0
        if held is not None:
            if head and head == last and stats[2][0] > 0:
                stats[3][0] += 1
            for mine, its in zip(stats, held, strict=True):
                mine[0] += its[0]
        last = tail if worded else last if len(stats[1]) == 1 else 0
        held = tuple(x[-1:].copy() for x in stats)
        ready = tuple(x[:-1] for x in stats)
        if len(ready[1]):
            yield _features(ready), ready[1]
        at = end
    if held is None:
        held = _stats(data, np.array([0, 0]))[0]
    yield _features(held), held[1]


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the lines before and after it in its text, or zeros."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.column_stack([x, before, after])


class Field:
    """Weights of the two labels (1 is good): a difference of unary scores and a 2 x 2 matrix of transitions."""

    def __init__(self, unary: np.ndarray | None = None, step: np.ndarray | None = None):
        self.unary = np.zeros(3 * WIDTH) if unary is None else unary
        self.step = np.zeros((2, 2)) if step is None else step
        #: slope and offset of the curve from a quality's log-odds to a score's
        self.curve = (1.0, 0.0)

    def quality(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The mean of each text's marginals; a line weighs one more than its length, so that empty texts have one too."""
        p, _ = self.marginals(x, first)
        return np.add.reduceat(p * (length + 1), first[:-1]) / np.add.reduceat(length + 1, first[:-1])

    def score(self, quality: np.ndarray) -> np.ndarray:
        q = np.clip(quality, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(q / (1 - q)) + self.curve[1])))

    def calibrate(self, quality: np.ndarray, labels: np.ndarray, share: float) -> Field:
        """share: that of label 1 among all labelled rows. Newton's method with a weak pull to the curve that changes nothing."""
        q = np.clip(quality, 1e-6, 1 - 1e-6)
        design = np.column_stack([np.log(q / (1 - q)), np.ones(len(q))])
        weight = np.where(labels == 1, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))
        theta, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            slope = design.T @ (weight * (labels - p)) - (theta - start)
            bend = (design * (weight * p * (1 - p))[:, None]).T @ design + np.eye(2)
            theta = theta + np.linalg.solve(bend, slope)
        self.curve = (float(max(theta[0], 0.05)), float(theta[1]))
        return self

    def marginals(self, x: np.ndarray, first: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The probability of good of each line; with pairs, the expected transitions of all texts too. All texts take each step together."""
        good = x @ self.unary
        counts = np.diff(first)
        by = np.argsort(-counts, kind="stable")
        live = [int(n) for n in np.searchsorted(-counts[by], -np.arange(counts.max()) if len(counts) else [], side="left")]  # texts with more than t lines
        begin = first[:-1][by]
        emit = np.column_stack([np.zeros(len(good)), good])
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        norm = lambda v: v - np.logaddexp(v[:, :1], v[:, 1:])
        for t, n in enumerate(live):
            at = begin[:n] + t
            if t == 0:
                forward[at] = norm(emit[at])
            else:
                prev = forward[at - 1]
                forward[at] = norm(np.column_stack([np.logaddexp(prev[:, 0] + self.step[0, k], prev[:, 1] + self.step[1, k]) for k in (0, 1)]) + emit[at])
        for t in reversed(range(len(live) - 1)):
            at = begin[: live[t + 1]] + t
            nxt = backward[at + 1] + emit[at + 1]
            backward[at] = norm(np.column_stack([np.logaddexp(nxt[:, 0] + self.step[k, 0], nxt[:, 1] + self.step[k, 1]) for k in (0, 1)]))
        both = norm(forward + backward)
        expected = np.zeros((2, 2))
        if pairs:
            inner = np.ones(len(good), bool)
            inner[first[:-1]] = False
            at = np.flatnonzero(inner)
            joint = forward[at - 1][:, :, None] + self.step[None] + (emit[at] + backward[at])[:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            return np.exp(both[:, 1]), joint
        return np.exp(both[:, 1]), expected

    def fit(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> Field:
        """labels: one of 0 and 1 for each text. Texts of either label weigh the same together, and every text the same."""
        doc = np.repeat(np.arange(len(labels)), np.diff(first))
        balance = len(labels) / 2 / np.maximum(np.bincount(labels, minlength=2), 1)
        weight = (balance[labels] / np.diff(first))[doc]
        y = labels[doc].astype(float)
        inner = np.ones(len(y), bool)
        inner[first[:-1]] = False
        theta = np.concatenate([self.unary, self.step.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, rounds + 1):
            self.unary, self.step = theta[:-4], theta[-4:].reshape(2, 2)
            p, joint = self.marginals(x, first, pairs=True)
            up = x.T @ (weight * (y - p)) / len(labels)
            seen = np.zeros_like(joint)
            own = y[inner].astype(int)
            seen[np.arange(len(own)), own, own] = 1
            trans = ((seen - joint) * weight[inner][:, None, None]).sum(axis=0) / len(labels)
            g = np.concatenate([up, trans.ravel()]) - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.unary, self.step = theta[:-4], theta[-4:].reshape(2, 2)
        return self


def long_quality(data: np.ndarray, field: Field, piece: int = 1 << 20) -> float:
    """The quality of one long text, as `Field.quality` has it, line by line: of each line its unary score, one message and its length stay, 12 bytes in all."""
    good, length = array("f"), array("f")
    before, waiting = np.zeros((1, WIDTH)), None

    def push(rows: np.ndarray, after: np.ndarray) -> None:
        nonlocal before
        around = np.vstack([before, rows, after])
        good.frombytes((np.column_stack([rows, around[:-2], around[2:]]) @ field.unary).astype(np.float32).tobytes())
        before = rows[-1:]

    for x, n in long_lines(data, piece):
        length.frombytes(n.astype(np.float32).tobytes())
        if waiting is not None:
            push(waiting, x[:1])
        waiting = x
    push(waiting, np.zeros((1, WIDTH)))
    # messages as log-odds of good
    (a, b), (c, d) = field.step.tolist()
    forward, now = array("f"), None
    for g in good:
        now = g if now is None else g + _log_odds(now, a, b, c, d)
        forward.append(now)
    total = weight = 0.0
    back = 0.0
    for k in range(len(good) - 1, -1, -1):
        odds = forward[k] + back
        p = 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0
        total += p * (length[k] + 1)
        weight += length[k] + 1
        back = _log_odds(back + good[k], a, c, b, d)
    return total / weight


def _log_odds(r: float, bad_bad: float, bad_good: float, good_bad: float, good_good: float) -> float:
    """The log-odds of good of a line, from the log-odds r of the one beside it and the scores of steps (of that line to this one)."""
    if r > 0:
        e = math.exp(-r)
        return math.log(e * math.exp(bad_good) + math.exp(good_good)) - math.log(e * math.exp(bad_bad) + math.exp(good_bad))
    e = math.exp(max(r, -700.0))
    return math.log(math.exp(bad_good) + e * math.exp(good_good)) - math.log(math.exp(bad_bad) + e * math.exp(good_bad))


def score_texts(column: pa.Array, field: Field, piece: int = 1 << 20) -> np.ndarray:
    """A score from 0 to 1 for each text. Texts beyond a piece go line by line, so that memory grows by 12 bytes a line alone."""
    data, offsets = hashing.flat(column)
    out = np.zeros(len(column))
    for i, j in hashing.ranges(offsets, piece):
        if j - i == 1 and offsets[j] - offsets[i] > piece:
            out[i] = field.score(np.array([long_quality(data[offsets[i] : offsets[j]], field, piece)]))[0]
            continue
        x, length, first = lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out[i:j] = field.score(field.quality(with_neighbours(x, first), length, first))
    return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, learn: object, label: str = "quality", most: int = SAMPLE) -> Field:
    """Learns from a sample of the labelled rows where `learn` holds; the sample's line features reach the driver, and nothing else: 60 bytes a line, of
    `SAMPLE_LINES` lines of a document at most, in the middle of it, and of one row of those that repeat a doc_id.

    Labels other than 0 and 1 and those of unknown documents don't count. Without both labels every score is 0.5.
    """
    known = labels.where(learn).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = sample(known, "label", most).groupBy("doc_id").agg(F.max("label").alias("label")).select(F.col("doc_id").alias("_k"), "label")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_k")).select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = hashing.flat(b.column("text"))
            parts = []
            for i in range(len(offsets) - 1):
                x = np.concatenate([x.astype(np.float32) for x, _ in long_lines(data[offsets[i] : offsets[i + 1]])])
                skip = max(0, len(x) - SAMPLE_LINES) // 2
                parts.append(x[skip : skip + SAMPLE_LINES].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(parts, pa.binary())], ["doc_id", "label", "x"])

    one = rows.mapInArrow(run, "doc_id long, label int, x binary").groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("m")).select("doc_id", "m.label", "m.x")
    got = sorted(one.collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    if len({r["label"] for r in got}) < 2:
        return Field()
    own = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH).astype(float) for r in got]
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    x = np.concatenate(own)
    y, wide = np.array([r["label"] for r in got]), with_neighbours(x, first)
    own = Field().fit(wide, first, y)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return own.calibrate(own.quality(wide, np.expm1(8 * x[:, 0]), first), y, counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, field: Field, text: str = "text", name: str = "score") -> DataFrame:
    """docs with each text's score (null texts count as empty). A column of that name is replaced."""
    rest = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_texts(b.column(text), field), pa.float64())], [*b.schema.names, name])

    return rest.mapInArrow(run, schema_with(rest, **{name: T.DoubleType()}))


def op8_query(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Learns where the checksum of doc_id modulo 4 isn't 2, scores everything. Null texts count as empty, which have a score too; of a document's contradicting labels 1 counts; rows without
    doc_id aren't held out, and teach nothing; repeated rows get equal scores; an empty table gives none."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    field = fit(docs, labels, ~held)
    scored = score(docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text")), field)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
