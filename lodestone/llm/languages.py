"""Operator 5: language identification by error-correcting output codes.

A text is the counts of its byte trigrams (ASCII in lower case, runs of other ASCII than letters as one space), hashed into
`FEATURES` cells, under square root and scaled to length 1. Every language has a codeword of +1 and -1; for each bit one binary
classifier (ridge regression) predicts it from the features. A text gets the language whose codeword has the least
weighted loss, a bit weighing for a language by how well its classifier does on that language (leave-one-out). The score is
the softmax of the losses; `ambiguous` flags texts whose best two codewords are nearly as close.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import hashing
from lodestone.llm.samples import sample
from lodestone.llm.shared import schema_with

FEATURES = 4096
#: Labelled rows that the classifiers are fitted on, shared equally among the languages.
SAMPLE = 1_200
#: Different trigrams from which on a text says enough for a low score to mean another language.
TRIGRAMS = 100
_FOLD = np.array([b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint32)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """For runs of rows: the first, and a row of features for each."""
    data, offsets = hashing.flat(column)
    for i, j in hashing.ranges(offsets, 1 << 18):
        counts = np.zeros((j - i, FEATURES + 1))
        for at in range(int(offsets[i]), int(offsets[j]), hashing.PIECE):  # a long text is counted piece by piece
            b = _FOLD[data[max(at - 2, offsets[i]) : min(at + hashing.PIECE, offsets[j])]]
            if len(b) < 3:
                continue
            code = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(20)
            code[(b[:-2] == 32) & (b[1:-1] == 32)] = FEATURES
            own = offsets[i : j + 1] - max(at - 2, offsets[i])
            doc = np.repeat(np.arange(j - i), np.diff(np.clip(own, 0, len(b))))[: len(b) - 2]
            for k in (1, 2):  # trigrams that would reach into the next text
                edge = own[1:-1] - k
                code[edge[(edge >= 0) & (edge < len(code))]] = FEATURES
            counts += np.bincount(doc * (FEATURES + 1) + code, minlength=counts.size).reshape(counts.shape)
        x = np.sqrt(counts[:, :FEATURES]).astype(np.float32)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        yield i, x / np.where(norm > 0, norm, 1)


def codewords(classes: int) -> np.ndarray:
    """A row of +1 and -1 for each class: all ways to part up to 6 classes in two, else the best of random matrices of about 10 log2(classes) bits."""
    if classes <= 1:
        return np.zeros((classes, 0))
    if classes <= 6:
        return np.array([[1 if c == 0 or not (b >> (c - 1)) & 1 else -1 for b in range(1, 2 ** (classes - 1))] for c in range(classes)])
    rng, best, least = np.random.default_rng(7), None, -1
    width = int(np.ceil(10 * np.log2(classes)))
    for _ in range(200):
        m = rng.choice([-1, 1], (classes, width))
        if (np.abs(m.sum(axis=0)) == classes).any():
            continue
        d = ((width - m @ m.T) // 2 + width * np.eye(classes, dtype=int)).min()
        if d > least:
            best, least = m, d
    return best


class Model:
    """Fitted classifiers. rows of x belong to the languages in y."""

    def __init__(self, x: np.ndarray, y: list[str], ridge: float = 0.05):
        self.names = sorted(set(y))
        self.code = codewords(len(self.names))
        #: by row of x the score it gets from the others, and the score below which texts of `TRIGRAMS` trigrams are in no learned language (see fit)
        self.alone, self.floor = np.ones(len(x)), 0.0
        self.weights, self.bias, self.trust = np.zeros((FEATURES, self.code.shape[1]), np.float32), np.zeros(self.code.shape[1]), np.ones(self.code.shape)
        if len(self.names) < 2:
            return
        x = x.astype(np.float64)
        own = np.array([self.names.index(v) for v in y])
        target = self.code[own].astype(float)
        # equal weight for every language, whatever its rows
        w = (1 / np.bincount(own, minlength=len(self.names)))[own] * len(own) / len(self.names)
        self.bias = np.average(target, axis=0, weights=w)
        kernel = x @ x.T
        inverse = np.linalg.inv(kernel + np.diag(ridge / w))
        alpha = inverse @ (target - self.bias)
        self.weights = (x.T @ alpha).astype(np.float32)
        loo = target - alpha / np.diag(inverse)[:, None]
        right = (np.sign(loo) == target).astype(float)
        for c in range(len(self.names)):
            self.trust[c] = np.maximum(right[own == c].mean(axis=0), 0.01)
        self.trust /= self.trust.sum(axis=1, keepdims=True)
        self.alone = self._shares(loo).max(axis=1)

    def _shares(self, margin: np.ndarray, sharpness: float = 8.0) -> np.ndarray:
        """The languages' shares for each row of the classifiers' margins."""
        loss = np.exp(-margin[:, None, :] * self.code[None])
        distance = (loss * self.trust[None]).sum(axis=2)
        p = np.exp(-sharpness * (distance - distance.min(axis=1, keepdims=True)))
        return p / p.sum(axis=1, keepdims=True)

    def decode(self, x: np.ndarray, sharpness: float = 8.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row the position of the nearest codeword's language, its share, and the share of the next."""
        if len(self.names) < 2:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x))
        p = self._shares(x @ self.weights + self.bias, sharpness)
        order = np.argsort(-p, axis=1, kind="stable")
        return order[:, 0], np.take_along_axis(p, order[:, :1], 1)[:, 0], np.take_along_axis(p, order[:, 1:2], 1)[:, 0]


def enough(x: np.ndarray) -> np.ndarray:
    return np.count_nonzero(x, axis=1) >= TRIGRAMS


def fit(docs: DataFrame, learn: object, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = SAMPLE) -> Model:
    """Learns from a sample of the rows where `learn` (a condition) holds and the language isn't null. Only the sample's features reach the driver, 8 KB a key:
    of the rows that repeat a sampled key one counts, and partial minima leave the tasks, however many they are.

    The model's floor lies a third of the way from chance to the leave-one-out score that 99 in 100 of the sample's texts of `TRIGRAMS` trigrams reach.
    """
    chosen = sample(docs.where(learn).where(F.col(lang).isNotNull()), lang, most, key)
    picked = chosen.groupBy(F.col(key).alias("_k")).agg(F.min(lang).alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in features(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("y").slice(i, len(x)), b.column("k").slice(i, len(x)).cast(pa.string()), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["y", "k", "x"])

    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(F.broadcast(picked), "_k").select(F.col("_k").alias("k"), F.col("_y").alias("y"), "text")
    one = rows.mapInArrow(run, "y string, k string, x binary").groupBy("k").agg(F.min(F.struct("y", "x")).alias("m")).select("k", "m.y", "m.x")
    got = sorted(one.collect(), key=lambda r: (r["k"], r["y"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float16) for r in got], np.float32).reshape(-1, FEATURES)
    model = Model(x, [r["y"] for r in got])
    alone = model.alone[enough(x)]
    if len(model.names) > 1 and len(alone):
        model.floor = float(2 / len(model.names) + np.quantile(alone, 0.01)) / 3
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", margin: float = 0.2, foreign: bool = False) -> DataFrame:
    """docs with lang_pred, score and ambiguous (columns of these names are replaced), on request also foreign: whether a text has trigrams enough and a score below the model's floor.

    lang_pred is `und`, with score 0, where the text is null or has no letter, or no language was learned. Only the text is looked at. Of languages equally near the first by name is predicted;
    repeated rows get equal predictions; an empty table gives none.
    """
    names = ["lang_pred", "score", "ambiguous", *["foreign"][: int(foreign)]]
    rest = docs.drop(*names)
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    letter_at = next(c for c in ("_letter" + "_" * k for k in range(len(rest.columns) + 1)) if c.lower() not in {x.lower() for x in rest.columns})
    wide = rest.withColumn(letter_at, has_letter)
    schema, keep = schema_with(rest, lang_pred=T.StringType(), score=T.DoubleType(), ambiguous=T.BooleanType(), **dict.fromkeys(names[3:], T.BooleanType())), list(rest.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letter = b.column(letter_at).to_pylist()
            langs, scores, unsure, no = [], [], [], []
            for i, x in features(b.column(text)):
                best, p, q = model.decode(x)
                no += ((p < model.floor) & enough(x)).tolist()
                for k in range(len(x)):
                    ok = letter[i + k] and bool(model.names)
                    langs.append(model.names[best[k]] if ok else "und")
                    scores.append(float(p[k]) if ok else 0.0)
                    unsure.append(bool(ok and p[k] - q[k] < margin))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_()), *[pa.array(no, pa.bool_())][: int(foreign)]], [*keep, *names])

    return wide.mapInArrow(run, schema)


def op5_query(docs: DataFrame) -> DataFrame:
    """Learns where the checksum of doc_id modulo 5 isn't 0, predicts everywhere. Rows without doc_id aren't held out, and teach nothing; nulls, ties and repeats as in `identify`."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    model = fit(docs, ~held)
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
