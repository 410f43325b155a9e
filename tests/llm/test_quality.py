"""Long texts piece by piece against whole ones, and bounded samples of repeated ids."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import hashing, languages, quality


def texts():
    rng = np.random.default_rng(1)
    out = ["", "\n", "a", "\n\n\n", "a a\n\na a", "word " * 50, "word word\n" * 30 + "end", "x" * 300, "\n" + "y y y " * 40 + "\n\n"]
    for _ in range(60):
        parts = rng.choice(["ab", "ab ", "\n", " ", "###", "ü ", "Z. ", "12 "], int(rng.integers(1, 120)))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("piece", [1, 5, 64])
def test_lines_in_pieces(piece):
    for t in texts():
        data, offsets = hashing.flat(pa.array([t]))
        x, length, _ = quality.lines(data, offsets)
        parts = [*quality.long_lines(data, piece)]
        assert np.allclose(np.concatenate([p for p, _ in parts]), x) and np.allclose(np.concatenate([n for _, n in parts]), length), t


@pytest.mark.parametrize("piece", [1, 30])
def test_scores_in_pieces(piece):
    rng = np.random.default_rng(2)
    field = quality.Field(rng.normal(size=3 * quality.WIDTH), rng.normal(size=(2, 2)) * 2)
    column = pa.array(texts())
    assert np.allclose(quality.score_texts(column, field, piece), quality.score_texts(column, field), atol=1e-4)


def test_memory_of_a_long_text():
    field = quality.Field(np.ones(3 * quality.WIDTH) / 10, np.zeros((2, 2)))
    column = pa.array(["A line of some words, and more of them.\n" * 200_000 + "one more " * 300_000])
    tracemalloc.start()
    assert 0 < quality.score_texts(column, field)[0] < 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20


def test_samples_stay_bounded_when_an_id_repeats(spark):
    rows = [(7, f"the words of text {k} ### |", "aa") for k in range(3000)] + [(i, "the words of it" if i % 2 else "der und die", "aa" if i % 2 else "bb") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.fit(docs, docs.doc_id.isNotNull())
    assert len(model.alone) <= 61 and model.names == ["aa", "bb"]
    labels = spark.createDataFrame([(7, 0), *[(i, 1) for i in range(100, 160)]], "doc_id long, quality int")
    field = quality.fit(docs, labels, labels.doc_id.isNotNull())
    good, bad = quality.score_texts(pa.array(["the words of it", "the words of text 9 ### |"]), field)
    assert good > bad


def test_a_column_named_like_a_help_column(spark):
    docs = spark.createDataFrame([(1, "the words", 5), (2, "", 6)], "doc_id long, text string, _letter int")
    model = languages.Model(np.eye(2, languages.FEATURES, dtype=np.float32), ["aa", "bb"])
    got = {r["doc_id"]: r for r in languages.identify(docs, model).collect()}
    assert got[1]["_letter"] == 5 and got[2]["_letter"] == 6 and got[2]["lang_pred"] == "und" and got[1]["lang_pred"] != "und"
