"""The pipeline's stages on odd tables, by brute force."""

from collections import Counter

import pytest

import corpus_pipeline as pipeline
from lodestone.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, items int, `_s` string, shard int"
MORE = (True, 1, "s", 3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(None, "the hidden answer"), ("q", "one two three four five six seven eight")], "item_id string, text string").write.parquet(f"{where}/benchmark.parquet")
    rows = [
        (1, "some words that are here to stay with us", "en", "a", 1), (1, "some words that are here to stay with us", "en", "a", 1), (2, "Some words that are here to stay with us", "en", "b", 1),
        (3, None, None, None, None), (3, None, None, None, None), (4, "", "en", "a", 0), (5, "123 456", "en", "a", 7), (None, "the hidden answer is 7", "en", "b", 1), (None, "quite another text without a number", "en", None, 1),
        (None, "quite another text without a number", "en", None, 1), (None, "SOME words that are here to stay with us", "en", "b", 1), (6, "so one two three four five six seven eight nine", "en", "b", 1), (7, "x " * 5000, "en", None, 1),
    ]
    spark.createDataFrame([(*r, *MORE) for r in rows], SCHEMA).write.parquet(f"{where}/documents.parquet")
    return where


def test_stages_on_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = set(pipeline.COLUMNS)
    a = pipeline.language(spark, docs, folder).cache()
    assert set(a.columns) == columns and Counter(r["doc_id"] for r in a.collect()) == {1: 2, 2: 1, None: 4, 6: 1, 7: 1}
    b = pipeline.near_duplicates(spark, docs, folder).cache()
    assert set(b.columns) == columns and Counter((r["doc_id"], (r["text"] or "")[:5]) for r in b.collect()) == {(1, "some "): 1, (3, ""): 1, (4, ""): 1, (5, "123 4"): 1, (None, "the h"): 1, (None, "quite"): 1, (6, "so on"): 1, (7, "x x x"): 1}
    c = pipeline.decontaminate(spark, docs, folder).cache()
    assert set(c.columns) == columns and Counter(r["doc_id"] for r in c.collect()) == {1: 2, 2: 1, 3: 2, 4: 1, 5: 1, None: 3, 7: 1}
    d = pipeline.mix(spark, docs, folder).cache()
    want = Counter()
    for r in mixing.mix(docs).select("doc_id", "source", "times").collect():
        want[r["doc_id"], r["source"]] += r["times"]
    assert set(d.columns) == columns and Counter((r["doc_id"], r["source"]) for r in d.collect()) == +want
    e = pipeline.shard(spark, docs, folder)
    assert e.count() == docs.count()
    assert pipeline.run(spark, folder).count() > 0


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
