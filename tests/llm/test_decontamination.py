"""Ids of benchmark items: none, texts, repeated; blocks in the shared folder."""

import hashlib
import json
import tracemalloc
import uuid

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import decontamination, hashing


@pytest.mark.parametrize("block_words", [2_000_000, 8])
def test_item_ids_of_any_kind(spark, block_words):
    docs = spark.createDataFrame([(1, "x one two three y four"), (2, "four"), (None, None), (3, ""), (2, "four")], "doc_id long, text string")
    for kind, ids in (("string", ["b", "a10", None]), ("long", [10, 9, None]), ("int", [10, 9, None])):
        bench = spark.createDataFrame([(ids[0], "one two three"), (ids[1], "two three"), (ids[2], "four"), (ids[2], None), (ids[0], "y")], f"item_id {kind}, text string")
        got = {(r["doc_id"], r["n_words"]): r for r in decontamination.contamination(docs, bench, block_words=block_words).collect()}
        assert got[1, 6]["items"] == sorted(ids[:2]) and [tuple(s) for s in got[1, 6]["spans"]] == [(1, 6)]
        assert got[2, 1]["items"] == [] and [tuple(s) for s in got[2, 1]["spans"]] == [(0, 1)]
        assert got[None, 0]["items"] == got[3, 0]["items"] == []
        rows = {r["doc_id"]: r for r in decontamination.op7_query(docs, bench).collect()}
        said = ",".join(sorted(str(x) for x in ids[:2]))
        assert (rows[1]["n_hit"], rows[1]["n_items"], rows[1]["contaminated"], rows[1]["items_sha256"]) == (5, 2, True, hashlib.sha256(said.encode()).hexdigest())
        assert (rows[2]["n_hit"], rows[2]["n_items"]) == (1, 0)


def test_a_large_block_goes_by_the_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 1)
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "b c")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "a b c d e f g h i")], "item_id string, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontamination.op7_query(docs, bench).collect()} == {1: 9, 2: 0}


def test_an_index_of_the_whole_shard_can_be_asked_anything():
    rng = np.random.default_rng(7)
    for vocabulary in (3, 40):
        docs = [[f"w{x}" for x in rng.integers(0, vocabulary, n)] for n in (0, 1, 60, 0, 200, 7, 0)]
        data, offsets = hashing.flat(pa.array([" ".join(d) for d in docs]))
        words, first = hashing.word_hashes(data, offsets, hashing.ALNUM)
        shard = decontamination.Shard(words, first)
        asked = [(k, " ".join(f"w{x}" for x in rng.integers(0, vocabulary + 2, n))) for k, n in enumerate(rng.integers(1, 5, 60))]
        phrases = next(decontamination.windows_of(iter(asked), 8, 10**6))
        begin, end, found = shard.search(phrases)
        got = sorted((int(b), int(e), i) for b, e, f in zip(begin, end, found, strict=True) for i in phrases.items[f])
        want = []
        for i, t in asked:
            w = t.split()
            want += [(int(first[d]) + at, int(first[d]) + at + len(w), i) for d, own in enumerate(docs) for at in range(len(own) - len(w) + 1) if own[at : at + len(w)] == w]
        assert got == sorted(want)


def test_shards_are_no_larger_than_they_say(spark, monkeypatch, tmp_path):
    real = decontamination.Shard

    class Told(real):
        def __init__(self, words, first):
            with open(tmp_path / uuid.uuid4().hex, "w") as f:
                json.dump(np.diff(first).tolist(), f)
            super().__init__(words, first)

    monkeypatch.setattr(decontamination, "Shard", Told)
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 100)
    texts = ["a b c " * n for n in (12, 0, 3, 3, 40, 5, 5, 5, 1, 0)] * 3
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([("q", "c a b c a b c a"), ("r", "b c b")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontamination.op7_query(docs, bench).collect()}
    assert got == {k: (3 * (n := len(t) // 6), 3 * n - 4 if n >= 4 else 0) for k, t in enumerate(texts)}
    shards = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert sorted(x for s in shards for x in s) == sorted(3 * (len(t) // 6) for t in texts)
    assert all(2 * sum(s) <= 100 or sum(x > 0 for x in s) == 1 for s in shards)


def test_an_index_is_built_within_memory_for_its_words():
    words = hashing.mix(np.random.default_rng(1).zipf(1.3, 200_000).astype(np.uint64))
    first = np.arange(0, 200_001, 400)
    decontamination.Shard(words[:400], first[:2])
    tracemalloc.start()
    try:
        shard = decontamination.Shard(words, first)
        built, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert shard.index.n == 200_501 and most < 80 * len(words) and built < 16 * len(words)
