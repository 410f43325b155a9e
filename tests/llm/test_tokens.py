"""Cuts and far characters against the library, long texts, and shared folders by scheme."""

import random
import tracemalloc

import numpy as np
import pytest

from lodestone.llm import stores, tokens


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.default_path(), tokens.proven(tokens.default_path()))


def same(counter, text):
    return np.frombuffer(counter.ids(text), np.uint16).tolist() == counter.library.encode(text, add_special_tokens=False).ids


def test_far_words_alone_go_to_the_library(counter):
    rng = random.Random(2)
    for alphabet in ("ab'sЖш漢字かなカ。、，가나 　 \t\n\r\x1c\x1f.,!0٣½🙂é'll", "Жa ", "漢。字、a \n"):
        for _ in range(3000):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) + ("<|endoftext|>Ж" if rng.random() < 0.05 else "")
            assert same(counter, s), s
    counter.far.clear()
    assert same(counter, "plain words around one Жук and more plain words") and [*counter.far] == [" Жук"]


@pytest.mark.parametrize("piece", [1, 7, 50])
def test_long_texts_in_pieces(counter, monkeypatch, piece):
    monkeypatch.setattr(tokens, "PIECE", piece)
    rng = random.Random(3)
    for alphabet in ("ab's  \n\t.!é漢。", "ab cd ", "xyz"):
        for _ in range(800):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))
            assert "".join(counter.cut_up(s)) == s and same(counter, s), s


def test_memory_does_not_grow_with_a_text(counter):
    text = "Some words of it, and others. " * 300_000
    counter.count(text[:100_000])
    tracemalloc.start()
    assert counter.count(text) > 2_000_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20


def test_schemes():
    from pyarrow import fs

    for uri, path in (("/a/b", "/a/b"), ("file:///a/b", "/a/b"), ("file:/a/b", "/a/b")):
        store, at = stores.open_store(uri)
        assert isinstance(store, fs.LocalFileSystem) and at == path
    with pytest.raises(ValueError, match="can't reach"):
        stores.open_store("wasb://x/y")
