"""Words and shingles of many texts at once, as 64-bit hashes, by numpy over the Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at once; longer texts are cut between words.
PIECE = 1 << 21


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on every other."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15))


_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = stream(11, 256)[_LOWER]
_BASE = U(0x9E3779B97F4A7C15)

#: Bytes of words that white space ends, and of words of ASCII letters, digits and anything beyond ASCII.
SPACED = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])
ALNUM = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each text begins (one more entry than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have `limit` bytes at most together, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


def _hash_piece(data: np.ndarray, breaks: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of data; words end at `breaks` too."""
    inside = keep[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = breaks[breaks < len(data)]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, U), starts
    kept = data[inside]
    begin = np.cumsum(inside, dtype=np.int64)[starts] - 1
    lengths = np.diff(np.append(begin, len(kept)))
    with np.errstate(over="ignore"):
        powers = np.full(int(lengths.max()), _BASE, U)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=U)
        at = np.arange(len(kept))
        at -= np.repeat(begin, lengths)
        value = powers[at]
        del at
        value *= _BYTE[kept]
        return mix(np.add.reduceat(value, begin) + lengths.astype(U)), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order (ASCII capitals count as small letters), and each text's first word (one more entry than texts).

    A text longer than PIECE is hashed piece by piece, cut where a byte is in no word, so that memory doesn't grow with it.
    """
    if len(offsets) == 2 and len(data) > PIECE:
        parts, i = [], 0
        while i < len(data):
            j = min(i + PIECE, len(data))
            while j < len(data):
                outside = np.flatnonzero(~keep[data[j : j + 4096]])
                if len(outside):
                    j += int(outside[0])
                    break
                j = min(j + 4096, len(data))
            parts.append(_hash_piece(data[i:j], np.zeros(0, np.int64), keep)[0])
            i = j
        h = np.concatenate(parts)
        return h, np.array([0, len(h)])
    h, starts = _hash_piece(data, offsets[:-1], keep)
    return h, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words of each text, repeats included, and each text's first; a text of fewer words but not none is one run."""
    counts = np.diff(first)
    if not len(words):
        return np.zeros(0, U), np.zeros(len(first), np.int64)
    with np.errstate(over="ignore"):
        multiplier = U(0xD6E8FEB86659FD93)
        padded = np.concatenate([words, np.zeros(width - 1, U)])
        run = np.zeros(len(words), U)
        for k in range(width):
            run = run * multiplier + padded[k : k + len(words)]
        run = mix(run + U(width))
        size = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
        out_first = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], size)
        out = run[take]
        for i in np.flatnonzero((counts > 0) & (counts < width)):
            h = U(0)
            for w in words[first[i] : first[i + 1]]:
                h = h * multiplier + w
            out[out_first[i]] = mix(np.array([h + U(counts[i])], U))[0]
    return out, out_first


def grouped(column: pa.Array, keep: np.ndarray, width: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows i to j: i, j, the number of words of each, the shingle hashes of all, and each row's first shingle."""
    data, offsets = flat(column)
    for i, j in ranges(offsets):
        own = offsets[i : j + 1] - offsets[i]
        words, first = word_hashes(data[offsets[i] : offsets[j]], own, keep)
        runs, runs_first = shingles(words, first, width)
        yield i, j, np.diff(first), runs, runs_first
