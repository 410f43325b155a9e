"""Operators 4 and 6: counts of tokens with the whole-token shortcut, and flat files of token ids.

For a byte-level BPE vocabulary without normalizer the pieces that the pre-tokenizer cuts (pre-tokens) are encoded one by one.
`prove` finds, once for a vocabulary and before any job, the strings in it that the library encodes as that one token: merging needn't be
run for a pre-token among them. Tasks get the proven strings with their code. The rest is merged by the library, once for each different pre-token as long as the
memory for them lasts.

A pre-token never reaches from a character that isn't white space to one that is, so texts are cut there: long ones into pieces, worked on one after another, and
those with single spaces and line breaks alone into chunks, which are remembered whole. Pre-tokens are cut by a pattern of
explicit character ranges where all characters are below U+0250 or in U+2010..U+2027 and U+2030..U+205E; a word with any other character
goes to the library, and the words around it don't.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import cut, range_buckets, schema_with
from lodestone.llm.stores import new_store, open_store

#: Different strings whose tokens a worker remembers, about 150 bytes each, and as many that it knew before.
REMEMBERED = 400_000
#: Characters that are worked on at once.
PIECE = 1 << 16
#: Where a text may be cut: before white space, or a full stop of Chinese and Japanese after one of their letters.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5])(?=[\u3001\u3002])")
_FAR = re.compile("[^\x00-ɏ‐-‧‰-⁞]")
#: White space other than single spaces and line breaks between words.
_WIDE = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0")


def _is_far(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _FAR.search(text) is not None
    return False


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _class(want: str) -> str:
    """The characters of general categories L or N below U+0250, as ranges for a character class."""
    runs: list[list[int]] = []
    for c in range(0x250):
        if unicodedata.category(chr(c))[0] == want:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


def pretoken_pattern() -> re.Pattern:
    """How byte-level BPE of this kind cuts text, for the characters that _FAR doesn't match."""
    letter, number, space = _class("L"), _class("N"), "\\t-\\r \\x85\\xa0"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def _byte_letters() -> dict[str, int]:
    """Which character stands for which byte in the vocabulary: printable ones for themselves, the others for the next ones from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Memory(dict):
    """Remembers what `make` gives for short strings. When it is full it begins anew, but still finds what it last knew, so that frequent strings stay."""

    def __init__(self, make: Callable[[str], bytes], seed: dict[str, bytes]):
        super().__init__()
        self.make, self.seed, self.last = make, seed, {}

    def __missing__(self, key: str) -> bytes:
        value = self.last.get(key) or self.seed.get(key) or self.make(key)
        if len(key) < 64:
            if len(self) >= REMEMBERED:
                self.last = dict(self)
                self.clear()
            self[key] = value
        return value


class Counter:
    """Token ids of texts as the library gives them, without added special tokens."""

    def __init__(self, path: str, known: dict[str, bytes] | None = None):
        """known: what `prove` has found for this vocabulary; null: it is proven here."""
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        added = said.get("added_tokens") or []
        plain = not any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added)
        #: whether pre-tokens can be handled one by one
        self.by_piece = bool(said["model"]["type"] == "BPE" and not said.get("normalizer") and not said.get("truncation") and not said.get("padding") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and plain)
        self.size = self.library.get_vocab_size()
        self.special = {a["content"]: a["id"] for a in added}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.cut = pretoken_pattern()
        self.dtype, self.kind = (np.uint16, "H") if self.size <= 65536 else (np.uint32, "I")
        letters = {b: c for c, b in _byte_letters().items()}
        self.letters = str.maketrans({chr(b): letters[b] for b in range(256)})
        self.known: dict[str, bytes] = {}
        if self.by_piece:
            self.model = self.library.model
            self.known = {s: np.array([i], self.dtype).tobytes() for s, i in self.prove().items()} if known is None else known
        self.pieces = Memory(self._merge, self.known)
        #: what stands between two spaces; a line break begins a chunk of its own, without a space
        self.chunks = Memory(self._chunk, {})
        #: words with characters that the pattern doesn't know
        self.far = Memory(self._library, {})

    def prove(self) -> dict[str, int]:
        """Vocabulary strings that are one whole pre-token and that the library encodes alone as their own single token."""
        letters, found = _byte_letters(), {}
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            try:
                s = bytes(letters[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if s not in self.special and not _FAR.search(s) and (m := self.cut.match(s)) and m.end() == len(s):
                found[s] = i
        names = [*found]
        for s, e in zip(names, self.library.encode_batch(names, add_special_tokens=False), strict=True):
            if e.ids != [found[s]]:
                del found[s]
        return found

    def _merge(self, piece: str) -> bytes:
        """The ids of a pre-token that isn't a whole token, by the library's merges."""
        return array(self.kind, [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _chunk(self, c: str) -> bytes:
        if c.isalpha():  # one pre-token
            return self.known.get(" " + c) or self._merge(" " + c)
        own = self.cut.findall(c if c[:1] == "\n" else " " + c)
        return b"".join([self.chunks[p[1:]] if p[0] == " " and p[1:].isalpha() else self.pieces[p] for p in own])

    def _pieces(self, part: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut.findall(part)))

    def _library(self, part: str) -> bytes:
        return np.array(self.library.encode(part, add_special_tokens=False).ids, self.dtype).tobytes()

    def _far(self, part: str) -> bytes:
        """Of a part with unknown characters: its words one by one, each with the white space before it, which no pre-token leaves at its end."""
        return b"".join([self.far[word] if _FAR.search(word) else self._pieces(word) for word in _CUT.split(part) if word])

    def cut_up(self, text: str) -> Iterator[str]:
        """Pieces of about `PIECE` characters of which each is encoded as in the whole text."""
        if not self.by_piece or len(text) <= PIECE or any(re.search(r"\s", x) for x in self.special):
            yield text
            return
        at = 0
        while at < len(text):
            found = _CUT.search(text, at + PIECE) if at + PIECE < len(text) else None
            end = len(text) if found is None else found.start()
            yield text[at:end]
            at = end

    def packed(self, text: str | None) -> Iterator[bytes]:
        """The packed ids, piece by piece."""
        if text:
            yield from map(self._ids, self.cut_up(text))

    def ids(self, text: str | None) -> bytes:
        """The packed ids."""
        return b"".join(self.packed(text))

    def _ids(self, text: str) -> bytes:
        if not self.by_piece:
            return self._library(text)
        out, far = [], _is_far(text)
        for part in self.cut_special.split(text) if any(x in text for x in self.special) else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], self.dtype).tobytes())
            elif far and _is_far(part):
                out.append(self._far(part))
            elif any(x in part for x in _WIDE):
                out.append(self._pieces(part))
            elif part:
                first, *rest = part.replace("\n", " \n").split(" ")
                out.append(self._pieces(first) if first or not rest else b"")
                out += map(self.chunks.__getitem__, rest)
        return b"".join(out)

    def count(self, text: str | None) -> int:
        return sum(map(len, self.packed(text))) // self.dtype().itemsize


@lru_cache(2)
def proven(path: str) -> dict[str, bytes]:
    """The vocabulary strings that alone are one token, with their packed ids: proven once in the driver, and sent with the tasks' code, about 1 MB for 50,000 strings."""
    return Counter(path).known


_COUNTERS: dict[str, Counter] = {}


def counter(path: str, known: dict[str, bytes]) -> Counter:
    """One for all tasks of a worker."""
    if path not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[path] = Counter(path, known)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text; 0 for null and empty texts. A column of that name is replaced."""
    path = path or default_path()
    rest, known = docs.drop(name), proven(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, known)
        for b in batches:
            counts = [own.count(t.as_py()) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64())], [*b.schema.names, name])

    return rest.mapInArrow(run, schema_with(rest, **{name: T.LongType()}))


def op4_query(docs: DataFrame, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every whole text. Null and empty texts have 0 of both; repeated rows and null ids are rows like any other; an empty table gives none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = token_counts(docs.select("doc_id", F.col("text"), F.octet_length(text).cast("long").alias("n_bytes")))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def write_ids(docs: DataFrame, where: str, path: str | None = None, end: int = 0) -> DataFrame:
    """Writes flat files of ids below the folder `where` and returns their manifest: (bucket, first, rows), prefix sums over all before.

    Documents are dealt to ranges of doc_id (null first, equal ones by text). Each range becomes `<bucket>.ids` (unsigned little-endian, 16 bits
    if the vocabulary has 65,536 ids at most, else 32), `<bucket>.off` (64-bit offsets of its documents, one more than documents) and
    `<bucket>.doc` (64-bit doc_ids, and a byte each for null). Files appear under their names at once when they are whole, and a
    repeated task writes the same bytes, so a lost executor leaves no wrong file.
    """
    path = path or default_path()
    known = proven(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bucket, n = range_buckets(rows, "doc_id", least=docs.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.withColumn("bucket", bucket(F.col("doc_id"))).repartition(n, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = open_store(where)
        store.create_dir(base, recursive=True)
        own = counter(path, known)
        last = np.array([end], own.dtype).tobytes()
        now, out, temp, offsets, names, done = None, None, "", [0], [], []

        def close() -> None:
            out.close()
            ids = np.array([0 if x is None else x for x in names], "<i8")
            for kind, data in (("off", np.array(offsets, "<i8").tobytes()), ("doc", ids.tobytes() + bytes(x is None for x in names))):
                with store.open_output_stream(f"{temp}.{kind}") as f:
                    f.write(data)
            for kind in ("ids", "off", "doc"):
                try:
                    store.move(f"{temp}.{kind}", f"{base}/{now}.{kind}")
                except OSError:  # some stores don't replace; a file that is there has the same bytes
                    if store.get_file_info(f"{base}/{now}.{kind}").type != fs.FileType.File:
                        raise
                    store.delete_file(f"{temp}.{kind}")
            done.append((now, offsets[-1], len(names)))

        for batch in batches:
            for i, t, b in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("bucket").to_pylist(), strict=True):
                if b != now:
                    if out is not None:
                        close()
                    now, temp, offsets, names = b, f"{base}/_{b}-{uuid.uuid4().hex}", [0], []
                    out = store.open_output_stream(f"{temp}.ids")
                n = 0
                for data in (*own.packed(t.as_py()), last):
                    out.write(data)
                    n += len(data) // own.dtype().itemsize
                offsets.append(offsets[-1] + n)
                names.append(i)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(3)], ["bucket", "ids", "rows"])

    written = cut(dealt.mapInArrow(run, "bucket long, ids long, rows long"))
    # a row for each file; the sums before it
    return cut(written.withColumn("first", F.coalesce(F.sum("ids").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))


def read_ids(manifest: DataFrame, where: str, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone; local ones are memory-mapped, others read by ranges."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from tokenizers import Tokenizer

        dtype = np.dtype("<u2" if Tokenizer.from_file(path).get_vocab_size() <= 65536 else "<u4")
        store, base = open_store(where)
        for batch in batches:
            for b, first, rows in zip(*(batch.column(k).to_pylist() for k in ("bucket", "first", "rows")), strict=True):
                with store.open_input_file(f"{base}/{b}.off") as f:
                    offsets = np.frombuffer(f.read(), "<i8")
                with store.open_input_file(f"{base}/{b}.doc") as f:
                    raw = f.read()
                names, null = np.frombuffer(raw[: 8 * rows], "<i8"), np.frombuffer(raw[8 * rows :], np.uint8) > 0
                local = isinstance(store, fs.LocalFileSystem)
                source = pa.memory_map(f"{base}/{b}.ids") if local else store.open_input_file(f"{base}/{b}.ids")
                sums = []
                with source:
                    for i in range(rows):
                        source.seek(int(offsets[i]) * dtype.itemsize)
                        ids = np.frombuffer(source.read_buffer(int(offsets[i + 1] - offsets[i]) * dtype.itemsize), dtype)
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        del ids
                yield pa.RecordBatch.from_arrays([pa.array(names, mask=null), pa.array(offsets[:-1] + first), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism * 16))
    return manifest.select("bucket", "first", "rows").repartition(parts, "bucket").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_query(docs: DataFrame) -> DataFrame:
    """Files of all documents, read back. Null and empty texts are the end id alone; rows without doc_id come first, and rows of one doc_id
    follow each other by text, null first; an empty table gives no file and no row."""
    where = new_store(docs.sparkSession, "token-ids")
    return read_ids(write_ids(docs, where), where)
