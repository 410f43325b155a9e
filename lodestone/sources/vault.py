"""A folder of notes as a DataFrame, and changes written back to it.

Spark's own file sources hide names that begin with _ or a dot; here only folders are hidden. The walk runs on the driver, with folders
pruned and extensions filtered before any byte is read; files are read by the tasks, and only if their content is asked for.
The folder must be one that driver and executors share.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.errors import SAID, UsageError

#: Fixed names of folders that hold no notes.
SKIPPED = frozenset({".obsidian", ".git", ".trash", "node_modules"})


def skipped(name: str, hidden: bool) -> bool:
    return name in SKIPPED or not hidden and name.startswith(".")


def is_note(name: str) -> bool:
    return os.path.splitext(name)[1].lower() == ".md"


def resolve(root: str, path: str, must_exist: bool = False) -> tuple[str, str]:
    """The absolute path and that from the root, of a path that is under the root, links followed; so must be the nearest folder that exists of a new one."""
    if not path:
        raise UsageError("a path is needed")
    real = os.path.realpath(root)
    absolute = os.path.normpath(path if os.path.isabs(path) else os.path.join(os.path.abspath(root), path))
    under = lambda p, base: p == base or p.startswith(base.rstrip(os.sep) + os.sep)
    if not under(absolute, os.path.abspath(root)) and not under(absolute, real):
        raise UsageError(f"{path} is not below the folder of notes")
    if must_exist and not os.path.lexists(absolute):
        raise UsageError(f"there is no {path}")
    known = absolute
    while not os.path.exists(known) and os.path.dirname(known) != known:
        known = os.path.dirname(known)
    if not under(os.path.realpath(known), real):
        raise UsageError(f"{path} leads out of the folder of notes")
    base = os.path.abspath(root) if under(absolute, os.path.abspath(root)) else real
    return absolute, os.path.relpath(absolute, base).replace(os.sep, "/")


def walk(root: str, start: str, every: bool = False, hidden: bool = False) -> Iterator[str]:
    """Absolute paths of regular files. A start that is a file is itself the walk, whatever its name."""
    if os.path.isfile(start):
        yield start
        return
    for entry in sorted(os.scandir(start), key=lambda e: e.name):
        if entry.is_dir(follow_symlinks=False):
            if not skipped(entry.name, hidden):
                yield from walk(root, entry.path, every, hidden)
        elif entry.is_file(follow_symlinks=False) and (every or is_note(entry.name)):
            yield entry.path


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths


class VaultReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.root, self.scope = options["path"], options.get("scope", ".")
        self.every, self.hidden = (str(options.get(k, "false")).lower() == "true" for k in ("all", "includehidden"))
        self.each, self.columns = int(options.get("filesperpartition", 500)), columns

    def partitions(self) -> list[Files]:
        start, _ = resolve(self.root, self.scope, must_exist=True)
        found = [(p, os.path.relpath(p, self.root).replace(os.sep, "/")) for p in walk(self.root, start, self.every, self.hidden)]
        return [Files(found[i : i + self.each]) for i in range(0, len(found), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, rel in partition.paths:
            at = os.stat(path)
            own = {"path": rel, "mtime_ms": at.st_mtime * 1000.0, "size": at.st_size}
            if "content" in self.columns:
                with open(path, "rb") as f:
                    own["content"] = f.read()
            yield tuple(own[c] for c in self.columns)


class VaultSource(DataSource):
    """`spark.read.format("vault").option("path", root)`; options scope (a file or folder), all, includeHidden, metadata (true: without content), filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def _columns(self) -> list[str]:
        return ["path", "mtime_ms", "size"] + ["content"] * (str(self.options.get("metadata", "false")).lower() != "true")

    def schema(self) -> str:
        kinds = {"path": "string", "mtime_ms": "double", "size": "long", "content": "binary"}
        return ", ".join(f"{c} {kinds[c]}" for c in self._columns())

    def reader(self, schema: object) -> VaultReader:
        return VaultReader(dict(self.options), self._columns())


def read_vault(spark: SparkSession, root: str, scope: str = ".", every: bool = False, hidden: bool = False, content: bool = True) -> DataFrame:
    """(path, mtime_ms, size, content) of the files of a folder. Without content no file is opened."""
    resolve(root, scope, must_exist=True)
    spark.dataSource.register(VaultSource)
    options = {"path": root, "scope": scope, "all": str(every).lower(), "includeHidden": str(hidden).lower(), "metadata": str(not content).lower()}
    return spark.read.format("vault").options(**options).load()


def decoded(content: Column | str, keep_mark: bool = False) -> Column:
    """Bytes as text, null where they aren't UTF-8; a byte order mark in front goes unless kept."""
    text = F.try_validate_utf8((F.col(content) if isinstance(content, str) else content).cast("string"))
    return text if keep_mark else F.regexp_replace(text, r"\A\x{FEFF}", "")


def repaired(content: Column | str) -> Column:
    """Bytes as text, with U+FFFD where they aren't UTF-8."""
    return F.make_valid_utf8((F.col(content) if isinstance(content, str) else content).cast("string"))


def write_file(path: str, text: str) -> None:
    """Puts a file in place whole: written beside it and renamed."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle, temp = tempfile.mkstemp(prefix=".lodestone-", dir=os.path.dirname(path))
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="", errors="surrogatepass") as f:
            f.write(text)
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def write_changes(changes: DataFrame, root: str) -> None:
    """Writes a change set (code A, M or D; path; after; optionally from_path, which a move leaves) into a folder that all tasks share.

    Each file is replaced at once; a task that runs again writes the same. Dry runs are change sets that aren't written.
    """
    columns = [c for c in ("code", "path", "after", "from_path") if c in changes.columns]
    base = os.path.abspath(root)

    def apply(rows: Iterator) -> None:
        for r in rows:
            target, _ = resolve(base, r["path"])
            if r["code"] == "D":
                if os.path.exists(target):
                    os.unlink(target)
                continue
            write_file(target, r["after"] or "")
            if "from_path" in columns and r["from_path"] and r["from_path"] != r["path"]:
                source, _ = resolve(base, r["from_path"])
                if os.path.exists(source):
                    os.unlink(source)

    changes.select(*columns).foreachPartition(apply)


def make_folder(root: str, path: str, parents: bool = True, dry: bool = False) -> list[tuple[str, str]]:
    """[(code, path)] of a new folder, [] if it is there."""
    target, rel = resolve(root, path)
    if os.path.isdir(target):
        return []
    if os.path.exists(target):
        raise UsageError(f"{rel} is a file")
    if not dry:
        os.makedirs(target) if parents else os.mkdir(target)
    return [("A", rel)]


def copy_path(root: str, source: str, to: str, recursive: bool = False, overwrite: bool = False, dry: bool = False) -> list[tuple[str, str, str]]:
    """[(code, path, from)] of a file or folder copied."""
    (a, a_rel), (b, b_rel) = resolve(root, source, must_exist=True), resolve(root, to)
    there = os.path.exists(b)
    if there and not overwrite:
        raise UsageError(SAID["path"] + b_rel)
    if os.path.isdir(a):
        if not recursive:
            raise UsageError("a folder is copied with recursive alone")
        if b == a or b.startswith(a + os.sep):
            raise UsageError("a folder can't be copied into itself")
    if not dry:
        os.makedirs(os.path.dirname(b), exist_ok=True)
        shutil.copytree(a, b, dirs_exist_ok=True, symlinks=True) if os.path.isdir(a) else shutil.copy2(a, b)
    return [("M" if there else "A", b_rel, a_rel)]
