"""Reading and changing the YAML block at the head of notes.

Scalars follow the core schema of YAML 1.2 (yes, no and dates are strings). A change rewrites the lines of its own key and leaves all other bytes, comments
and the order of keys as they are; a new key goes to the end. Values are JSON-like. YAML has no SQL form, so blocks go through Arrow to
Python in batches, once for a call; the texts below them stay in the JVM.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import UsageError
from lodestone.operators.edit import changes

try:
    import yaml
except ImportError:  # the other operators don't need it
    yaml = None

#: White space of a line as str.strip has it, and a text's head as `Block` reads it.
BLANK = r"[\t\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"
HEAD = rf"(?s)\A(?:\x{{FEFF}}?{BLANK}---{BLANK}(?:\n|\z)(?:(?:.*?\n)??{BLANK}(?:---|\.\.\.){BLANK}(?:\n|\z))?|\x{{FEFF}})"


@lru_cache(1)
def _schema() -> tuple[type, type]:
    """A loader and a dumper of the core schema, made once; the loader in C where PyYAML has it."""
    if yaml is None:
        raise UsageError("frontmatter needs PyYAML")
    rules = [
        ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
        ("tag:yaml.org,2002:int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
        ("tag:yaml.org,2002:float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+.0123456789")),
    ]
    loader, dumper = type("Loader", (getattr(yaml, "CSafeLoader", yaml.SafeLoader),), {}), type("Dumper", (yaml.SafeDumper,), {"increase_indent": lambda self, flow=False, indentless=False: yaml.SafeDumper.increase_indent(self, flow, False)})
    for kind in (loader, dumper):
        kind.yaml_implicit_resolvers = {}
        for tag, pattern, firsts in rules:
            kind.add_implicit_resolver(tag, re.compile(pattern), firsts)
    loader.add_constructor("tag:yaml.org,2002:int", lambda self, node: int(node.value, 0) if re.match(r"0[ox]", node.value) else int(node.value))
    loader.add_constructor("tag:yaml.org,2002:float", lambda self, node: float(re.sub(r"\.(inf|nan)", r"\1", node.value.lower())))
    return loader, dumper


def _plain(value: object, label: str) -> object:
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise UsageError(f"{label} must be JSON-compatible")
        return value
    if isinstance(value, list):
        return [_plain(v, f"{label}[{i}]") for i, v in enumerate(value)]
    if isinstance(value, dict) and all(isinstance(k, str) for k in value):
        return {k: _plain(v, f"{label}.{k}") for k, v in value.items()}
    raise UsageError(f"{label} must be JSON-compatible")


def _same(a: object, b: object) -> bool:
    """Deep equality; the order of keys doesn't count, and true isn't 1."""
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True) or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)


def head_of(content: Column) -> Column:
    """A text's byte order mark and its block with both delimiters; of a block that never closes its first line; '' if there is neither."""
    return F.regexp_extract(content, HEAD, 0)


class Block:
    """A text's byte order mark, line ends, frontmatter and body. crlf: whether the whole text has CRLF, where just its head is given."""

    def __init__(self, text: str, crlf: bool = False):
        self.mark = "﻿" if text.startswith("﻿") else ""
        text = text.removeprefix("﻿")
        self.eol = "\r\n" if crlf or "\r\n" in text else "\n"
        lines = re.findall(r"[^\n]*\n|[^\n]+\Z", text)
        self.there = bool(lines) and lines[0].strip() == "---"
        self.yaml, self.body = "", text
        if self.there:
            end = next((k for k, x in enumerate(lines[1:], 1) if x.strip() in ("---", "...")), None)
            if end is None:
                raise UsageError("Frontmatter opening delimiter has no closing delimiter")
            self.yaml, self.body = "".join(lines[1:end]), "".join(lines[end + 1 :])
        loader, self.dumper = _schema()
        source = self.yaml.replace("\r\n", "\n")
        own = loader(source)
        try:
            self.node = own.get_single_node()
            if self.node is not None and not (isinstance(self.node, yaml.ScalarNode) and self.node.tag.endswith(":null")):
                if not isinstance(self.node, yaml.MappingNode):
                    raise UsageError("Frontmatter root must be a YAML mapping")
                self._unique(self.node)
                self.values = _plain(own.construct_document(self.node), "frontmatter")
            else:
                self.node, self.values = None, {}
        except yaml.YAMLError as error:
            raise UsageError(f"Invalid frontmatter YAML: {error}") from None
        finally:
            own.dispose()
        self.source = source

    def _unique(self, node: object) -> None:
        if isinstance(node, yaml.MappingNode):
            names = [k.value if isinstance(k, yaml.ScalarNode) else None for k, _ in node.value]
            if None in names or len(set(names)) < len(names):
                raise UsageError("Invalid frontmatter YAML: keys must be unique strings")
            for _, v in node.value:
                self._unique(v)
        elif isinstance(node, yaml.SequenceNode):
            for v in node.value:
                self._unique(v)

    def _end(self, node: object) -> int:
        """Where a value's own text ends, without comments and blank lines below a block."""
        while isinstance(node, yaml.CollectionNode) and not node.flow_style and node.value:
            node = node.value[-1][1] if isinstance(node, yaml.MappingNode) else node.value[-1]
        return len(self.source[: node.end_mark.index].rstrip("\n"))

    def put(self, key: str, value: object) -> None:
        said = yaml.dump({key: value}, Dumper=self.dumper, allow_unicode=True, sort_keys=False, default_flow_style=False, width=math.inf).rstrip("\n")
        pair = next(((k, v) for k, v in self.node.value if k.value == key), None) if self.node is not None else None
        if pair is None:
            base = self.source if not self.source or self.source.endswith("\n") else f"{self.source}\n"
            self.source = f"{'' if self.node is None and not base.strip().startswith('#') else base}{said}\n"
        else:
            start, end = pair[0].start_mark.index, max(self._end(pair[1]), pair[0].end_mark.index + 1)
            self.source = self.source[:start] + said + self.source[end:]

    def drop(self, key: str) -> None:
        k, v = next((k, v) for k, v in self.node.value if k.value == key)
        start, end = k.start_mark.index, max(self._end(v), k.end_mark.index + 1)
        line = self.source.find("\n", end)
        self.source = self.source[:start] + ("" if line < 0 else self.source[line + 1 :])
        if len(self.values) == 1:
            self.source = ""

    def text(self) -> str:
        return f"{self.mark}---{self.eol}{self.source.replace(chr(10), self.eol)}---{self.eol}{self.body}"


def set_value(block: Block, key: str, value: object) -> bool:
    if key in block.values and _same(block.values[key], value):
        return False
    block.put(key, value)
    return True


def delete_value(block: Block, key: str, value: object = None) -> bool:
    if key not in block.values:
        raise UsageError(f"Frontmatter key not found: {key}")
    block.drop(key)
    return True


def _items(block: Block, key: str) -> list:
    if not isinstance(block.values[key], list):
        raise UsageError(f"Frontmatter key is not a list: {key}")
    return block.values[key]


def add_value(block: Block, key: str, value: object) -> bool:
    if key not in block.values:
        block.put(key, [value])
        return True
    if any(_same(x, value) for x in _items(block, key)):
        return False
    block.put(key, [*block.values[key], value])
    return True


def remove_value(block: Block, key: str, value: object) -> bool:
    if key not in block.values:
        raise UsageError(f"Frontmatter key not found: {key}")
    items = _items(block, key)
    at = next((i for i, x in enumerate(items) if _same(x, value)), None)
    if at is None:
        raise UsageError(f"Frontmatter list value not found for key: {key}")
    block.put(key, items[:at] + items[at + 1 :])
    return True


def _mutate(files: DataFrame, action: Callable[[Block, str, object], bool], key: str, value: object = None, strict: bool = False) -> DataFrame:
    if not key.strip() or re.search(r"[\r\n]", key):
        raise UsageError("key must be one line that isn't blank")
    value = _plain(value, "value")

    def each(heads: pd.Series, crlf: pd.Series) -> pd.DataFrame:
        after, error = [], []
        for head, far in zip(heads, crlf, strict=True):
            try:
                block = Block(head, bool(far)) if head is not None else None
                changed = block is not None and action(block, key, value)
                after.append(block.text() if changed else head)
                error.append(None if changed else "No changes." if block else "not readable")
            except UsageError as e:
                after.append(None)
                error.append(str(e))
        return pd.DataFrame({"after": after, "error": error})

    note = F.lower("path").endswith(".md")
    at = files.select("path", "content", F.when(note, head_of(F.col("content"))).alias("_head"))
    done = F.pandas_udf(each, "after string, error string")(F.col("_head"), F.col("content").contains("\r\n"))
    at = at.select("path", "content", "_head", done.alias("_d"))
    rest = F.substring("content", F.length("_head") + 1, F.length("content"))
    return changes(at, F.when(note, F.concat("_d.after", rest)), F.when(~note, F.concat(F.lit("Frontmatter tools only support Markdown files: "), "path")).otherwise(F.col("_d.error")), strict)


def set_frontmatter(files: DataFrame, key: str, value: object, strict: bool = False) -> DataFrame:
    """A change set in which `key` has `value`; equal values are no change."""
    return _mutate(files, set_value, key, value, strict)


def delete_frontmatter(files: DataFrame, key: str, strict: bool = False) -> DataFrame:
    return _mutate(files, delete_value, key, None, strict)


def add_frontmatter_value(files: DataFrame, key: str, value: object, strict: bool = False) -> DataFrame:
    """The value at the end of a list, made if missing; one that is there already is no change."""
    return _mutate(files, add_value, key, value, strict)


def remove_frontmatter_value(files: DataFrame, key: str, value: object, strict: bool = False) -> DataFrame:
    """Without the first equal element of a list."""
    return _mutate(files, remove_value, key, value, strict)


def read_frontmatter(files: DataFrame, strict: bool = False) -> DataFrame:
    """(path, has_frontmatter, frontmatter VARIANT, error) of Markdown files; {} without a block."""

    def each(heads: pd.Series) -> pd.DataFrame:
        rows = []
        for head in heads:
            try:
                block = Block(head or "")
                rows.append((block.there, json.dumps(block.values, ensure_ascii=False, sort_keys=True), None))
            except UsageError as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=["there", "json", "error"])

    got = files.where(F.lower("path").endswith(".md")).select("path", F.pandas_udf(each, "there boolean, json string, error string")(head_of(F.col("content"))).alias("d"))
    error = F.when(F.col("d.error").isNotNull(), F.raise_error(F.col("d.error"))).cast("string") if strict else F.col("d.error")
    return got.select("path", F.col("d.there").alias("has_frontmatter"), F.parse_json("d.json").alias("frontmatter"), error.alias("error"))
