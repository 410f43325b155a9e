"""Operator 3: shards by a hierarchical weighted hash tree (regions, racks, shards), in DataFrame functions only.

At each node every child draws -ln(u) / weight from a hash of the key and the child's path, and the least draw wins: weighted
rendezvous hashing, level by level. A child's share is its weight's share of its siblings' weights. When the weights below
a node change, keys move only between that subtree and the others of its parent, never among those others; keys that
stay in a subtree without changes stay in their shard.

A region has room for shards that aren't open yet (`Spare`): they take part in their region's draws with their weight, but
can't win. An exponential draw forgets how far it has come, so what a child draws more than the least of its siblings is as good as a draw of its own:
a shard's whole draw is its region's, plus its rack's excess over the least rack, plus its own excess over the least
shard of the rack. In a region with spares the open shards race by these sums; in a full one the least sum is where the descent
ends. Since no sum depends on which shards are open, opening one moves keys only into it, and `tree(n + 1)` is `grown(tree(n))` for every n.

Draws come from 52 bits of an MD5 digest, so that any engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import range_buckets


class Spare(float):
    """The weight of a shard that isn't open yet."""


#: Weights of shards by region and rack.
Tree = list[list[list[float]]]
#: Rows that are numbered together, about.
SLOT_ROWS = 100_000


def tree(shards: int, racks: int = 2, shards_each: int = 5) -> Tree:
    """Regions of `racks` racks of `shards_each` shards of weight 1; shards of the last region beyond their number are spare."""
    if shards < 1:
        raise ValueError("shards must be positive")
    room = racks * shards_each
    one = lambda i: 1.0 if i < shards else Spare(1.0)
    return [[[one(i) for i in range(first + q * shards_each, first + (q + 1) * shards_each)] for q in range(racks)] for first in range(0, shards, room)]


def grown(of: Tree) -> Tree:
    """With one more shard, which takes rows only into itself: the first spare one, or the first of a further region like the last one, whose other shards are spare."""
    flat = [(r, q, k) for r, region in enumerate(of) for q, rack in enumerate(region) for k, w in enumerate(rack) if isinstance(w, Spare)]
    if flat:
        first = flat[0]
        return [[[float(w) if (r, q, k) == first else w for k, w in enumerate(rack)] for q, rack in enumerate(region)] for r, region in enumerate(of)]
    return grown([*of, [[Spare(w) for w in rack] for rack in of[-1]]])


def is_open(w: float) -> bool:
    return w > 0 and not isinstance(w, Spare)


def _draw(key: Column, path: str, weight: float) -> Column:
    digest = F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("null")), F.lit(path)))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.ln(u) / F.lit(float(weight))


def _choose(key: Column, children: Column) -> Column:
    """The number of the child with the least draw, of equal draws the smallest. children: an array of (path, weight, number)."""

    def draw(c: Column) -> Column:
        digest = F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("null")), c["path"]))
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
        return F.struct((-F.ln(u) / c["weight"]).alias("draw"), c["number"].alias("number"))

    return F.array_min(F.transform(children, draw))["number"]


def _children(nodes: list[tuple[str, float, int]]) -> Column:
    """As a literal, without children of weight 0."""
    kind = "array<struct<path: string, weight: double, number: int>>"
    return F.array(*[F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight"), F.lit(n).alias("number")) for p, w, n in nodes if w > 0]).cast(kind)


class Layout:
    """A tree's nodes as (path, weight, number) by level, and the regions whose open shards have to race."""

    def __init__(self, of: Tree):
        self.regions, self.racks, self.shards, self.races = [], [], [], {}
        n = 0
        for r, region in enumerate(of):
            self.regions.append((str(r), float(sum(map(sum, region))), r))
            self.racks.append([(f"{r}.{q}", float(sum(rack)), len(self.shards) + q) for q, rack in enumerate(region)])
            for q, rack in enumerate(region):
                self.shards.append([(f"{r}.{q}.{k}", float(w), n + k) for k, w in enumerate(rack)])
                n += len(rack)
            if any(isinstance(w, Spare) for rack in region for w in rack):
                self.races[r] = [[is_open(w) for w in rack] for rack in region]
        if not any(is_open(w) for region in of for rack in region for w in rack):
            raise ValueError("some shard must be open and have a weight above 0")

    def racing(self, r: int) -> list[tuple[tuple[str, float, int], list[tuple[str, float, int]], list[tuple[str, float, int]]]]:
        """(rack, its open shards, all its shards) of the racks of a region in which some shard is open."""
        out = []
        for rack, some in zip(self.racks[r], self.races[r], strict=True):
            own = self.shards[rack[2]]
            if any(some):
                out.append((rack, [x for x, yes in zip(own, some, strict=True) if yes], [x for x in own if x[1] > 0]))
        return out


def place(df: DataFrame, key: str, of: Tree, name: str = "shard") -> DataFrame:
    """df with the shard (numbered through the tree, spare ones too, from 0) of each row's key, one column; null keys are a key like any other.

    In full regions only the chosen region's racks and the chosen rack's shards draw, so a key costs the children along one path; a
    region with spares, as one at most of `tree` has, costs its racks and its open shards besides.
    """
    at, c = Layout(of), F.col(key)
    if not at.races:
        first = df.withColumn("_region", _choose(c, _children(at.regions)))
    else:
        held, full = [], [x for x in at.regions if x[2] not in at.races and x[1] > 0]
        for r in at.races:
            path, weight, _ = at.regions[r]
            least = F.array_min(F.array(*[_draw(c, p, w) for p, w, _ in at.racks[r] if w > 0]))
            for rack, some, every in at.racing(r):
                base = _draw(c, path, weight) + (_draw(c, rack[0], rack[1]) - least) - F.array_min(F.array(*[_draw(c, p, w) for p, w, _ in every]))
                held += [F.struct((base + _draw(c, p, w)).alias("draw"), F.lit(r).alias("region"), F.lit(n).alias("number")) for p, w, n in some]
        held += [F.struct(_draw(c, p, w).alias("draw"), F.lit(r).alias("region"), F.lit(-1).alias("number")) for p, w, r in full]
        first = df.withColumn("_won", F.array_min(F.array(*held))).withColumn("_region", F.col("_won.region")).withColumn("_open", F.col("_won.number")).drop("_won")
    racked = first.withColumn("_rack", _choose(c, F.get(F.array(*map(_children, at.racks)), F.col("_region"))))
    down = _choose(c, F.get(F.array(*map(_children, at.shards)), F.col("_rack")))
    if not at.races:
        return racked.withColumn(name, down).drop("_region", "_rack")
    return racked.withColumn(name, F.when(F.col("_open") >= 0, F.col("_open")).otherwise(down)).drop("_region", "_rack", "_open")


def slots(df: DataFrame, shard: str, key: str, order: list[str], name: str = "slot") -> DataFrame:
    """df with gapless numbers from 0 within each shard, in the order of `order`, which begins with the key (a long).

    Shards are numbered in buckets, ranges of the key with some `SLOT_ROWS` rows of all shards each, and each bucket goes on from
    the sum of the buckets before it, so that no task holds a shard and numbers don't depend on the buckets. Counts come from the key alone.
    """
    bucket, _ = range_buckets(df, key, SLOT_ROWS)
    df = df.withColumn("_bucket", bucket(F.col(key)))
    counts = df.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select(shard, "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    numbered = df.withColumn("_row", F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order)))
    return numbered.join(before, [shard, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("long")).drop("_bucket", "_row", "_before")


def op3_query(docs: DataFrame, shards: int = 40) -> DataFrame:
    """All documents in 40 shards by doc_id; only the number of shards and doc_id decide.

    Null texts have a size of 16 and checksum 0. Equal doc_ids share a shard and are numbered by checksum and size; null ids
    are one key, numbered first. An empty table gives none. Slots follow doc_id whatever the table's size.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    of = tree(shards)
    placed = place(place(rows, "doc_id", of), "doc_id", grown(of), "grown_shard")
    out = slots(placed, "shard", "doc_id", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _sql_draw(path: str, weight: float) -> str:
    return f"-ln((CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '/{path}'), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0) / {weight}"


def _sql_choose(nodes: list[tuple[str, float, int]]) -> str:
    """SQL for the number of the child with the least draw."""
    cells = ", ".join(f"{{'d': {_sql_draw(p, w)}, 'k': {n}}}" for p, w, n in nodes)
    return f"list_min([{cells}]).k"


def _sql_shard(of: Tree) -> str:
    at = Layout(of)
    shard = [_sql_choose(x) for x in at.shards]
    down = [f"CASE {_sql_choose(x)} {' '.join(f'WHEN {q} THEN {shard[q]}' for _, _, q in x)} END" for x in at.racks]
    if not at.races:
        return f"CASE {_sql_choose(at.regions)} {' '.join(f'WHEN {r} THEN {x}' for r, x in enumerate(down))} END"
    cells = [f"{{'d': {_sql_draw(p, w)}, 'r': {r}, 'k': -1}}" for p, w, r in at.regions if r not in at.races]
    for r in at.races:
        path, weight, _ = at.regions[r]
        least = f"list_min([{', '.join(_sql_draw(p, w) for p, w, _ in at.racks[r])}])"
        for rack, some, every in at.racing(r):
            own = f"list_min([{', '.join(_sql_draw(p, w) for p, w, _ in every)}])"
            cells += [f"{{'d': {_sql_draw(path, weight)} + ({_sql_draw(rack[0], rack[1])} - {least}) - {own} + {_sql_draw(p, w)}, 'r': {r}, 'k': {n}}}" for p, w, n in some]
    won = f"list_min([{', '.join(cells)}])"
    return f"CASE WHEN {won}.k >= 0 THEN {won}.k ELSE CASE {won}.r {' '.join(f'WHEN {r} THEN {x}' for r, x in enumerate(down) if r not in at.races)} END END"


#: Slots follow doc_id through the whole shard, as the operator's do.
OP3_SQL = f"""
WITH step AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
placed AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, 'key' AS law,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST(('0x' || h) AS BIGINT))),
      lambda c, b: xor(c // 256, step.t[xor(c % 256, b) + 1])), 4294967295) AS text_crc32,
    CAST({_sql_shard(tree(40))} AS INTEGER) AS shard, CAST({_sql_shard(grown(tree(40)))} AS INTEGER) AS grown_shard
  FROM documents, step)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM placed
"""
