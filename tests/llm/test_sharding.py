"""Growth by one shard at every number of shards, slots in many buckets, and the SQL with them."""

import hashlib
import math
from collections import Counter

import duckdb
import pytest

from lodestone.llm import sharding


def draw(key, path, weight):
    u = (int(hashlib.md5(f"{key}/{path}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(u) / weight


def brute(key, of):
    """Every open shard's whole draw."""
    cells, n = [], 0
    for r, region in enumerate(of):
        racks = [draw(key, f"{r}.{q}", sum(rack)) for q, rack in enumerate(region)]
        for q, rack in enumerate(region):
            own = [draw(key, f"{r}.{q}.{k}", w) for k, w in enumerate(rack)]
            base = draw(key, str(r), sum(map(sum, region))) + (racks[q] - min(racks)) - min(own)
            cells += [(base + own[k], n + k) for k, w in enumerate(rack) if not isinstance(w, sharding.Spare)]
            n += len(rack)
    return min(cells)[1]


def test_every_tree_is_the_one_before_with_one_more_shard(spark):
    assert all(sharding.grown(sharding.tree(n)) == sharding.tree(n + 1) for n in range(1, 200))
    at = {n: [brute(i, sharding.tree(n)) for i in range(600)] for n in range(1, 62)}
    for n in range(1, 61):
        assert all(b in (a, n) and a < n for a, b in zip(at[n], at[n + 1], strict=True)), n
        moved = sum(a != b for a, b in zip(at[n], at[n + 1], strict=True))
        assert abs(moved / 600 - 1 / (n + 1)) < 4 * (1 / (n + 1) / 600) ** 0.5 + 0.003, n
    for n in (1, 7, 40, 41):
        got = {r["id"]: r["shard"] for r in spark.range(600).transform(sharding.place, "id", sharding.tree(n)).collect()}
        assert [got[i] for i in range(600)] == at[n], n


def test_shares_are_weights_while_a_region_fills(spark):
    for n in (13, 28):
        counts = Counter(r["shard"] for r in spark.range(30_000).transform(sharding.place, "id", sharding.tree(n)).collect())
        assert all(abs(c / 30_000 * n - 1) < 0.15 for c in counts.values()) and len(counts) == n
    uneven = [[[1.0, 3.0], [2.0]], [[sharding.Spare(4.0), 1.0], [sharding.Spare(1.0)]]]
    counts = Counter(r["shard"] for r in spark.range(30_000).transform(sharding.place, "id", uneven).collect())
    assert {*counts} == {0, 1, 2, 4}
    for s, share in ((0, 1 / 7), (1, 3 / 7), (2, 2 / 7), (4, 1 / 7)):
        assert abs(counts[s] / 30_000 - share) < 0.015
    with pytest.raises(ValueError, match="open"):
        sharding.place(spark.range(1), "id", [[[sharding.Spare(1.0)]]])


def test_sql_holds_with_many_buckets(spark, monkeypatch):
    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(c.sql(sharding.OP3_SQL).select("doc_id", "shard", "slot", "grown_shard").fetchall())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for rows in (100, 7):
        monkeypatch.setattr(sharding, "SLOT_ROWS", rows)
        assert sorted(tuple(r) for r in sharding.op3_query(docs).select("doc_id", "shard", "slot", "grown_shard").collect()) == want
