from collections import Counter

import pytest
from pyspark.sql import functions as F

from shellgraph.llm import jump_hash as M


@pytest.mark.parametrize("n", [1, 2, 7, 16, 100])
def test_only_the_new_shard_gains(spark, n):
    rows = spark.range(20_000).select(M.jump_shard(F.col("id"), n).alias("a"), M.jump_shard(F.col("id"), n + 1).alias("b")).collect()
    moved = [r for r in rows if r.a != r.b]
    assert all(r.b == n for r in moved) and abs(len(moved) - 20_000 / (n + 1)) < 6 * (20_000 / (n + 1)) ** 0.5
    counts = Counter(r.a for r in rows)
    assert set(counts) == set(range(n)) and max(counts.values()) < 20_000 / n + 6 * (20_000 / n) ** 0.5


def test_slots(spark):
    df = spark.range(5000).selectExpr("id % 4000 as doc_id", "repeat('é', cast(id % 7 as int)) as text").union(spark.range(3000).selectExpr("77L", "'same'"))
    rows = M.assign(df, 16).collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
    assert len(rows) == 8000 and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert len({r.shard for r in rows if r.doc_id == 77}) == 1
    again = M.assign(df.repartition(9), 16).collect()
    assert sorted(rows) == sorted(again)


def test_odd(odd, none):
    rows = M.assign(odd, 16).collect()
    assert len(rows) == odd.count()
    assert sorted(r["size"] for r in rows if r.doc_id in (3, 4, 10)) == [1, 1, 1 + len("𝒳 é ß 漢字 \U0001f600".encode())]
    assert M.assign(none, 16).collect() == []
    with pytest.raises(ValueError):
        M.jump_shard(F.lit(1), 0)


def test_many_shards(spark):
    """With thousands of shards nearly all get keys, and one shard more takes keys only into itself."""
    n = 3000
    both = spark.range(20_000).select(M.jump_shard(F.col("id"), n).alias("a"), M.jump_shard(F.col("id"), n + 1).alias("b")).collect()
    assert all(r.b in (r.a, n) for r in both) and 0 <= min(r.a for r in both) and max(r.a for r in both) < n
    assert len({r.a for r in both}) > 0.99 * n
