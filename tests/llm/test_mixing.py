import random
import re

import pytest
from pyspark.sql import functions as F

from shellgraph.llm import mixing as M


def water(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by resharing in rounds."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        part = {s: left * w[s] / sum(w[q] for q in open_) for s in open_}
        over = {s for s in open_ if part[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target | part
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 10, 500, 10_000]) + rng.randrange(50) for s in ["a", "B", "é", "zz", "z", None, "𝒳"][: rng.randrange(2, 8)]}
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), M.Mix()).collect()}
    want = water(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 60) + ("\x0b é\x85" if i % 5 == 0 else ""), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_taken(spark, docs):
    rows = M.taken(docs, M.Mix()).collect()
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    sizes, got, target = {}, {}, {}
    for r in rows:
        text, source = texts[r.doc_id]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text)) and r.taken <= 2 * r["size"] and r.taken == len(r.shards) * r["size"]
        sizes[source] = sizes.get(source, 0) + r["size"]
        got[source] = got.get(source, 0) + r.taken
        target[source] = r.target
    want = water(sizes)
    assert len(rows) == 1500 and all(abs(target[s] - want[s]) < 1e-6 * want[s] and abs(got[s] - want[s]) <= 0.01 * want[s] for s in want)
    assert sorted(map(str, rows)) == sorted(map(str, M.taken(docs.repartition(11), M.Mix()).collect()))


def test_quotas_are_exact_and_even(spark, docs):
    mix = M.Mix(levels=3)
    dealt = M.deal(M.plan(docs, mix), mix).select("source", "block", "full", F.explode("draws").alias("d")).select("source", "block", "full", "d.*").collect()
    assert len(dealt) == len({(r.source, r.round, r.block) for r in dealt})  # each draw in one shard
    assert all(r.round <= r.full for r in dealt)
    got = M.quotas(spark.createDataFrame([("a", 80), ("b", 40), (None, 8), ("none", 0)], "source string, n long"), mix).collect()
    totals, shards = {}, {}
    for r in got:
        totals[r.source] = totals.get(r.source, 0) + r.quota
        shards[r.shard] = shards.get(r.shard, 0) + r.quota
    assert totals == {"a": 80, "b": 40, None: 8} and shards == {i: 16 for i in range(8)}
    per = {}
    for r in dealt:
        per[r.shard] = per.get(r.shard, 0) + 1
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 1


def test_quotas_follow_the_law(spark):
    """Means and variances of the sources' draws that go left, over 600 trees of one level, against those of the
    multivariate hypergeometric law; 300 sources, so that groups hold several."""
    counts = {"a": 60, "b": 30, "c": 10}
    items = F.array(*[F.struct(F.lit(k).alias("source"), F.lit(n).cast("long").alias("n")) for k, n in counts.items()])
    lefts = M._split(items, lambda x: x["n"], lambda x: x["source"], F.lit(50).cast("long"), F.col("id"))
    rows = [r[0] for r in spark.range(600).select(lefts).collect()]
    assert all(sum(r) == 50 for r in rows)
    for i, n in enumerate(counts.values()):
        x = [r[i] for r in rows]
        mean, var = sum(x) / 600, sum((v - sum(x) / 600) ** 2 for v in x) / 599
        law = 50 * n / 100 * (1 - n / 100) * 50 / 99
        assert abs(mean - n / 2) < 4 * (law / 600) ** 0.5 and 0.75 * law < var < 1.3 * law
    many = spark.createDataFrame([(f"s{i}", 1 + i % 5) for i in range(300)], "source string, n long")
    got = M.quotas(many, M.Mix(levels=1)).groupBy("shard").agg(F.sum("quota")).collect()
    assert sorted(r[1] for r in got) == [450, 450]


def test_equal_rows(spark):
    """Two thousand equal rows of another column's values among others: each is drawn for itself."""
    rows = [(1, "one two three", "a", i) for i in range(2000)] + [(i, "w " * (i % 9 + 1), "ab"[i % 2], i) for i in range(2, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, dup int").repartition(6)
    want = sum(len(r.shards) for r in M.taken(df).collect() if r.doc_id == 1)
    got = [r.dup for r in M.mix_documents(df).collect() if r.doc_id == 1]
    assert len(got) == want and max(got.count(x) for x in set(got)) <= 2


def test_documents(docs, odd, none):
    want = {r.doc_id: len(r.shards) for r in M.taken(docs).collect()}
    got = {}
    for r in M.mix_documents(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    mixed = M.mix_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    assert all(r[c] == "x" for r in mixed.collect() for c in odd.columns[5:])
    drawn = {}
    for r in mixed.collect():
        drawn[r.doc_id, r.text] = drawn.get((r.doc_id, r.text), 0) + 1
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    wanted = {}
    for r in M.taken(odd).collect():
        wanted[r.doc_id] = wanted.get(r.doc_id, 0) + r.taken
    for i in wanted:
        assert wanted[i] == sum(n * words(t) for (d, t), n in drawn.items() if d == i)
    rows = M.taken(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r["size"] for r in rows)
    assert M.taken(none).collect() == [] and M.mix_documents(none).collect() == []
