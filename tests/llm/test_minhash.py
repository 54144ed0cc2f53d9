import random
import re

import pytest

from shellgraph.llm import common, minhash as M


def slow(rows, k, percent):
    """component by smallest doc_id, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(d, low.get(root(i), d))
    return sorted((d, len(s), low[root(i)], d == low[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def variants(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgÉé") for _ in range(5))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([2, 30, 120]))]
        for _ in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(int(len(w) * rng.random() * 0.09)):
                w[rng.randrange(len(w))] = word()
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(w).upper() if rng.random() < 0.1 else " ".join(w)))
            n += 1
    rng.shuffle(rows)
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \x0b "), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two")]


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 85), (2, 3, 85), (3, 5, 80)])
def test_all_links(spark, seed, k, percent):
    rows = variants(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = M.near_duplicates(df, M.MinHash(shingle=k, percent=percent, tables=12)).collect()
    assert sorted(map(tuple, got)) == slow(rows, k, percent)


def test_parities_bound_the_difference():
    from shellgraph.llm.common import mix, seeds

    a = mix(seeds(500, 1))
    b = mix(seeds(500, 1))[100:]
    differ = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in M._parity(a) ^ M._parity(b))
    assert 60 <= differ <= 100


def test_odd(odd, none):
    rows = M.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by[1] == {(1, True)} and by[2] == {(1, False)} and by[8] == {(7, False)} and by[9] == {(9, True)} and by[None] == {(None, True)}
    assert M.near_duplicates(none).collect() == []
    kept = M.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 9, 9, 10] and kept.where("doc_id is null").count() == 2
    assert all(r[c] == "x" for r in kept.collect() for c in odd.columns[5:])
    assert M.keep_one(none).collect() == []


def test_keep_one_on_ties(spark):
    """Of a component one row stays, also where its rows have no doc_id or share one; names clash with inner ones."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(None, words, 1), (None, words + " more", 2), (5, "other text of five words here", 3), (5, "Other text of five words here", 4), (5, "something else", 5), (5, "something else", 5), (None, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id int").selectExpr("*", "'x' as text_a", "'y' as Keep_B", "'z' as root")
    kept = M.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.keep_id) for r in kept.collect()), key=str)
    assert len(got) == 4 and (5, 5) in got and (None, 6) in got and len({(5, 3), (5, 4)} & set(got)) == 1 and len({(None, 1), (None, 2)} & set(got)) == 1


def test_pairs_of_a_large_group_are_made_once(spark, monkeypatch):
    """A thousand unequal near copies of one text: the pairs that are confirmed are distinct and few."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(120)], []
    for n in range(1000):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(120)] = word()
        rows.append((n, " ".join(w)))
    made, old = [], common.bucket_links

    def spy(scratch, members, facts, close, first, confirm):
        def counted(pairs):
            kept = scratch.save(pairs, "pairs")
            made.append((kept.count(), kept.distinct().count()))
            return confirm(kept)

        return old(scratch, members, facts, close, first, counted)

    monkeypatch.setattr(common, "bucket_links", spy)
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == slow(rows, 3, 85)
    assert all(n == d for n, d in made) and sum(n for n, _ in made) < 20 * len(rows)


def joins(plan):
    """(keys, rows made) of the joins of an executed plan."""
    if "QueryStage" in plan.getClass().getSimpleName():
        return joins(plan.plan())
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return joins(plan.executedPlan())
    own = []
    if "HashJoin" in plan.getClass().getSimpleName() or "MergeJoin" in plan.getClass().getSimpleName():
        own = [(re.sub(r"#\d+L?", "", plan.leftKeys().mkString(",")), plan.longMetric("numOutputRows").value())]
    below = plan.children()
    return own + [x for i in range(below.size()) for x in joins(below.apply(i))]


def test_facts_meet_nodes_once(spark, monkeypatch):
    """What is known of a node joins it once, however many buckets it is in."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(100)], []
    for n in range(300):
        w = list(base)
        for _ in range(rng.randrange(1, 8)):
            w[rng.randrange(100)] = word()
        rows.append((n, " ".join(w)))
    seen, old = [], common.bucket_links

    def spy(scratch, members, facts, close, first, confirm):
        def looked(pairs):
            pairs.collect()
            seen.extend(n for keys, n in joins(pairs._jdf.queryExecution().executedPlan()) if keys == "node")
            return confirm(pairs)

        return old(scratch, members, facts, close, first, looked)

    monkeypatch.setattr(common, "bucket_links", spy)
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == slow(rows, 3, 85)
    assert seen and max(seen) <= len(rows)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (2000, 3000), (3000, 2000)]
    got = {r.node: r.root for r in common.components(common.Scratch(spark), spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_components_of_stars_take_no_round_and_small_tables_few_tasks(spark, monkeypatch):
    saved, save = [], common.Scratch.save

    def noted(self, df, name):
        out = save(self, df, name)
        saved.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(common.Scratch, "save", noted)
    monkeypatch.setattr(common, "SMALL_ROWS", 1000)
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    star = spark.range(1, 500).selectExpr("id as u", "id % 5 * -1 - 1 as v")
    got = {r.node: r.root for r in common.components(common.Scratch(spark), star).collect()}
    assert got == {i: -(i % 5) - 1 for i in range(1, 500)} | {-i: -i for i in range(1, 6)}
    assert [name for name, _ in saved] == ["edges"]
    saved.clear()
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chain = spark.range(30).selectExpr("id as u", "id + 1 as v").union(spark.range(300, 400).selectExpr("id", "300 + (id - 300) div 2"))
        got = {r.node: r.root for r in common.components(common.Scratch(spark), chain).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    assert got == {i: 0 for i in range(31)} | {i: 300 for i in range(300, 400)}
    assert len(saved) > 2 and all(files <= 4 for name, files in saved if name in ("large", "star"))
