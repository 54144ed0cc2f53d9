import random

import numpy as np
import pyarrow as pa
import pytest

from shellgraph.llm import decontam as M

BENCH = "item_id long, text string"


def corpus(seed, n_items=70, vocab=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)]
    pick = lambda n: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(vocab)], k=n))
    items = [pick(rng.randrange(3, 30)) for _ in range(n_items)]
    return rng, pick, items


@pytest.mark.parametrize("seed", range(6))
def test_search_is_exhaustive(seed):
    """Block-max WAND finds what scoring every item finds."""
    rng, pick, items = corpus(seed)
    index = M.Index(list(range(len(items))), pa.array(items), M.Rules(threshold=0.35, block=4, least=1))
    tests = []
    for _ in range(60):
        text = pick(40) + " " + rng.choice(items) if rng.random() < 0.5 else pick(60)
        (_, _, h, counts, _), = M._words(pa.array([text]))
        t = index.lookup(h)
        tests.append(np.unique(t[t >= 0]))
    assert sum(len(p.members) for p in index.parts) == len(set(items))
    for part in index.parts:
        full = np.zeros((len(index.terms), len(part.members)))
        full[part.post_term, part.post_item] = part.score
        for t in tests:
            scores = full[t].sum(axis=0)
            want = {int(i): scores[i] for i in np.flatnonzero(scores >= 0.35 - 1e-9)}
            got = dict(part.search(t))
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


@pytest.mark.parametrize("seed", range(3))
def test_no_passage_is_missed(seed):
    """The first filter passes every window in which an item reaches the threshold."""
    rng, pick, items = corpus(seed, vocab=2000)
    rules = M.Rules(threshold=0.5, question=0, answer=0, least=16, part=20)
    index = M.Index(list(range(len(items))), pa.array(items), rules)
    texts = [pick(rng.randrange(0, 400)) + " " + rng.choice([*items, ""]) + " " + pick(rng.randrange(0, 200)) for _ in range(40)]
    (_, _, h, counts, first), = M._words(pa.array(texts))
    got = index.leaks(h, counts, first)
    assert len(index.parts) > 2
    for r in range(len(texts)):
        words = h[first[r] : first[r] + counts[r]]
        want = {}
        for part in index.parts:
            for a in range(0, max(1, len(words)), part.window // 2):
                t = index.lookup(words[a : a + part.window])
                for k, score in part.search(np.unique(t[t >= 0])):
                    item = int(part.members[k])
                    want[item] = max(score, want.get(item, 0))
        assert {i: round(s[0], 9) for (q, i), s in got.items() if q == r} == {i: round(s, 9) for i, s in want.items()}


def test_leaks_and_clean(spark):
    _, pick, items = corpus(9, vocab=3000)
    rng = random.Random(1)
    docs = [(i, pick(300) + "\n" + (rng.choice(items).upper().replace(" ", ", ") if i % 3 == 0 else "") + " " + pick(200)) for i in range(30)]
    found = M.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), BENCH))
    assert {r.doc_id for r in found.collect() if r.question_overlap == 1} >= {i for i in range(30) if i % 3 == 0}


def brute(docs, items, rules):
    """Plain BM25 of every item in every window of its own class: {(doc, item)} that leak."""
    import math
    import re

    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    own = [words(t) for t in items]
    df = {}
    for w in own:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    mean = sum(map(len, own)) / len(own)
    out = set()
    for n, w in enumerate(own):
        idf = {x: math.log1p((len(own) - df[x] + 0.5) / (df[x] + 0.5)) for x in w}
        norm = rules.k1 * (1 - rules.b + rules.b * len(w) / mean)
        gain = {x: idf[x] * w.count(x) * (rules.k1 + 1) / (w.count(x) + norm) for x in w}
        width = max(rules.least // 2, 2 ** math.ceil(math.log2(len(w))))
        cut = max(1, len(w) - max(1, len(w) // 3))
        two = list(zip(w, w[1:], strict=False))
        question, answer = set(two[: cut - 1]), set(two[cut - 1 :])
        for i, text in docs:
            d = words(text)
            for a in range(0, max(1, len(d)), width):
                part = d[a : a + 2 * width]
                have, pairs = set(part), set(zip(part, part[1:], strict=False))
                share = lambda s: len(s & pairs) / len(s) if s else 1.0  # noqa: B023, E731
                if sum(v for x, v in gain.items() if x in have) / sum(gain.values()) >= rules.threshold - 1e-9 and share(question) >= rules.question and share(answer) >= rules.answer:
                    out.add((i, n))
    return out


@pytest.mark.parametrize("rules", [M.Rules(), M.Rules(threshold=0.4, question=0.3, answer=0.3, least=8)])
def test_against_brute_force(spark, rules):
    """All leaks, and no others, with items of very different lengths, some alike."""
    rng, pick, items = corpus(5, vocab=400)
    items += [pick(300), pick(1500), items[0], items[3] + " more"]
    parts = lambda t: " ".join(w for w in t.split() if rng.random() < 0.8)
    docs = [(i, " ".join([pick(rng.randrange(0, 200)), parts(rng.choice(items)), pick(rng.randrange(0, 100))])) for i in range(40)]
    found = M.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), BENCH), rules)
    got = [(r.doc_id, r.item_id) for r in found.collect()]
    assert sorted(got) == sorted(brute(docs, items, rules)) and len(got) >= 10


def test_one_long_item_changes_nothing(spark):
    """Words of an item that are scattered over a long text are no leak, with or without a long item in the test set."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    w = item.split()
    rng = random.Random(2)
    fill = lambda n: " ".join(f"f{rng.randrange(5000)}" for _ in range(n))
    docs = [(i, " ".join(x for k in range(0, 12, 3) for x in (" ".join(w[k : k + 3]), fill(2000)))) for i in range(20)] + [(99, fill(50) + " " + item)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for more in ([], [(2, " ".join(f"long{i}" for i in range(10_000)))]):
        assert [(r.doc_id, r.item_id) for r in M.find_leaks(df, spark.createDataFrame([(1, item), *more], BENCH)).collect()] == [(99, 1)]


def test_equal_items_are_counted_once():
    """40,000 items of the same three words among 80,000 cost no more than one."""
    import tracemalloc

    texts = ["same three words"] * 40_000 + [f"a{i} b{i} c{i}" for i in range(40_000)]
    index = M.Index(list(range(80_000)), pa.array(texts), M.Rules())
    (_, _, h, counts, first), = M._words(pa.array(["same three words " * 200]))
    tracemalloc.start()
    found = index.leaks(h, counts, first)
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    assert [len(index.ids[item]) for _, item in found] == [40_000]


def test_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs"), (2, None), (3, ""), (None, "two words"), (4, "?!"), (1, "quick brown fox jumps over the lazy dog and runs")], BENCH)
    got = [(r.doc_id, r.item_id) for r in M.find_leaks(odd, bench).collect()]
    assert set(got) == {(1, 1), (2, 1)} and got.count((1, 1)) >= 2
    assert M.find_leaks(none, bench).collect() == [] and M.find_leaks(odd, bench.where("false")).collect() == []
    kept = M.drop_leaks(odd, bench)
    assert kept.schema == odd.schema and kept.count() == odd.count() - 3
    with pytest.raises(ValueError):
        M.build_index(bench, M.Rules(max_items=1))
