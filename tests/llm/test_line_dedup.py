import hashlib
import random
from collections import Counter

import pytest

from shellgraph.llm import common as C
from shellgraph.llm import line_dedup as M

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(texts, least, chars=1):
    lines = [(t or "").split("\n") for t in texts]
    have = Counter(k for ls in lines for k in {key(x) for x in ls})
    out = []
    for ls in lines:
        kept = [x for x in ls if not (len(key(x)) >= chars and have[key(x)] >= least)]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def random_texts(n, seed=1):
    r = random.Random(seed)
    common = ["Subscribe  now", "ÄÖ über", "© 2020", "read MORE", " "]
    word = lambda: "".join(r.choice("abÄ Z\t") for _ in range(r.randint(0, 6)))
    return ["\n".join(r.choice([word, lambda: r.choice(common), lambda: "\t" + r.choice(common).upper() + "\r"])() for _ in range(r.randint(0, 8))) for _ in range(n)]


@pytest.mark.parametrize("batches,fanout,least,chars", [(1, 4, 3, 1), (5, 2, 3, 1), (4, 3, 10, 2), (3, 2, 1, 1)])
def test_against_brute_force(spark, batches, fanout, least, chars):
    texts = [*random_texts(120), None, "", "\n", "\n\n a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in M.drop_common(df, M.Lines(least, chars, batches, fanout)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, least, chars)


def test_odd_rows(spark, odd, none):
    rows = odd.collect()
    out = M.drop_common(odd, M.Lines(min_docs=2))
    assert set(out.columns) == {*odd.columns, "n_lines", "n_dropped"}
    want = brute([r.text for r in rows], 2)
    expect = sorted(repr((r.doc_id, n, d, hashlib.md5(t.encode()).hexdigest())) for r, (n, d, t) in zip(rows, want, strict=True))
    assert sorted(repr((r.doc_id, r.n_lines, r.n_dropped, hashlib.md5(r.text.encode()).hexdigest())) for r in out.collect()) == expect
    assert M.drop_common(none).collect() == []


def test_hot_line_and_many_lines_in_one_text(spark):
    long = "\n".join(f"line {i % 5000}" for i in range(30_000))
    df = spark.createDataFrame([(i, "same\nown %d\nsame" % i) for i in range(300)] + [(1000, long), (1001, long)], "doc_id int, text string")
    got = {r.doc_id: r for r in M.drop_common(df, M.Lines(min_docs=2)).collect()}
    assert all(got[i].text == f"own {i}" and got[i].n_dropped == 2 for i in range(300))
    assert got[1000].text == "" and got[1000].n_dropped == 30_000


def test_levels_and_reopening(spark):
    """Runs are merged by level; a batch counts once; the index can be opened again."""
    root = C.Scratch(spark).path("index")
    index = M.Runs(spark, root, buckets=3, fanout=2, enough=1000)
    rows = lambda a, b: spark.range(a, b).selectExpr("id as h1", "id * 7 as h2", "1L as n")
    for k in range(5):
        index.add(f"b{k}", rows(0, 10 * (k + 1)))
    assert [r["level"] for r in index.state["runs"]] == [2, 0]
    index.close()
    again = M.Runs(spark, root)
    again.add("b4", rows(0, 50))
    assert (again.buckets, again.fanout, again.enough) == (3, 2, 1000) and len(again.state["runs"]) == 2
    assert {r.h1 for r in again.common(3).collect()} == set(range(30))
    assert again.common(5).count() == 10
    again.close()


def test_runs_do_not_move(spark):
    """The anti-join reads a run in its buckets: only the batch is shuffled."""
    index = M.Runs(spark, C.Scratch(spark).path("index"), buckets=4)
    index.add("a", spark.range(100).selectExpr("id as h1", "id as h2", "1L as n"))
    plan = index.unsettled(spark.range(50, 150).selectExpr("id as h1", "id as h2", "1L as n"))
    assert sorted(r.h1 for r in plan.collect()) == list(range(100, 150))
    text = plan._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in text
    index.close()


def test_keep_first_over_batches(spark):
    index = M.Runs(spark, C.Scratch(spark).path("index"), buckets=2, fanout=2)
    texts = random_texts(90, seed=3)
    seen, want = set(), []
    for t in texts:
        kept = []
        for x in t.split("\n"):
            if key(x) == "" or key(x) not in seen:
                kept.append(x)
                seen.add(key(x))
        want.append("\n".join(kept))
    got = []
    for b in range(3):
        df = spark.createDataFrame([(i, texts[i], "x") for i in range(30 * b, 30 * b + 30)], "doc_id int, text string, h1 string")
        got += M.keep_first(df, index, str(b), ["doc_id"]).collect()
    assert [r.text for r in sorted(got)] == want
    with pytest.raises(ValueError):
        M.keep_first(df, index, "2", ["doc_id"])
    index.close()
