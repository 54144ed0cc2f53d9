import numpy as np
import pytest

from shellgraph.llm import common, link_graph as M
from shellgraph.llm.queries import RULES

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("url,host,path", [
    ("http://A.Example.com/en/1?x#y", "a.example.com", "/en/1"), (None, "", ""), ("no scheme", "", ""), ("x://h", "h", ""), ("x://h?q=/a", "h", ""),
    ("a://b#c://d/e", "b", ""), ("http://É.com/p#q", "É.com", "/p"), ("http:///p", "", "/p"), ("s://h\n/x\ny?z", "h\n", "/x\ny"),
])
def test_parts(spark, url, host, path):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(url,)], "u string").select(M.host_of(F.col("u")).alias("h"), M.path_of(F.col("u")).alias("p")).first()
    assert (r.h, r.p) == (host, path)


@pytest.mark.parametrize("url,rule", [
    ("http://com/en/", "com/en/"), ("http://a.com/en/8", "com/en/"), ("http://a.example.com/en/71", "example.com/en/7"), ("http://xexample.com/en/7", "com/en/"),
    ("http://x.net/de/8", "net/de/"), ("http://example.net/de/80", "example.net/de/8"), ("http://x.org/es/", "org/es/"), ("http://x.org/es", None), (None, None),
])
def test_rules(spark, url, rule):
    df = spark.createDataFrame([(1, url, None)], PAGES)
    r = M.judge(df, RULES).first()
    assert r.rule == rule and r.verdict in ("allow", "block")


def slow_rank(edges, seeds, damping=0.85):
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    m, s = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts))
    for a, b, w in edges:
        m[at[b], at[a]] += w
    m /= np.maximum(m.sum(axis=0), 1e-300)
    for h, w in seeds.items():
        s[at[h]] = w / sum(seeds.values())
    x = s.copy()
    for _ in range(500):
        y = damping * (m @ x)
        x = y + (1 - y.sum()) * s
    return dict(zip(hosts, x, strict=True))


def test_pagerank(spark):
    rng = np.random.default_rng(3)
    edges = [(f"h{a}", f"h{b}", int(w)) for a, b, w in zip(rng.integers(0, 30, 90), rng.integers(0, 30, 90), rng.integers(1, 9, 90), strict=True) if a != b]
    seeds = {"h1": 2.0, "h5": 1.0, "alone": 1.0}
    got = M.propagate(common.Scratch(spark), spark.createDataFrame(edges, "src string, dst string, weight long"), spark.createDataFrame(list(seeds.items()), "host string, mass double"), tolerance=1e-7, rounds=200)
    want = slow_rank(edges, seeds)
    got = {r.host: r["rank"] for r in got.collect()}
    assert all(abs(got.get(h, 0) - want[h]) < 1e-5 for h in want)


def propagated(spark, edges, seeds, **limits):
    got = M.propagate(common.Scratch(spark), spark.createDataFrame(edges, "src string, dst string, weight long"), spark.createDataFrame(list(seeds.items()), "host string, mass double"), **limits)
    return {r.host: r["rank"] for r in got.collect()}


def test_small_seeds_reach_all(spark):
    """A seed with little of the mass is followed to its last host, by the default limits."""
    edges, seeds = [("b", "x1", 1), ("x1", "x2", 1), ("x2", "x3", 1), ("x3", "x2", 1), ("x3", "x4", 9)], {"big": 40000.0, "b": 1.0}
    got, want = propagated(spark, edges, seeds), slow_rank(edges, seeds)
    assert got == pytest.approx(want, rel=1e-5, abs=0)


def test_pagerank_closely(spark):
    rng = np.random.default_rng(3)
    edges = [(f"h{a}", f"h{b}", int(w)) for a, b, w in zip(rng.integers(0, 30, 90), rng.integers(0, 30, 90), rng.integers(1, 9, 90), strict=True) if a != b]
    seeds = {"h1": 2.0, "h5": 1.0, "alone": 1.0}
    got, want = propagated(spark, edges, seeds, tolerance=1e-9), slow_rank(edges, seeds)
    assert all(abs(got.get(h, 0) - want[h]) < 1e-6 for h in want)


def test_distrust_runs_backwards(spark):
    a = lambda *to: "".join(f'<a class="x" href="{t}">t</a>' for t in to)
    rows = [(1, "http://good.com/ok/", a("http://friend.com/x", "/local")), (2, "http://bad.com/no/", None), (3, "http://fan.com/", a("http://bad.com/1", "//bad.com/2")), (4, "http://friend.com/", ""), (5, "http://other.com/", "<a href='mailto:x'>")]
    rules = [M.Rule("allow", "good.com", "/ok/"), M.Rule("block", "bad.com", "/no/")]
    got = {r.page_id: r.verdict for r in M.judge(spark.createDataFrame(rows, PAGES), rules).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_odd(spark):
    rows = [(None, None, None), (1, "", ""), (1, "http://a.com/en/", "<a href=x>"), (1, "http://a.com/en/", "<a href=x>")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'h' as host", "1 as rank", "2 as trust")
    assert [(r.page_id, r.host, r.verdict) for r in sorted(M.judge(df, RULES).collect(), key=str)] == [(1, "", "allow"), (1, "a.com", "block"), (1, "a.com", "block"), (None, "", "allow")]
    assert M.judge(df.where("false"), RULES).collect() == []
