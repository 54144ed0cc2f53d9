import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shellgraph.llm import merkle as M

COLS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(part, r)))


def lower(t):
    return t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def build(nodes):
    """Root, and each leaf's siblings level by level."""
    out, at, ways = nodes, list(range(len(nodes))), [[] for _ in nodes]
    while len(out) > 1:
        for i, a in enumerate(at):
            run = out[a // 16 * 16 : a // 16 * 16 + 16]
            ways[i].append((run[: a % 16], run[a % 16 + 1 :]))
        out = [sha("".join(out[k : k + 16])) for k in range(0, len(out), 16)]
        at = [a // 16 for a in at]
    return out[0], ways


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    sub = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub[s] = build([leaf(r) for r in by[s]])
    root, crown = build([sub[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for r, way in zip(by[s], sub[s][1], strict=True):
            full = way + crown[k]
            now = leaf((*r[:4], lower(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
            for left, right in full:
                now = sha("".join(left) + now + "".join(right))
            out.append((r[0], leaf(r), sub[s][0], root, sha("".join(x for a, b in full for x in (*a, *b))), now, now == root))
    return sorted(map(repr, out))


def changed():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def check(spark, rows, parts=None):
    df = spark.createDataFrame(rows, COLS)
    got = M.verify(df.repartition(parts) if parts else df, changed())
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("n,sources,parts", [(1, 1, 1), (16, 1, 3), (17, 2, 1), (300, 3, 7), (5000, 40, 5), (700, 700, 4)])
def test_against_brute_force(spark, n, sources, parts):
    r = random.Random(n)
    rows = [(i, r.choice([None, *[f"s{k}é" for k in range(sources)]]) if sources > 1 else "a", r.choice(["en", None, ""]), r.choice([None, i]), r.choice([None, "", "Text É", "plain"]) or "X" * (i % 9)) for i in range(n)]
    check(spark, rows, parts)


def test_one_source_has_most_rows(spark):
    check(spark, [(i, "hot" if i % 100 else f"s{i}", "en", 1, f"T{i}") for i in range(6000)], 6)


def test_repeated_rows_and_odd_ones(spark, odd, none):
    rows = [tuple(r[c] for c in M.FIELDS) for r in odd.collect()] + [(1, "a", "en", 1, "Same")] * 400
    check(spark, rows, 3)
    got = M.verify(odd, changed())
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute([tuple(r[c] for c in M.FIELDS) for r in odd.collect()])
    assert M.verify(none, changed()).collect() == [] and M.manifest(none).collect() == []


def test_large_source_in_many_ranges(spark):
    """More leaves than one task builds a subtree of."""
    rows = spark.range(70_000).selectExpr("id as doc_id", "'a' as source", "'en' as lang", "1L as n_chars", "concat('T', id) as text")
    got = M.verify(rows, changed()).select("leaf", "proof_sha256", "verified", "doc_id").collect()
    leaves = [leaf((i, "a", "en", 1, f"T{i}")) for i in range(70_000)]
    root, ways = build(leaves)
    assert len(got) == 70_000
    for r in got:
        assert r.leaf == leaves[r.doc_id] and r.proof_sha256 == sha("".join(x for a, b in ways[r.doc_id] for x in (*a, *b)))
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 5 != 0)


def test_proofs_fold_to_the_root(spark):
    rows = spark.range(500).selectExpr("id as doc_id", "cast(id % 3 as string) as source", "'en' as lang", "1L as n_chars", "'x' as text")
    for r in M.manifest(rows).collect():
        assert M.fold(r.leaf, [(s.lefts, s.rights) for s in r.proof]) == r.root


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
def test_query(spark):
    from shellgraph.llm import queries

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*M.FIELDS).collect()]
    got = queries.queries()["op13_merkle_manifest"](spark, "/root/testdata/sf0.001")
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)
