"""Behaviours that the shipped outputs don't exercise, on small made-up structures."""

from collections import Counter
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shellgraph import schema
from shellgraph.functions import chemistry
from shellgraph.operators import distance, lookup, matching, residues, topk
from shellgraph.plans import batch, compare, dedup, network
from shellgraph.sources import files, reports, structures
from shellgraph.streaming import watch


def line(serial, name, res, chain, num, x, y, z, el="", alt=" ", occ=1.0, rec="ATOM  ", icode=" "):
    pad = name if len(name) == 4 else f" {name:<3}"
    return f"{rec}{serial:5d} {pad}{alt}{res:>3} {chain}{num:4d}{icode}   {x:8.3f}{y:8.3f}{z:8.3f}{occ:6.2f}{0:6.2f}          {el:>2}"


def atoms(spark, spec):
    rows = []
    for i, (res, num, chain, name, el, xyz, *more) in enumerate(spec):
        sid = more[0] if more else "s"
        f = [float(np.float32(v)) for v in xyz]
        rows.append((sid, 0, chain, "H" if res in ("ZN", "OEX", "HEM", "HOH") else " ", res, num, "", name, "", el, *f, 1.0, i))
    return spark.createDataFrame(rows, schema.ATOM)


def net(spark, spec, **kw):
    return network.coordination_network(atoms(spark, spec), network.Settings(("zn",), **kw))


def chosen(df):
    return {(r.resname, r.resnum, r.atom_name) for r in df.collect()}


ZN = ("ZN", 1, "A", "ZN", "ZN", (0, 0, 0))


def test_pdb_scan(spark, tmp_path):
    text = [line(1, "N", "GLY", "A", 1, 30.549, 1, 2, "N"), line(2, "O", "HOH", "A", 2, 1, 1, 1, "O", "A", 0.5, "HETATM"), line(3, "O", "HOH", "A", 2, 2, 2, 2, "O", "B", 0.5, "HETATM"), "TER", line(4, "CA", "GLY", "A", 1, 0, 0, 0), "ATOM  bad line", "END"]
    (tmp_path / "x.pdb").write_text("\r\n".join(text))
    got = structures.read_pdb(spark, str(tmp_path / "x.pdb")).orderBy("ordinal").collect()
    assert [(r.atom_name, r.element, r.x) for r in got] == [("N", "N", 30.548999786376953), ("O", "O", 1.0), ("CA", "C", 0.0)]
    assert got[0].structure_id == "x" and [r.hetflag for r in got] == [" ", "W", " "]
    models = ["MODEL        1", line(1, "N", "GLY", "A", 1, 0, 0, 0, "N"), "ENDMDL", "MODEL        2", line(1, "N", "GLY", "A", 1, 5, 0, 0, "N")]
    (tmp_path / "m.pdb").write_text("\n".join(models))
    assert sorted((r.model, r.x) for r in structures.read_pdb(spark, str(tmp_path / "m.pdb")).collect()) == [(0, 0.0), (1, 5.0)]
    with pytest.raises(ValueError):
        structures.read_structures(spark, ["a.xyz"], strict=True)
    assert structures.read_structures(spark, []).collect() == []


def test_boundary_and_carbon(spark):
    n = net(spark, [ZN, ("HIS", 10, "A", "NE2", "N", (3, 0, 0)), ("HIS", 10, "A", "CE1", "C", (2, 0, 0)), ("SER", 11, "A", "OG", "O", (0, 3.6, 0)), ("SER", 12, "A", "OG", "O", (0, 0, 3.61))])
    assert chosen(n.pcs) == {("HIS", 10, "NE2"), ("SER", 11, "OG")}


TOP = [
    ZN, ("ARG", 1, "A", "NE", "N", (3, 0, 0)), ("ARG", 1, "A", "NH1", "N", (2, 0, 0)), ("ARG", 1, "A", "NH2", "N", (2.5, 0, 0)),
    ("ASP", 2, "A", "OD1", "O", (0, 2, 0)), ("ASP", 2, "A", "OD2", "O", (0, 2.5, 0)), ("HIS", 3, "A", "ND1", "N", (0, 0, 2)), ("HIS", 3, "A", "NE2", "N", (0, 0, 3)),
    ("GLY", 4, "A", "N", "N", (-2, 0, 0)), ("GLY", 4, "A", "O", "O", (-3, 0, 0)),
]


def test_topk_and_two_hops(spark):
    n = net(spark, [*TOP, ("TYR", 9, "A", "OH", "O", (0, 0, 5))])
    assert chosen(n.pcs) == {("ARG", 1, "NE"), ("ARG", 1, "NH1"), ("ARG", 1, "NH2"), ("ASP", 2, "OD1"), ("ASP", 2, "OD2"), ("HIS", 3, "ND1"), ("GLY", 4, "N"), ("GLY", 4, "O")}
    assert chosen(n.scs) == {("TYR", 9, "OH")}
    e = n.edges.where("link_type = 'pcs->scs'").first()
    assert (e.src_atom, e.dst_atom, round(e.distance_A, 3)) == ("ND1", "OH", 3.0)


def test_topk_ignores_row_order(spark):
    a = atoms(spark, TOP)
    one, two = (network.coordination_network(x, network.Settings(("ZN",))).pcs for x in (a, a.repartition(7)))
    assert chosen(one) == chosen(two)


def test_expansion(spark):
    more = [("HIS", 3, "A", n, "C", (9, 9, i)) for i, n in enumerate(("CA", "CB", "CG", "CD2", "CE1"))] + [("HIS", 3, "A", "O", "O", (9, 9, 7)), ("HIS", 3, "A", "N", "N", (9, 9, 8))]
    his = lambda n: {a for r, _, a in chosen(n.pcs) if r == "HIS"}
    assert his(net(spark, TOP + more, expand=True, exclude_moieties=("IMIDAZOLE",))) == {"ND1", "CA", "N", "O"}
    assert his(net(spark, TOP + more, expand=True, exclude_moieties=())) == {"ND1", "CA", "N", "O", "CG", "CD2", "CE1", "NE2"}


def test_empty_cofactor(spark):
    n = net(spark, TOP[1:])
    assert n.pcs.collect() == n.scs.collect() == n.edges.collect() == [] and n.edges.columns[1:] == schema.EDGE


def test_bonds_and_interest(spark):
    a = atoms(spark, [("GLY", 4, c, n, n[0], (i, 0, 0)) for c in "AB" for i, n in enumerate(("N", "CA", "C", "O"))] + [("GLY", 5, "A", "N", "N", (0, 0, 0))])
    got = {(r.chain, r.a1, r.a2) for r in network.bonds(a).collect()}
    assert got == {(c, *p) for c in "AB" for p in (("N", "CA"), ("CA", "C"), ("C", "O"))}
    assert {(r.resnum, r.chain) for r in network.residues_of_interest(a, [3]).collect()} == {(4, "A"), (4, "B")}


def test_residue_zero(spark):
    spec = [("ZN", 0, "A", "ZN", "ZN", (0, 0, 0)), *TOP[1:]]
    n = net(spark, spec)
    assert network.atom_report(n).where("resname = 'ZN'").count() == 0 and network.atom_report(n, strict_parity=False).where("resname = 'ZN'").count() == 1


def test_chemistry():
    m = chemistry.moieties()
    assert m["GLU", "OE1"] == "COO" and ("GLU", "CB") not in m and m["GLY", "HA2"] == "backbone" and ("PRO", "H") not in m and m["HEM", "NA"] == "heme_por" and m["HEM", "FE"] == "heme_fe"
    b = chemistry.bonds()
    assert ("GLY", "N", "CA") in b and len({r for r, *_ in b}) >= 30 and len(b) == len(set(b))
    count = Counter(r for r, *_ in b)
    assert {r: count[r] for r in ("HEM", "HEA", "HM1", "HM2", "SRM")} == {"HEM": 78, "HEA": 82, "HM1": 84, "HM2": 82, "SRM": 70}
    assert {r: count[r] for r in ("GLY", "ASP", "HIS", "ARG", "TRP", "PRO", "SF4", "OEX", "ICS", "HCA", "SO3", "CU1")} == {"GLY": 8, "ASP": 12, "HIS": 15, "ARG": 15, "TRP": 18, "PRO": 12, "SF4": 12, "OEX": 15, "ICS": 33, "HCA": 11, "SO3": 3, "CU1": 1}
    assert m["ANY", "O"] == m["ANY", "N"] == "backbone" and m["ANY", "OXT"] == "c_terminus"


OEX = {"CA1": (0, 0, 0), "MN1": (1, 2, 0), "MN2": (3, 0, 1), "MN3": (0, 1, 4), "MN4": (2, 2, 2)}


def _template(spark, names=OEX):
    return atoms(spark, [("OEX", 1, "A", n, "X", p) for n, p in names.items()])


def _network(spark):
    rows = [(i, "" if i == 0 else "PCS", "OEX", "1", "A", n, "m", "interactor", *map(float, p)) for i, (n, p) in enumerate(OEX.items())]
    rows.append((9, "SCS", "SER", "7", "A", "OG", "hydroxyl", "interactor", 5.0, 5.0, 5.0))
    return spark.createDataFrame(rows, "ordinal long, category string, resname string, resnum string, chain string, atom_name string, moiety string, interactor string, x double, y double, z double")


def test_alignment(spark):
    turn = lambda p: (-p[1] + 1, p[0] + 2, p[2] + 3)  # noqa: E731  90 degrees about z, then moved
    spec = [("MY-OEX", 5, "Q", "CAL" if n == "CA1" else n, "X", turn(p)) for n, p in OEX.items() if n != "MN4"]
    spec += [("SER", 7, "Q", "OG", "O", turn((5, 5, 5))), ("HOH", 8, "Q", "O", "O", turn((2, 2, 2)))]
    flipped = [("OEX", 5, "Q", n, "X", (-p[0], p[1], p[2]), "mirror") for n, p in OEX.items()]
    few = [("OEX", 5, "Q", n, "X", p, "few") for n, p in list(OEX.items())[:2]]
    c = compare.compare(_template(spark), _network(spark), atoms(spark, spec + flipped + few))
    fits = {r.structure_id: r for r in c.fits.collect()}
    assert set(fits) == {"s", "mirror"} and fits["s"].rmsd < 1e-4 and fits["mirror"].rmsd > 0.1 and fits["s"].n == 4
    for r in fits.values():
        rot = np.array([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)])
        assert abs(np.linalg.det(rot) - 1) < 1e-9
    m = {r.template_atom: r for r in c.matches.where("job_name = 's'").collect()}
    assert m["OG"].matched_within_cutoff == "Y" and m["OG"].distance_A < 1e-4 and m["MN4"].query_atom != "O"
    rates = {r.category: (r.total, r.matched) for r in c.rates.where("job_name = 's'").collect()}
    assert rates["UNK"] == (1, 1) and rates["SCS"] == (1, 1) and rates[None][0] == 6
    text = reports.match_summary("s", c.rates.where("job_name = 's'"), c.matches.where("job_name = 's' and matched_within_cutoff = 'N'"))
    assert "| SCS | 1 / 1 | 100.0% |" in text


def test_kabsch_recovers_rotations(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(20):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        p, t = rng.normal(size=(9, 3)), rng.normal(size=3)
        rows += [(g, *map(float, a), *map(float, q @ a + t)) for a in p]
    pairs = spark.createDataFrame(rows, "g int, px double, py double, pz double, qx double, qy double, qz double")
    fitted = pairs.join(matching.fit(pairs, ["g"]), "g").select("*", *[c.alias(f"a{n}") for c, n in zip(matching.moved("px", "py", "pz"), "xyz", strict=True)])
    worst = fitted.agg(F.max(F.abs(F.col("ax") - F.col("qx")) + F.abs(F.col("ay") - F.col("qy")) + F.abs(F.col("az") - F.col("qz")))).first()[0]
    assert worst < 1e-9


def brute_pairs(rows, cutoff):
    out = []
    for i, k, *p in rows:
        for j, m, *q in rows:
            if k is not None and k == m and None not in (*p, *q):
                d = float(np.sqrt(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))))
                if d <= cutoff:
                    out.append((i, j, round(d, 9)))
    return sorted(out)


def cloud(seed, n, spread=3.0):
    """Points in a dense cluster, a loose one and far away, some of them equal, with odd rows."""
    rng = np.random.default_rng(seed)
    scale = np.array([0.01, 1.0, 20.0])[rng.integers(0, 3, n)]
    rows = [(i, i % 3, *map(float, rng.normal(size=3) * spread * s)) for i, s in enumerate(scale)]
    return rows + [(n + 1, *rows[5][1:]), (n + 2, None, 0.0, 0.0, 0.0), (n + 3, 1, None, 0.0, 0.0), (n + 4, 7, 1.0, 1.0, 1.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs(spark, seed):
    rows = cloud(seed, 300)
    pts = spark.createDataFrame(rows, "i long, k long, x double, y double, z double")
    for s in ("grid", "broadcast", "auto"):
        assert sorted((r.l.i, r.r.i, round(r.d, 9)) for r in distance.pairs(pts, pts, ["k"], 1.3, s).collect()) == brute_pairs(rows, 1.3)
    with pytest.raises(ValueError):
        distance.pairs(pts, pts, ["k"], 1.3, "keyed")


@pytest.mark.parametrize("seed,n,every", [(1, 300, 7), (2, 900, 1), (3, 20, 3), (4, 400, 399)])
def test_nearest_by_octree(spark, seed, n, every):
    rows = cloud(seed, n)
    pts = spark.createDataFrame(rows, "i long, k long, x double, y double, z double")
    right = [r for r in rows if r[0] % every == 0]
    want = []
    for i, k, *p in rows:
        d = [(float(np.sqrt(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)))), j) for j, m, *q in right if k is not None and m == k and None not in (*p, *q)]
        want.append((i, min(d)[1] if d else -1))
    got = distance.nearest(pts.repartition(3), pts.where(f"i % {every} = 0"), ["k"], ["i"])
    assert sorted((r.l.i, r.r.i if r.r else -1) for r in got.collect()) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    empty = distance.nearest(pts, pts.where("false"), ["k"], ["i"])
    assert empty.where("r is null and d is null").count() == len(rows)


def test_nearest_in_one_large_structure(spark):
    """A lattice of which every point's nearest is known, a third of it squeezed into one place, no keys."""
    left = spark.range(40_000).selectExpr("id", "double(id % 50) as x", "double(id div 50 % 50) as y", "double(id div 2500) + 0.25 as z")
    dense = spark.range(10_000).selectExpr("-id - 1 as id", "-5.0 - 1e-6 * (id % 31) as x", "-5.0 - 1e-6 * (id div 31 % 31) as y", "-5.0 - 1e-6 * (id div 961) as z")
    right = left.withColumn("z", left.z - 0.25).union(dense)
    got = distance.nearest(left, right, [], ["id"])
    assert got.where("l.id <> r.id or d <> 0.25").count() == 0 and got.count() == 40_000


def test_equal_rows_stay(spark):
    """Joins keep a bag: rows equal in all columns come out as often as they went in."""
    one = spark.createDataFrame([(1, 0.0, 0.0, 0.0)] * 3 + [(2, 9.0, 9.0, 9.0)], "i int, x double, y double, z double")
    near = one.where("i = 1").limit(1)
    assert distance.within(one, near, [], 1.0).count() == 3
    assert distance.nearest(one, near, [], ["i"]).count() == distance.nearest(one, near, [], ["i"], cutoff=1.0).count() == 4


def test_nearest_with_cutoff(spark):
    rows = cloud(5, 900)
    pts = spark.createDataFrame(rows, "i long, k long, x double, y double, z double")
    right = [r for r in rows if r[0] % 4]
    want = []
    for i, k, *p in rows:
        d = [(float(np.sqrt(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)))), j) for j, m, *q in right if k is not None and m == k and None not in (*p, *q)]
        want.append((i, min(d)[1] if d and min(d)[0] <= 2.0 else -1))
    got = distance.nearest(pts, pts.where("i % 4 <> 0"), ["k"], ["i"], cutoff=2.0).collect()
    assert sorted((r.l.i, r.r.i if r.r else -1) for r in got) == sorted(want) and all((r.d is None) == (r.r is None) for r in got)
    near = distance.within(pts, pts.where("i % 4 <> 0"), ["k"], 2.0).collect()
    assert sorted(r.i for r in near) == sorted(i for i, j in want if j >= 0)


def rows_met(df):
    """The most rows that one join of a collected table made."""
    df.collect()

    def most(plan):
        name = plan.getClass().getSimpleName()
        if "QueryStage" in name:
            return most(plan.plan())
        if name == "AdaptiveSparkPlanExec":
            return most(plan.executedPlan())
        below = plan.children()
        return max([plan.longMetric("numOutputRows").value() if "Join" in name else 0, *(most(below.apply(i)) for i in range(below.size()))])

    return most(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("copies", [1, 10])
def test_wide_cutoff_meets_few(spark, copies):
    """A cutoff that spans all points, and points that lie on each other: rows met don't grow with either."""
    pts = spark.range(2000 * copies).selectExpr("id", "rand(3) as a", "id % 2000 as p").selectExpr("id", "double(p % 13) as x", "double(p div 13 % 13) as y", "double(p div 169) as z")
    left = pts.where("id < 2000")
    assert rows_met(distance.nearest(left.withColumn("x", left.x + 0.1), pts, [], ["id"], cutoff=100.0)) < 1_000_000
    assert rows_met(distance.within(left.withColumn("x", left.x + 0.1), pts, [], 100.0)) < 1_000_000


def test_pairs_broadcast_only_what_is_counted(spark, monkeypatch):
    """Neither strategy sends the driver a side that grows: above the counted bound both shuffle."""
    pts = spark.range(500).selectExpr("id as i", "double(id) as x", "0.0d as y", "0.0d as z").withColumn("k", F.lit(1))
    plan = lambda s: distance.pairs(pts, pts, ["k"], 1.5, s)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan("broadcast") and "Broadcast" not in plan("grid")
    monkeypatch.setattr(distance, "BROADCAST_ROWS", 400)
    assert "Broadcast" not in plan("broadcast")


def test_chain_dedup(spark):
    seq = [("GLY", 1), ("SER", 2), ("ASP", 3)]
    a = [(r, n, c, "CA", "C", (n + (5 if c == "B" else 0), 0, 0)) for c in "AB" for r, n in seq] + [("GLY", 1, "C", "CA", "C", (0, 0, 0)), ("HEM", 9, "B", "FE", "FE", (0, 0, 0)), ("HOH", 8, "A", "O", "O", (0, 0, 0))]
    df = atoms(spark, a)
    kept = lambda **k: sorted(r.chain for r in dedup.keep_chains(df, **k).collect())
    assert kept() == ["A", "C"] and kept(mask=["HEM"]) == ["B", "C"] and kept(by="coords") == ["A", "B", "C"]
    assert kept(mask=["GLY"], mode="any", collapse=True) == ["A"]
    lines = [r.value for r in reports.pdb_lines(dedup.deduplicate(df)).orderBy("ordinal").collect()]
    assert all(len(x) == 80 for x in lines) and lines[0][12:16] == " CA " and {x[21] for x in lines} == {"A", "C"}


def test_centroid_match(spark):
    t = atoms(spark, [("GLY", 5, "A", "CA", "C", (0, 0, 0))])
    q = atoms(spark, [("GLY", 5, "A", "CA", "C", (0.5, 0, 0)), ("GLY", 5, "B", "CA", "C", (9, 0, 0))])
    merged = compare.match_residues(t, q, 3.6).first()
    apart = compare.match_residues(t, q, 3.6, key=("chain", "resname", "resnum")).first()
    assert merged.query_resnum is None and merged.distance is None and apart.distance == 0.5
    e = compare.evaluate_ca(t, q, 1.0).first()
    assert (e.total, e.matches, e.misses, e.mean_distance) == (1, 1, 0, 0.5)


CIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.auth_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.auth_atom_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
"""


def _cif(names):
    return CIF + "".join(f"HETATM X {n} OEX 'A' 1 {n} {x} {y} {z}\n" for n, (x, y, z) in names.items()) + "HETATM O OG SER A 7 OG 5 5 5\n#\n"


@pytest.fixture()
def runs(tmp_path):
    def put(path, text):
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_text(text)

    head = "seed,sample,ranking_score\n"
    put("a/ranking_scores.csv", head + "1,0,0.9\n1,1,0.9\n2,0,bad\n,3,1.0\n3,0,NaN\n")
    put("a/seed-1_sample-0/model.cif", _cif(OEX))
    put("a/a_summary_confidences.json", json.dumps({"iptm": 0.5, "ptm": 0.6, "ranking_score": 0.9, "has_clash": 0}))
    put("b/ranking_scores.csv", head)
    put("c/ranking_scores.csv", head + "1,0,0.1\n")
    put("d/ranking_scores.csv", head + "1,0,0.1\n")
    put("d/scores.csv", "sample_dir,model_relpath\nseed-1_sample-0,deep/m.cif\n")
    put("d/deep/m.cif", _cif(dict(list(OEX.items())[:2])))
    return str(tmp_path)


def test_batch(spark, runs):
    manifest, summary = batch.run_batch(spark, runs, _template(spark), _network(spark))
    got = {os.path.basename(r.run_dir): r for r in manifest.collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "ok", "b": "skipped", "c": "skipped", "d": "failed"}
    assert (got["a"].sample, got["a"].iptm, got["a"].job_name) == ("0", 0.5, "batch__a__seed1_sample0") and got["a"].rmsd < 1e-6
    assert (got["a"].total, got["a"].matched, got["a"].percent) == (6, 6, 100.0)
    assert got["b"].message.startswith("No valid rows") and got["c"].message.startswith("Model file not found")
    assert [r.run_dir for r in summary.collect()] == [got["a"].run_dir]
    assert tuple(batch.status_counts(manifest).first()) == (1, 2, 1)


def test_stream(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "one.cif").write_text(_cif(OEX))
    out = []
    for more in ({}, {"two.cif": _cif(OEX)}):
        for n, text in more.items():
            (tmp_path / "in" / n).write_text(text)
        watch.watch(spark, str(tmp_path / "in"), _template(spark), _network(spark), lambda df, i: out.append((i, {r.job_name for r in df.collect()})), str(tmp_path / "cp")).awaitTermination()
    assert [names for _, names in out] == [{"one"}, {"two"}]


def test_files(spark, tmp_path, monkeypatch):
    (tmp_path / "1abc.cif").write_text("x")
    assert files.resolve(str(tmp_path / "1abc.pdb")) == str(tmp_path / "1abc.cif")
    with pytest.raises(FileNotFoundError):
        files.resolve(str(tmp_path / "2abc"))
    assert files.atoms_path("a/b.csv") == "a/b_atoms.csv" and files.sidecar(str(tmp_path)) == {}
    (tmp_path / "network.json").write_text('{"cofactor_resname": "ZN", "distance_cutoff": 4.0, "exclude_moieties": []}')
    s = network.Settings.from_options(files.sidecar(str(tmp_path)), {"distance_cutoff": None})
    assert (s.cofactors, s.cutoff, s.exclude_moieties) == (("ZN",), 4.0, ())
    names = str(tmp_path / "names.txt")
    files.write_synonyms(names, compare.RESIDUE_NAMES, compare.ATOM_NAMES)
    files.write_synonyms(names, [["other"]], [["x"]])
    assert files.read_synonyms(spark, names) == (compare.RESIDUE_NAMES, compare.ATOM_NAMES)
    assert reports.free_path(str(tmp_path), "x", ".pdb").endswith("x_dedup.pdb")


def test_sectioned_csv(spark, tmp_path):
    text = "Residue Category,Residue Name,Residue Number,Chain,Chemical Moiety,Interactors\r\nPCS,ASP,1,A,,\"O, N\"\r\n\r\nResidue Category,Residue Name,Residue Number,Chain,Atom,x,y,z\r\nPCS,ASP,1,A,O,1,2,3\r\nPCS,ASP,1,A,N,bad,2,3\r\nshort\r\n"
    (tmp_path / "t.csv").write_text(text)
    r, a = reports.read_breakdown(spark, str(tmp_path / "t.csv"))
    assert r.first().interactors == "O, N" and [(x.atom_name, x.x) for x in a.collect()] == [("O", 1.0)]
    (tmp_path / "u.csv").write_text("nothing\n")
    with pytest.raises(ValueError):
        reports.read_breakdown(spark, str(tmp_path / "u.csv"))
    assert reports.csv_text(r.select("category", "moiety"), a.select("x")) == "category,moiety\r\nPCS,\r\n\r\nx\r\n1.0\r\n"


def test_argmax_skips_nan(spark):
    df = spark.createDataFrame([(1, "a", math.nan, 0), (1, "b", 0.5, 1), (1, "c", 0.5, 2), (2, "d", None, 0)], "k int, v string, s double, o long")
    assert [tuple(r) for r in topk.argmax(df, ["k"], "v", F.col("s"), [F.col("o")], "best").collect()] == [(1, "b")]


def test_signatures_empty_mask(spark):
    df = spark.createDataFrame([("x", ["a"], ["m"]), ("y", ["a"], ["n"])], "id string, signature array<string>, present array<string>")
    g = residues.duplicate_groups(df, [], "id").first()
    assert g.canonical == "x" and g.n_matching == 0


def test_co_moiety(spark):
    a = atoms(spark, [("ASP", 1, "A", n, n[0], (0, 0, 0)) for n in ("N", "O", "OXT", "OD1", "OD2", "XX")] + [("HOH", 2, "A", "O", "O", (0, 0, 0)), ("GLY", 3, "A", "O", "O", (0, 0, 0)), ("GLY", 4, "A", "OXT", "O", (0, 0, 0))])
    got = {(r.resnum, r.atom_name): (r.moiety, r.together) for r in lookup.co_moiety(a, schema.RESIDUE).collect()}
    assert got[1, "OD1"] == got[1, "OD2"] == ("COO", ["OD1", "OD2"]) and got[1, "N"] == ("backbone", ["N", "O", "OXT"])
    assert got[1, "O"][0] == got[1, "OXT"][0] == "c_terminus" and got[1, "XX"] == (None, None)
    assert (got[2, "O"][0], got[3, "O"][0], got[4, "OXT"][0]) == ("water", "backbone", None)


def test_preference(spark):
    df = spark.createDataFrame([(1, "COO", "OD2", 2.0), (1, "COO", "OD1", 2.0000000001), (1, "COO", "ZZ", 2.0), (2, "x", "B", 1.0), (2, "x", "A", 1.0), (2, "x", "C", 0.9)], "g long, moiety string, name string, d double")
    best = topk.keep_closest(df, ["g"], "d", topk.preference_of("moiety", "name", chemistry.PREFERRED), "name")
    assert {(r.g, r.name) for r in best.collect()} == {(1, "OD1"), (2, "C")}


def test_one_signature_of_very_many_chains(spark):
    """No row holds the members of a group."""
    df = spark.range(300_000).selectExpr("id", "array('GLY', cast(id % 3 div 2 as string)) as signature", "array('HEM') as present").repartition(6)
    g = {r.canonical: r.n for r in residues.duplicate_groups(df, [], "id").collect()}
    assert g == {0: 200_000, 2: 100_000}
    assert residues.duplicates(df, [], "id", mask=["HEM"]).groupBy("canonical").count().collect() == residues.duplicates(df, [], "id").groupBy("canonical").count().collect()
    assert residues.duplicates(df, [], "id").count() == 299_998


def test_confidences_are_those_of_the_named_files(spark, tmp_path):
    """Beside the two files that count lie others of like names; a file with one figure counts, a broken one doesn't."""
    from shellgraph.sources import files

    def put(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("r1/r1_summary_confidences.json", '{"iptm": 0.9}')
    put("r1/a_summary_confidences.json", '{"iptm": 0.1, "ptm": 0.1}')
    put("r1/seed-1_sample-0/other_summary_confidences.json", '{"iptm": 0.2}')
    put("r2/seed-1_sample-0/summary_confidences.json", '{"has_clash": false}')
    put("r2/r2_summary_confidences.json", '{"iptm": 0.3}')
    put("r3/seed-1_sample-0/summary_confidences.json", "{broken")
    put("r3/r3_summary_confidences.json", '{"ptm": 0.4}')
    put("r4/z_summary_confidences.json", '{"ptm": 0.5}')
    runs = spark.createDataFrame([(f"{tmp_path}/r{k}", "1", "0") for k in (1, 2, 3, 4)], "run_dir string, seed string, sample string")
    got = {r.run_dir[-2:]: r.confidence for r in files.confidences(spark, str(tmp_path), runs).collect()}
    assert got["r1"].iptm == 0.9 and got["r1"].ptm is None and got["r4"] is None
    assert got["r2"].has_clash == "false" and got["r2"].iptm is None and got["r3"].ptm == 0.4


def test_stream_goes_on_past_bad_files(spark, tmp_path):
    """Files without atoms and without enough shared atoms are told apart, and end nothing."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/good.cif").write_text(open(os.path.join(os.path.dirname(__file__), "data/site.cif")).read())
    (tmp_path / "in/bad.cif").write_text("not a structure \x00 at all")
    (tmp_path / "in/few.cif").write_text("data_x\nloop_\n_atom_site.group_PDB\n_atom_site.type_symbol\n_atom_site.auth_atom_id\n_atom_site.auth_comp_id\n_atom_site.auth_asym_id\n_atom_site.auth_seq_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\nATOM C CA GLY A 1 0.0 0.0 0.0\n")
    left = {}
    watch.watch(spark, str(tmp_path / "in"), _template(spark), _network(spark), lambda df, i: df.count(), str(tmp_path / "cp"), rejected=lambda df, i: left.update({r.structure_id: r.reason for r in df.collect()})).awaitTermination()
    assert {k: v for k, v in left.items() if k != "good"} == {"bad": "no atoms", "few": "no three shared atoms"}
