"""Driver-table queries: every relational operator of the engine on tables that SQL can check.

``embeddings`` serves as a set of points (three of its dimensions), ``part`` as a larger one; orders, line
items and events stand for structures, atoms and observations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import chemistry
from .operators import distance, lookup, matching, residues, topk
from .plans import batch, compare, network

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: vec_id, label, x, y, z (ten times the first three dimensions), resnum (vec_id div 5), slot."""
    e = F.col("embedding")
    xyz = [(e[i].cast("double") * 10).alias(c) for i, c in enumerate("xyz")]
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", *xyz, F.expr("vec_id div 5").alias("resnum"), (F.col("vec_id") % 3).alias("slot"))


_P = "p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z, vec_id // 5 AS resnum, vec_id % 3 AS slot FROM embeddings)"
_D = "sqrt(({0}.x - {1}.x) * ({0}.x - {1}.x) + ({0}.y - {1}.y) * ({0}.y - {1}.y) + ({0}.z - {1}.z) * ({0}.z - {1}.z))"


def scan_filter_project(spark, d):
    rows = _t(spark, d, "lineitem").where(F.upper("l_returnflag").isin("A", "R") & (F.col("l_quantity") > 30) & ~F.col("l_linestatus").isin("F"))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


def distance_semi_join(spark, d):
    p = points(spark, d)
    near = distance.within(p.where("label not in (0, 9)"), p.where("label = 0").select("x", "y", "z"), [], 0.5)
    return near.select("vec_id", F.round("min_distance", 6).alias("min_distance"))


def _parts(spark, d):
    return _t(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), (F.col("p_partkey") % 50).cast("double").alias("z"))


def _part_pairs(spark, d, strategy):
    p = _parts(spark, d)
    found = distance.pairs(p, p, ["p_brand"], 2.0, strategy).where("l.p_partkey < r.p_partkey")
    return found.select(F.col("l.p_partkey").alias("a"), F.col("r.p_partkey").alias("b"), F.round("d", 6).alias("d"))


def distance_pairs(spark, d):
    return _part_pairs(spark, d, "broadcast")


def distance_pairs_grid(spark, d):
    return _part_pairs(spark, d, "grid")


def nearest_neighbor(spark, d):
    p = points(spark, d)
    near = distance.nearest(p.where("label <> 0"), p.where("label = 0"), [], ["vec_id"])
    return near.select(F.col("l.vec_id").alias("vec_id"), F.col("r.vec_id").alias("nearest"), F.round("d", 6).alias("d"))


def nearest_within_cutoff_left(spark, d):
    p = points(spark, d)
    near = distance.nearest(p.where("label = 1"), p.where("label = 2"), [], ["vec_id"], cutoff=0.4, strategy="grid")
    return near.select(F.col("l.vec_id").alias("vec_id"), F.coalesce("r.vec_id", F.lit(-1).cast("long")).alias("nearest"), F.round("d", 6).alias("d"))


_LINE_ORDER = ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


def policy_topk_per_group(spark, d):
    policy = spark.createDataFrame([("A", "F", 3), ("R", "O", 0), ("ANY", "O", 2)], "resname string, moiety string, k int")
    rows = _t(spark, d, "lineitem").drop("l_shipdate")
    top = topk.policy_topk(rows, policy, ["l_suppkey", "l_returnflag", "l_linestatus"], ["l_returnflag", "l_linestatus"], _LINE_ORDER, most=3)
    return top.select("l_suppkey", "l_returnflag", "l_linestatus", "l_orderkey", "l_extendedprice", F.col("rank").cast("long").alias("rank"))


def residue_anti_join(spark, d):
    big = _t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, d, "customer").join(big, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


_RESIDUES = ("OEX", "ASP", "GLU", "HIS", "SER", "TYR", "LYS", "ASN", "ARG", "HOH")  # by label
_NAMES = (("CA1", "MN1", "O5"), ("OD1", "OD2", "CB"), ("OE1", "OE2", "CG"), ("ND1", "NE2", "CB"), ("OG", "OG", "O"), ("OH", "CZ", "N"), ("NZ", "CE", "O"), ("OD1", "ND2", "CB"), ("NH1", "NH2", "NE"), ("O", "H1", "H2"))  # by label and slot


def atoms(spark: SparkSession, d: str) -> DataFrame:
    """``points`` as atoms of one structure: the label gives the residue's name and chain, label and slot the atom's name."""
    one = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    name = one([n for three in _NAMES for n in three], F.col("label") * 3 + F.col("slot"))
    return points(spark, d).select(
        F.lit("e").alias("structure_id"), F.lit(0).alias("model"), F.col("label").cast("string").alias("chain"), F.lit(" ").alias("hetflag"), one(_RESIDUES, F.col("label")).alias("resname"),
        F.col("resnum").cast("int").alias("resnum"), F.lit("").alias("icode"), name.alias("atom_name"), F.lit("").alias("altloc"), F.substring(name, 1, 1).alias("element"),
        "x", "y", "z", F.lit(1.0).alias("occupancy"), F.col("vec_id").alias("ordinal"),
    )


def _atom_values() -> str:
    """SQL: (label, slot, resname, atom_name, moiety, k) of every kind of atom."""
    policy = {(r, m): k for r, m, k in chemistry.POLICY}
    rows = []
    for label, (r, names) in enumerate(zip(_RESIDUES, _NAMES, strict=True)):
        for slot, n in enumerate(names):
            m = chemistry.moieties().get((r, n), chemistry.UNKNOWN)
            rows.append(f"({label}, {slot}, '{r}', '{n}', '{m}', {policy.get((r, m), policy.get(('ANY', m), 1))})")
    return "v(label, slot, resname, atom_name, moiety, k) AS (VALUES " + ", ".join(rows) + ")"


_A = f"{_P}, {_atom_values()}, a AS (SELECT p.*, v.resname, v.atom_name, v.moiety, v.k FROM p JOIN v USING (label, slot))"


def _network_edges(spark, d, cutoff):
    n = network.coordination_network(atoms(spark, d), network.Settings(("OEX",), cutoff=cutoff))
    return n.edges.select("link_type", *[f"{s}_{c}" for s in ("src", "dst") for c in ("resname", "resnum", "chain", "atom")], F.round("distance_A", 6).alias("distance"))


def two_hop_network(spark, d):
    return _network_edges(spark, d, 0.3)


def edge_list(spark, d):
    return _network_edges(spark, d, 0.5)


def _network_sql(cutoff: float) -> str:
    dist = _D.format("a", "b")
    hop = lambda rows, around, out: f"""
        {out}_n AS (SELECT a.*, min({dist}) AS d FROM {rows} a JOIN {around} b ON {dist} <= {cutoff} GROUP BY ALL),
        {out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, resnum, moiety ORDER BY d, vec_id) AS rk FROM {out}_n) WHERE rk <= k)"""  # noqa: E731
    edge = lambda src, dst, kind: f"""SELECT '{kind}' AS link_type, src_resname, src_resnum, src_chain, src_atom, dst_resname, dst_resnum, dst_chain, dst_atom, round(d, 6) AS distance FROM
        (SELECT b.resname AS src_resname, b.resnum AS src_resnum, CAST(b.label AS VARCHAR) AS src_chain, b.atom_name AS src_atom, a.resname AS dst_resname, a.resnum AS dst_resnum, CAST(a.label AS VARCHAR) AS dst_chain, a.atom_name AS dst_atom,
            {dist} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {dist}, b.vec_id) AS rn FROM {dst} a CROSS JOIN {src} b) WHERE rn = 1"""  # noqa: E731
    return f"""WITH {_A}, c AS (SELECT * FROM a WHERE label = 0), able AS (SELECT * FROM a WHERE label <> 0 AND atom_name NOT LIKE 'C%'), {hop('able', 'c', 'f')},
        rest AS (SELECT * FROM able r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.label = r.label AND f.resnum = r.resnum)), {hop('rest', 'f', 's')}
        {edge('c', 'f', 'cofactor->pcs')} UNION ALL {edge('f', 's', 'pcs->scs')}"""


def moiety_lookup(spark, d):
    return lookup.label_moieties(atoms(spark, d)).select("ordinal", "resname", "atom_name", "moiety")


def moiety_wildcards(spark, d):
    """Each atom's moiety by the wildcard rules, and the names of its residue's atoms of that label."""
    found = lookup.co_moiety(atoms(spark, d), ["resnum", "chain", "resname"])
    return found.groupBy("resnum", "chain", "atom_name").agg(F.min("moiety").alias("moiety"), F.min(F.array_join("together", " ")).alias("together"), F.count("*").alias("n"))


def centroid_match(spark, d):
    """Residues of label 0 against those of all other labels, each a structure of its own."""
    p = points(spark, d).select(F.col("label").cast("string").alias("structure_id"), F.col("resnum").cast("int").alias("resnum"), F.lit("R").alias("resname"), F.col("vec_id").alias("ordinal"), "x", "y", "z")
    near = compare.match_residues(p.where("structure_id = '0'").drop("structure_id"), p.where("structure_id <> '0'"), 0.6)
    return near.select("structure_id", "template_resnum", "query_resnum", F.round("distance", 6).alias("distance"))


def ca_evaluation(spark, d):
    p = points(spark, d).select(F.col("label").cast("string").alias("structure_id"), F.when(F.col("slot") < 2, "CA").otherwise("CB").alias("atom_name"), F.col("vec_id").alias("ordinal"), "x", "y", "z")
    out = compare.evaluate_ca(p.where("structure_id = '0'"), p.where("structure_id <> '0'"), 0.6)
    return out.select("structure_id", "total", "matches", "misses", F.round("mean_distance", 6).alias("mean_distance"))


_CENTRE = [names[0] for names in compare.ATOM_NAMES]


def network_comparison(spark, d):
    """Every second point as a template network, matched to three structures that hold the others by their number's third
    part, each turned and moved with its centre; the fit has to bring the network back."""
    a = atoms(spark, d).withColumn("resnum", F.col("ordinal").cast("int"))
    names = F.element_at(F.array(*[F.lit(n) for n in _CENTRE]), (F.col("ordinal") % len(_CENTRE) + 1).cast("int"))
    centre = a.where("chain = '0'").withColumns({"atom_name": names, "resnum": F.lit(1), "chain": F.lit("Z")})
    net = a.where("chain <> '0' and ordinal % 2 = 0").select(F.lit("PCS").alias("category"), "resname", "resnum", "chain", "atom_name", F.lit("m").alias("moiety"), F.lit("interactor").alias("interactor"), "x", "y", "z", "ordinal")
    parts = [a.where(f"chain <> '0' and ordinal % 2 = 1 and ordinal % 3 = {j}").unionByName(centre).withColumn("structure_id", F.lit(f"s{j}")) for j in range(3)]
    moved = [(-F.col("y") + 3).alias("x"), (F.col("x") - 1).alias("y"), (F.col("z") + 2).alias("z")]
    query = parts[0].unionByName(parts[1]).unionByName(parts[2])
    query = query.select(*[c for c in query.columns if c not in "xyz"], *moved)
    m = compare.compare(centre, net, query, cutoff=0.3).matches
    return m.select("job_name", "ordinal", "query_residue", "query_resnum", "query_atom", F.round("distance_A", 6).alias("distance"), "same_residue_name", "same_atom_name", "matched_within_cutoff")


def residues_of_interest(spark, d):
    return network.residues_of_interest(atoms(spark, d), [3, 7, 20], ["OEX "]).select("ordinal", "resname", "resnum", "group")


def lookup_with_wildcard_default(spark, d):
    policy = spark.createDataFrame([("Brand#1", "PROMO", 5), ("Brand#2", "LARGE", 4), ("ANY", "PROMO", 3), ("ANY", "SMALL", 2)], "resname string, moiety string, k int")
    return topk.policy_k(_t(spark, d, "part"), policy, ["p_brand", "p_type"]).select("p_partkey", "p_brand", "p_type", "k")


_SYNONYMS = [["view", "click"], ["purchase", "signup"]]


def synonym_canonicalise(spark, d):
    names = lookup.synonyms(spark, _SYNONYMS)
    rows = lookup.canonicalise(_t(spark, d, "events"), "event_type", names, "canonical")
    return rows.groupBy("user_id", "canonical").agg(F.count("*").alias("n"))


def argmax_group_pick(spark, d):
    sizes = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return topk.argmax(sizes, ["user_id"], "event_type", F.col("n"), [F.col("first")], "best")


def match_rate_rollup(spark, d):
    rates = matching.match_rates(_t(spark, d, "labels"), "quality", F.col("toxic") == 1)
    return rates.select(F.coalesce("category", F.lit("ALL")).alias("category"), "total", "matched", F.round("percent", 6).alias("percent"))


def residue_centroid(spark, d):
    c = residues.centroids(points(spark, d), ["resnum"], "label", "vec_id")
    return c.select("resnum", "label", *[F.round(a, 6).alias(a) for a in "xyz"])


def residue_breakdown(spark, d):
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_orderkey").agg(residues.names_list("p_brand").alias("brands"), residues.names_list("p_type").alias("types"), F.count("*").alias("n"))


def category_precedence(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    parts = [("Cofactor", o.where("o_totalprice > 450000")), ("PCS", o.where("o_totalprice > 250000")), ("SCS", _t(spark, d, "customer"))]
    return lookup.precedence(parts, ["c_custkey"])


def first_by_key_dedup(spark, d):
    rows = topk.first_by(_t(spark, d, "lineitem").drop("l_shipdate"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _signed(spark, d):
    rows = _t(spark, d, "lineitem")
    flag = F.concat("l_returnflag", "l_linestatus")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus"]
    signed = residues.signatures(rows, ["l_orderkey"], flag, order)
    return signed.join(rows.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("present")), "l_orderkey")


def duplicate_signature_groups(spark, d):
    g = residues.duplicate_groups(_signed(spark, d), [], "l_orderkey")
    return g.select(F.array_join("signature", ",").alias("signature"), "n", F.col("canonical").alias("first"))


def mask_preferred_canonical(spark, d):
    parts = _t(spark, d, "lineitem").select(F.col("l_orderkey"), "l_linestatus", "l_returnflag", "l_linenumber", "l_partkey")
    signed = residues.signatures(parts, ["l_orderkey"], F.col("l_linestatus"), ["l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"])
    signed = signed.join(parts.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("present")), "l_orderkey")
    g = residues.duplicate_groups(signed, [], "l_orderkey", mask=["A", "N"], mode="all")
    return g.select(F.array_join("signature", ",").alias("signature"), "n", "n_matching", "canonical")


def cutoff_sweep(spark, d):
    p = points(spark, d)
    near = distance.nearest(p.where("label <> 0"), p.where("label = 0"), [], ["vec_id"], cutoff=4.0)
    s = matching.cutoff_sweep(near.select(F.col("l.label").alias("label"), "d"), "label", "d")
    return s.select(F.round("cutoff", 1).alias("cutoff"), F.round("mean_matches", 6).alias("mean_matches"), F.round("std_matches", 6).alias("std_matches"))


def cube_filter(spark, d):
    p = points(spark, d).withColumn("atom_name", F.when(F.col("vec_id") % 2 == 0, "CA").otherwise("N"))
    return network.cube(p.where("label > 2"), p.where("label = 0"), -0.5).select("vec_id", "label")


_RULES = [("A", "1", "2"), ("A", "2", "3"), ("N", "1", "3"), ("R", "4", "5")]


def bond_rule_join(spark, d):
    rules = spark.createDataFrame(_RULES, "l_returnflag string, a1 string, a2 string")
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linenumber").cast("string").alias("l_linenumber"), F.col("l_partkey").alias("o1"), F.col("l_suppkey").alias("o2"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.col("l_discount").alias("z"))
    found = residues.bond_pairs(rows, rules, ["l_orderkey"], "l_linenumber", "l_returnflag", ["o1", "o2", "x", "y", "z"])
    return found.select("l_orderkey", "l_returnflag", "a1", "a2", F.col("p1.x").alias("x1"), F.col("p2.x").alias("x2"))


_EVENTS = ["click", "error", "purchase", "signup", "view"]


def pivot_matrix(spark, d):
    rows = _t(spark, d, "events")
    return matching.wide_matrix(rows, "user_id", "event_type", _EVENTS, F.round(F.max("value"), 4))


def frequency_breakdown(spark, d):
    rows = _t(spark, d, "events").withColumn("bucket", F.col("user_id") % 20)
    f = matching.frequencies(rows, "bucket", "event_type", _EVENTS)
    return f.select("bucket", *[F.round(e, 6).alias(e) for e in _EVENTS])


def _fit_pairs(spark, d):
    e = F.col("embedding")
    return _t(spark, d, "embeddings").select("label", *[e[i].cast("double").alias(f"p{c}") for i, c in enumerate("xyz")], *[e[i + 3].cast("double").alias(f"q{c}") for i, c in enumerate("xyz")])


def rmsd_by_group(spark, d):
    gap = sum(((F.col(f"p{c}") - F.col(f"q{c}")) * (F.col(f"p{c}") - F.col(f"q{c}")) for c in "xyz"), F.lit(0.0))
    return _fit_pairs(spark, d).groupBy("label").agg(F.round(matching.rmsd(gap), 6).alias("rmsd"), F.count("*").alias("n"))


def covariance_3x3(spark, d):
    m = matching.moments(_fit_pairs(spark, d), ["label"])
    return m.select("label", "n", *[F.round(f"h{i}{j}", 6).alias(f"h{i}{j}") for i in range(3) for j in range(3)])


def kabsch_alignment(spark, d):
    f = matching.fit(_fit_pairs(spark, d), ["label"])
    return f.select("label", "n", *[F.round(c, 6).alias(c) for c in f.columns[2:]])


def kabsch_relations(spark, d):
    """What makes a fit the best rotation: R R' = 1, det R = 1, R H symmetric; and means map onto means. 0 and 1 but for rounding."""
    pairs = _fit_pairs(spark, d)
    f = matching.fit(pairs, ["label"]).join(matching.moments(pairs, ["label"]).drop("n"), "label")
    r = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    dot = lambda xs: sum(xs, F.lit(0.0))
    bent = [F.abs(dot(r[i][k] * r[j][k] for k in range(3)) - float(i == j)) for i in range(3) for j in range(3)]
    rh = [[dot(r[i][k] * F.col(f"h{k}{j}") for k in range(3)) for j in range(3)] for i in range(3)]
    skew = [F.abs(rh[i][j] - rh[j][i]) for i, j in ((0, 1), (0, 2), (1, 2))]
    det = dot(r[0][i] * (r[1][(i + 1) % 3] * r[2][(i + 2) % 3] - r[1][(i + 2) % 3] * r[2][(i + 1) % 3]) for i in range(3))
    off = [F.abs(dot(r[i][j] * F.col(f"m_p{c}") for j, c in enumerate("xyz")) + F.col(f"t{i}") - F.col(f"m_q{q}")) for i, q in enumerate("xyz")]
    clean = lambda c: F.abs(F.round(c, 6))
    return f.select("label", "n", clean(F.greatest(*bent)).alias("bent"), clean(det).alias("det"), clean(F.greatest(*skew)).alias("skew"), clean(F.greatest(*off)).alias("off"))


def set_ops(spark, d):
    o = _t(spark, d, "orders")
    urgent = o.where("o_orderpriority = '1-URGENT'").select("o_custkey")
    open_ = o.where("o_orderstatus = 'O'").select("o_custkey")
    every = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    parts = {"union": urgent.union(open_).distinct(), "union_all": urgent.unionAll(open_), "intersect": urgent.intersect(open_), "except": every.exceptAll(urgent.distinct()), "except_distinct": open_.subtract(urgent)}
    out = None
    for k, df in parts.items():
        part = df.agg(F.lit(k).alias("op"), F.count("*").alias("n"), F.sum("o_custkey").alias("total")).select("op", "n", "total")
        out = part if out is None else out.unionByName(part)
    subset = urgent.join(every, "o_custkey", "left_anti").agg(F.lit("subset").alias("op"), F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))
    return out.unionByName(subset)


def expansion_union(spark, d):
    """Seeds near the cofactor with the backbone of their residues and what shares a moiety with a seed, hydroxyls excluded."""
    rows = lookup.label_moieties(atoms(spark, d))
    chosen = distance.within(rows.where("chain <> '0'"), rows.where("chain = '0'").select("structure_id", "x", "y", "z"), ["structure_id"], 0.3).drop("min_distance")
    return network.expand(rows, chosen, ["Hydroxyl"]).select("ordinal", "resname", "resnum", "atom_name", "moiety")


def json_priority_coalesce(spark, d):
    rows = _t(spark, d, "events").select("event_id", "user_id", F.from_json("props", "k long, missing double").alias("c"))
    return rows.groupBy("user_id").agg(F.sum(F.coalesce(F.col("c.missing"), F.col("c.k").cast("double"), F.lit(0.0))).alias("total"), F.count("c.k").alias("present"))


def combinatorial_pairs(spark, d):
    """Both groups' points that have one of the other group within the distance."""
    p = points(spark, d)
    one, two = p.where("label = 3"), p.where("label = 4")
    both = [distance.within(a, b.select("x", "y", "z"), [], 0.4, "grid") for a, b in ((one, two), (two, one))]
    return both[0].unionByName(both[1]).select("vec_id", "label", F.round("min_distance", 6).alias("min_distance"))


def interactor_self_join(spark, d):
    """Names of other points near one of a group's points, and whether a point interacts at all."""
    p = points(spark, d)
    near = distance.pairs(p, p, ["slot"], 0.35, "grid").where("l.vec_id <> r.vec_id")
    heard = near.groupBy("l.vec_id").agg(residues.names_list(F.col("r.label").cast("string")).alias("names"))
    return lookup.flag_members(p, heard, ["vec_id"], "interacts").join(heard, "vec_id", "left").select("vec_id", F.coalesce("names", F.lit("")).alias("names"), "interacts")


def preference_tiebreak(spark, d):
    """The nearest per group, equal to a millionth, by preference of label, then by number."""
    p = points(spark, d)
    near = distance.within(p.where("label <> 0"), p.where("label = 0").select("x", "y", "z"), [], 2.0)
    rank = F.when(F.col("label") == 5, 0).when(F.col("label") == 3, 1).otherwise(9)
    return topk.keep_closest(near, ["resnum"], "min_distance", rank, "vec_id").select("resnum", "vec_id", "label")


def run_status_counts(spark, d):
    """Orders as runs, the first of each customer: how many are done, were skipped, or failed."""
    first = topk.first_by(_t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    runs = _t(spark, d, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    return batch.status_counts(runs.select(F.when(F.col("o_orderstatus").isNull(), "skipped").when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status")))


_NEAREST = f"""SELECT a.vec_id, a.label, b.vec_id AS nearest, {_D.format('a', 'b')} AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D.format('a', 'b')}, b.vec_id) AS rn FROM p a CROSS JOIN p b"""
_PAIRS_SQL = f"""WITH q AS (SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y, CAST(p_partkey % 50 AS DOUBLE) AS z FROM part)
    SELECT a.p_partkey AS a, b.p_partkey AS b, round({_D.format('a', 'b')}, 6) AS d FROM q a JOIN q b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE {_D.format('a', 'b')} <= 2.0"""
_FIT = "f AS (SELECT label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS p{i}, CAST(embedding[{i + 4}] AS DOUBLE) AS q{i}" for i in range(3)) + " FROM embeddings)"
_SIG = "string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus)"

ORACLE = {
    "scan_filter_project": "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE upper(l_returnflag) IN ('A', 'R') AND l_quantity > 30 AND l_linestatus NOT IN ('F')",
    "distance_semi_join": f"WITH {_P} SELECT a.vec_id, round(min({_D.format('a', 'b')}), 6) AS min_distance FROM p a JOIN p b ON b.label = 0 AND {_D.format('a', 'b')} <= 0.5 WHERE a.label NOT IN (0, 9) GROUP BY a.vec_id",
    "distance_pairs": _PAIRS_SQL,
    "distance_pairs_grid": _PAIRS_SQL,
    "nearest_neighbor": f"WITH {_P}, n AS ({_NEAREST} WHERE a.label <> 0 AND b.label = 0) SELECT vec_id, nearest, round(d, 6) AS d FROM n WHERE rn = 1",
    "nearest_within_cutoff_left": f"WITH {_P}, n AS ({_NEAREST} WHERE a.label = 1 AND b.label = 2 AND {_D.format('a', 'b')} <= 0.4) SELECT p.vec_id, coalesce(n.nearest, -1) AS nearest, round(n.d, 6) AS d FROM p LEFT JOIN n ON n.vec_id = p.vec_id AND n.rn = 1 WHERE p.label = 1",
    "policy_topk_per_group": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax) AS rank FROM lineitem)
        SELECT l_suppkey, l_returnflag, l_linestatus, l_orderkey, l_extendedprice, rank FROM r
        WHERE rank <= CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 3 WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 0 WHEN l_linestatus = 'O' THEN 2 ELSE 1 END""",
    "residue_anti_join": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "two_hop_network": _network_sql(0.3),
    "edge_list": _network_sql(0.5),
    "lookup_with_wildcard_default": "SELECT p_partkey, p_brand, p_type, CASE WHEN p_brand = 'Brand#1' AND p_type = 'PROMO' THEN 5 WHEN p_brand = 'Brand#2' AND p_type = 'LARGE' THEN 4 WHEN p_type = 'PROMO' THEN 3 WHEN p_type = 'SMALL' THEN 2 ELSE 1 END AS k FROM part",
    "synonym_canonicalise": "SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN 'VIEW' ELSE 'PURCHASE' END AS canonical, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL",
    "argmax_group_pick": "WITH s AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, event_type AS best FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM s) WHERE r = 1",
    "match_rate_rollup": "SELECT coalesce(CAST(quality AS VARCHAR), 'ALL') AS category, count(*) AS total, CAST(sum(CAST(toxic = 1 AS INT)) AS BIGINT) AS matched, round(sum(CAST(toxic = 1 AS INT)) * 100.0 / count(*), 6) AS percent FROM labels GROUP BY ROLLUP (quality)",
    "residue_centroid": f"WITH {_P} SELECT resnum, arg_min(label, vec_id) AS label, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM p GROUP BY resnum",
    "residue_breakdown": "SELECT l_orderkey, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS brands, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey",
    "category_precedence": "WITH u AS (SELECT o_custkey AS c_custkey, 0 AS r FROM orders WHERE o_totalprice > 450000 UNION ALL SELECT o_custkey, 1 FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT c_custkey, 2 FROM customer) SELECT c_custkey, ['Cofactor', 'PCS', 'SCS'][min(r) + 1] AS category FROM u GROUP BY c_custkey",
    "first_by_key_dedup": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS n FROM lineitem) WHERE n = 1",
    "duplicate_signature_groups": f"WITH s AS (SELECT l_orderkey, {_SIG} AS signature FROM lineitem GROUP BY l_orderkey) SELECT signature, count(*) AS n, min(l_orderkey) AS first FROM s GROUP BY signature HAVING count(*) > 1",
    "mask_preferred_canonical": """WITH s AS (SELECT l_orderkey, string_agg(l_linestatus, ',' ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS signature, bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'N') AS fits FROM lineitem GROUP BY l_orderkey)
        SELECT signature, count(*) AS n, count(*) FILTER (fits) AS n_matching, coalesce(min(l_orderkey) FILTER (fits), min(l_orderkey)) AS canonical FROM s GROUP BY signature HAVING count(*) > 1""",
    "cutoff_sweep": f"""WITH {_P}, n AS ({_NEAREST} WHERE a.label <> 0 AND b.label = 0), c AS (SELECT i * CAST(0.2 AS DOUBLE) AS cutoff FROM range(21) t(i)),
        k AS (SELECT label, cutoff, sum(CASE WHEN d <= cutoff THEN 1 ELSE 0 END) AS m FROM n CROSS JOIN c WHERE rn = 1 GROUP BY label, cutoff)
        SELECT round(cutoff, 1) AS cutoff, round(avg(m), 6) AS mean_matches, round(stddev_pop(m), 6) AS std_matches FROM k GROUP BY cutoff""",
    "cube_filter": f"WITH {_P}, w AS (SELECT max(greatest(abs(x), abs(y), abs(z))) AS w FROM p WHERE label = 0 AND vec_id % 2 = 0) SELECT vec_id, label FROM p, w WHERE label > 2 AND vec_id % 2 = 0 AND greatest(abs(x), abs(y), abs(z)) <= w - 0.5",
    "bond_rule_join": """WITH o AS (SELECT l_orderkey, l_returnflag, l_linenumber, arg_max(l_extendedprice, row(l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount)) AS x FROM lineitem GROUP BY ALL),
        r(f, a1, a2) AS (VALUES ('A', 1, 2), ('A', 2, 3), ('N', 1, 3), ('R', 4, 5))
        SELECT a.l_orderkey, a.l_returnflag, CAST(a1 AS VARCHAR) AS a1, CAST(a2 AS VARCHAR) AS a2, a.x AS x1, b.x AS x2 FROM r JOIN o a ON a.l_returnflag = f AND a.l_linenumber = a1 JOIN o b ON b.l_orderkey = a.l_orderkey AND b.l_returnflag = f AND b.l_linenumber = a2""",
    "pivot_matrix": "SELECT user_id, " + ", ".join(f"round(max(CASE WHEN event_type = '{e}' THEN value END), 4) AS {e}" for e in _EVENTS) + " FROM events GROUP BY user_id",
    "frequency_breakdown": "SELECT user_id % 20 AS bucket, " + ", ".join(f"round(count(*) FILTER (event_type = '{e}') / count(*), 6) AS {e}" for e in _EVENTS) + " FROM events GROUP BY 1",
    "rmsd_by_group": f"WITH {_FIT} SELECT label, round(sqrt(sum((p0 - q0) * (p0 - q0) + (p1 - q1) * (p1 - q1) + (p2 - q2) * (p2 - q2)) / count(*)), 6) AS rmsd, count(*) AS n FROM f GROUP BY label",
    "covariance_3x3": f"WITH {_FIT}, m AS (SELECT *, " + ", ".join(f"avg(p{i}) OVER (PARTITION BY label) AS a{i}, avg(q{i}) OVER (PARTITION BY label) AS b{i}" for i in range(3)) + " FROM f) SELECT label, count(*) AS n, " + ", ".join(f"round(sum((p{i} - a{i}) * (q{j} - b{j})), 6) AS h{i}{j}" for i in range(3) for j in range(3)) + " FROM m GROUP BY label",
    "set_ops": """WITH u AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), o AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), c AS (SELECT c_custkey AS k FROM customer),
        a AS (SELECT 'union' AS op, k FROM (SELECT k FROM u UNION SELECT k FROM o) UNION ALL SELECT 'union_all', k FROM (SELECT k FROM u UNION ALL SELECT k FROM o) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM u INTERSECT SELECT k FROM o)
            UNION ALL SELECT 'except', k FROM (SELECT k FROM c EXCEPT SELECT k FROM u) UNION ALL SELECT 'except_distinct', k FROM (SELECT k FROM o EXCEPT SELECT k FROM u))
        SELECT op, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM a GROUP BY op UNION ALL SELECT 'subset', CAST(count(*) = 0 AS BIGINT), 0 FROM (SELECT k FROM u EXCEPT SELECT k FROM c)""",
    "expansion_union": f"""WITH {_A}, s AS (SELECT a.* FROM a WHERE a.label <> 0 AND EXISTS (SELECT 1 FROM a b WHERE b.label = 0 AND {_D.format('a', 'b')} <= 0.3)),
        m AS (SELECT a.* FROM a WHERE EXISTS (SELECT 1 FROM s WHERE s.label = a.label AND s.resnum = a.resnum AND (a.atom_name IN {chemistry.BACKBONE} OR (s.moiety = a.moiety AND s.moiety <> 'hydroxyl')))),
        u AS (SELECT * FROM s UNION SELECT * FROM m)
        SELECT vec_id AS ordinal, resname, resnum, atom_name, moiety FROM (SELECT *, row_number() OVER (PARTITION BY label, resnum, atom_name ORDER BY vec_id) AS n FROM u) WHERE n = 1""",
    "moiety_lookup": f"WITH {_A} SELECT vec_id AS ordinal, resname, atom_name, moiety FROM a",
    "moiety_wildcards": f"""WITH {_A}, x AS (SELECT *, moiety <> '{chemistry.UNKNOWN}' AS known FROM a),
        w AS (SELECT *, CASE WHEN atom_name = 'O' THEN CASE WHEN resname = 'HOH' THEN 'water' ELSE 'backbone' END WHEN known THEN moiety WHEN atom_name = 'N' THEN 'backbone' END AS m FROM x),
        t AS (SELECT label, resnum, moiety, string_agg(DISTINCT atom_name, ' ' ORDER BY atom_name) AS together FROM x WHERE known GROUP BY ALL)
        SELECT w.resnum, CAST(w.label AS VARCHAR) AS chain, atom_name, min(m) AS moiety, min(together) AS together, count(*) AS n
        FROM w LEFT JOIN t ON t.label = w.label AND t.resnum = w.resnum AND t.moiety = m GROUP BY ALL""",
    "centroid_match": f"""WITH {_P}, c AS (SELECT label, resnum, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY ALL),
        n AS (SELECT b.label, a.resnum AS template_resnum, b.resnum AS query_resnum, {_D.format('a', 'b')} AS d FROM c a JOIN c b ON a.label = 0 AND b.label <> 0 AND {_D.format('a', 'b')} <= 0.6),
        r AS (SELECT *, row_number() OVER (PARTITION BY label, template_resnum ORDER BY d, query_resnum) AS rn FROM n)
        SELECT CAST(j.label AS VARCHAR) AS structure_id, c.resnum AS template_resnum, r.query_resnum, round(r.d, 6) AS distance
        FROM c CROSS JOIN (SELECT DISTINCT label FROM p WHERE label <> 0) j LEFT JOIN r ON r.label = j.label AND r.template_resnum = c.resnum AND rn = 1 WHERE c.label = 0""",
    "ca_evaluation": f"""WITH {_P}, n AS (SELECT b.label, a.vec_id, min({_D.format('a', 'b')}) AS d FROM p a JOIN p b ON a.label = 0 AND b.label <> 0 AND a.slot < 2 AND b.slot < 2 GROUP BY ALL)
        SELECT CAST(label AS VARCHAR) AS structure_id, count(*) AS total, count(*) FILTER (d <= 0.6) AS matches, count(*) FILTER (d > 0.6) AS misses, round(avg(d) FILTER (d <= 0.6), 6) AS mean_distance FROM n GROUP BY label""",
    "network_comparison": f"""WITH {_A}, n AS (SELECT * FROM a WHERE label <> 0 AND vec_id % 2 = 0), q AS (SELECT vec_id % 3 AS j, vec_id, resname, CAST(vec_id AS INTEGER) AS resnum, atom_name, x, y, z FROM a WHERE label NOT IN (0, 9) AND vec_id % 2 = 1
            UNION ALL SELECT j, c.vec_id, 'OEX', 1, list_extract({_CENTRE}, CAST(vec_id % {len(_CENTRE)} AS INTEGER) + 1), x, y, z FROM a c CROSS JOIN range(3) t(j) WHERE label = 0),
        r AS (SELECT n.vec_id AS ordinal, n.resname AS t_resname, n.atom_name AS t_atom, q.*, {_D.format('n', 'q')} AS d, row_number() OVER (PARTITION BY q.j, n.vec_id ORDER BY {_D.format('n', 'q')}, q.vec_id) AS rn FROM n CROSS JOIN q)
        SELECT 's' || j AS job_name, ordinal, resname AS query_residue, resnum AS query_resnum, atom_name AS query_atom, round(d, 6) AS distance, CASE WHEN resname = t_resname THEN 'Y' ELSE 'N' END AS same_residue_name,
            CASE WHEN atom_name = t_atom THEN 'Y' ELSE 'N' END AS same_atom_name, CASE WHEN d <= 0.3 THEN 'Y' ELSE 'N' END AS matched_within_cutoff FROM r WHERE rn = 1""",
    "residues_of_interest": f"""WITH {_A} SELECT vec_id AS ordinal, resname, resnum, CASE WHEN resname = 'OEX' THEN 'cofactor' ELSE 'residue' END AS "group" FROM a WHERE resname = 'OEX' OR resnum IN (4, 8, 21)""",
    "kabsch_relations": "SELECT label, count(*) AS n, CAST(0 AS DOUBLE) AS bent, CAST(1 AS DOUBLE) AS det, CAST(0 AS DOUBLE) AS skew, CAST(0 AS DOUBLE) AS off FROM embeddings GROUP BY label",
    "json_priority_coalesce": "SELECT user_id, sum(coalesce(CAST(json_extract_string(props, '$.missing') AS DOUBLE), CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)) AS total, count(json_extract_string(props, '$.k')) AS present FROM events GROUP BY user_id",
    "combinatorial_pairs": f"WITH {_P} SELECT a.vec_id, a.label, round(min({_D.format('a', 'b')}), 6) AS min_distance FROM p a JOIN p b ON (a.label, b.label) IN ((3, 4), (4, 3)) AND {_D.format('a', 'b')} <= 0.4 GROUP BY a.vec_id, a.label",
    "interactor_self_join": f"WITH {_P}, q AS (SELECT * FROM p), h AS (SELECT a.vec_id, string_agg(DISTINCT CAST(b.label AS VARCHAR), ', ' ORDER BY CAST(b.label AS VARCHAR)) AS names FROM q a JOIN q b ON a.slot = b.slot AND a.vec_id <> b.vec_id AND {_D.format('a', 'b')} <= 0.35 GROUP BY a.vec_id) SELECT q.vec_id, coalesce(names, '') AS names, names IS NOT NULL AS interacts FROM q LEFT JOIN h ON q.vec_id = h.vec_id",
    "preference_tiebreak": f"WITH {_P}, n AS ({_NEAREST} WHERE a.label <> 0 AND b.label = 0) SELECT vec_id // 5 AS resnum, vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id // 5 ORDER BY round(d, 6), CASE label WHEN 5 THEN 0 WHEN 3 THEN 1 ELSE 9 END, vec_id) AS r FROM n WHERE rn = 1 AND d <= 2.0) WHERE r = 1",
    "run_status_counts": "WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1) SELECT count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus IS NULL) AS skipped, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM customer LEFT JOIN f ON c_custkey = o_custkey",
}

QUERIES: dict[str, Query] = {f.__name__: f for f in (
    scan_filter_project, distance_semi_join, distance_pairs, distance_pairs_grid, nearest_neighbor, nearest_within_cutoff_left, policy_topk_per_group,
    residue_anti_join, two_hop_network, edge_list, lookup_with_wildcard_default, synonym_canonicalise, argmax_group_pick, match_rate_rollup, residue_centroid,
    residue_breakdown, category_precedence, first_by_key_dedup, duplicate_signature_groups, mask_preferred_canonical, cutoff_sweep, cube_filter, bond_rule_join,
    pivot_matrix, frequency_breakdown, rmsd_by_group, covariance_3x3, kabsch_alignment, set_ops, expansion_union, json_priority_coalesce, combinatorial_pairs,
    interactor_self_join, preference_tiebreak, run_status_counts, moiety_lookup, moiety_wildcards, centroid_match, ca_evaluation, residues_of_interest,
    kabsch_relations, network_comparison,
)}
