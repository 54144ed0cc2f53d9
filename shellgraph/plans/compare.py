"""Template networks against query structures: canonical names, rigid fit, nearest atoms, match rates.

``query`` holds the atoms of many structures; every structure is one job, and one run serves them all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry
from ..operators import distance, lookup, matching, residues, topk

# The names that stand for each other, the canonical one first.
RESIDUE_NAMES = [["OEX", "MY-OEX"]]
ATOM_NAMES = [["O1"], ["O2"], ["O3"], ["O4"], ["O5"], ["MN1"], ["MN2"], ["MN3"], ["MN4"], ["CA1", "CAL"]]


@dataclass(frozen=True)
class Comparison:
    """matches: a row for each network atom and job; matrix: the fitted atoms; fits: transform, RMSD and the two
    residues by job; rates: matches by category and over all (category null)."""

    matches: DataFrame
    matrix: DataFrame
    fits: DataFrame
    rates: DataFrame


def named(atoms: DataFrame, residue_names: Sequence[Sequence[str]], atom_names: Sequence[Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """Atoms with known names, one for each residue and canonical atom, the last in order."""
    spark = atoms.sparkSession
    rows = lookup.canonicalise(atoms, "resname", lookup.synonyms(spark, residue_names), "residue")
    rows = lookup.canonicalise(rows, "atom_name", lookup.synonyms(spark, atom_names), "atom")
    return rows.groupBy(*keys, "residue", "resnum", "chain", "atom").agg(F.max_by(F.struct("x", "y", "z"), "ordinal").alias("p"), F.min("ordinal").alias("first"))


def best_residue(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The atoms of the residue with most of them, the first of equal ones."""
    size = rows.groupBy(*keys, "residue", "resnum", "chain").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    best = topk.argmax(size.withColumn("who", F.struct("residue", "resnum", "chain")), keys, "who", F.col("n"), [F.col("first")], "who") if keys else size.agg(F.max_by(F.struct("residue", "resnum", "chain"), F.struct("n", -F.col("first"))).alias("who"))
    flat = best.select(*keys, "who.residue", "who.resnum", "who.chain")
    return rows.join(flat, [*keys, "residue", "resnum", "chain"])


def compare(template: DataFrame, network: DataFrame, query: DataFrame, cutoff: float = 2.0, residue_names=RESIDUE_NAMES, atom_names=ATOM_NAMES) -> Comparison:
    """Match ``network`` atoms to every structure of ``query`` after fitting the template's centre onto its own.

    ``template`` gives the residue to fit (resname, resnum, chain, atom_name, x, y, z, ordinal), ``network`` the atoms to
    match (category, resname, resnum, chain, atom_name, moiety, interactor, x, y, z, ordinal). Structures without
    three shared atoms have no fit and no rows. Waters of the query are never matched. A network atom with no query
    atom at all keeps a row with nulls.
    """
    t = best_residue(named(template, residue_names, atom_names, []), [])
    q = best_residue(named(query, residue_names, atom_names, ["structure_id"]), ["structure_id"])
    shared = q.select("structure_id", "atom", F.col("p").alias("q"), F.struct("residue", "resnum", "chain").alias("query_centre")).join(t.select("atom", F.col("p").alias("p"), F.struct("residue", "resnum", "chain").alias("template_centre")), "atom")
    flat = shared.select("structure_id", "atom", "template_centre", "query_centre", *[F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "pq" for c in "xyz"])
    fits = matching.fit(flat, ["structure_id"])
    moved = flat.join(fits, "structure_id").select("*", *[c.alias(f"a{n}") for c, n in zip(matching.moved("px", "py", "pz"), "xyz", strict=True)])
    gap = sum(((F.col(f"a{c}") - F.col(f"q{c}")) * (F.col(f"a{c}") - F.col(f"q{c}")) for c in "xyz"), F.lit(0.0))
    matrix = moved.select("structure_id", "atom", "template_centre", "query_centre", "px", "py", "pz", "ax", "ay", "az", "qx", "qy", "qz", F.sqrt(gap).alias("deviation"))
    errors = moved.groupBy("structure_id").agg(matching.rmsd(gap).alias("rmsd"), F.first("template_centre").alias("template_centre"), F.first("query_centre").alias("query_centre"))
    fits = fits.join(errors, "structure_id")

    net = network.select(F.col("ordinal").alias("n_ordinal"), "category", F.col("resname").alias("t_resname"), F.col("resnum").alias("t_resnum"), F.col("chain").alias("t_chain"), F.col("atom_name").alias("t_atom"), "moiety", "interactor", "x", "y", "z")
    placed = fits.crossJoin(net)  # jobs times the network's atoms: what is to be reported
    placed = placed.select("structure_id", "n_ordinal", "category", "t_resname", "t_resnum", "t_chain", "t_atom", "moiety", "interactor", *[c.alias(n) for c, n in zip(matching.moved(), "xyz", strict=True)])
    dry = query.where(~F.upper(F.trim("resname")).isin(*chemistry.WATERS)).select("structure_id", "ordinal", F.upper(F.trim("resname")).alias("resname"), "resnum", "chain", F.upper(F.trim("atom_name")).alias("atom_name"), "element", "x", "y", "z")
    near = distance.nearest(placed, dry, ["structure_id"], ["ordinal"])
    hit = F.coalesce(F.col("d") <= cutoff, F.lit(False))
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "Y").otherwise("N")
    matches = near.select(
        F.col("l.structure_id").alias("job_name"), F.col("l.n_ordinal").alias("ordinal"), F.col("l.category").alias("category"),
        F.col("l.t_resname").alias("template_residue"), F.col("l.t_resnum").alias("template_resnum"), F.col("l.t_chain").alias("template_chain"),
        F.col("l.t_atom").alias("template_atom"), F.col("l.moiety").alias("template_moiety"), F.col("l.interactor").alias("template_interactor"),
        F.col("r.resname").alias("query_residue"), F.col("r.resnum").alias("query_resnum"), F.col("r.chain").alias("query_chain"),
        F.col("r.atom_name").alias("query_atom"), F.col("r.element").alias("query_element"), F.col("d").alias("distance_A"),
        yes(F.col("r.resname") == F.col("l.t_resname")).alias("same_residue_name"), yes(F.col("r.atom_name") == F.col("l.t_atom")).alias("same_atom_name"),
        yes(hit).alias("matched_within_cutoff"),
    )
    rates = matching.match_rates(matches, "category", F.col("matched_within_cutoff") == "Y", ["job_name"])
    return Comparison(matches, matrix, fits, rates)


def fit_report(c: Comparison) -> DataFrame:
    """A row for each fitted structure, with the headings of the report file: the two residues, how many atoms were
    fitted and which, and their RMSD."""
    used = c.matrix.groupBy("structure_id").agg(F.count("*").alias("n_atoms"), F.concat_ws(" ", F.array_sort(F.collect_list("atom"))).alias("atoms_used"))
    centre = lambda n: [F.col(f"{n}_centre.{k}").alias(f"{n}_{v}") for k, v in (("residue", "residue"), ("resnum", "resnum"), ("chain", "chain"))]
    rows = c.fits.join(used, "structure_id").orderBy("structure_id")
    return rows.select(F.col("structure_id").alias("job_name"), *centre("template"), *centre("query"), "n_atoms", "atoms_used", "rmsd")


def match_residues(template: DataFrame, query: DataFrame, cutoff: float, key: Sequence[str] = ("resnum",)) -> DataFrame:
    """Template residue centroids with the nearest query centroid within the cutoff, by structure. ``key`` names a
    residue: the number alone merges chains, (chain, resname, resnum) doesn't. Unmatched: null columns."""
    t = residues.centroids(template, list(key))
    q = residues.centroids(query, ["structure_id", *key])
    jobs = query.select("structure_id").distinct()
    near = distance.nearest(jobs.crossJoin(t), q, ["structure_id"], [*key], cutoff=cutoff)
    return near.select("l.structure_id", F.col("l.resnum").alias("template_resnum"), F.col("l.resname").alias("template_resname"), F.col("r.resnum").alias("query_resnum"), F.col("r.resname").alias("query_resname"), F.col("d").alias("distance"))


def evaluate_ca(template: DataFrame, query: DataFrame, cutoff: float) -> DataFrame:
    """By structure: template CA atoms, how many have a query CA within the cutoff, misses, and the mean distance of
    the matches (null if none)."""
    ca = F.col("atom_name") == "CA"
    jobs = query.select("structure_id").distinct()
    t = template.where(ca).select(F.col("ordinal").alias("t"), "x", "y", "z")
    near = distance.nearest(jobs.crossJoin(t), query.where(ca).select("structure_id", "ordinal", "x", "y", "z"), ["structure_id"], ["ordinal"], cutoff)
    hit = F.col("d").isNotNull()
    return near.groupBy("l.structure_id").agg(F.count("*").alias("total"), F.count_if(hit).alias("matches"), F.count_if(~hit).alias("misses"), F.avg(F.when(hit, F.col("d"))).alias("mean_distance"))
