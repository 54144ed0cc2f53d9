"""Plot-ready tables for viewers: markers, bonds, and links with their coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import distance, lookup
from ..schema import ATOM_KEY
from . import network


def markers(n: network.Network) -> DataFrame:
    """Every atom of the network's residues: sphere, moiety (hover text), whether it interacts, x, y, z."""
    rows = lookup.label_moieties(network.residue_atoms(n), upper=True, fallback_backbone=True)
    acting = n.cofactor.select(*ATOM_KEY).unionByName(n.pcs.select(*ATOM_KEY)).unionByName(n.scs.select(*ATOM_KEY))
    return lookup.flag_members(rows, acting, ATOM_KEY, "interacts").select(*ATOM_KEY, "element", "category", "moiety", "interacts", "x", "y", "z")


def bonds(n: network.Network, focused: bool = True) -> DataFrame:
    """Bonds as segments; ``focused``: of the network's residues alone."""
    b = network.bonds(network.residue_atoms(n) if focused else n.atoms)
    return b.select("structure_id", "resname", "resnum", "chain", "a1", "a2", *[F.col(f"p{i}.{c}").alias(f"{c}{i}") for i in (1, 2) for c in "xyz"])


def links(n: network.Network) -> tuple[DataFrame, DataFrame]:
    """(drawn, missed): edges with both ends' coordinates, and those with an end among no markers."""
    m = markers(n)
    out = n.edges
    for side in ("src", "dst"):
        names = ["resname", "resnum", "chain", "atom"]
        end = m.select("structure_id", *[F.col(c if c != "atom" else "atom_name").alias(f"{side}_{c}") for c in names], F.struct("x", "y", "z").alias(f"{side}_xyz"))
        out = out.join(end, ["structure_id", *[f"{side}_{c}" for c in names]], "left")
    found = F.col("src_xyz").isNotNull() & F.col("dst_xyz").isNotNull()
    return out.where(found), out.where(~found)


def conserved(n: network.Network, numbers: list[int]) -> DataFrame:
    """Markers with whether their residue is among the conserved ones."""
    return markers(n).withColumn("conserved", F.coalesce(F.col("resnum").isin(*numbers), F.lit(False)))


def cube_matches(template: DataFrame, query: DataFrame, cutoff: float) -> DataFrame:
    """By structure, CA atoms of the template with a CA of the query's cube within the cutoff: matches, total, percent."""
    near = distance.nearest(query.select("structure_id").distinct().crossJoin(template.where("atom_name = 'CA'").select("ordinal", "x", "y", "z")), network.cube(query, template, cutoff).where("atom_name = 'CA'").select("structure_id", "ordinal", "x", "y", "z"), ["structure_id"], ["ordinal"], cutoff)
    hit = F.col("d").isNotNull()
    return near.groupBy("l.structure_id").agg(F.count_if(hit).alias("matches"), F.count("*").alias("total"), (F.count_if(hit) * 100.0 / F.count("*")).alias("percent"))
