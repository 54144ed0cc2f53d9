"""Removing duplicate chains of structures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry
from ..operators import residues


def chains(atoms: DataFrame, by: str = "sequence") -> DataFrame:
    """(structure_id, chain, signature, present) of the first model's chains. A signature is the residue names in
    order (``sequence``), or all atoms with coordinates to three decimals (``coords``), of standard residues that
    aren't water; as text elements, in both cases. ``present``: names of all that isn't water."""
    first = atoms.groupBy("structure_id").agg(F.min("model").alias("model"))
    rows = atoms.join(first, ["structure_id", "model"], "left_semi")
    dry = rows.where(~F.col("resname").isin(*chemistry.WATERS) & (F.col("hetflag") != "W"))
    standard = dry.where("hetflag = ' '")
    key = ["structure_id", "chain"]
    if by == "sequence":
        one = standard.groupBy(*key, "resnum", "icode", "resname").agg(F.min("ordinal").alias("first"))
        signed = residues.signatures(one, key, F.col("resname"), ["first"])
    elif by == "coords":
        point = [F.bround(c, 3) for c in ("x", "y", "z")]
        signed = residues.signatures(standard, key, F.concat_ws("|", "resnum", "icode", "resname", "atom_name", *[p.cast("string") for p in point]), ["resnum", "icode", "atom_name", "ordinal"])
    else:
        raise ValueError(f"by {by}")
    names = dry.groupBy(*key).agg(F.collect_set("resname").alias("present"))
    return signed.join(names, key)


def keep_chains(atoms: DataFrame, by: str = "sequence", mask: Sequence[str] = (), mode: str = "all", collapse: bool = False) -> DataFrame:
    """(structure_id, chain) to keep: all but the duplicates of each group's canonical chain, which is the first that
    holds the mask, else the first. ``collapse``: where several kept chains hold the mask, only the smallest stays,
    and nothing else of that structure."""
    signed = chains(atoms, by)
    extra = residues.duplicates(signed, ["structure_id"], "chain", mask, mode)
    kept = atoms.select("structure_id", "chain").distinct().join(extra, ["structure_id", "chain"], "left_anti")
    if not (collapse and mask):
        return kept
    m = F.array(*[F.lit(x) for x in mask])
    fits = (F.size(F.array_except(m, "present")) == 0) if mode == "all" else F.arrays_overlap(m, "present")
    holding = signed.where(fits).join(kept, ["structure_id", "chain"], "left_semi").groupBy("structure_id").agg(F.min("chain").alias("only"), F.count("*").alias("n")).where("n > 1")
    touched = holding.join(extra.select("structure_id").distinct(), "structure_id", "left_semi")
    out = kept.join(touched, "structure_id", "left")
    return out.where("only is null or chain = only").select("structure_id", "chain")


def deduplicate(atoms: DataFrame, **options) -> DataFrame:
    """Atoms of the first model's kept chains."""
    first = atoms.groupBy("structure_id").agg(F.min("model").alias("model"))
    return atoms.join(first, ["structure_id", "model"], "left_semi").join(keep_chains(atoms, **options), ["structure_id", "chain"], "left_semi")
