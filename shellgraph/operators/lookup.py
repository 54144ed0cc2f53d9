"""Dimension lookups: moieties, synonyms, category precedence, flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry


def label_moieties(atoms: DataFrame, table: DataFrame | None = None, default: str | None = chemistry.UNKNOWN, upper: bool = False, fallback_backbone: bool = False) -> DataFrame:
    """``atoms`` with ``moiety`` by (resname, atom_name). ``upper``: names in upper case before the
    lookup; ``fallback_backbone``: unlabelled atoms with backbone names are backbone; what is left
    gets ``default``. The table is a fixed dimension, small enough to broadcast."""
    table = table or chemistry.moiety_table(atoms.sparkSession)
    fold = F.upper if upper else (lambda c: F.col(c) if isinstance(c, str) else c)
    t = table.select(fold("resname").alias("__r"), fold("atom_name").alias("__a"), F.col("moiety").alias("__m"))
    out = atoms.drop("moiety").join(F.broadcast(t), (fold("resname") == F.col("__r")) & (fold("atom_name") == F.col("__a")), "left")
    backbone = F.when(F.col("atom_name").isin(*chemistry.BACKBONE), "backbone") if fallback_backbone else F.lit(None).cast("string")
    return out.withColumn("moiety", F.coalesce("__m", backbone, F.lit(default))).drop("__r", "__a", "__m")


def co_moiety(atoms: DataFrame, keys: Sequence[str], table: DataFrame | None = None) -> DataFrame:
    """(keys, atom_name, moiety, together): each atom's moiety with wildcards, and the sorted names of its residue's atoms
    of that label.

    OXT is the c_terminus where the residue has O, else nothing; O is the c_terminus where it has OXT, else water in
    HOH, else backbone; other names go by (residue, name), then ("ANY", name). Atoms without moiety have null."""
    table = table or chemistry.moiety_table(atoms.sparkSession)
    exact = table.select(F.col("resname").alias("__r"), F.col("atom_name").alias("__a"), F.col("moiety").alias("__exact"))
    some = table.where("resname = 'ANY'").select(F.col("atom_name").alias("__b"), F.col("moiety").alias("__any"))
    rows = atoms.select(*keys, *([] if "resname" in keys else ["resname"]), "atom_name").join(F.broadcast(exact), (F.col("resname") == F.col("__r")) & (F.col("atom_name") == F.col("__a")), "left")
    rows = rows.join(F.broadcast(some), F.col("atom_name") == F.col("__b"), "left")
    named = rows.groupBy(*keys).agg(F.bool_or(F.col("atom_name") == "O").alias("__o"), F.bool_or(F.col("atom_name") == "OXT").alias("__oxt"))
    name = F.col("atom_name")
    oxygen = F.when(F.col("__oxt"), "c_terminus").when(F.col("resname") == "HOH", "water").otherwise("backbone")
    moiety = F.when(name == "OXT", F.when(F.col("__o"), F.lit("c_terminus"))).when(name == "O", oxygen).otherwise(F.coalesce("__exact", "__any"))
    rows = rows.join(named, list(keys)).withColumn("moiety", moiety)
    labelled = rows.where("__exact is not null").groupBy(*keys, F.col("__exact").alias("moiety")).agg(F.array_sort(F.collect_set("atom_name")).alias("together"))
    return rows.join(labelled, [*keys, "moiety"], "left").select(*keys, "atom_name", "moiety", "together")


def synonyms(spark, groups: Sequence[Sequence[str]]) -> DataFrame:
    """(synonym, canonical) of groups whose first name is canonical; a name in two groups belongs to
    the later one."""
    found = {name.upper(): group[0].upper() for group in groups for name in group}
    return spark.createDataFrame(sorted(found.items()), "synonym string, canonical string")


def canonicalise(df: DataFrame, column: str, names: DataFrame, out: str) -> DataFrame:
    """Rows whose ``column`` is a known name, with its canonical form; others go."""
    n = names.select(F.col("synonym").alias("__s"), F.col("canonical").alias(out))
    return df.join(F.broadcast(n), F.upper(F.trim(column)) == F.col("__s")).drop("__s")


def precedence(parts: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """(keys, category): of the named sets, first wins, the first that holds the key."""
    rows = None
    for rank, (_, df) in enumerate(parts):
        part = df.select(*keys, F.lit(rank).alias("__rank"))
        rows = part if rows is None else rows.unionByName(part)
    names = F.array(*[F.lit(n) for n, _ in parts])
    return rows.groupBy(*keys).agg(F.min("__rank").alias("__rank")).select(*keys, F.element_at(names, F.col("__rank") + 1).alias("category"))


def flag_members(df: DataFrame, members: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df`` with a boolean, whether its keys are among ``members``."""
    m = members.select(*keys).distinct().withColumn("__in", F.lit(True))
    return df.join(m, list(keys), "left").withColumn(name, F.coalesce("__in", F.lit(False))).drop("__in")
