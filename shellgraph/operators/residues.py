"""Aggregates over residues: centroids, name lists, bonds, signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names_list(c: str | Column) -> Column:
    """The distinct values in order, joined by comma and space."""
    return F.array_join(F.array_sort(F.collect_set(c)), ", ")


def centroids(atoms: DataFrame, keys: Sequence[str], name: str = "resname", order: str = "ordinal") -> DataFrame:
    """Mean x, y, z per key, and the first atom's name. Rows without key or coordinates are skipped."""
    rows = atoms.dropna(subset=[*keys, "x", "y", "z"])
    names = [] if name in keys else [F.min_by(name, order).alias(name)]
    return rows.groupBy(*keys).agg(*names, *[F.avg(c).alias(c) for c in "xyz"])


def bond_pairs(atoms: DataFrame, rules: DataFrame, keys: Sequence[str], name: str, kind: str, order: Sequence[str]) -> DataFrame:
    """(keys, a1, a2, p1, p2): the pairs of a rule ``(kind, a1, a2)`` whose two atoms the residue has;
    of atoms with one name the last in ``order`` counts. Rules are a small fixed dimension."""
    one = atoms.groupBy(*keys, kind, name).agg(F.max_by(F.struct("x", "y", "z"), F.struct(*order)).alias("p"))
    first = one.withColumnsRenamed({name: "a1", "p": "p1"})
    second = one.withColumnsRenamed({name: "a2", "p": "p2"})
    return first.join(F.broadcast(rules), [kind, "a1"]).join(second, [*keys, kind, "a2"]).select(*keys, kind, "a1", "a2", "p1", "p2")


def signatures(rows: DataFrame, keys: Sequence[str], element: Column, order: Sequence[str]) -> DataFrame:
    """(keys, signature): the elements of each key as one array, in order."""
    e = F.struct(*order, element.alias("__e"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(e)), lambda s: s["__e"]).alias("signature"))


def _fits(mask: Sequence[str], mode: str, present: str) -> Column:
    m = F.array(*[F.lit(x) for x in mask]).cast("array<string>")
    if not mask:
        return F.lit(False)
    if mode == "all":
        return F.size(F.array_except(m, F.col(present))) == 0
    if mode == "any":
        return F.arrays_overlap(m, F.col(present))
    raise ValueError(f"mode {mode}")


def duplicate_groups(signed: DataFrame, scope: Sequence[str], member: str, mask: Sequence[str] = (), mode: str = "all", present: str = "present") -> DataFrame:
    """Groups of several members of one scope and signature: (scope, signature, n, n_matching, canonical).

    canonical: the smallest member whose set ``present`` holds the whole mask (mode ``all``) or any of it (``any``), else
    the smallest. An empty mask matches nothing. The arrays themselves are the group key, so no hash can collide; counts
    and minima combine before they move, so a signature of any share is no large row."""
    rows = signed.select(*scope, "signature", member, _fits(mask, mode, present).alias("__fits"))
    out = rows.groupBy(*scope, "signature").agg(F.count(member).alias("n"), F.count_if("__fits").alias("n_matching"), F.min(member).alias("__least"), F.min(F.when(F.col("__fits"), F.col(member))).alias("__fit"))
    return out.where("n > 1").select(*scope, "signature", "n", "n_matching", F.coalesce("__fit", "__least").alias("canonical"))


def duplicates(signed: DataFrame, scope: Sequence[str], member: str, mask: Sequence[str] = (), mode: str = "all", present: str = "present") -> DataFrame:
    """(scope, member, canonical): every member of a duplicate group but the canonical one. Members meet their group by a
    name of 128 bits of the signature, and by the arrays."""
    name = lambda: [F.xxhash64("signature").alias("__h1"), F.xxhash64(F.lit(1), "signature").alias("__h2")]
    groups = duplicate_groups(signed, scope, member, mask, mode, present).select(*scope, F.col("signature").alias("__s"), "canonical", *name())
    rows = signed.select(*scope, "signature", member, *name())
    return rows.join(groups, [*scope, "__h1", "__h2"]).where(F.col("signature") == F.col("__s")).where(F.col(member) != F.col("canonical")).select(*scope, member, "canonical")
