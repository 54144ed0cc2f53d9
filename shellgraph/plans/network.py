"""Coordination networks: two hops from a centre group, for many structures in one job.

Cofactor atoms are the centre. Primary seeds (PCS) are atoms of other residues within the cutoff of a
cofactor atom; secondary seeds (SCS) those within the cutoff of a primary seed, outside the cofactor's and
the primary residues. In each residue and moiety only the nearest few atoms coordinate, as policy says.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry
from ..operators import distance, lookup, residues, topk
from ..schema import ATOM_KEY, RESIDUE

INTERACTION = 3.0  # a fixed value of the residue report


@dataclass(frozen=True)
class Settings:
    """``combinatorial`` and ``combinatorial_cutoff`` act only with ``strict_parity`` off: they then keep cofactor
    atoms with one of the other group within that distance. ``exclude_moieties`` limits expansion, never seeds."""

    cofactors: tuple[str, ...]
    cofactors2: tuple[str, ...] = ()
    cutoff: float = 3.6
    expand: bool = False
    exclude_moieties: tuple[str, ...] = ("alanine_sidechain",)
    combinatorial: bool = False
    combinatorial_cutoff: float = 20.0
    excluded_elements: tuple[str, ...] = ("C",)
    default_k: int = 1
    strict_parity: bool = True
    strategy: str = "auto"

    @classmethod
    def from_options(cls, *layers: dict) -> Settings:
        """Settings from layers of options, later ones first in rank; None never overrides."""
        merged = reduce(lambda a, b: a | {k: v for k, v in b.items() if v is not None}, layers, {})
        as_names = lambda v: (v,) if isinstance(v, str) else tuple(v or ())
        out = cls(as_names(merged.get("cofactor_resname")), as_names(merged.get("cofactor_resname2")))
        take = {"cutoff": "distance_cutoff", "expand": "expand_residues", "combinatorial": "combinatorial", "combinatorial_cutoff": "combinatorial_cofactor_cutoff"}
        out = replace(out, **{k: merged[o] for k, o in take.items() if o in merged})
        return replace(out, exclude_moieties=as_names(merged["exclude_moieties"])) if "exclude_moieties" in merged else out


@dataclass(frozen=True)
class Network:
    """Atoms with their moiety, the three spheres (``min_distance`` to the sphere before), and the edges."""

    atoms: DataFrame
    cofactor: DataFrame
    pcs: DataFrame
    scs: DataFrame
    edges: DataFrame


def cofactor_atoms(atoms: DataFrame, names: Sequence[str]) -> DataFrame:
    return atoms.where(F.upper("resname").isin(*[n.upper() for n in names]))


def seeds(atoms: DataFrame, around: DataFrame, excluded: DataFrame, s: Settings) -> DataFrame:
    """Coordinating atoms around a sphere: near enough, of an element that may coordinate, of no excluded
    residue, and among the first k of their residue and moiety by distance."""
    able = atoms.where(~F.upper("element").isin(*s.excluded_elements))
    near = distance.within(able, around.select("structure_id", "x", "y", "z"), ["structure_id"], s.cutoff, s.strategy)
    near = near.join(excluded.select(*RESIDUE).distinct(), RESIDUE, "left_anti")
    policy = chemistry.policy_table(atoms.sparkSession)
    most = max(k for *_, k in chemistry.POLICY)
    return topk.policy_topk(near, policy, [*RESIDUE, "moiety"], ["resname", "moiety"], ["min_distance", "ordinal"], max(most, s.default_k), s.default_k).drop("rank")


def links(sources: DataFrame, targets: DataFrame, kind: str, s: Settings) -> DataFrame:
    """An edge from the nearest source to each target within the cutoff, the first source of equally near ones."""
    found = distance.nearest(targets, sources, ["structure_id"], ["ordinal"], s.cutoff, s.strategy).where("r is not null")
    label = (lambda c: F.lit("")) if s.strict_parity else (lambda c: F.col(c))
    side = lambda t, n: [F.col(f"{t}.resname").alias(f"{n}_resname"), F.col(f"{t}.resnum").alias(f"{n}_resnum"), F.col(f"{t}.chain").alias(f"{n}_chain"), F.col(f"{t}.atom_name").alias(f"{n}_atom"), label(f"{t}.moiety").alias(f"{n}_moiety")]
    return found.select(F.col("l.structure_id").alias("structure_id"), F.lit(kind).alias("link_type"), *side("r", "src"), *side("l", "dst"), F.col("d").alias("distance_A"))


def expand(atoms: DataFrame, chosen: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """Seeds with the backbone of their residues and what shares a moiety with a seed, unknown moieties
    included, but for excluded ones (in any case). Seeds stay; each atom once."""
    wanted = chosen.where(~F.lower("moiety").isin(*[m.lower() for m in exclude])) if exclude else chosen
    own = wanted.groupBy(*RESIDUE).agg(F.collect_set("moiety").alias("__m"))
    rows = atoms.join(chosen.select(*RESIDUE).distinct(), RESIDUE, "left_semi").join(own, RESIDUE, "left")
    more = rows.where(F.col("atom_name").isin(*chemistry.BACKBONE) | F.coalesce(F.array_contains("__m", F.col("moiety")), F.lit(False)))
    return topk.first_by(chosen.select(*atoms.columns).unionByName(more.select(*atoms.columns)), ATOM_KEY, ["ordinal"])


def coordination_network(atoms: DataFrame, s: Settings) -> Network:
    """The network of each structure in ``atoms``. Without cofactor atoms a structure has no seeds and no edges."""
    atoms = lookup.label_moieties(atoms)
    core = cofactor_atoms(atoms, [*s.cofactors, *s.cofactors2])
    if s.combinatorial and not s.strict_parity and s.cofactors2:
        one, two = cofactor_atoms(atoms, s.cofactors), cofactor_atoms(atoms, s.cofactors2)
        near = [distance.within(a, b, ["structure_id"], s.combinatorial_cutoff, s.strategy).drop("min_distance") for a, b in ((one, two), (two, one))]
        core = near[0].unionByName(near[1])
    # the spheres are small and read again by every later step
    pcs = seeds(atoms, core, core, s).persist()
    scs = seeds(atoms, pcs, core.select(*RESIDUE).unionByName(pcs.select(*RESIDUE)), s).persist()
    edges = links(core, pcs, "cofactor->pcs", s).unionByName(links(pcs, scs, "pcs->scs", s))
    if s.expand:
        pcs, scs = (expand(atoms, x, s.exclude_moieties) for x in (pcs, scs))
    return Network(atoms, core, pcs, scs, edges)


def residue_report(n: Network, moiety_names: bool = False) -> DataFrame:
    """A row for each residue of a sphere: category, names of its moiety's atoms (empty unless
    ``moiety_names``), and the names of primary and secondary atoms within 3.0 of one of its atoms."""
    cols = ["structure_id", *RESIDUE[1:], "atom_name", "x", "y", "z", "ordinal", "moiety"]
    spheres = reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("category"), F.lit(i).alias("order"), *cols) for i, (k, d) in enumerate((("Cofactor", n.cofactor), ("PCS", n.pcs), ("SCS", n.scs)))])
    around = n.pcs.select(*cols).unionByName(n.scs.select(*cols))
    near = distance.pairs(spheres, around, ["structure_id"], INTERACTION).where("l.ordinal <> r.ordinal")
    heard = near.groupBy("l.category", *[f"l.{c}" for c in RESIDUE]).agg(residues.names_list(F.col("r.atom_name")).alias("interactors"))
    own = spheres.groupBy("category", "order", *RESIDUE).agg(F.min("ordinal").alias("first"), F.collect_set("moiety").alias("__m"))
    if moiety_names:
        same = n.atoms.groupBy(*RESIDUE, "moiety").agg(F.collect_set("atom_name").alias("__a"))
        named = own.select("category", *RESIDUE, F.explode("__m").alias("moiety")).join(same, [*RESIDUE, "moiety"]).groupBy("category", *RESIDUE).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__a")))), ", ").alias("moiety"))
        own = own.join(named, ["category", *RESIDUE], "left")
    else:
        own = own.withColumn("moiety", F.lit(""))
    out = own.drop("__m").join(heard, ["category", *RESIDUE], "left")
    return out.withColumns({"interactors": F.coalesce("interactors", F.lit("")), "moiety": F.coalesce("moiety", F.lit(""))})


def residue_atoms(n: Network) -> DataFrame:
    """Every atom of every residue of the network, with the residue's first category of Cofactor, PCS, SCS."""
    category = lookup.precedence([("Cofactor", n.cofactor), ("PCS", n.pcs), ("SCS", n.scs)], RESIDUE)
    return n.atoms.join(category, RESIDUE)


def atom_report(n: Network, strict_parity: bool = True) -> DataFrame:
    """Per atom of the network's residues: category, moiety (backbone names count where unlabelled) and whether
    the atom itself interacts. With parity residues are known by chain and number, and number 0 is left out."""
    key = ["structure_id", "chain", "resnum"] if strict_parity else RESIDUE
    part = lambda d: d.where("resnum <> 0") if strict_parity else d
    category = lookup.precedence([(k, part(d)) for k, d in (("Cofactor", n.cofactor), ("PCS", n.pcs), ("SCS", n.scs))], key)
    acting = reduce(DataFrame.unionByName, [d.select(*key, "atom_name") for d in (n.cofactor, n.pcs, n.scs)])
    rows = lookup.flag_members(n.atoms.join(category, key), acting, [*key, "atom_name"], "interacts")
    return rows.withColumn("interactor", F.when(F.col("interacts"), "interactor").otherwise("non-interactor"))


def residues_of_interest(atoms: DataFrame, numbers: Sequence[int], cofactors: Sequence[str] = ("HM1",), alternatives: Sequence[str] = ()) -> DataFrame:
    """Cofactor atoms by trimmed name, and the atoms of the residues one above each number, in all chains."""
    names = [n.strip().upper() for n in (*cofactors, *alternatives)]
    core = F.upper(F.trim("resname")).isin(*names)
    chosen = F.coalesce(F.col("resnum").isin(*[n + 1 for n in numbers]), F.lit(False))
    return atoms.where(core | chosen).withColumn("group", F.when(core, "cofactor").otherwise("residue"))


def bonds(atoms: DataFrame) -> DataFrame:
    """Bonds of every residue as pairs of named points, for viewers."""
    folded = atoms.withColumns({"resname": F.upper(F.trim("resname")), "atom_name": F.upper(F.trim("atom_name"))})
    return residues.bond_pairs(folded, chemistry.bond_table(atoms.sparkSession), ["structure_id", "resnum", "chain"], "atom_name", "resname", ["ordinal"])


def cube(query: DataFrame, template: DataFrame, cutoff: float) -> DataFrame:
    """CA and CB atoms of ``query`` in the cube about the origin that holds the template's (its atoms where it has
    none of these) with ``cutoff`` to spare."""
    widest = F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z")))
    traced = F.col("atom_name").isin("CA", "CB")
    limit = template.agg(F.coalesce(F.max(F.when(traced, F.greatest(F.abs("x"), F.abs("y"), F.abs("z")))), widest).alias("__w"))  # one row
    rows = query.where(traced).crossJoin(F.broadcast(limit))
    return rows.where(F.greatest(F.abs("x"), F.abs("y"), F.abs("z")) <= F.col("__w") + cutoff).drop("__w")
