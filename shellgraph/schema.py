"""Schemas of the data model: atoms as rows, dimensions, and the reports made from them."""

from __future__ import annotations

ATOM = (
    "structure_id string, model int, chain string, hetflag string, resname string, resnum int, icode string, "
    "atom_name string, altloc string, element string, x double, y double, z double, occupancy double, ordinal long"
)
#: A residue, as every report names it. ``icode`` joins the key where insertion codes matter.
RESIDUE = ["structure_id", "resname", "resnum", "chain"]
ATOM_KEY = [*RESIDUE, "atom_name"]
MOIETY = "resname string, atom_name string, moiety string"
POLICY = "resname string, moiety string, k int"
BOND_RULE = "resname string, a1 string, a2 string"
EDGE = [
    "link_type", "src_resname", "src_resnum", "src_chain", "src_atom", "src_moiety",
    "dst_resname", "dst_resnum", "dst_chain", "dst_atom", "dst_moiety", "distance_A",
]
