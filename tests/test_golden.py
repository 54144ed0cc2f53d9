"""Parity with known results on an excerpt of PDB entry 4UB6: the residues around its metal cluster."""

import csv
import os
import shutil

import pytest
from pyspark.sql import functions as F

from shellgraph.plans import compare, dedup, network
from shellgraph.sources import reports, structures

DATA = os.path.join(os.path.dirname(__file__), "data")
PDB = f"{DATA}/site.pdb"


@pytest.fixture(scope="module")
def atoms(spark):
    return structures.read_pdb(spark, PDB).cache()


@pytest.fixture(scope="module")
def net(atoms):
    return network.coordination_network(atoms, network.Settings(("OEX",)))


def rows(path):
    with open(path, newline="") as f:
        return list(csv.reader(f))


def test_scan(spark, atoms):
    with open(PDB) as f:
        lines = [x for x in f if x.startswith(("ATOM", "HETATM"))]
    assert structures.read_pdb(spark, PDB, altloc=False).count() == len(lines)
    assert atoms.count() == len({(x[12:16], x[17:27]) for x in lines}) < len(lines)


def test_links(net):
    want = rows(f"{DATA}/site_links.csv")[1:]
    got = net.edges.collect()
    as_row = lambda r: [r.link_type, r.src_resname, str(r.src_resnum), r.src_chain, r.src_atom, r.src_moiety, r.dst_resname, str(r.dst_resnum), r.dst_chain, r.dst_atom, r.dst_moiety, f"{r.distance_A:.3f}"]
    assert sorted(map(as_row, got)) == sorted(want)


def test_residues(net):
    want = [r for r in rows(f"{DATA}/site_residues.csv")[1:32]]
    got = {(r.category, r.resname, str(r.resnum), r.chain): (r.moiety, r.interactors) for r in network.residue_report(net).collect()}
    assert len(got) == len(want)
    for category, name, number, chain, moiety, heard in want:
        m, i = got[category, name, number, chain]
        assert m == moiety
        # names come sorted here and there; compare them as sets of words
        assert set(filter(None, i.split(", "))) == set(filter(None, heard.split(", "))), (name, number)


def test_atoms(net):
    want = sorted(r[:7] + [float(x) for x in r[7:]] for r in rows(f"{DATA}/site_atoms.csv")[1:])
    got = sorted([r.category, r.atom_name, r.resname, str(r.resnum), r.chain, r.moiety, r.interactor, r.x, r.y, r.z] for r in network.atom_report(net).collect())
    assert got == want
    section = sorted([r[0], r[1], r[2], r[3], r[4], *map(float, r[5:])] for r in rows(f"{DATA}/site_residues.csv")[34:])
    assert sorted([r.category, r.resname, str(r.resnum), r.chain, r.atom_name, r.x, r.y, r.z] for r in network.residue_atoms(net).collect()) == section


def test_read_back_and_self_match(spark, atoms):
    residues, listed = reports.read_breakdown(spark, f"{DATA}/site_residues.csv")
    assert (residues.count(), listed.count()) == (31, 156)
    net_atoms = reports.read_network_atoms(spark, f"{DATA}/site_atoms.csv")
    c = compare.compare(listed, net_atoms, atoms)
    assert c.fits.first()["rmsd"] < 1e-6
    dry = c.matches.where(~F.col("template_residue").isin("HOH"))
    assert c.matches.count() == 156 and dry.where("matched_within_cutoff = 'N'").count() == 0
    assert dry.where("distance_A > 1e-5").count() == 0


def test_mmcif(spark):
    cif = structures.read_mmcif(spark, f"{DATA}/site.cif", altloc=False)
    assert cif.count() == 12
    cu = cif.where("resname = 'CU'").first()
    assert (cu.chain, cu.resnum, cu.element, cu.structure_id) == ("A", 200, "CU", "site")


def test_batch_of_structures(spark, net, tmp_path):
    for i in range(4):
        shutil.copy(PDB, tmp_path / f"copy{i}.pdb.pdb")
    many = structures.read_pdb(spark, f"{tmp_path}/*.pdb")
    found = {}
    for strategy in ("grid", "broadcast"):
        edges = network.coordination_network(many, network.Settings(("OEX",), strategy=strategy)).edges.collect()
        found[strategy] = sorted(map(str, edges))
        assert {r.structure_id for r in edges} == {f"copy{i}" for i in range(4)}
    assert found["grid"] == found["broadcast"] and len(found["grid"]) == 4 * net.edges.count()
    assert dedup.keep_chains(many).count() == many.select("structure_id", "chain").distinct().count()
