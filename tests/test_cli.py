"""The command line on the example structure, each command in the session at hand."""

import csv
import glob
import os


from shellgraph import cli
from shellgraph.plans import network, views
from shellgraph.sources import reports, structures

DATA = os.path.join(os.path.dirname(__file__), "data")
PDB, OUT, ATOMS = f"{DATA}/site.pdb", f"{DATA}/site_residues.csv", f"{DATA}/site_atoms.csv"


def table(folder):
    rows = []
    for f in sorted(glob.glob(f"{folder}/**/*.csv", recursive=True)):
        with open(f, newline="") as h:
            rows += list(csv.DictReader(h))
    return rows


def test_network(spark, tmp_path):
    cli.main(["network", "--template", PDB, "--cofactor", "OEX", "--outdir", str(tmp_path / "o")])
    assert (len(table(tmp_path / "o/links")), len(table(tmp_path / "o/residues")), len(table(tmp_path / "o/atoms"))) == (37, 31, 156)


def test_compare(spark, tmp_path):
    cli.main(["compare", "--template-csv", OUT, "--template-atoms-csv", ATOMS, "--query-structure", PDB, "--job-name", "self", "--outdir", str(tmp_path)])
    assert len(table(tmp_path / "self/network_match")) == 156 and "## By Category" in (tmp_path / "self/site_results.md").read_text()


def test_dedup(spark, tmp_path):
    cli.main(["dedup", PDB, "--outdir", str(tmp_path), "--yes"])
    back = structures.read_pdb(spark, str(tmp_path / "site_dedup.pdb"))
    before = structures.read_pdb(spark, PDB)
    assert back.count() == before.count() and sorted(map(str, back.select("chain", "resnum", "atom_name", "x", "y", "z").collect())) == sorted(map(str, before.select("chain", "resnum", "atom_name", "x", "y", "z").collect()))


def test_dedup_of_files_called_alike(spark, tmp_path):
    lines = open(PDB).read().splitlines(keepends=True)
    for folder, keep in (("a", lines), ("b", [x for x in lines if not x.startswith("HETATM")])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "m.pdb").write_text("".join(keep))
    cli.main(["dedup", str(tmp_path), "--outdir", str(tmp_path), "--yes"])
    sizes = [structures.read_pdb(spark, str(tmp_path / n)).count() for n in ("m_dedup.pdb", "m_dedup(1).pdb")]
    assert sizes[0] == structures.read_pdb(spark, PDB).count() > sizes[1] > 0
    assert (tmp_path / "m_dedup.pdb").read_text().splitlines()[-1] == "END" and not glob.glob(str(tmp_path / ".dedup-*"))
    both = structures.read_structures(spark, [str(tmp_path / f / "m.pdb") for f in "ab"])
    assert both.select("structure_id").distinct().count() == 2


def test_network_to_compare_to_batch(spark, tmp_path):
    """Each command on what the one before has written, nothing else."""
    cli.main(["network", "--template", PDB, "--cofactor", "OEX", "--outdir", str(tmp_path / "o")])
    template = str(tmp_path / "o/site.pdb_Coord_Breakdown.csv")
    assert open(template).readline().strip() == "Residue Category,Residue Name,Residue Number,Chain,Chemical Moiety,Interactors"
    for _ in range(2):
        cli.main(["compare", "--template-csv", template, "--query-structure", PDB, "--job-name", "self", "--outdir", str(tmp_path / "m")])
    report = table(tmp_path / "m/self/alignment_report")
    assert len(report) == 2 and report[0]["template_residue"] == "OEX" and float(report[0]["rmsd"]) < 1e-3  # appended to
    assert list(report[0]) == reports.FIT_COLUMNS
    (metrics,) = reports.read_job_metrics(spark, str(tmp_path / "m")).collect()
    assert (metrics.job_name, metrics.total, metrics.matched) == ("site", 156, sum(r["matched_within_cutoff"] == "Y" for r in table(tmp_path / "m/self/network_match"))) and metrics.rmsd < 1e-3
    run = tmp_path / "runs/r1"
    (run / "seed-1_sample-0").mkdir(parents=True)
    (run / "ranking_scores.csv").write_text("seed,sample,ranking_score\n1,0,0.9\n")
    cols = "group_PDB id type_symbol label_atom_id label_alt_id label_comp_id auth_asym_id auth_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z occupancy pdbx_PDB_model_num auth_atom_id auth_comp_id".split()
    rows = structures.read_pdb(spark, PDB).orderBy("ordinal").collect()
    body = "".join(f"{'ATOM' if r.hetflag == ' ' else 'HETATM'} {i} {r.element} {r.atom_name} . {r.resname} {r.chain} {r.resnum} ? {r.x} {r.y} {r.z} 1.0 1 {r.atom_name} {r.resname}\n" for i, r in enumerate(rows))
    (run / "seed-1_sample-0/model.cif").write_text("data_x\nloop_\n" + "".join(f"_atom_site.{c}\n" for c in cols) + body + "#\n")
    cli.main(["batch", "--template-csv", template, "--root", str(tmp_path / "runs"), "--outdir", str(tmp_path / "b")])
    (row,) = table(tmp_path / "b/manifest")
    assert row["status"] == "ok" and float(row["rmsd"]) < 1e-3 and row["total"] == "156"


def test_evaluate(spark, tmp_path):
    """A template against all structures whose names fit a pattern."""
    for n in ("a.pdb", "b.pdb", "other.pdb"):
        (tmp_path / n).write_text(open(PDB).read())
    cli.main(["evaluate", "--template", PDB, "--pattern", f"{tmp_path}/[ab].pdb", "--cutoff", "1.0", "--outdir", str(tmp_path / "e")])
    rows = table(tmp_path / "e/evaluation")
    assert [r["Query_File"] for r in rows] == ["a", "b"] and all(r["misses"] == "0" and int(r["matches"]) > 0 for r in rows)


def test_names_file(spark, tmp_path):
    cli.main(["compare", "--template-csv", OUT, "--template-atoms-csv", ATOMS, "--query-structure", PDB, "--job-name", "n", "--outdir", str(tmp_path / "m"), "--write-names", str(tmp_path / "names.txt")])
    from shellgraph.plans import compare
    from shellgraph.sources import files

    assert files.read_synonyms(spark, str(tmp_path / "names.txt")) == (compare.RESIDUE_NAMES, compare.ATOM_NAMES)


def test_views(spark):
    n = network.coordination_network(structures.read_pdb(spark, PDB), network.Settings(("OEX",)))
    assert views.markers(n).count() == 156 and views.markers(n).where("interacts").count() == 47
    drawn, missed = views.links(n)
    assert (drawn.count(), missed.count()) == (37, 0)
    assert views.bonds(n).where("resname = 'OEX'").count() == 15
    assert views.conserved(n, [170]).where("conserved").select("resnum").distinct().collect()[0][0] == 170
    assert views.cube_matches(n.atoms, n.atoms, 1.0).first().percent == 100.0
