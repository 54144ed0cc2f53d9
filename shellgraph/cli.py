"""Command line: ``python -m shellgraph network|compare|batch|evaluate|dedup``.

Every command takes many structures at once where the job allows it; reports go to folders by structure.
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import batch, compare, dedup, network
from .sources import datasource, files, ledger, reports, structures


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shellgraph")
    sub = p.add_subparsers(dest="command", required=True)
    n = sub.add_parser("network", help="coordination network of structures")
    n.add_argument("--template", required=True)
    n.add_argument("--cofactor", nargs="*")
    n.add_argument("--cofactor2", nargs="*")
    n.add_argument("--distance", type=float)
    n.add_argument("--expand-residues", action=argparse.BooleanOptionalAction)
    n.add_argument("--combinatorial", action=argparse.BooleanOptionalAction)
    n.add_argument("--combinatorial-cutoff", type=float)
    n.add_argument("--exclude-moieties", nargs="*")
    n.add_argument("--mode", choices=["Coord_Network", "Residues_of_Interest"])
    n.add_argument("--residues-of-interest", type=int, nargs="*")
    n.add_argument("--config", help="settings file; else network.yaml or network.json beside the template")
    n.add_argument("--outdir", default="network_output")
    c = sub.add_parser("compare", help="match a template network to structures")
    b = sub.add_parser("batch", help="match a template network to all predicted runs below a folder")
    for q in (c, b):
        q.add_argument("--template-csv", required=True)
        q.add_argument("--template-atoms-csv")
        q.add_argument("--match-cutoff", type=float, default=2.0)
        q.add_argument("--names", help="file of interchangeable residue and atom names")
        q.add_argument("--outdir", default="matches")
    c.add_argument("--query-structure", required=True, nargs="+")
    c.add_argument("--job-name", required=True)
    c.add_argument("--write-names", help="write the names used to this file, if there is none")
    e = sub.add_parser("evaluate", help="count a template's CA atoms that structures have nearby")
    e.add_argument("--template", required=True)
    e.add_argument("--pattern", required=True, help="file, folder or pattern of structures")
    e.add_argument("--cutoff", type=float, default=1.0)
    e.add_argument("--outdir", default="evaluation")
    b.add_argument("--root", "--af3-root", dest="root", required=True)
    b.add_argument("--job-prefix", default="batch")
    d = sub.add_parser("dedup", help="remove duplicate chains")
    d.add_argument("path")
    d.add_argument("--by", choices=["sequence", "coords"], default="sequence")
    d.add_argument("--outdir")
    d.add_argument("--yes", action="store_true")
    d.add_argument("--dry-run", action="store_true")
    d.add_argument("--mask-res", nargs="*", default=[])
    d.add_argument("--mask-mode", choices=["all", "any"], default="all")
    return p


def run_network(spark: SparkSession, a: argparse.Namespace) -> None:
    path = files.resolve(a.template)
    options = {"cofactor_resname": a.cofactor, "cofactor_resname2": a.cofactor2, "distance_cutoff": a.distance, "expand_residues": a.expand_residues, "combinatorial": a.combinatorial, "combinatorial_cofactor_cutoff": a.combinatorial_cutoff, "exclude_moieties": a.exclude_moieties}
    side = files.sidecar(os.path.dirname(a.config), [os.path.basename(a.config)]) if a.config else files.sidecar(os.path.dirname(path))
    s = network.Settings.from_options(side, options)
    atoms = structures.read_structures(spark, [path])
    if (a.mode or side.get("mode")) == "Residues_of_Interest":
        numbers = a.residues_of_interest or side.get("residues_of_interest_integers") or []
        core = side.get("roi_cofactor_resname") or ["HM1"]
        reports.save_csv(network.residues_of_interest(atoms, numbers, [core] if isinstance(core, str) else core).orderBy("structure_id", "ordinal"), f"{a.outdir}/residues_of_interest")
        return
    if not s.cofactors:
        raise SystemExit("--cofactor is needed")
    n = network.coordination_network(atoms.persist(), s)
    reports.save_csv(n.edges, f"{a.outdir}/links")
    by_residue = ["order", "chain", "resnum", "resname"]
    report = network.residue_report(n).persist()
    own = network.residue_atoms(n).persist()
    stem = f"{a.outdir}/{os.path.basename(path)}_Coord_Breakdown"
    # one template, so one structure
    reports.save_breakdown(spark, f"{stem}.csv", report.orderBy(*by_residue).select("category", "resname", "resnum", "chain", "moiety", "interactors"), own.orderBy("ordinal").select("category", "resname", "resnum", "chain", "atom_name", "x", "y", "z"))
    atoms_csv = network.atom_report(n).orderBy("ordinal").select("category", "atom_name", "resname", "resnum", "chain", "moiety", "interactor", "x", "y", "z").toDF(*reports.ATOM_COLUMNS)
    reports.write_text(spark, files.atoms_path(f"{stem}.csv"), reports.csv_text(atoms_csv))
    reports.save_csv(report.select(F.col("category").alias("Residue Category"), F.col("resname").alias("Residue Name"), F.col("resnum").alias("Residue Number"), F.col("chain").alias("Chain"), F.col("moiety").alias("Chemical Moiety"), F.col("interactors").alias("Interactors"), "structure_id"), f"{a.outdir}/residues")
    reports.save_csv(network.atom_report(n).orderBy("structure_id", "ordinal").select(F.col("category").alias("Category"), F.col("atom_name").alias("Atom"), F.col("resname").alias("Residue"), F.col("resnum").alias("Residue Number"), F.col("chain").alias("Chain"), F.col("moiety").alias("Moiety"), F.col("interactor").alias("InteractorFlag"), "x", "y", "z", "structure_id"), f"{a.outdir}/atoms")


def _template(spark: SparkSession, a: argparse.Namespace):
    _, listed = reports.read_breakdown(spark, a.template_csv)
    return listed, reports.read_network_atoms(spark, a.template_atoms_csv or files.atoms_path(a.template_csv))


def run_compare(spark: SparkSession, a: argparse.Namespace) -> None:
    listed, net = _template(spark, a)
    names = files.read_synonyms(spark, a.names) if a.names else (compare.RESIDUE_NAMES, compare.ATOM_NAMES)
    c = compare.compare(listed, net, structures.read_structures(spark, [files.resolve(q) for q in a.query_structure]), a.match_cutoff, *names)
    if a.write_names:
        files.write_synonyms(a.write_names, *names)
    out = f"{a.outdir}/{a.job_name}"
    matches = c.matches.persist()
    if matches.isEmpty():
        raise SystemExit("fewer than three shared atoms")
    reports.save_csv(matches.orderBy("job_name", "ordinal").drop("ordinal"), f"{out}/network_match")
    flat = lambda d: d.withColumns({k: F.concat_ws(":", f"{k}.residue", F.col(f"{k}.resnum").cast("string"), f"{k}.chain") for k in ("template_centre", "query_centre")})
    reports.save_csv(flat(c.matrix).orderBy("structure_id", "atom"), f"{out}/alignment_matrix")
    ledger.append(compare.fit_report(c), f"{out}/alignment_report")
    jobs = [r[0] for r in matches.select("job_name").distinct().sort("job_name").collect()]  # a page for each query file
    for job in jobs:
        text = reports.match_summary(job, c.rates.where(F.col("job_name") == job), matches.where((F.col("job_name") == job) & (F.col("matched_within_cutoff") == "N")).orderBy("ordinal"))
        reports.write_text(spark, f"{out}/{job.strip('/').replace('/', '_')}_results.md", text)


def run_batch(spark: SparkSession, a: argparse.Namespace) -> None:
    listed, net = _template(spark, a)
    manifest, summary = batch.run_batch(spark, a.root, listed, net, a.job_prefix, a.match_cutoff)
    # written once and read back, so that both tables come from one run of the comparison
    ledger.append(manifest.orderBy("run_dir"), f"{a.outdir}/manifest")
    done = ledger.latest(spark, f"{a.outdir}/manifest", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in manifest.schema), ["run_dir"])
    reports.save_csv(done.where("status = 'ok'").select(summary.columns).orderBy("run_dir"), f"{a.outdir}/summary")


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    paths = [p for p, _ in datasource.find_files(a.pattern)]
    template = structures.read_structures(spark, [files.resolve(a.template)])
    reports.save_evaluation(compare.evaluate_ca(template, structures.read_structures(spark, paths), a.cutoff), f"{a.outdir}/evaluation")


def run_dedup(spark: SparkSession, a: argparse.Namespace) -> None:
    paths = [os.path.abspath(a.path)] if os.path.isfile(a.path) else sorted(p for s in (*structures.PDB_SUFFIXES, *structures.CIF_SUFFIXES) for p in glob.glob(f"{os.path.abspath(a.path)}/**/*.{s}", recursive=True))
    atoms = structures.read_structures(spark, paths, strict=True).persist()
    options = {"by": a.by, "mask": [m.upper() for m in a.mask_res], "mode": a.mask_mode, "collapse": not a.yes}
    if a.dry_run:
        dedup.keep_chains(atoms, **options).orderBy("structure_id", "chain").show(1000, False)
        return
    name = structures.naming(paths)
    ids = {p: r[0] for p, r in zip(paths, spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").sort("i").select(name(F.col("p"))).collect(), strict=True)}
    targets, taken = {}, set()
    for path in paths:
        folder, stem = a.outdir or os.path.dirname(path), os.path.basename(path).rsplit(".", 1)[0]
        targets[ids[path]] = reports.free_path(folder, stem, ".pdb", taken)
        taken.add(targets[ids[path]])
    reports.save_pdb(dedup.deduplicate(atoms, **options), targets, a.outdir or os.path.dirname(paths[0]))


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if getattr(a, "outdir", None):
        os.makedirs(a.outdir, exist_ok=True)
    spark = SparkSession.builder.appName("shellgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    {"network": run_network, "compare": run_compare, "batch": run_batch, "evaluate": run_evaluate, "dedup": run_dedup}[a.command](spark, a)


if __name__ == "__main__":
    main(sys.argv[1:])
