"""Report files: sectioned and plain CSV in, CSV, Markdown and PDB out."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import datasource, ledger

# The headings of the report files.
RESIDUE_COLUMNS = ["Residue Category", "Residue Name", "Residue Number", "Chain", "Chemical Moiety", "Interactors"]
RESIDUE_ATOM_COLUMNS = ["Residue Category", "Residue Name", "Residue Number", "Chain", "Atom", "x", "y", "z"]
ATOM_COLUMNS = ["Category", "Atom", "Residue", "Residue Number", "Chain", "Moiety", "InteractorFlag", "x", "y", "z"]
FIT_COLUMNS = ["job_name", "template_residue", "template_resnum", "template_chain", "query_residue", "query_resnum", "query_chain", "n_atoms", "atoms_used", "rmsd"]


def read_breakdown(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(residues, atoms) of a breakdown table with two sections, each with its own header line.

    The first line whose first cell is ``Residue Category`` starts the residue section; the first such line
    with an ``Atom`` cell the atom section (the same line, in a table that has only atoms). Atom rows too short
    or without numeric coordinates are skipped. ``ordinal`` is the line's number. A file without such a header
    is an error when it is read."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).where("trim(line) <> ''")
    cells = text.select(F.col("n").cast("long").alias("ordinal"), F.from_csv("line", F.lit(", ".join(f"c{i} string" for i in range(8)))).alias("c"), "line")
    head = F.col("c.c0") == "Residue Category"
    kind = F.when(head & F.array_contains(F.split("line", ","), "Atom"), "atoms").when(head, "residues")
    rows = cells.withColumn("kind", kind).withColumn("section", F.last("kind", True).over(W.orderBy("ordinal")))  # one small file
    rows = rows.where("kind is null and section is not null")
    if rows.isEmpty() and cells.where(head).isEmpty():
        raise ValueError(f"{path} has no Residue Category header")
    name = lambda i: F.trim(F.col(f"c.c{i}"))
    residues = rows.where("section = 'residues'").select("ordinal", name(0).alias("category"), name(1).alias("resname"), name(2).cast("int").alias("resnum"), name(3).alias("chain"), name(4).alias("moiety"), name(5).alias("interactors"))
    xyz = [F.expr(f"try_cast(c.c{i} as double)").alias(n) for i, n in zip((5, 6, 7), "xyz", strict=True)]
    atoms = rows.where("section = 'atoms'").select("ordinal", name(0).alias("category"), name(1).alias("resname"), F.expr("try_cast(c.c2 as int)").alias("resnum"), name(3).alias("chain"), name(4).alias("atom_name"), *xyz)
    return residues, atoms.dropna(subset=["x", "y", "z"])


def read_network_atoms(spark: SparkSession, path: str) -> DataFrame:
    """The per-atom table of a network; atom and residue names in upper case. Missing columns are an error."""
    rows = spark.read.option("header", "true").csv(path)
    if missing := set(ATOM_COLUMNS) - set(rows.columns):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    rows = rows.withColumn("ordinal", F.monotonically_increasing_id())
    up = lambda c: F.upper(F.trim(c))
    xyz = [F.expr(f"try_cast({c} as double)").alias(c) for c in "xyz"]
    return rows.select("ordinal", F.col("Category").alias("category"), up("Residue").alias("resname"), F.col("Residue Number").alias("resnum"), F.col("Chain").alias("chain"), up("Atom").alias("atom_name"), F.col("Moiety").alias("moiety"), F.col("InteractorFlag").alias("interactor"), *xyz).dropna(subset=["x", "y", "z"])


def save_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV files with headers, also where there are no rows."""
    df.write.mode(mode).option("header", "true").csv(path)


def csv_text(*sections: DataFrame) -> str:
    """One text of small sorted tables, with headers and a blank line between sections: the legacy report form."""
    out = io.StringIO()
    w = csv.writer(out)
    for i, df in enumerate(sections):
        if i:
            w.writerow([])
        w.writerow(df.columns)
        w.writerows(["" if v is None else v for v in r] for r in df.toLocalIterator())
    return out.getvalue()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, in whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def save_breakdown(spark: SparkSession, path: str, residues: DataFrame, atoms: DataFrame) -> None:
    """The two-section table of one structure's network, as ``read_breakdown`` reads it. Its atoms are those of a few
    residues around a cofactor."""
    write_text(spark, path, csv_text(residues.toDF(*RESIDUE_COLUMNS), atoms.toDF(*RESIDUE_ATOM_COLUMNS)))


def save_evaluation(results: DataFrame, path: str) -> None:
    """The table of an evaluation by query structure, sorted by name."""
    save_csv(results.withColumnRenamed("structure_id", "Query_File").orderBy("Query_File"), path)


FITS = "job_name string, template_residue string, template_resnum string, template_chain string, query_residue string, query_resnum string, query_chain string, n_atoms long, atoms_used string, rmsd double"


def read_job_metrics(spark: SparkSession, outdir: str, strict_parity: bool = True) -> DataFrame:
    """(job_name, rmsd, matched, total, percent) of all comparisons below ``outdir``, from their alignment reports and
    match tables; what is missing is null. With parity the first report of a job counts, as reports are appended to;
    else the last, which belongs to the match table."""
    best = ledger.latest(spark, f"{outdir}/*/alignment_report", FITS, ["job_name"], first=strict_parity)
    pick = F.min_by if strict_parity else F.max_by
    fits = best.groupBy("job_name").agg(pick("rmsd", F.struct("rmsd")).alias("rmsd"))
    hits = spark.createDataFrame([], "job_name string, total long, matched long")
    if _glob(spark, f"{outdir}/*/network_match"):
        rows = spark.read.option("header", "true").option("recursiveFileLookup", "true").csv(f"{outdir}/*/network_match")
        hits = rows.groupBy("job_name").agg(F.count("*").alias("total"), F.count_if(F.upper("matched_within_cutoff") == "Y").alias("matched"))
    return fits.join(hits, "job_name", "full").select("job_name", "rmsd", "matched", "total", F.expr("try_divide(matched * 100.0D, cast(total as double))").alias("percent"))


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(f.getPath().toString() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or [])


def save_pdb(atoms: DataFrame, targets: dict[str, str], work: str) -> None:
    """The atoms of each structure as a PDB file at its path in ``targets``, one task's work each; a structure without
    atoms becomes an empty model. Files get their names when all are written, and none does where a task fails;
    ``work`` is a folder for temporary names."""
    spark = atoms.sparkSession
    datasource.register(spark)
    names = spark.createDataFrame(list(targets.items()), "structure_id string, path string")  # a row for each input file
    ends = names.select("path", F.lit((1 << 63) - 1).alias("ordinal"), F.lit("END").alias("value"))
    lines = pdb_lines(atoms).join(names, "structure_id").select("path", "ordinal", "value").unionByName(ends)
    lines.repartition("path").sortWithinPartitions("path", "ordinal").write.format("line_files").mode("append").option("path", work).save()


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """(structure_id, ordinal, value): atoms as 80-column PDB lines."""
    name = F.when(F.length("atom_name") < 4, F.concat(F.lit(" "), F.rpad("atom_name", 3, " "))).otherwise(F.substring("atom_name", 1, 4))
    record = F.when(F.col("hetflag") == " ", "ATOM  ").otherwise("HETATM")
    serial = F.row_number().over(W.partitionBy("structure_id").orderBy("ordinal"))
    line = F.format_string("%s%5d %s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s  ", record, serial % 100_000, name, F.rpad("altloc", 1, " "), F.substring("resname", 1, 3), F.substring(F.rpad("chain", 1, " "), 1, 1), "resnum", F.rpad("icode", 1, " "), "x", "y", "z", "occupancy", F.lit(0.0), F.substring("element", 1, 2))
    return atoms.select("structure_id", "ordinal", line.alias("value"))


def free_path(folder: str, stem: str, suffix: str, taken: Collection[str] = ()) -> str:
    """``<stem>_dedup<suffix>`` in ``folder``, numbered if it exists already or is ``taken``."""
    n, path = 0, os.path.join(folder, f"{stem}_dedup{suffix}")
    while os.path.exists(path) or path in taken:
        n += 1
        path = os.path.join(folder, f"{stem}_dedup({n}){suffix}")
    return path


def match_summary(job: str, rates: DataFrame, unmatched: DataFrame) -> str:
    """Markdown of one comparison: overall, by category, and the unmatched atoms. A report of one template."""
    rows = {r["category"]: r for r in rates.collect()}
    over = rows.pop(None, None)
    total, hit, pct = (over["total"], over["matched"], over["percent"]) if over else (0, 0, 0.0)
    out = [f"# Alignment Summary — {job}", "", "## Overall", f"- Matched {hit}/{total} network atoms ({pct:.1f}%).", "", "## By Category", "| Category | Matched / Total | Percent |", "| --- | --- | --- |"]
    out += [f"| {c} | {rows[c]['matched']} / {rows[c]['total']} | {rows[c]['percent']:.1f}% |" for c in sorted(rows)]
    out += ["", "## Unmatched template atoms (within cutoff = N)"]
    left = [f"- {r['template_chain']}:{r['template_residue']}{r['template_resnum']}:{r['template_atom']}" for r in unmatched.collect()]
    return "\n".join([*out, *(left or ["- None"])])
