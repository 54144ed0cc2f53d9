"""Discovery of inputs: paths, predicted-model runs, their rankings, models and confidences, settings."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import topk

STRUCTURE_SUFFIXES = (".pdb", ".cif", ".mmcif")
#: The five confidence figures kept of a prediction.
CONFIDENCES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("iptm", "ptm", "ranking_score", "fraction_disordered")] + [T.StructField("has_clash", T.StringType())])


def resolve(path: str) -> str:
    """``path`` if it exists, else the same name with another structure suffix, gzipped or not; a bare id of
    four or five characters is looked for in the working directory. FileNotFoundError otherwise."""
    stem = path.removesuffix(".gz")
    stem = next((stem.removesuffix(s) for s in STRUCTURE_SUFFIXES if stem.endswith(s)), stem)
    tries = [path, *(stem + s + z for s in STRUCTURE_SUFFIXES for z in ("", ".gz"))]
    if os.sep not in path and len(stem) in (4, 5):
        tries += [os.path.join(os.getcwd(), t) for t in tries[1:]]
    for t in tries:
        if os.path.isfile(t):
            return t
    raise FileNotFoundError(path)


def atoms_path(template: str) -> str:
    """The atom table beside a template's residue table."""
    stem, dot, suffix = template.rpartition(".")
    return f"{stem}_atoms{dot}{suffix}" if dot else f"{template}_atoms"


def sidecar(folder: str, names: Sequence[str] = ("network.yaml", "network.json")) -> dict:
    """Settings in the first readable of the named YAML (if PyYAML is there) or JSON files; none: empty."""
    for name in names:
        try:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                if name.endswith(".json"):
                    return json.load(f)
                import yaml

                return yaml.safe_load(f) or {}
        except (OSError, ImportError, ValueError):
            continue
    return {}


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path) of files below ``root``; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")


def _folder(path):
    return F.regexp_replace(path, r"/[^/]+$", "")


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_dir): the folders that hold a ranking table, also an empty one."""
    return list_files(spark, root, "ranking_scores.csv").select(_folder(F.col("path")).alias("run_dir")).distinct()


def rankings(spark: SparkSession, root: str) -> DataFrame:
    """(run_dir, seed, sample, ranking_score, ordinal) of all ranking tables below ``root``. Rows without seed,
    sample or a numeric score are left out."""
    rows = spark.read.schema("seed string, sample string, ranking_score string").option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "ranking_scores.csv").option("enforceSchema", "false").csv(root)
    rows = rows.select(_folder(F.col("_metadata.file_path")).alias("run_dir"), F.trim("seed").alias("seed"), F.trim("sample").alias("sample"), F.expr("try_cast(ranking_score as double)").alias("ranking_score"), F.monotonically_increasing_id().alias("ordinal"))
    return rows.where("seed <> '' and sample <> '' and ranking_score is not null")


def best_samples(spark: SparkSession, root: str) -> DataFrame:
    """(run_dir, seed, sample, ranking_score): each run's best sample, the first of equal ones; nulls for a run
    without valid rows. NaN is never the best."""
    best = topk.argmax(rankings(spark, root).withColumn("s", F.struct("seed", "sample", "ranking_score")), ["run_dir"], "s", F.col("ranking_score"), [F.col("ordinal")], "best")
    runs = discover_runs(spark, root).withColumn("run_dir", F.regexp_replace("run_dir", "^file:/+", "/"))
    return runs.join(best.withColumn("run_dir", F.regexp_replace("run_dir", "^file:/+", "/")), "run_dir", "left").select("run_dir", "best.*")


def locate_models(spark: SparkSession, root: str, samples: DataFrame) -> DataFrame:
    """``samples(run_dir, seed, sample)`` with ``model_path``: the direct path ``seed-<s>_sample-<n>/model.cif`` if it
    exists, else the one ``scores.csv`` names for that folder, if that exists; else null."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    have = list_files(spark, root, "*.cif").select(plain(F.col("path")).alias("path"))
    listed = spark.read.schema("sample_dir string, model_relpath string").option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "scores.csv").option("enforceSchema", "false").csv(root)
    listed = listed.select(_folder(plain(F.col("_metadata.file_path"))).alias("run_dir"), "sample_dir", "model_relpath", F.monotonically_increasing_id().alias("line"))
    name = F.concat(F.lit("seed-"), F.col("seed"), F.lit("_sample-"), F.col("sample"))
    first = F.struct(~F.coalesce("h2", F.lit(False)), "line")  # of several rows the first whose file is there
    listed = listed.withColumn("p2", F.concat_ws("/", "run_dir", F.col("model_relpath"))).where("model_relpath is not null")
    listed = listed.join(have.select(F.col("path").alias("p2"), F.lit(True).alias("h2")), "p2", "left")
    listed = listed.groupBy("run_dir", "sample_dir").agg(F.min_by(F.when(F.col("h2"), F.col("p2")), first).alias("other"))
    rows = samples.withColumn("sample_dir", name).join(listed, ["run_dir", "sample_dir"], "left")
    rows = rows.withColumn("p1", F.concat_ws("/", "run_dir", "sample_dir", F.lit("model.cif")))
    rows = rows.join(have.select(F.col("path").alias("p1"), F.lit(True).alias("h1")), "p1", "left")
    return rows.withColumn("model_path", F.when(F.col("h1"), F.col("p1")).otherwise(F.col("other"))).drop("p1", "h1", "other", "sample_dir")


def confidences(spark: SparkSession, root: str, samples: DataFrame) -> DataFrame:
    """``samples`` with the five figures of the sample's own ``summary_confidences.json``, else of the run's
    ``<run>_summary_confidences.json``, whichever is there first and holds a JSON object; other files of such names don't
    count. Figures that a file lacks are null."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*summary_confidences.json").text(root, wholetext=True)
    rows = rows.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("__p"), F.from_json("value", CONFIDENCES).alias("c"), "value")
    readable = F.expr("try_parse_json(value)")
    rows = rows.where(F.schema_of_variant(readable).startswith("OBJECT")).drop("value")
    sample = F.concat(F.lit("seed-"), F.col("seed"), F.lit("_sample-"), F.col("sample"))
    run = F.regexp_extract("run_dir", r"([^/]+)$", 1)
    out = samples.withColumns({"__own": F.concat_ws("/", "run_dir", sample, F.lit("summary_confidences.json")), "__all": F.concat(F.col("run_dir"), F.lit("/"), run, F.lit("_summary_confidences.json"))})
    for name, found in (("__own", "__c1"), ("__all", "__c2")):
        out = out.join(rows.withColumnsRenamed({"__p": name, "c": found}), name, "left")
    return out.withColumn("confidence", F.coalesce("__c1", "__c2")).drop("__own", "__all", "__c1", "__c2")


def read_synonyms(spark: SparkSession, path: str) -> tuple[list[list[str]], list[list[str]]]:
    """(residue groups, atom groups) of a names file: sections in brackets, a group a line, ``#`` starts a comment.
    A small settings file; an empty section is an error."""
    found: dict[str, list[list[str]]] = {"[residuenames]": [], "[atomnames]": []}
    section = ""
    for (line,) in spark.read.text(path).collect():
        words = line.partition("#")[0].split()
        if words and words[0].startswith("["):
            section = words[0].lower()
        elif words and section in found:
            found[section].append(words)
    if not all(found.values()):
        raise ValueError(f"{path} lacks residue or atom names")
    return found["[residuenames]"], found["[atomnames]"]


def write_synonyms(path: str, residues: Sequence[Sequence[str]], atoms: Sequence[Sequence[str]]) -> None:
    """The same file; an existing one is the user's and stays."""
    if not os.path.exists(path):
        with open(path, "w", encoding="utf-8") as f:
            f.write("\n".join(["[ResidueNames]", *map(" ".join, residues), "", "[AtomNames]", *map(" ".join, atoms), ""]))
