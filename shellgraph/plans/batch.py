"""Batches of predicted models: find runs, take each one's best sample, compare all in one job, report.

Rows are keyed by the run's full path, so reruns replace what they reported before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, structures
from . import compare


def run_batch(spark: SparkSession, root: str, template: DataFrame, network: DataFrame, prefix: str = "batch", cutoff: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(manifest, summary) of all runs below ``root``.

    manifest: run_dir, job_name, seed, sample, ranking_score, model_path, status (ok, skipped, failed), message, the
    confidence figures, total, matched, percent (null where nothing was counted), rmsd. A run without valid ranking
    rows or without its model file is skipped; one whose model can't be fitted has failed. summary: the ok runs.
    """
    found = files.best_samples(spark, root)
    if found.isEmpty():
        raise ValueError(f"no ranking tables below {root}")
    located = files.confidences(spark, root, files.locate_models(spark, root, found))
    run = F.regexp_extract("run_dir", r"([^/]+)$", 1)
    jobs = located.withColumn("job_name", F.concat(F.lit(f"{prefix}__"), run, F.lit("__seed"), F.col("seed"), F.lit("_sample"), F.col("sample")))
    # one path per run, for Spark's readers; their contents are read in one job
    paths = [r[0] for r in jobs.where("model_path is not null").select("model_path").distinct().collect()]
    status = F.when(F.col("seed").isNull(), "skipped").when(F.col("model_path").isNull(), "skipped")
    message = F.when(F.col("seed").isNull(), "No valid rows in ranking_scores.csv").when(F.col("model_path").isNull(), F.concat(F.lit("Model file not found for seed "), F.col("seed"), F.lit(" sample "), F.col("sample")))
    if paths:
        path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
        atoms = read_models(spark, paths, path)
        c = compare.compare(template, network, atoms, cutoff)
        over = c.rates.where("category is null").select(F.col("job_name").alias("model_path"), "total", "matched", F.expr("try_divide(matched * 100.0D, cast(total as double))").alias("percent"))
        measured = c.fits.select(F.col("structure_id").alias("model_path"), "rmsd").join(over, "model_path", "left")
        jobs = jobs.join(measured, "model_path", "left")
    else:
        jobs = jobs.withColumns({n: F.lit(None).cast("double") for n in ("rmsd", "total", "matched", "percent")})
    manifest = jobs.withColumn("status", F.coalesce(status, F.when(F.col("rmsd").isNull(), "failed").otherwise("ok")))
    manifest = manifest.withColumn("message", F.coalesce(message, F.when(F.col("rmsd").isNull(), "no three shared atoms")))
    manifest = manifest.select("run_dir", "job_name", "seed", "sample", "ranking_score", "model_path", "status", "message", F.col("confidence.iptm").alias("iptm"), F.col("confidence.ptm").alias("ptm"), F.col("confidence.fraction_disordered").alias("fraction_disordered"), F.col("confidence.has_clash").alias("has_clash"), "total", "matched", "percent", "rmsd")
    return manifest, manifest.where("status = 'ok'").select("run_dir", "job_name", "seed", "sample", "ranking_score", "iptm", "ptm", "matched", "total", "percent", "rmsd")


def read_models(spark: SparkSession, paths: list[str], path) -> DataFrame:
    """mmCIF models keyed by their path, since all are called alike."""
    text = spark.read.text(paths, wholetext=True).select(path.alias("structure_id"), "value")
    return structures.parse_mmcif(text)


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"))
