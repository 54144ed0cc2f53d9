"""Report tables that are appended to and survive reruns.

A table is a folder with ``attempts/<id>`` of CSV files and ``commits/<number>-<id>.json``, written under a name that
isn't read and renamed when an attempt's files are complete. What no commit names is invisible: a writer that is lost
leaves nothing that is read. No writer touches another's files; writers at the same time may take one number, and then
count in the order of their ids. Rows of a key in several attempts are one row to ``latest``, that of the last attempt.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "number long, folder string"


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, pattern: str) -> bool:
    p, store = _store(spark, pattern)
    return bool(store.globStatus(p))


def append(df: DataFrame, path: str) -> int:
    """Add ``df`` as one attempt; its number. An attempt without rows counts too."""
    spark = df.sparkSession
    folder = uuid.uuid4().hex
    df.write.option("header", "true").csv(f"{path}/attempts/{folder}")
    number = 1 + (commits(spark, path).agg(F.max("number")).first()[0] or 0)
    final, store = _store(spark, f"{path}/commits/{number:09d}-{folder}.json")
    aside, _ = _store(spark, f"{path}/commits/{folder}.tmp")
    out = store.create(aside, False)
    out.write(bytearray(json.dumps({"number": number, "folder": folder}).encode("utf-8")))
    out.close()
    store.rename(aside, final)
    return number


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(number, folder, table): the committed attempts of the tables a path or pattern names."""
    if not _exists(spark, f"{path}/commits/*.json"):
        return spark.createDataFrame([], COMMIT + ", table string")
    rows = spark.read.schema(COMMIT).json(f"{path}/commits/*.json")
    return rows.select("number", "folder", _table("commits"))


def _table(part: str):
    return F.regexp_extract(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"), f"^(.*)/{part}/", 1).alias("table")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all committed attempts of the tables that ``path`` names, by the names of ``schema``, with number, folder
    and table."""
    fields = T.StructType.fromDDL(schema)
    if not _exists(spark, f"{path}/attempts/*"):
        return spark.createDataFrame([], f"{schema}, number long, folder string, table string")
    rows = spark.read.option("header", "true").option("enforceSchema", "false").schema(", ".join(f"`{f.name}` string" for f in fields)).csv(f"{path}/attempts/*")
    name = F.regexp_extract(F.col("_metadata.file_path"), "/attempts/([^/]+)/", 1).alias("folder")
    rows = rows.select("*", name, _table("attempts")).join(commits(spark, path), ["table", "folder"])
    return rows.select(*[F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) for f in fields], "number", "folder", "table")


def latest(spark: SparkSession, path: str, schema: str, keys: Sequence[str], first: bool = False) -> DataFrame:
    """Each key's row in the last attempt that has it (or in the ``first``), without number and table. Rows of one attempt
    with equal keys: the greatest of them."""
    rows = read(spark, path, schema)
    names = [f.name for f in T.StructType.fromDDL(schema)]
    by = F.struct("number", "folder", *names)
    best = F.min(by) if first else F.max(by)
    return rows.groupBy("table", *[F.col(k).alias(f"__{k}") for k in keys]).agg(best.alias("r")).select("r.*").select(*names)
