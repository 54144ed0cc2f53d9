"""The data sources: equal to the line readers, filters taken over, and files that appear together or not at all."""

import gzip
import os
import shutil

import pytest
from pyspark.sql import functions as F

from shellgraph.sources import datasource, structures

DATA = os.path.join(os.path.dirname(__file__), "data")


@pytest.fixture(scope="module")
def source(spark):
    datasource.register(spark)
    return spark.read.format("structure")


@pytest.fixture
def folder(tmp_path):
    for n in ("site.pdb", "site.cif"):
        os.makedirs(tmp_path / "in" / n[-3:], exist_ok=True)
        shutil.copy(f"{DATA}/{n}", tmp_path / "in" / n[-3:] / n)
    with open(f"{DATA}/site.pdb", "rb") as f, gzip.open(tmp_path / "in" / "packed.pdb.gz", "wb") as g:
        g.write(f.read())
    two = "HEADER\nMODEL        2\nATOM      1  CA AALA A   1       1.000   2.000   3.000  0.40\nATOM      2  CA BALA A   1       4.000   5.000   6.000  0.60           C\nENDMDL\r\nMODEL     \nHETATM    3  O   HOH B  -1A      0.000   0.000  bad    \nHETATM    4  O   HOH B  -1A      0.125   0.000  -1.000\n"
    (tmp_path / "in" / "two.pdb").write_text(two)
    (tmp_path / "in" / "notes.txt").write_text("no structure")
    return f"{tmp_path}/in"


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("altloc", [True, False])
def test_equal_to_the_line_reader(spark, source, folder, altloc):
    pdb = [f"{folder}/pdb/site.pdb", f"{folder}/packed.pdb.gz", f"{folder}/two.pdb"]
    want = structures.read_pdb(spark, pdb, altloc).unionByName(structures.read_mmcif(spark, f"{folder}/cif/site.cif", altloc))
    got = spark.read.format("structure").option("altloc", str(altloc).lower()).load(folder)
    assert got.dtypes == want.dtypes and rows(got) == rows(want) and got.count() > 1000
    assert rows(source.load(f"file://{folder}/*.pdb")) == rows(structures.read_pdb(spark, pdb[2]))


def test_filters_are_taken_over(spark, source, folder):
    every = source.load(folder)
    asked = (F.col("chain") == "A") & F.col("element").isin("O", "N") & (F.col("structure_id") == "site") & (F.col("x") > 0)
    got = every.where(asked)
    plan = got._jdf.queryExecution().executedPlan().toString()
    kept = plan[plan.index("Filter") :].splitlines()[0]
    assert "x#" in kept and "element" not in kept and "structure_id#" not in kept.replace("isnotnull(structure_id", "")
    held = spark.createDataFrame(every.collect(), every.schema)
    assert rows(got) == rows(held.where(asked)) and 0 < got.count()
    reader = datasource.StructureReader({"path": folder})
    list(reader.pushFilters([datasource.EqualTo(("structure_id",), "two")]))
    assert [p.files for p in reader.partitions()] == [[f"{folder}/two.pdb"]]
    assert source.load(folder).where("structure_id = 'none'").count() == 0


def test_nothing_there(source, tmp_path):
    with pytest.raises(Exception, match="FileNotFoundError"):
        source.load(f"{tmp_path}/missing.pdb").collect()


def test_line_files_appear_together(spark, source, tmp_path):
    lines = spark.range(3000).selectExpr(f"concat('{tmp_path}/f', id % 7) as path", "id as ordinal", "cast(id as string) as value")
    write = lambda df: df.write.format("line_files").mode("append").option("path", str(tmp_path)).save()
    write(lines.repartition(4, "path").sortWithinPartitions("path", "ordinal"))
    assert sorted(os.listdir(tmp_path)) == [f"f{k}" for k in range(7)]
    assert open(tmp_path / "f3").read().split() == [str(i) for i in range(3, 3000, 7)]
    other = lines.withColumn("path", F.concat("path", F.lit(".new")))
    broken = other.repartition(4, "path").sortWithinPartitions("path", "ordinal").withColumn("value", F.when(F.col("ordinal") == 2999, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        write(broken)
    with pytest.raises(Exception, match="several tasks|not in a row"):
        write(other.repartition(3))
    assert sorted(os.listdir(tmp_path)) == [f"f{k}" for k in range(7)]
