"""Report tables: reruns, lost writers, several writers."""

import os
import shutil
from concurrent.futures import ThreadPoolExecutor

from shellgraph.sources import ledger, reports

DDL = "job string, rmsd double"


def table(df):
    return sorted(map(tuple, df.collect()))


def test_reruns_give_one_row_a_run(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert ledger.read(spark, path, DDL).count() == 0 and ledger.commits(spark, path).count() == 0
    for k, rows in enumerate(([("a", 1.0), ("b", 2.0)], [("a", 3.0)], [("a", None), ("c", 5.5)], [])):
        assert ledger.append(spark.createDataFrame(rows, DDL), path) == k + 1
    assert table(ledger.latest(spark, path, DDL, ["job"])) == [("a", None), ("b", 2.0), ("c", 5.5)]
    assert table(ledger.latest(spark, path, DDL, ["job"], first=True)) == [("a", 1.0), ("b", 2.0), ("c", 5.5)]
    assert ledger.read(spark, path, DDL).count() == 5


def test_half_written_attempt_is_invisible(spark, tmp_path):
    path = f"{tmp_path}/t"
    ledger.append(spark.createDataFrame([("a", 1.0)], DDL), path)
    (done,) = os.listdir(f"{path}/attempts")
    shutil.copytree(f"{path}/attempts/{done}", f"{path}/attempts/lost")
    with open(f"{path}/commits/x.tmp", "w") as f:
        f.write('{"number": 2, "fol')
    assert table(ledger.read(spark, path, DDL).drop("table", "folder")) == [("a", 1.0, 1)]
    assert ledger.append(spark.createDataFrame([("a", 2.0)], DDL), path) == 2
    assert table(ledger.latest(spark, path, DDL, ["job"])) == [("a", 2.0)]


def test_several_writers(spark, tmp_path):
    path = f"{tmp_path}/t"
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: ledger.append(spark.createDataFrame([(f"j{k}", float(k))], DDL), path), range(8)))
    assert max(numbers) <= 8 and table(ledger.latest(spark, path, DDL, ["job"])) == [(f"j{k}", float(k)) for k in range(8)]


def test_metrics_of_reruns(spark, tmp_path):
    for rmsd in (0.5, 0.2):
        row = ("j", "OEX", "1", "A", "OEX", "1", "A", 4, "O1", rmsd)
        ledger.append(spark.createDataFrame([row], reports.FITS), f"{tmp_path}/j/alignment_report")
    spark.createDataFrame([("j", "Y"), ("j", "N")], "job_name string, matched_within_cutoff string").write.option("header", "true").csv(f"{tmp_path}/j/network_match")
    assert table(reports.read_job_metrics(spark, str(tmp_path))) == [("j", 0.5, 1, 2, 50.0)]
    assert table(reports.read_job_metrics(spark, str(tmp_path), strict_parity=False)) == [("j", 0.2, 1, 2, 50.0)]
