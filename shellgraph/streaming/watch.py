"""New model files as they arrive: each micro-batch is compared like a batch and appended, and totals are kept as state.

This wraps the batch plan for folders that grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..plans import compare
from ..sources import structures

SITE = r"(?im)^\s*_atom_site\.cartn_x\b"


def arriving(spark: SparkSession, folder: str, pattern: str = "*.cif") -> DataFrame:
    """(structure_id, value) of the files of ``folder`` as they come, each once."""
    text = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", pattern).load(folder)
    return text.select(structures.structure_id(F.col("_metadata.file_path")).alias("structure_id"), "value")


def watch(spark: SparkSession, folder: str, template: DataFrame, network: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, cutoff: float = 2.0, pattern: str = "*.cif", rejected: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Compare every new mmCIF file of ``folder``; ``sink(matches, batch_id)`` gets the match table of each batch, and
    ``rejected((structure_id, reason), batch_id)`` the files that give no match: without atom coordinates, or
    without three shared atoms. Such files never end the stream; files without a byte aren't seen at all.

    Files are tracked in ``checkpoint``, so each is compared once; a sink that overwrites by batch id makes
    that exactly once. ``trigger`` is passed on, ``availableNow=True`` by default."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        atoms = structures.parse_mmcif(batch.where(F.regexp_like("value", F.lit(SITE))))
        matches = compare.compare(template, network, atoms, cutoff).matches.persist()
        sink(matches, number)
        if rejected:
            done = matches.select(F.col("job_name").alias("structure_id")).distinct()
            parsed = atoms.select("structure_id").distinct().withColumn("has", F.lit(True))
            left = batch.select("structure_id").join(done, "structure_id", "left_anti").join(parsed, "structure_id", "left")
            rejected(left.select("structure_id", F.when(F.col("has"), "no three shared atoms").otherwise("no atoms").alias("reason")), number)
        matches.unpersist()
        batch.unpersist()

    return arriving(spark, folder, pattern).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


TOTALS = "run string, structures long, rejected long, total long, matched long, percent double"


class RunTotals(StatefulProcessor):
    """By run, the totals over all structures that came: how many, how many without a match, atoms and matches. A
    structure that comes again replaces what it counted before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "structure_id string", "total long, matched long")
        self.sums = handle.getValueState("sums", "structures long, rejected long, total long, matched long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        now = list(self.sums.get()) if self.sums.exists() else [0, 0, 0, 0]
        for frame in rows:
            for name, total, matched in zip(frame["structure_id"], frame["total"], frame["matched"], strict=True):
                new = (int(total), int(matched))
                if self.known.containsKey((name,)):
                    self._count(now, tuple(self.known.getValue((name,))), -1)
                self._count(now, new, 1)
                self.known.updateValue((name,), new)
        self.sums.update(tuple(now))
        yield pd.DataFrame({"run": [key[0]], "structures": [now[0]], "rejected": [now[1]], "total": [now[2]], "matched": [now[3]], "percent": [100.0 * now[3] / now[2] if now[2] else 0.0]})

    @staticmethod
    def _count(sums: list[int], one: tuple[int, int], sign: int) -> None:
        for i, v in enumerate((1, int(one[0] == 0), *one)):
            sums[i] += sign * v

    def close(self) -> None:
        pass


def running_totals(results: DataFrame) -> DataFrame:
    """TOTALS after each batch, in update mode, of the stream ``results(run, structure_id, total, matched)``, a row for each
    structure that was compared; total 0: it gave no match. Needs the RocksDB state store; state is one pair of
    numbers a structure, by run."""
    return results.groupBy("run").transformWithStateInPandas(RunTotals(), TOTALS, "update", "none")
