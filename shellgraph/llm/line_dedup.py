"""Line deduplication over levelled sorted runs of line hashes.

A run holds, for the lines of one batch or of several merged ones, (h1, h2, n): the 128-bit hash of a line's key
and the number of documents with it, each key once, in buckets by hash, sorted. A new batch is merge-anti-joined with the
runs, bucket by bucket, without moving them, and adds what is left as a run of level 0. Where a level has
``fanout`` runs they are merged into one of the next, so that n batches leave about fanout * log(n) runs and each
key is rewritten log(n) times. Built-in expressions only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: The white space that a key is stripped of, and the letters that are lower-cased.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def key_of(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case and no other letter. Lines of ASCII alone take the
    faster function."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def row_key(text: str, order: Sequence[str]) -> list[Column]:
    """128 bits that stand for a text, or for one beside the values of ``order``; equal texts have equal lines."""
    parts = [*order, F.coalesce(F.col(text).cast("string"), F.lit(""))]
    return [F.xxhash64(*parts).alias("t1"), F.xxhash64(F.lit(1), *parts).alias("t2")]


def hashed_lines(docs: DataFrame, text: str, min_chars: int, order: Sequence[str] = ()) -> DataFrame:
    """(t1, t2, h1, h2, at, first, o): each line of each row whose key has at least ``min_chars`` code points, by its
    place; first: it is its row's first line of that key; o: the values of ``order``, if any are named."""
    keys = F.transform(lines_of(F.col(text)), lambda s, i: F.struct(key_of(s).alias("k"), i.alias("at")))
    # sorted by hash, equal keys stand beside each other and the first of them is the first in the text
    marks = F.sort_array(F.transform(F.filter(keys, lambda e: F.length(e["k"]) >= min_chars), lambda e: F.struct(F.xxhash64(e["k"]).alias("h1"), F.xxhash64(F.lit(1), e["k"]).alias("h2"), e["at"].alias("at"))))
    more = [F.struct(*order).alias("o")] if order else []
    rows = docs.select(*row_key(text, order), marks.alias("marks"), *more)
    one = rows.select("t1", "t2", *["o"] * len(more), F.posexplode("marks").alias("i", "e"), F.col("marks")[F.greatest(F.col("i") - 1, F.lit(0))].alias("p"))
    return one.select("t1", "t2", *["o"] * len(more), "e.h1", "e.h2", "e.at", ((F.col("i") == 0) | (F.col("e.h1") != F.col("p.h1")) | (F.col("e.h2") != F.col("p.h2"))).alias("first"))


@dataclass
class Runs:
    """An index of levelled runs in ``root``. Its state is the file ``runs.json``, written after each run, so that
    a batch counts wholly or not at all and one that is added again changes nothing; ``Runs(spark, root)`` on a
    folder that has it opens the index. One writer at a time.

    buckets: fixed when the index is made, by default spark.sql.shuffle.partitions; enough: documents with which a key
    needs no further counting."""

    spark: SparkSession
    root: str
    buckets: int = 0
    fanout: int = 4
    enough: int = 1
    state: dict = field(default_factory=lambda: {"batches": [], "runs": [], "next": 0})

    def __post_init__(self) -> None:
        self.name = f"shellgraph_runs_{uuid.uuid4().hex}"
        p, fs = self._path("runs.json")
        if fs.exists(p):
            text = self.spark.read.text(p.toString(), wholetext=True).first()[0]
            self.state = json.loads(text)
            self.buckets, self.fanout, self.enough = (self.state[k] for k in ("buckets", "fanout", "enough"))
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for run in self.state["runs"]:
            self._register(run)

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _table(self, run: dict) -> str:
        return f"{self.name}_{run['id']}"

    def _register(self, run: dict) -> None:
        where = f"{self.root}/run-{run['id']}"
        self.spark.sql(f"create table {self._table(run)} (h1 bigint, h2 bigint, n bigint) using parquet clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{where}'")

    def _commit(self) -> None:
        """The state as one file under its final name; what it doesn't name is no part of the index."""
        (new, fs), (old, _) = self._path("runs.json.new"), self._path("runs.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(self.state | {"buckets": self.buckets, "fanout": self.fanout, "enough": self.enough}).encode()))
        out.close()
        fs.delete(old, False)
        fs.rename(new, old)

    def _write(self, rows: DataFrame, level: int) -> dict:
        """``rows``, in ``buckets`` partitions by key: a task for each bucket, so each bucket is one sorted file."""
        run = {"id": self.state["next"], "level": level}
        self.state["next"] += 1
        rows.write.mode("overwrite").format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/run-{run['id']}").saveAsTable(self._table(run))
        return run

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(self._table(r)) for r in self.state["runs"]]

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """``counts(h1, h2, n)`` without the keys that a run holds with ``enough`` documents: a merge join with each run,
        in its buckets."""
        out = counts.repartition(self.buckets, *KEY)
        for run in self.runs():
            out = out.join(run.where(F.col("n") >= self.enough).hint("merge"), KEY, "left_anti")
        return out

    def add(self, batch: str, counts: DataFrame) -> None:
        """Add a batch's ``counts``, each key once, as a run; compact full levels. A batch known by name is in already."""
        if batch in self.state["batches"]:
            return
        self.state["runs"].append(self._write(self.unsettled(counts), 0))
        self.state["batches"].append(batch)
        self._commit()
        level = 0
        while len(full := [r for r in self.state["runs"] if r["level"] == level]) >= self.fanout:
            merged = self._write(self._summed(full), level + 1)
            self.state["runs"] = [r for r in self.state["runs"] if r not in full] + [merged]
            self._commit()
            self._forget(full)
            level += 1

    def _forget(self, runs: Sequence[dict]) -> None:
        for r in runs:
            self.spark.sql(f"drop table if exists {self._table(r)}")
            C.delete(self.spark, f"{self.root}/run-{r['id']}")

    def common(self, least: int) -> DataFrame:
        """(h1, h2) of the keys that at least ``least`` (at most ``enough``) documents hold."""
        if not self.state["runs"]:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._summed(self.state["runs"]).where(F.col("n") >= least).select(*KEY)

    def _summed(self, runs: Sequence[dict]) -> DataFrame:
        """The counts of several runs, read as one table and dealt to buckets. Not a union of the tables: in Spark 4.1.2
        one of bucketed tables takes itself for bucketed, and sums over it come out by table."""
        rows = self.spark.read.schema("h1 long, h2 long, n long").parquet(*[f"{self.root}/run-{r['id']}" for r in runs])
        return rows.repartition(self.buckets, *KEY).groupBy(*KEY).agg(F.sum("n").alias("n"))

    def close(self) -> None:
        """Forget the tables' names; the folder stays."""
        for r in self.state["runs"]:
            self.spark.sql(f"drop table if exists {self._table(r)}")


def without(docs: DataFrame, text: str, marked: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """``docs`` with ``__lines``, ``__kept`` (arrays of lines) after the places in ``marked(t1, t2, at)`` are dropped from
    rows of that key. Texts move once, if ``marked`` is too large to be broadcast by size."""
    drop = marked.groupBy("t1", "t2").agg(F.collect_set("at").alias("__drop"))
    rows = docs.select("*", *[c.alias(f"__{n}") for c, n in zip(row_key(text, order), ("t1", "t2"), strict=True)])
    out = rows.join(drop.withColumnsRenamed({"t1": "__t1", "t2": "__t2"}), ["__t1", "__t2"], "left").drop("__t1", "__t2")
    out = out.withColumn("__lines", lines_of(F.col(text)))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(F.transform(left, lambda i: F.col("__lines")[i]))
    return out.withColumn("__kept", kept).drop("__drop")


@dataclass(frozen=True)
class Lines:
    """min_docs: documents in which a key loses its lines everywhere; min_chars: code points below which a key is kept;
    batches: parts of the corpus that are added to the index one after the other."""

    min_docs: int = 10
    min_chars: int = 1
    batches: int = 4
    fanout: int = 3


def drop_common(docs: DataFrame, p: Lines = Lines(), text: str = "text") -> DataFrame:
    """``docs`` with each text cleaned of the lines whose key at least ``min_docs`` rows hold, and with n_lines (before)
    and n_dropped, both long.

    A key is the line stripped of white space and in lower case (A-Z); shorter ones than ``min_chars`` are never dropped.
    Null and empty texts have one empty line and come out empty. A key counts once a row, however often the row has it;
    repeated rows count each. Other columns stay, but for ``n_lines`` and ``n_dropped`` of the input, which give way.
    An empty table gives an empty result. Lines are hashed in one pass; the index takes them in batches of rows by hash.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    docs = docs.drop("n_lines", "n_dropped")
    lines = hashed_lines(docs, text, p.min_chars).withColumn("batch", F.pmod(F.xxhash64("t1"), F.lit(p.batches)).cast("int"))
    path = scratch.path("lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    index = Runs(spark, scratch.path("index"), fanout=p.fanout, enough=p.min_docs)
    for b in range(p.batches):
        counts = lines.where((F.col("batch") == b) & F.col("first")).groupBy(*KEY).agg(F.count("*").alias("n"))
        index.add(str(b), counts)
    often = scratch.save(index.common(p.min_docs), "common")
    marked = lines.select("t1", "t2", "at", *KEY).join(often, KEY, "left_semi").select("t1", "t2", "at")
    marked = scratch.save(marked.distinct(), "marked")
    index.close()
    out = without(docs, text, marked)
    done = out.withColumns({text: F.array_join("__kept", "\n"), "n_lines": F.size("__lines").cast("long"), "n_dropped": (F.size("__lines") - F.size("__kept")).cast("long")})
    return done.drop("__lines", "__kept")


def keep_first(docs: DataFrame, index: Runs, batch: str, order: Sequence[str], text: str = "text", min_chars: int = 1) -> DataFrame:
    """``docs``, a batch that comes after those in ``index`` (of ``enough`` 1), without the lines that an earlier batch
    has, and without all but the first of equal lines of its own, by ``order`` of the rows and place; the batch's keys are
    added to the index. A batch that the index has by name is refused.

    ``order`` should tell rows apart: those equal in it and in their text keep the same lines. Null and empty texts as in
    ``drop_common``. The result is written before the index changes."""
    if batch in index.state["batches"]:
        raise ValueError(f"batch {batch} is in the index")
    scratch = C.Scratch(docs.sparkSession)
    place = scratch.save(hashed_lines(docs, text, min_chars, order).select(*KEY, F.struct("o", "t1", "t2", "at").alias("place")).distinct(), "places")
    new = scratch.save(index.unsettled(place.groupBy(*KEY).agg(F.min("place").alias("place"), F.count_distinct("place.t1", "place.t2").alias("n"))), "new")
    marked = scratch.save(place.join(new.select(*KEY, "place"), [*KEY, "place"], "left_anti").select("place.t1", "place.t2", "place.at"), "marked")
    out = without(docs, text, marked, order)
    done = scratch.save(out.withColumn(text, F.array_join("__kept", "\n")).drop("__lines", "__kept"), "kept")
    index.add(batch, new.select(*KEY, "n"))
    return done
