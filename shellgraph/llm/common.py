"""Shared helpers of the training-data operators: durable intermediate tables, vectorised
hashing of Arrow text buffers, and connected components.

Nothing here reads paths with ``open``; intermediate tables go through Spark's writers to the
folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK_BYTES = 1 << 19
_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh temporary one only in local mode with none set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="shellgraph-"))
    return f"file://{_LOCAL_DIR[0]}"


ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what Spark sends Python at once by bytes, in this session: its own bound is a number of rows, which
    says nothing where texts are long. A smaller bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not (now and now.isdigit() and int(now) <= ARROW_BYTES):
        spark.conf.set(key, ARROW_BYTES)


class Scratch:
    """Tables written once and read again: lineage ends there, so a lost executor costs no
    recomputation of earlier steps. ``drop`` frees tables that nothing lazy reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/sg-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def add(self, df: DataFrame, path: str) -> DataFrame:
        """The table at ``path`` with ``df`` added to it."""
        df.write.mode("append").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def save_buckets(self, df: DataFrame, name: str, key: str, n: int, *folders: str) -> DataFrame:
        """``df`` as a table in ``n`` buckets by ``key``, and in folders: joins and sums by the key don't move it. Each task
        writes a file for each bucket it has rows of. The table's name is forgotten by ``drop``."""
        path, table = self.path(name), f"sg_{uuid.uuid4().hex}"
        out = df.write.format("parquet").bucketBy(n, key).option("path", path)
        (out.partitionBy(*folders) if folders else out).saveAsTable(table)
        out = self.spark.table(table)
        out._scratch_path, out._scratch_table = path, table
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if table := getattr(t, "_scratch_table", None):
                self.spark.sql(f"drop table if exists {table}")
            delete(self.spark, t._scratch_path)

    def free_shuffles(self) -> None:
        """Let Spark free the shuffle files of plans that are done with: it does so once their objects are collected,
        for which an idle driver sees no reason by itself."""
        gc.collect()
        self.spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` has not got, letter case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- hashing of text buffers


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def seeds(n: int, seed: int) -> np.ndarray:
    """n well-mixed 64-bit numbers from a seed."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = seeds(256, 11)
_BYTE_LOWER = _BYTE[_LOWER]
_P = U64(0x9E3779B97F4A7C15 | 1)
_P_INV = U64(pow(int(_P), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for k, p in (("up", _P), ("down", _P_INV)):
            a = np.full(n, p, U64)
            a[0] = 1
            _POWERS[k] = np.cumprod(a, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null has no bytes."""
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows holding at most ``limit`` bytes, or one row that alone holds more."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, off: np.ndarray, is_sep: np.ndarray, lower_ascii: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words in rows off[0]..off[-1], with the number of words per row and
    each row's first word. A word is a run of bytes outside ``is_sep``."""
    base = off[0]
    b = data[base : off[-1]]
    n, rows = len(b), len(off) - 1
    if not n:
        return np.zeros(0, U64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    word = ~is_sep[b]
    edge = np.zeros(n + 1, bool)
    edge[(off - base)] = True
    prev = np.empty(n, bool)
    prev[0], prev[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~prev | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    up, down = _powers(n + 1)
    acc = np.zeros(n + 1, U64)
    np.cumsum((_BYTE_LOWER if lower_ascii else _BYTE)[b] * up[:n], out=acc[1:])
    h = mix((acc[ends] - acc[starts]) * down[starts] + (ends - starts).astype(U64))
    first = np.searchsorted(starts, off[:-1] - base)
    counts = np.diff(np.append(first, len(starts)))
    return h, counts, first


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


# ---------------------------------------------------------------- connected components

BROADCAST_ROWS = 200_000


def unsent(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a side of a join of which no side is broadcast where ``rows`` is above BROADCAST_ROWS: numbers that stay few bytes in
    files are many times that in the driver, which Spark's own limit by file size doesn't see."""
    return df.hint("merge") if rows > BROADCAST_ROWS else df


SMALL_ROWS = 50_000  # of two or three numbers, in a task


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` short rows, in no more tasks and files than they need: what a small table costs is tasks."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SMALL_ROWS)))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``: root is the smallest node it reaches.

    Alternating large-star and small-star rounds, until each node has one edge or is the root of those it is in. Each takes
    minima with map-side combination and joins them back, so a hub is never gathered in one task. Null ends and loops are
    ignored; without edges the result is empty.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    e = scratch.save(e, "edges")
    while True:
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        rows, deep = ends.agg(F.sum("up"), F.max(F.expr("up > 1 or up = 1 and down = 1"))).first()
        if not deep:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v").distinct().select("v", "v"))
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(unsent(low, rows), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(few_tasks(large, rows), "large")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        # the edge to the least neighbour stays, the others' ends meet that neighbour
        small = large.join(unsent(low2, rows), "u").select(F.expr("if(v = m, u, v)").alias("u"), F.col("m").alias("v")).distinct()
        new = scratch.save(few_tasks(small, rows), "star")
        scratch.drop(e, large)
        e = new


def _told(state: DataFrame, facts: DataFrame, rows: int) -> DataFrame:
    """``state(key, part, node, root)`` with the columns of ``facts(node, ...)``; root as __root. A node's buckets (as many as
    it has keys) become one row before the join, so that it makes a row for each node and not for each place in a bucket."""
    held = state.groupBy("node").agg(F.first("root").alias("__root"), F.collect_list(F.struct("key", "part")).alias("__at"))
    rich = held.join(unsent(facts, rows), "node").withColumn("__at", F.explode("__at"))
    return rich.select("__at.key", "__at.part", *[c for c in rich.columns if c != "__at"])


def bucket_links(scratch: Scratch, members: DataFrame, facts: DataFrame, close: str, first: str, confirm: Callable[[DataFrame], DataFrame], meet: Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Links (u, v), u < v, between nodes that share a bucket: enough that their components are those of all
    confirmed pairs of all buckets.

    ``members(key, part, node, lead)`` has the buckets of several nodes: part says which of its keys a node is in the
    bucket for, lead is one of its nodes. ``facts(node, ...)`` is what is known of a node, whose columns two conditions
    name with the suffix _u or _v: ``close`` holds for every link; ``first`` for just one ``part`` of those that two
    nodes share, so that a pair of many common buckets is made once. ``confirm`` turns pairs (u, v) into the links
    among them. ``meet``, where given, makes the last round's pairs instead of a join by key under the two conditions: of
    (key, part, node, root) of the members, of (key, n, pairs, top) by bucket and of the facts, where n counts members, n and those outside ``top``, the
    largest component, have the product pairs.

    First every member meets its bucket's lead. After that only members of different components need to meet.
    Rounds in which members meet another lead join most of what belongs together, and go on while each halves the
    pairs that are left; then those outside a bucket's largest component meet all others of it. No bucket is capped.
    """
    names = [c for c in facts.columns if c != "node"]
    side = lambda df, x: df.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in names])
    stars = members.where("lead <> node").select(F.least("lead", "node").alias("u"), F.greatest("lead", "node").alias("v")).distinct()
    size = members.count()
    links = scratch.save(confirm(stars.join(unsent(side(facts, "v"), size), "v").join(unsent(side(facts, "u"), size), "u").where(close).select("u", "v")), "links")
    scratch.free_shuffles()
    before, turn = float("inf"), 0
    while True:
        roots = components(scratch, links)
        state = members.select("key", "part", "node").join(unsent(roots, size), "node", "left").select("key", "part", "node", F.coalesce("root", "node").alias("root"))
        mixed = state.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        state = scratch.save(few_tasks(state.join(unsent(mixed, size), "key"), size), "mixed")
        sums = state.groupBy("key", "root").agg(F.count("*").alias("c"))
        sums = sums.groupBy("key").agg(F.sum("c").cast("double").alias("n"), F.max(F.struct("c", "root")).alias("top"))
        sums = sums.select("key", "n", ((F.col("n") - F.col("top.c")) * F.col("n")).alias("pairs"), F.col("top.root").alias("top"))
        sums = scratch.save(few_tasks(sums, size), "sums")
        work, rows = sums.agg(F.sum("pairs"), F.sum("n")).first()
        if not rows:
            return links
        last = work <= 64 * rows or work > before / 2
        before, turn = work, turn + 1
        if last and meet:
            more = scratch.save(links.unionByName(confirm(meet(state, sums, facts, rows))), "links")
            scratch.drop(state, sums, links)
            scratch.free_shuffles()
            return more
        rich = _told(state, facts, rows)
        left = rich.select("key", F.col("node").alias("u"), F.col("__root").alias("root_u"), *[F.col(c).alias(f"{c}_u") for c in names])
        right = rich.select("key", "part", F.col("node").alias("v"), F.col("__root").alias("root_v"), *[F.col(c).alias(f"{c}_v") for c in names])
        if last:
            left = left.join(unsent(sums.select("key", "top"), rows), "key").where("root_u <> top")
            once = f"(root_v = top or u < v) and {close} and {first}"
        else:  # another lead for each bucket: a pseudo-random member
            pick = state.groupBy("key").agg(F.min_by("node", F.xxhash64("key", "node", F.lit(turn))).alias("u"))
            left, once = pick.join(unsent(left, rows), ["key", "u"]), close
        pairs = left.join(unsent(right, rows), "key").where(f"root_u <> root_v and {once}")
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        more = scratch.save(links.unionByName(confirm(pairs)), "links")
        scratch.drop(state, sums, links)
        scratch.free_shuffles()
        links = more
        if last:
            return links


def first_equal(column: str, low: int, high: int) -> str:
    """SQL: the first place from ``low`` to below ``high`` at which the arrays ``column``_u and ``column``_v agree."""
    return "case " + " ".join(f"when {column}_u[{i}] = {column}_v[{i}] then {i}" for i in range(low, high)) + " end"
