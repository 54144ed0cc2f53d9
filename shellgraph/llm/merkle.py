"""Merkle manifest of a dataset: a hash tree over the documents of each source, and one over the sources.

Leaves are range-sorted by source and id; counts by partition and source give each leaf its place in its tree. Where a
stretch of neighbouring leaves is read in one task, that task builds all nodes whose leaves it has, up to
``LOCAL`` levels. The roots of these subtrees, of which only those at the ends of a stretch are ragged, move by their
coordinate to make the upper levels, and the leaves' proofs are put together where their subtree is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import common as C

FAN = 16
LOCAL = 4  # levels that a task builds: at most FAN ** LOCAL leaves are held at once
SMALL = 200_000  # rows that may be broadcast, counted

#: Text of one column of a leaf: what H is taken of.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<run: binary, at: int>>"


def H(parts: bytes) -> bytes:
    """The digest of digests, which are given as bytes in a row and taken as hex text."""
    return hashlib.sha256(parts.hex().encode()).digest()


def leaf_of(values: dict[str, Column]) -> Column:
    """Binary SHA-256 of the columns of a row, each ``-`` if null, else its length in bytes, a colon and its text."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[part(values[n].cast("string")) for n in FIELDS]), 256))


def levels(n: int) -> int:
    """How many levels lie above the leaves of a tree of ``n`` leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def _levels(n: Column) -> Column:
    """The same as a column: the number of powers of FAN below n."""
    return sum(((n > FAN**k).cast("int") for k in range(16)), F.lit(0))


@dataclass(frozen=True)
class Tree:
    """placed: the leaves (grp, idx, n, leaf, ...), lvl: the level of the largest subtree that a task built over the leaf.
    paths: (grp, lvl, idx, above): the ways up from these subtrees, idx that of their first leaf. roots: (grp, leaf)."""

    placed: DataFrame
    paths: DataFrame
    roots: DataFrame


def grow(scratch: C.Scratch, leaves: DataFrame, order: list[str]) -> Tree:
    """The trees over ``leaves(grp, leaf, ...)``, one for each ``grp`` (not null), in ``order``. Rows equal in
    ``order`` may stand in either order, so it should end with the leaf itself."""
    spark = leaves.sparkSession
    # equal rows are told apart by a number, so that no range is larger than another for them
    salted = leaves.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    by = ["grp", *order, "salt"]
    ranged = salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("salt")
    ranged = scratch.save(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")  # part and place in it
    runs = ranged.groupBy("grp", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("low"), F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("grp").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"), F.sum("c").over(W.partitionBy("grp")).alias("n"))
    runs = scratch.save(runs, "runs")
    small = runs.count() <= SMALL
    placed = ranged.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(runs) if small else runs, ["grp", "part"])
    placed = placed.withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")
    schema = T.StructType([*placed.schema, T.StructField("lvl", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    found = scratch.save(placed.mapInArrow(_subtrees, schema), "subtrees")
    nodes = found.where("digest is not null").select("grp", "n", "lvl", "idx", "digest")
    top = _levels(F.col("n"))
    rising = nodes.select("grp", _levels(F.col("n")).alias("top"), "lvl", "idx", "digest")
    highest = nodes.agg(F.max(top)).first()[0] or 0
    # level by level: what a task built at this level, and what was put together below
    done, carried = [], None
    for k in range(highest):
        here = rising.where(F.col("lvl") == k)
        here = here.drop("lvl") if carried is None else here.drop("lvl").unionByName(carried.select("grp", "top", "idx", "digest"))
        span = FAN ** (k + 1)
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda s: s["digest"])
        up = here.where(F.col("top") > k).groupBy("grp", "top", F.expr(f"idx div {span} * {span}").alias("idx")).agg(kids.alias("kids"))
        up = up.withColumn("digest", F.unhex(F.sha2(F.lower(F.array_join(F.transform("kids", F.hex), "")), 256)))
        carried = scratch.save(up.select("grp", "top", "idx", "digest", F.unhex(F.array_join(F.transform("kids", F.hex), "")).alias("run"), F.lit(k + 1).alias("lvl")), f"level-{k + 1}")
        done.append(carried)
    uppers = reduce(DataFrame.unionByName, done, spark.createDataFrame([], "grp string, top int, idx long, digest binary, run binary, lvl int"))
    roots = rising.where("lvl = top").select("grp", F.col("digest").alias("leaf")).unionByName(uppers.where("lvl = top").select("grp", F.col("digest").alias("leaf")))
    # each subtree meets the nodes above it at once
    steps = rising.where("lvl < top").select("grp", "lvl", "idx", F.explode(F.sequence(F.col("lvl") + 1, F.col("top"))).alias("up"))
    steps = steps.withColumn("span", F.expr("cast(shiftleft(1L, 4 * up) as bigint)")).withColumn("to", F.expr("idx div span * span"))
    above = uppers.select("grp", F.col("lvl").alias("up"), F.col("idx").alias("to"), "run")
    if uppers.count() <= SMALL:
        above = F.broadcast(above)
    met = steps.join(above, ["grp", "up", "to"]).withColumn("at", F.expr("cast((idx - to) div shiftleft(1L, 4 * (up - 1)) as int)"))
    ways = met.groupBy("grp", "lvl", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("up", "run", "at"))), lambda s: F.struct(s["run"].alias("run"), s["at"].alias("at"))).alias("above"))
    paths = rising.select("grp", "lvl", "idx").join(ways, ["grp", "lvl", "idx"], "left").withColumn("above", F.coalesce("above", F.array().cast(PATH)))
    return Tree(found.drop("digest"), scratch.save(paths, "paths"), scratch.save(roots, "roots"))


def _raise(nodes: list[bytes]) -> list[bytes]:
    return [H(b"".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each leaf the level of the largest aligned subtree over it that this task has all leaves of, and to the first
    leaf of each such subtree its root as ``digest``. Works on stretches of neighbouring places, however they
    are dealt to tasks; a stretch is cut where the largest subtrees end."""
    span = FAN**LOCAL
    held: list[pa.RecordBatch] = []
    grp, nxt = None, -1

    def cover(lo: int, hi: int, n: int, leaves: list[bytes]) -> tuple[list[int], list[bytes | None]]:
        lvl, digest = [0] * (hi - lo), [None] * (hi - lo)
        top, at = levels(n), lo
        grown = [(lo, leaves)]  # first place and nodes of each level that lie wholly in the stretch
        for k in range(1, min(top, LOCAL) + 1):
            first, nodes = grown[-1]
            step, below = FAN**k, FAN ** (k - 1)
            a = -(-lo // step) * step
            b = hi if hi == n else hi // step * step
            use = nodes[(a - first) // below : (a - first) // below + -(-(b - a) // below)] if b > a else []
            grown.append((a, _raise(use)))
        while at < hi:
            k = len(grown) - 1
            while k and not (at % FAN**k == 0 and 0 <= (at - grown[k][0]) // FAN**k < len(grown[k][1])):
                k -= 1
            end = min(at + FAN**k, hi)
            lvl[at - lo : end - lo] = [k] * (end - at)
            digest[at - lo] = grown[k][1][(at - grown[k][0]) // FAN**k]
            at = end
        return lvl, digest

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        leaves = [x for b in held for x in b.column("leaf").to_pylist()]
        lo, n = held[0].column("idx")[0].as_py(), held[0].column("n")[0].as_py()
        lvl, digest = cover(lo, lo + len(leaves), n, leaves)
        i = 0
        for b in held:
            j = i + b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lvl[i:j], pa.int32()), pa.array(digest[i:j], pa.binary())], names=[*b.schema.names, "lvl", "digest"])
            i = j
        held.clear()

    for batch in batches:
        i, idx, grps = 0, batch.column("idx").to_pylist(), batch.column("grp").to_pylist()
        for j in range(len(idx) + 1):
            if j < len(idx) and grps[j] == grp and idx[j] == nxt and idx[j] % span:
                nxt += 1
                continue
            if j > i:
                held.append(batch.slice(i, j - i))
                i = j
            if j < len(idx):
                yield from flush()
                grp, nxt = grps[j], idx[j] + 1
    yield from flush()


def _split(way: list[dict]) -> list[tuple[bytes, bytes]]:
    """The siblings left and right of a node at each level, as digests in a row."""
    return [(s["run"][: 32 * s["at"]], s["run"][32 * (s["at"] + 1) :]) for s in way]


def proofs(scratch: C.Scratch, tree: Tree, columns: list[str], more: DataFrame | None = None) -> DataFrame:
    """(columns, grp, proof): the siblings of every leaf from the bottom to its root as structs (lefts, rights) of digests
    in a row; ``more(grp, beyond)``: what follows for a group, in the same form. Leaves move once more, to their
    subtrees' paths."""
    return _met(tree, columns, more).mapInArrow(_with_proof(columns), _proof_schema(tree, columns))


def _met(tree: Tree, columns: list[str], more: DataFrame | None) -> DataFrame:
    """Leaves behind the path of their subtree, sorted."""
    paths = tree.paths
    if more is not None:
        paths = paths.join(F.broadcast(more) if more.count() <= SMALL else more, "grp").withColumn("above", F.concat("above", "beyond"))
    rows = tree.placed.select("grp", "lvl", F.expr("idx div shiftleft(1L, 4 * lvl) * shiftleft(1L, 4 * lvl)").alias("sub"), F.col("idx"), "n", "leaf", *columns)
    heads = paths.select("grp", "lvl", F.col("idx").alias("sub"), "above", F.lit(-1).cast("long").alias("idx"))
    both = heads.unionByName(rows, allowMissingColumns=True)
    return both.repartition("grp", "lvl", "sub").sortWithinPartitions("grp", "lvl", "sub", "idx")


def _proof_schema(tree: Tree, columns: list[str]):
    pair = T.StructType([T.StructField("lefts", T.BinaryType()), T.StructField("rights", T.BinaryType())])
    return T.StructType([*tree.placed.select("grp", "leaf", *columns).schema, T.StructField("proof", T.ArrayType(pair))])


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[list[tuple[bytes, bytes]]], list[tuple[bytes, bytes]]]]:
    """Subtree by subtree: its leaves' rows, the siblings of each within it, and those above it."""
    held: list[pa.RecordBatch] = []
    above: list[tuple[bytes, bytes]] = []

    def close():
        leaves = [x for b in held for x in b.column("leaf").to_pylist()]
        lvl = held[0].column("lvl")[0].as_py()
        inner: list[list[tuple[bytes, bytes]]] = [[] for _ in leaves]
        nodes = leaves
        for k in range(lvl):
            step = FAN**k
            for a in range(0, len(nodes), FAN):
                run = b"".join(nodes[a : a + FAN])
                for p in range(len(run) // 32):
                    pair = (run[: 32 * p], run[32 * (p + 1) :])
                    for q in range((a + p) * step, min((a + p + 1) * step, len(leaves))):
                        inner[q].append(pair)
            nodes = _raise(nodes)
        return list(held), inner, above

    for batch in batches:
        i, idx = 0, batch.column("idx").to_pylist()
        for j, x in enumerate(idx):
            if x >= 0:
                continue
            if j > i:
                held.append(batch.slice(i, j - i))
            if held:
                yield close()
                held = []
            above = _split(batch.column("above")[j].as_py())
            i = j + 1
        if i < len(idx):
            held.append(batch.slice(i))
    if held:
        yield close()


def _with_proof(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lefts", pa.binary()), ("rights", pa.binary())]))
        for held, inner, above in _ways(batches):
            i = 0
            for b in held:
                rows = [[{"lefts": x, "rights": y} for x, y in [*inner[i + q], *above]] for q in range(b.num_rows)]
                i += b.num_rows
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("grp", "leaf", *columns)), pa.array(rows, kind)], names=["grp", "leaf", *columns, "proof"])

    return run


def fold(leaf: bytes, way: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings, from the bottom up, lead to."""
    for left, right in way:
        leaf = H(left + leaf + right)
    return leaf


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every leaf the hash of its proof, and the root from ``other``, which stands for the leaf where it isn't null."""
    for held, inner, above in _ways(batches):
        tail = b"".join(x + y for x, y in above).hex().encode()
        i = 0
        for b in held:
            leaves, others = b.column("leaf").to_pylist(), b.column("other").to_pylist()
            shas, ends = [], []
            for leaf, other in zip(leaves, others, strict=True):
                h = hashlib.sha256(b"".join(x + y for x, y in inner[i]).hex().encode())
                h.update(tail)
                shas.append(h.hexdigest())
                ends.append(fold(other or leaf, [*inner[i], *above]).hex())
                i += 1
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grp"), b.column("leaf"), pa.array(shas, pa.string()), pa.array(ends, pa.string())], names=["doc_id", "grp", "leaf", "proof_sha256", "folded_root"])


def _group(source: Column) -> Column:
    """A name for a source that is never null and sorts like it, null first."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def _both(scratch: C.Scratch, docs: DataFrame, changed: Column | None) -> tuple[Tree, DataFrame, DataFrame]:
    """The trees of all sources, (grp, beyond) and (grp, subroot, root)."""
    cols = {n: F.col(n) for n in FIELDS}
    other = F.lit(None).cast("binary")
    if changed is not None:
        text = F.col("text").cast("string")
        low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        other = F.when(changed, leaf_of(cols | {"text": low}))
    leaves = docs.select(_group(F.col("source")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(cols).alias("leaf"), other.alias("other"))
    tree = grow(scratch, scratch.save(leaves, "leaves"), ["doc_id", "leaf"])
    crown = grow(scratch, tree.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "leaf"), ["name", "leaf"])
    ways = proofs(scratch, crown, ["name"])
    at = F.transform("proof", lambda s: F.struct(F.concat(s["lefts"], F.unhex(F.lit("00" * 32)), s["rights"]).alias("run"), (F.octet_length(s["lefts"]) / 32).cast("int").alias("at")))
    beyond = scratch.save(ways.select(F.col("name").alias("grp"), F.col("leaf").alias("subroot"), at.alias("beyond")), "crown")
    root = crown.roots.select(F.col("leaf").alias("root"))
    return tree, beyond, root


def verify(docs: DataFrame, changed: Column) -> DataFrame:
    """Per row of ``docs(doc_id, source, lang, n_chars, text)``: doc_id, its leaf, the root of its source (subroot), the
    root, proof_sha256 (of all its siblings from the bottom to the root), and folded_root, verified: the root recomputed
    from its siblings and, where ``changed`` holds, the leaf of its row with A-Z of the text in lower case.

    Leaves of a source go by doc_id, null first, then by leaf; sources by their bytes, null first. Rows equal in all
    five columns have equal leaves in places beside each other. A dataset of one row has its leaf as root, and an empty
    proof. Nulls are told from empty values. Other columns are ignored; an empty table gives an empty result.
    Digests are lower-case hex text."""
    scratch = C.Scratch(docs.sparkSession)
    C.small_batches(docs.sparkSession)
    tree, crown, root = _both(scratch, docs, changed)
    rows = _met(tree, ["doc_id", "other"], crown.select("grp", "beyond"))
    out = rows.mapInArrow(_folded, "doc_id long, grp string, leaf binary, proof_sha256 string, folded_root string")
    tops = crown.select("grp", F.lower(F.hex("subroot")).alias("subroot")).crossJoin(root.select(F.lower(F.hex("root")).alias("root")))  # one root
    out = out.join(F.broadcast(tops) if crown.count() <= SMALL else tops, "grp")
    return out.select("doc_id", F.lower(F.hex("leaf")).alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, proof, root) of every row as in ``verify``; proof: an array of (lefts, rights), the digests of
    the siblings on both sides from the bottom to the root, each side in a row. Binary."""
    scratch = C.Scratch(docs.sparkSession)
    C.small_batches(docs.sparkSession)
    tree, crown, root = _both(scratch, docs, None)
    return proofs(scratch, tree, ["doc_id"], crown.select("grp", "beyond")).crossJoin(root).select("doc_id", "leaf", "proof", "root")
