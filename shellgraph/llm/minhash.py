"""MinHash near-duplicate detection with tensored banding.

A table key is the pair (A_i, B_j) of two half keys, each made of ``half`` minimum hashes. With m
half keys a side there are m*m tables for 2*m*half minimum hashes, about the square root of what
independent tables need. Documents meeting in a table are candidates; every accepted link is
confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class MinHash:
    """shingle: words in a shingle; percent: smallest Jaccard similarity, in hundredths; half:
    minimum hashes in a half key; tables: half keys a side. At similarity s a pair is missed with
    probability 1 - (1 - (1 - s**half)**tables)**2: 4e-4 at 0.85 with 3 and 9."""

    shingle: int = 3
    percent: int = 85
    half: int = 3
    tables: int = 9
    seed: int = 7


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each row; a row of fewer words has its whole
    sequence as one shingle, a row without words an empty set."""
    h, counts, first = C.word_hashes(data, off, C.ASCII_SPACE)
    mult = C.seeds(2 * k, 101) | C.U64(1)
    grams = np.zeros(0, C.U64)
    if len(h) >= k:
        n = len(h) - k + 1
        grams = h[:n] * mult[0]
        for i in range(1, k):
            grams += C.mix(h[i : i + n] + mult[k + i])* mult[i]
        grams = C.mix(grams)
    out = []
    for s, c in zip(first.tolist(), counts.tolist(), strict=True):
        if c >= k:
            g = np.sort(grams[s : s + c - k + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))] if len(g) > 1 else g)
        elif c:
            out.append(C.mix(np.array([sum(int(x) * int(m) for x, m in zip(h[s : s + c], mult, strict=False)) + c & (1 << 64) - 1], C.U64)))
        else:
            out.append(np.zeros(0, C.U64))
    return out


def _half_keys(sets: list[np.ndarray], p: MinHash) -> np.ndarray:
    """rows x (2 * tables) half keys."""
    n = 2 * p.tables * p.half
    a = (C.seeds(n, p.seed) >> C.U64(32)).astype(np.uint32) | np.uint32(1)
    b = (C.seeds(n, p.seed + 1) >> C.U64(32)).astype(np.uint32)
    low = np.full((len(sets), n), 0xFFFFFFFF, np.uint32)
    for r, s in enumerate(sets):
        x = (s >> C.U64(32)).astype(np.uint32)
        for i in range(0, len(x), 8192):
            y = x[i : i + 8192]
            m = a[:, None] * y[None, :]
            m += b[:, None]
            np.minimum(low[r], m.min(axis=1), out=low[r])
    parts = low.reshape(len(sets), 2 * p.tables, p.half).astype(C.U64)
    mult = C.seeds(p.half, p.seed + 2) | C.U64(1)
    key = np.broadcast_to(np.arange(2 * p.tables, dtype=C.U64), parts.shape[:2]).copy()
    for i in range(p.half):
        key = C.mix(key + parts[:, :, i] * mult[i])
    return key


def _set_id(s: np.ndarray) -> tuple[int, int]:
    return int(C.mix(s).sum(dtype=C.U64)), int(C.mix(s ^ C.U64(0x5851F42D4C957F2D)).sum(dtype=C.U64))


PARITY_WORDS = 16


def _parity(s: np.ndarray) -> np.ndarray:
    """1024 parities of the set over hash bins. Each element in just one of two sets changes one
    bit, so the number of differing bits never exceeds the size of the symmetric difference."""
    odd = np.bincount((s >> C.U64(5)).astype(np.int64) & (64 * PARITY_WORDS - 1), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketch(p: MinHash, full: bool, own: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.text_buffer(batch.column("text"))
            for i, j in C.chunks(off):
                sets = shingle_sets(data, off[i : j + 1], p.shingle)
                ids = np.array([_set_id(s) for s in sets], C.U64).reshape(-1, 2)
                cols = {"doc_id": batch.column("doc_id").slice(i, j - i), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "h1": C.signed(np.ascontiguousarray(ids[:, 0])), "h2": C.signed(np.ascontiguousarray(ids[:, 1]))}
                cols |= {c: batch.column(c).slice(i, j - i) for c in own}
                if full:
                    flat = np.concatenate(sets) if sets else np.zeros(0, C.U64)
                    ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                    bits = np.concatenate([_parity(s) for s in sets])
                    cols["parity"] = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bits) + 1, PARITY_WORDS, dtype=np.int32)), pa.array(bits))
                    cols["shingles"] = pa.ListArray.from_arrays(pa.array(ends), C.signed(flat))
                else:
                    keys = _half_keys(sets, p)
                    ends = np.arange(0, keys.size + 1, 2 * p.tables, dtype=np.int32)
                    cols["half_keys"] = pa.ListArray.from_arrays(pa.array(ends), C.signed(keys.ravel()))
                yield pa.RecordBatch.from_pydict(cols)

    return run


_BASE = "doc_id long, n_shingles long, h1 long, h2 long"
_KEY = "coalesce(doc_id, -9223372036854775807L - 1L)"


def near_duplicates(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``.

    Rows whose sets have 100*intersection >= percent*union are linked; component_id is the
    smallest doc_id reachable. Null or wordless texts have an empty set and link with nothing.
    Repeated rows share a component and all are ``kept`` when their doc_id is the smallest. A null
    doc_id never names a component unless all its members are null (then component_id is null and
    kept true). Other columns of ``docs`` are ignored; an empty table gives an empty result.

    Equal sets are one node from the start, so a group of copies of any size costs one row per
    table. In a table each member is compared with one leader; members that are still in different
    components then meet each other, after more leaders where a table holds many, each pair in the first
    table that it shares. A bound on the symmetric difference keeps hopeless pairs from being formed. No
    bucket is capped.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _named(docs, p).select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _named(docs: DataFrame, p: MinHash, own: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, *own, root, component_id) per row of ``docs(doc_id, text, *own)``, own being long columns.
    root names the component; it is null, as component_id is, where the set is empty."""
    scratch = C.Scratch(docs.sparkSession)
    C.small_batches(docs.sparkSession)
    more = "".join(f", {c} long" for c in own)
    sketch = scratch.save(docs.mapInArrow(_sketch(p, False, own), f"{_BASE}{more}, half_keys array<long>"), "sketch")
    nodes = sketch.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("low_doc"), F.min(F.expr(_KEY)).alias("any_doc"), F.first("half_keys").alias("half_keys"))
    nodes = scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = scratch.save(_members(nodes, p.tables), "members")
    scratch.free_shuffles()
    links = _verify(scratch, docs.select("doc_id", "text"), nodes, members, p)
    roots = C.components(scratch, links)
    named = nodes.select("h1", "h2", "node", "low_doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("low_doc").alias("component_id"))
    named = named.join(names, "root").select("h1", "h2", "root", "component_id")
    return sketch.select("doc_id", "n_shingles", *own, "h1", "h2").join(named, ["h1", "h2"], "left")


def _members(nodes: DataFrame, t: int) -> DataFrame:
    """(key, part, node, lead) of the tables' buckets of several nodes; table ``part`` pairs half keys part div t and
    t + part % t. Half keys that no other node has are struck out first, so that a node like no other costs 2 * t rows
    and not t * t."""
    half = nodes.select("node", F.posexplode("half_keys").alias("at", "half"))
    twice = half.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    met = half.join(twice, "half").groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("met"))
    some = nodes.select("node", "half_keys").join(met.where(f"met & {(1 << t) - 1} <> 0 and met >> {t} <> 0"), "node")
    part = some.select("node", "half_keys", "met", F.explode(F.sequence(F.lit(0), F.lit(t * t - 1))).alias("part"))
    part = part.where(f"getbit(met, int(part div {t})) = 1 and getbit(met, {t} + part % {t}) = 1")
    keys = part.select(F.xxhash64("part", F.expr(f"half_keys[int(part div {t})]"), F.expr(f"half_keys[{t} + part % {t}]")).alias("key"), "part", "node")
    shared = keys.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    return keys.join(shared, "key")


def _verify(scratch: C.Scratch, docs: DataFrame, nodes: DataFrame, members: DataFrame, p: MinHash) -> DataFrame:
    """Links (u, v) between nodes, enough that their components equal those of all links found in
    the tables."""
    who = members.select("node").distinct().join(nodes.select("node", "h1", "h2", "any_doc", "half_keys"), "node")
    texts = docs.join(who.select(F.col("any_doc").alias("k")).distinct(), F.expr(f"{_KEY} = k"), "left_semi")
    full = texts.mapInArrow(_sketch(p, True), f"{_BASE}, parity array<long>, shingles array<long>")
    sets = who.select("node", "h1", "h2", "half_keys").join(full.select("h1", "h2", F.col("n_shingles").alias("size"), "parity", "shingles"), ["h1", "h2"]).dropDuplicates(["node"])
    sets = scratch.save(sets.select("node", "size", "half_keys", "parity", "shingles"), "sets")
    scratch.free_shuffles()
    # linked only if the symmetric difference is at most this share of the sizes' sum; its lower
    # bound by parities drops most pairs before their sets meet, and no linked one
    differ = " + ".join(f"bit_count(parity_u[{i}] ^ parity_v[{i}])" for i in range(PARITY_WORDS))
    close = f"least(size_u, size_v) * 100 >= greatest(size_u, size_v) * {p.percent} and ({differ}) * {100 + p.percent} <= (size_u + size_v) * {100 - p.percent}"

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("node").alias("u"), F.col("shingles").alias("xu"))
        y = sets.select(F.col("node").alias("v"), F.col("shingles").alias("xv"))
        joined = pairs.join(y, "v").join(x, "u").select("u", "v", F.size(F.array_intersect("xu", "xv")).alias("i"), (F.size("xu") + F.size("xv")).alias("s"))
        return joined.where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * p.percent).select("u", "v")

    t = p.tables
    first = f"part = {t} * ({C.first_equal('half_keys', 0, t)}) + ({C.first_equal('half_keys', t, 2 * t)}) - {t}"
    return C.bucket_links(scratch, members, sets.select("node", "size", "half_keys", "parity"), close, first, confirmed)


def keep_one(docs: DataFrame, p: MinHash = MinHash(shingle=5, percent=80, tables=11)) -> DataFrame:
    """``docs`` without near copies: one row of each component stays, that of the smallest doc_id (null last), among
    several texts of that doc_id the one of the smallest hash.

    Rows of one doc_id (nulls alike) and one text (nulls alike) are one document and give one row, whatever their
    other columns. Texts without words are near copies of nothing. Columns may have any names; an empty table
    gives an empty result."""
    a, b, keep_id, keep_a, keep_b = C.free_names(docs, "text_a", "text_b", "keep_id", "keep_a", "keep_b")
    text = F.col("text").cast("string")
    hashes = F.xxhash64(text.isNull(), text), F.xxhash64(text, F.lit(29))  # together the name of a text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), hashes[0].alias("text_a"), hashes[1].alias("text_b"))
    found = _named(rows, p, ("text_a", "text_b"))
    which = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_a", "text_b")
    kept = found.where("n_shingles > 0").groupBy("root").agg(F.min(which).alias("w")).select("w.doc_id", "w.text_a", "w.text_b")
    kept = kept.unionByName(found.where("n_shingles = 0").select("doc_id", "text_a", "text_b")).distinct()
    kept = kept.select(F.col("doc_id").alias(keep_id), F.col("text_a").alias(keep_a), F.col("text_b").alias(keep_b))
    named = docs.withColumns({a: hashes[0], b: hashes[1]})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(keep_id)) & (F.col(a) == F.col(keep_a)) & (F.col(b) == F.col(keep_b))
    return named.join(kept, same, "left_semi").dropDuplicates(["doc_id", a, b]).drop(a, b)
