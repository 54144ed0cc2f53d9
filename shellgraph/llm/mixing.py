"""Mixing sources to target weights by exact block quotas and a splitting tree.

Every source is put in a pseudo-random order and cut into blocks by ranges of it. What a source has to give becomes a
number of block draws, its quota: whole rounds over all its blocks and a part of one. A binary tree splits the quotas
among the output shards: at each node half of the draws goes left, and how many of them are of which source follows the
multivariate hypergeometric law, which keeps the sums exact. A shard then takes as many of each source's permuted draws
as its quota says, disjoint from those of other shards, and shuffles its documents locally. What the mix takes of a
document is what the shards have drawn. Built-in expressions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

RANGES = 512  # of the order of a source; only the one where a part ends is ordered itself
GROUPS = 256  # of sources, so that no task of the tree holds all of them
MIX_BROADCAST = 200_000  # rows of the table of blocks that are sent to all tasks; more are joined by a shuffle
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in order; share: words to draw over all words; cap: most a
    source gives over what it has; levels: 2**levels output shards; blocks: cuts of a source, a power of two."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cap: float = 2.0
    levels: int = 3
    blocks: int = 64
    seed: int = 5


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, source_size)``, one row a source.

    Sources by code point, null last, weigh the cycle of weights. Words over a source's cap are
    reshared by weight among the others until none is above: that is one level, words per unit of
    weight, below which a source isn't capped. The level is found by going through the sources by
    cap over weight. The table has a row for each source, so one task orders it.
    """
    w = F.element_at(F.array(*map(F.lit, mix.weights)), (F.pmod(F.col("__i"), F.lit(len(mix.weights))) + 1).cast("int")).cast("double")
    df = sizes.withColumn("__i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    df = df.withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(mix.cap))
    every, by = W.partitionBy(), W.orderBy(F.col("__cap") / F.col("__w"), "__i")
    df = df.withColumn("__all", F.sum("source_size").over(every) * F.lit(mix.share))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(by.rowsBetween(0, W.unboundedFollowing))
    df = df.withColumn("__o", F.row_number().over(by)).withColumn("__level", level)
    first = F.min(F.when(F.col("__level") <= F.col("__cap") / F.col("__w"), F.struct("__o", "__level"))).over(every)
    df = df.withColumn("__level", first["__level"])
    return df.select("source", "source_size", F.least("__cap", F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap"))).alias("target"))


def _named(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source and ``text_hash``, which together name a document, and ``more``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), *more)


def _place(rows: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``place``, 63 bits that order a source, and ``block``; equal documents are told apart by ``dup``."""
    rows = rows.withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", "dup", F.lit(mix.seed)), 1))
    return rows.withColumn("block", F.shiftright("place", 63 - (mix.blocks.bit_length() - 1)).cast("int"))


def _hash_share(*key: Column) -> Column:
    """A number from 0 to below 1."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") * 2.0**-53


@dataclass(frozen=True)
class Plan:
    """units(doc_id, source, text_hash, dup, size, place, block): a row for each row of the documents. sources(source,
    source_size, target, full, rest, cut, closing): whole rounds over a source, words of the part of a round, the last
    place of the part, and the place of the one document that closes it (null: none)."""

    units: DataFrame
    sources: DataFrame


def _in_part(cut: str = "cut") -> Column:
    return F.coalesce((F.col("rest") > 0) & ((F.col("place") <= F.col(cut)) | F.col("place").eqNullSafe(F.col("closing"))), F.lit(False))


def plan(docs: DataFrame, mix: Mix = Mix()) -> Plan:
    """What the mix is to take of ``docs(doc_id, text, source)``.

    A part of a round takes documents in the source's order while their sum stays within what is left, then the one
    other document that comes nearest to the rest, if nearer than none. Null text has no words; a source without words
    has target 0. Rows equal in doc_id, source and text are counted before they shuffle. Empty table: empty plan.
    """
    scratch = C.Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = _named(docs, F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    rows = rows.groupBy("doc_id", "source", "text_hash").agg(F.min("size").alias("size"), F.count("*").alias("n"))
    units = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("dup"))
    units = scratch.save(_place(units, mix).drop("n"), "units")
    part = F.shiftright("place", 63 - (RANGES.bit_length() - 1)).cast("int")
    ranges = units.groupBy("source", part.alias("range")).agg(F.sum("size").alias("words"))
    ranges = scratch.save(ranges, "ranges")
    goal = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), mix)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = scratch.save(goal.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "goal")
    # sums of the ranges find the one in which the part ends; only its documents are put in order
    start = F.sum("words").over(W.partitionBy("source").orderBy("range")) - F.col("words")
    ends = ranges.withColumn("start", start).alias("r").join(goal.where("rest > 0").alias("g"), F.expr("r.source <=> g.source")).where("start <= rest and rest < start + words").select("r.source", "r.range", "start", "rest")
    inside = units.withColumn("range", part).alias("u").join(ends.alias("e"), F.expr("u.source <=> e.source and u.range = e.range")).select("u.source", "u.range", "size", "place", "start", "rest")
    inside = inside.withColumn("till", F.col("start") + F.sum("size").over(W.partitionBy("source").orderBy("place", "size").rowsBetween(W.unboundedPreceding, W.currentRow)))
    before = F.col("range").cast("long") * F.lit(1 << 63 - (RANGES.bit_length() - 1)) - 1
    taken = F.when(F.col("till") <= F.col("rest"), F.col("place"))
    cuts = inside.groupBy("source").agg(F.coalesce(F.max(taken), F.min(before)).alias("cut"), F.first("rest").alias("rest"), F.coalesce(F.max(F.when(F.col("till") <= F.col("rest"), F.col("till"))), F.first("start")).alias("got"))
    cuts = scratch.save(cuts.select("source", "cut", (F.col("rest") - F.col("got")).alias("gap")), "cuts")
    near = units.alias("u").join(cuts.alias("c"), F.expr("u.source <=> c.source and u.place > c.cut and u.size < 2 * c.gap")).groupBy("u.source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "place")).alias("near"))
    both = cuts.alias("c").join(near.alias("n"), F.expr("c.source <=> n.source"), "left").select("c.source", "cut", F.col("near.place").alias("closing"))
    sources = goal.alias("g").join(both.alias("b"), F.expr("g.source <=> b.source"), "left").select("g.*", "cut", "closing")
    return Plan(units, scratch.save(sources, "sources"))


def _split(items: Column, n: Callable[[Column], Column], name: Callable[[Column], Column], left: Column, *salt: Column) -> Column:
    """Of ``left`` draws without replacement from a pool of n(item) for each of the items, how many are of each: the
    multivariate hypergeometric law, drawn by going through the pool. All n are above 0."""

    def one(state: Column, item: Column) -> Column:
        begin = F.struct(state["pool"].alias("pool"), state["want"].alias("want"))

        def unit(s: Column, i: Column) -> Column:
            hit = F.when(_hash_share(name(item), i, *salt) * s["pool"] < s["want"], F.lit(1)).otherwise(F.lit(0)).cast("long")
            return F.struct((s["pool"] - 1).alias("pool"), (s["want"] - hit).alias("want"))

        end = F.aggregate(F.sequence(F.lit(1).cast("long"), n(item)), begin, unit)
        # the draws still wanted after each item; the differences are what the items give
        return F.struct(end["pool"].alias("pool"), end["want"].alias("want"), F.concat(state["after"], F.array(end["want"])).alias("after"))

    pool = F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + n(x))
    zero = F.struct(pool.alias("pool"), left.alias("want"), F.array(left).alias("after"))
    after = F.aggregate(items, zero, one, lambda s: s["after"])
    return F.transform(F.sequence(F.lit(1), F.size(items)), lambda i: F.element_at(after, i) - F.element_at(after, i + 1))


def quotas(totals: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, shard, quota) of ``totals(source, n)``, n > 0 draws, by the splitting tree.

    At each level half of a node's draws goes left. How many of them are of which source is drawn in two steps, for
    groups of sources and then within each group, which gives the same law; so a task sees one group's counts. The
    shards' sums differ by at most one.
    """
    scratch = C.Scratch(totals.sparkSession)
    node = totals.where("n > 0").select(F.lit(0).alias("shard"), F.pmod(F.xxhash64("source"), F.lit(GROUPS)).cast("int").alias("g"), "source", F.col("n").cast("long").alias("n"))
    for level in range(mix.levels):
        salt = [F.lit(mix.seed + 100 + level), F.col("shard")]
        cells = scratch.save(node.groupBy("shard", "g").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("items"), F.sum("n").alias("n")), "cells")
        top = cells.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("g", "n"))).alias("groups"), F.sum("n").alias("all"))
        odd = (F.col("all") % 2) * F.when(_hash_share(F.lit("odd"), *salt) < 0.5, 1).otherwise(0)
        top = top.withColumn("half", (F.floor(F.col("all") / 2) + odd).cast("long"))
        top = top.withColumn("lefts", _split(F.col("groups"), lambda x: x["n"], lambda x: x["g"], F.col("half"), *salt))
        top = top.select("shard", F.explode(F.arrays_zip("groups.g", "lefts")).alias("z")).select("shard", F.col("z.g").alias("g"), F.col("z.lefts").alias("left"))
        low = cells.join(top, ["shard", "g"]).withColumn("lefts", _split(F.col("items"), lambda x: x["n"], lambda x: x["source"], F.col("left"), F.lit("within"), *salt))
        low = low.select("shard", "g", F.explode(F.arrays_zip("items", "lefts")).alias("z"))
        sides = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("z.lefts").alias("n")), F.struct((F.col("shard") * 2 + 1).alias("shard"), (F.col("z.items.n") - F.col("z.lefts")).alias("n")))
        node = low.select("g", F.col("z.items.source").alias("source"), F.explode(sides).alias("side")).select("side.shard", "g", "source", "side.n").where("n > 0")
    return node.select("source", "shard", F.col("n").alias("quota"))


def deal(planned: Plan, mix: Mix = Mix()) -> DataFrame:
    """(source, block, source_size, target, full, rest, cut, closing, draws): for each block of a source the draws of it,
    an array of (round, shard). A source's draws, whole rounds and the blocks its part of a round touches, are
    permuted, and each shard takes as many as its quota says after those of the shards before it."""
    scratch = C.Scratch(planned.units.sparkSession)
    rows = planned.units.alias("u").join(planned.sources.alias("s"), F.expr("u.source <=> s.source")).select("s.*", "u.block", "u.place")
    per = ["source", "block", "source_size", "target", "full", "rest", "cut", "closing"]
    blocks = scratch.save(rows.groupBy(*per).agg(F.bool_or(_in_part()).alias("part")), "blocks")
    rounds = F.when(F.col("part"), F.sequence(F.lit(0).cast("long"), F.col("full"))).when(F.col("full") > 0, F.sequence(F.lit(0).cast("long"), F.col("full") - 1))
    draws = blocks.select("source", "block", F.explode(rounds).alias("round"))
    share = quotas(draws.groupBy("source").agg(F.count("*").alias("n")), mix)
    share = share.select("source", "shard", "quota", F.sum("quota").over(W.partitionBy("source").orderBy("shard")).alias("end"))
    order = W.partitionBy("source").orderBy(F.xxhash64("source", "round", "block", F.lit(mix.seed + 50)), "round", "block")
    dealt = draws.withColumn("r", F.row_number().over(order)).alias("d").join(share.alias("q"), F.expr("d.source <=> q.source and d.r <= q.end and d.r > q.end - q.quota"))
    dealt = dealt.groupBy("d.source", "d.block").agg(F.array_sort(F.collect_list(F.struct("d.round", "q.shard"))).alias("draws"))
    none = F.array().cast("array<struct<round:bigint,shard:int>>")
    out = blocks.drop("part").alias("b").join(dealt.alias("d"), F.expr("b.source <=> d.source and b.block = d.block"), "left").select("b.*", F.coalesce("draws", none).alias("draws"))
    return scratch.save(out, "dealt")


def mixture(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """``rows(source, block, place, ...)`` with the columns of ``dealt`` and ``drawn``, the draws that take the row: its
    block's, but of the part of a round only if the part reaches the row."""
    side = F.broadcast(dealt) if dealt.count() <= MIX_BROADCAST else dealt
    both = rows.alias("u").join(side.alias("d"), F.expr("u.source <=> d.source and u.block = d.block")).select("u.*", "source_size", "target", "full", "rest", "cut", "closing", "draws")
    both = both.withColumn("in_part", _in_part())
    return both.withColumn("drawn", F.filter("draws", lambda d: (d["round"] < F.col("full")) | F.col("in_part")))


def taken(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words of it in the shards' draws), shards (where
    they went, sorted)."""
    planned = plan(docs, mix)
    out = mixture(planned.units, deal(planned, mix))
    return out.select("doc_id", "size", "source_size", "target", (F.size("drawn") * F.col("size")).alias("taken"), F.sort_array(F.transform("drawn", lambda d: d["shard"])).alias("shards"))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixture: the rows of ``docs`` the shards have drawn, once for each draw, others not at all. A shard's rows are
    sorted by a hash of their own, which is the local shuffle, in pieces by ranges of it, so that no shard is one task's.

    Null texts have no words and count as empty; a row of null source belongs to the null source. Of rows equal in
    doc_id, source and text each is drawn for itself. Columns may have any names; the empty table gives an empty
    result. Texts move once (rows that are equal to others once more)."""
    scratch = C.Scratch(docs.sparkSession)
    planned = plan(docs, mix)
    dealt = deal(planned, mix)
    rows = _named(docs, F.struct("*").alias("row"))
    key = ["doc_id", "source", "text_hash"]
    several = planned.units.where("dup > 0").select(*key).distinct()
    if several.isEmpty():
        rows = rows.withColumn("dup", F.lit(0).cast("long"))
    else:
        same = F.expr(" and ".join(f"r.{k} <=> s.{k}" for k in key))
        once = rows.alias("r").join(several.alias("s"), same, "left_anti").withColumn("dup", F.lit(0).cast("long"))
        # numbered in pieces, so that equal rows of any number don't meet in one task
        more = rows.alias("r").join(several.alias("s"), same, "left_semi").withColumn("piece", F.spark_partition_id())
        at = W.partitionBy(*key, "piece")
        more = scratch.save(more.withColumn("at", F.row_number().over(at.orderBy(F.lit(0)))), "equal")
        pieces = more.groupBy(*key, "piece").agg(F.count("*").alias("n"))
        pieces = pieces.select(*key, "piece", (F.sum("n").over(W.partitionBy(*key).orderBy("piece")) - F.col("n")).alias("before"))
        more = more.alias("m").join(pieces.alias("p"), F.expr(" and ".join(f"m.{k} <=> p.{k}" for k in (*key, "piece")))).select("m.doc_id", "m.source", "m.text_hash", "m.row", (F.col("before") + F.col("at") - 1).alias("dup"))
        rows = once.unionByName(more)
    out = mixture(_place(rows, mix), dealt).select("row", "place", F.explode("drawn").alias("draw"))
    rank = F.xxhash64("place", "draw.round", F.lit(mix.seed + 70))
    out = out.select("row", F.col("draw.shard").alias("shard"), rank.alias("rank"))
    return out.repartition("shard", F.shiftright("rank", 52)).sortWithinPartitions("shard", "rank").select("row.*")
