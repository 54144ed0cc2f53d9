"""Sharding by jump consistent hashing: a stable key and the shard count decide, no ring table.

Each key has its own stream of uniform numbers. From bucket b the key jumps to
floor((b + 1) / u) with the next number u, and stays in the last bucket below the shard count.
Appending a shard therefore moves a key only into the new shard, with probability 1 / (n + 1).
Built-in expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
STEPS = 24


def jump_shard(key: Column, shards: int, seed: int = 17) -> Column:
    """The shard of ``key`` among ``shards``, an int. Equal keys share a shard; null is a key of its own.

    A key jumps about ln(shards) times; ln(shards) + STEPS steps are made for all, and the rest that could be needed
    only for the few keys that aren't there by then (a jump always moves on)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    steps = min(shards, int(math.log(shards)) + 1 + STEPS)

    def step(s: Column, i: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, i, F.lit(seed)), 11).cast("double") + 1.0) * (2.0**-53)
        return F.when(s["j"] >= shards, s).otherwise(F.struct(s["j"].alias("b"), F.floor((s["j"] + 1.0) / u).cast("double").alias("j")))

    def run(start: Column, low: int, high: int) -> Column:
        return F.aggregate(F.sequence(F.lit(low), F.lit(high)), start, step)

    state = run(F.struct(F.lit(0).cast("double").alias("b"), F.lit(0).cast("double").alias("j")), 1, steps)
    if steps < shards:  # the rare rest
        rest = F.aggregate(F.array(state), F.struct(F.lit(0).cast("double").alias("b"), F.lit(0).cast("double").alias("j")), lambda _, s: F.when(s["j"] >= shards, s).otherwise(run(s, steps + 1, shards)))
        return rest["b"].cast("int")
    return state["b"].cast("int")


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law ``key``,
    shard, slot (gapless from 0 in each shard) and grown_shard (with one shard more).

    The order in a shard is that of the key's hash, then key, size and checksum. Equal rows are
    counted before any shuffle of their own, so a key of any share is one row in the ordering; they
    take neighbouring slots. Null text counts as empty; a null key is placed like any other.
    Other columns are ignored. An empty table gives an empty result.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("__n"))
    rows = rows.withColumn("__h", F.xxhash64("doc_id", F.lit(29)))
    # of the high bits, so that buckets follow the order of the hash
    rows = rows.select("*", jump_shard(F.col("doc_id"), shards).alias("shard"), (F.shiftright("__h", 54) + BUCKETS // 2).cast("int").alias("__b"))
    sums = rows.groupBy("shard", "__b").agg(F.sum("__n").alias("__c")).groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("__b", "__c"))).alias("__counts"))
    # at most BUCKETS counts for each shard
    ends = F.aggregate(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), F.array(F.lit(0).cast("long")), lambda a, i: F.concat(a, F.array(F.element_at(a, -1) + F.coalesce(F.try_element_at("__counts", i), F.lit(0).cast("long")))))
    sums = sums.select("shard", F.posexplode(ends).alias("__b", "__before"))
    order = ["__h", "doc_id", "size", "text_crc32"]
    within = rows.selectExpr("*", f"sum(__n) over (partition by shard, __b order by {', '.join(order)} rows between unbounded preceding and current row) - __n as __in")
    out = within.join(F.broadcast(sums), ["shard", "__b"])  # (BUCKETS + 1) * shards rows
    out = out.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__k"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__before") + F.col("__in") + F.col("__k")).alias("slot"), jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"))
