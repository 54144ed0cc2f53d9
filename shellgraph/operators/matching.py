"""Rigid fits and match statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rmsd(squared: Column) -> Column:
    """Root of the mean of squared distances."""
    return F.sqrt(F.sum(squared) / F.count(squared))


def moments(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key of ``pairs(px, py, pz, qx, qy, qz)``: n, the two centroids (pc, qc) and the covariance
    sums h00..h22 of p against q. Everything the fit needs, as combining sums.

    Sums are taken about each group's mean, in a second pass, to keep digits.
    """
    p, q = ["px", "py", "pz"], ["qx", "qy", "qz"]
    mean = pairs.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in [*p, *q]])
    both = pairs.join(mean, list(keys))
    sums = [F.sum((F.col(a) - F.col(f"m_{a}")) * (F.col(b) - F.col(f"m_{b}"))).alias(f"h{i}{j}") for i, a in enumerate(p) for j, b in enumerate(q)]
    centres = [F.first(f"m_{c}").alias(f"m_{c}") for c in [*p, *q]]
    return both.groupBy(*keys).agg(F.first("n").alias("n"), *centres, *sums)


def fit(pairs: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """(keys, n, r00..r22, t0..t2): the rotation and translation that bring p onto q with the least
    squared error, q ~ R p + t (Kabsch). Never a reflection. Groups with fewer than ``least`` pairs have
    no fit. The 3x3 decomposition is the one step done in numpy, once a group."""
    m = moments(pairs, keys).where(F.col("n") >= least)
    out = T.StructType([m.schema[k] for k in keys] + [T.StructField("n", T.LongType())] + [T.StructField(f"r{i}{j}", T.DoubleType()) for i in range(3) for j in range(3)] + [T.StructField(f"t{i}", T.DoubleType()) for i in range(3)])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = lambda n: b.column(n).to_numpy(zero_copy_only=False)
            h = np.stack([col(f"h{i}{j}") for i in range(3) for j in range(3)], axis=1).reshape(-1, 3, 3)
            pc, qc = (np.stack([col(f"m_{s}{c}") for c in "xyz"], axis=1) for s in "pq")
            u, _, vt = np.linalg.svd(h)
            flip = np.ones((len(h), 3))
            flip[:, 2] = np.sign(np.linalg.det(np.swapaxes(u @ vt, 1, 2)))
            rot = np.swapaxes(vt, 1, 2) @ (flip[:, :, None] * np.swapaxes(u, 1, 2))
            move = qc - np.einsum("nij,nj->ni", rot, pc)
            new = [pa.array(rot[:, i, j]) for i in range(3) for j in range(3)] + [pa.array(move[:, i]) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column("n"), *new], names=out.names)

    return m.mapInArrow(solve, out)


def moved(x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    """The three coordinates after the transform in columns r00..t2."""
    return [F.col(f"r{i}0") * F.col(x) + F.col(f"r{i}1") * F.col(y) + F.col(f"r{i}2") * F.col(z) + F.col(f"t{i}") for i in range(3)]


def match_rates(df: DataFrame, category: str, matched: Column, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, category, total, matched, percent) by category, blank ones ``UNK``, and over all as category
    null. percent is 0 where nothing is counted."""
    c = F.coalesce(F.nullif(F.trim(F.col(category).cast("string")), F.lit("")), F.lit("UNK"))
    rows = df.select(*keys, c.alias("category"), F.coalesce(matched, F.lit(False)).cast("long").alias("__m"))
    sets = [F.col(k) for k in keys]
    out = rows.groupingSets([[*sets, F.col("category")], sets], *sets, F.col("category")).agg(F.count("*").alias("total"), F.sum("__m").alias("matched"))
    return out.withColumn("percent", F.coalesce(F.try_divide(F.col("matched") * 100.0, F.col("total").cast("double")), F.lit(0.0)))


def cutoff_sweep(nearest: DataFrame, group: str, d: str, most: float = 4.0, step: float = 0.2) -> DataFrame:
    """(cutoff, mean_matches, std_matches): for each cutoff the mean and population deviation over groups
    of how many distances are at most that far; null distances never are. Each distance is counted once, at the first
    cutoff that holds it, and the counts are summed up from there."""
    n = int(round(most / step))
    edge = lambda i: i * F.lit(float(step))
    # the first cutoff that holds a distance, found beside the quotient, whose last digit may be off
    near = F.ceil(F.col(d) / F.lit(float(step))).cast("int")
    first = F.greatest(F.lit(0), F.when(F.col(d) <= edge(near - 1), near - 1).when(F.col(d) <= edge(near), near).otherwise(near + 1))
    counts = nearest.select(group, F.when(F.col(d).isNotNull(), first).alias("__i")).groupBy(group, "__i").agg(F.count("*").alias("__c"))
    steps = counts.groupBy(group).agg(F.map_from_entries(F.collect_list(F.when(F.col("__i") <= n, F.struct("__i", "__c")))).alias("__m"))
    # at most n + 1 counts a group
    ends = F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.array().cast("array<bigint>"), lambda a, i: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + F.coalesce(F.try_element_at("__m", i), F.lit(0).cast("long")))))
    per = steps.select(group, F.posexplode(ends).alias("__i", "__n")).withColumn("cutoff", edge(F.col("__i")))
    return per.groupBy("cutoff").agg(F.avg("__n").alias("mean_matches"), F.stddev_pop("__n").alias("std_matches"))


def wide_matrix(df: DataFrame, row: str, column: str, values: Sequence[str], cell: Column) -> DataFrame:
    """One row a ``row``, one column for each of the given values of ``column``: a pivot over a fixed list,
    so that Spark needs no pass to find them."""
    return df.groupBy(row).pivot(column, list(values)).agg(cell)


def frequencies(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Per row the share of each of the given values among them; shares of a row sum to 1."""
    counts = wide_matrix(df.where(F.col(column).isin(*values)), row, column, values, F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return counts.select(row, *[(F.col(f"`{v}`") / total).alias(v) for v in values])
