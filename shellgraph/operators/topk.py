"""Ranking within groups: the policy-driven top k, first rows by key, arg-max picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def policy_k(df: DataFrame, policy: DataFrame, exact: Sequence[str], wildcard: str = "ANY", default: int = 1) -> DataFrame:
    """``df`` with k from ``policy(resname, moiety, k)``: that of the pair of columns ``exact``, else
    that of (wildcard, second column), else the default. Policy has few rows by its nature."""
    first, second = exact
    own = policy.select(F.col("resname").alias("__p1"), F.col("moiety").alias("__p2"), F.col("k").alias("__own"))
    some = policy.where(F.col("resname") == wildcard).select(F.col("moiety").alias("__p3"), F.col("k").alias("__some"))
    out = df.join(F.broadcast(own), (F.col(first) == F.col("__p1")) & (F.col(second) == F.col("__p2")), "left")
    out = out.join(F.broadcast(some), F.col(second) == F.col("__p3"), "left")
    return out.withColumn("k", F.coalesce("__own", "__some", F.lit(default))).drop("__p1", "__p2", "__p3", "__own", "__some")


def policy_topk(df: DataFrame, policy: DataFrame, group: Sequence[str], exact: Sequence[str], order: Sequence[str | Column], most: int, default: int = 1) -> DataFrame:
    """The first k rows of each group in ``order``, k by policy; adds ``rank``. k <= 0 drops the group.

    ``most`` is the largest k: a constant limit lets Spark cut groups before they are shuffled.
    """
    w = W.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return policy_k(ranked, policy, exact, default=default).where("rank <= k").drop("k")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in ``order``; unlike dropDuplicates the same one in every run."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def argmax(df: DataFrame, keys: Sequence[str], value: str, score: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Per key the ``value`` of the highest non-NaN ``score``; ties to the first in ``order``, given as
    numbers. A combining aggregate, no sort."""
    best = df.where(score.isNotNull() & ~F.isnan(score.cast("double")))
    return best.groupBy(*keys).agg(F.max_by(value, F.struct(score, *[-o for o in order])).alias(name))


def keep_closest(df: DataFrame, group: Sequence[str], d: str, preference: Column, name: str, digits: int = 6) -> DataFrame:
    """The nearest row of each group; of rows as near to ``digits`` decimals the one of the lowest ``preference``, then by
    name."""
    return first_by(df, group, [F.round(d, digits), preference, name])


def preference_of(kind: str, name: str, table: dict[str, list[str]]) -> Column:
    """The place of ``name`` among the preferred names of ``kind``; names that aren't listed come after all."""
    pairs = [x for k, names in table.items() for i, n in enumerate(names) for x in (F.lit(f"{k}|{n}"), F.lit(i))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("|", kind, name)), F.lit(1_000))
