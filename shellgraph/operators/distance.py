"""Joins by distance between points with columns x, y, z, within groups of equal keys.

All pairs within a cutoff meet on a grid of cells as wide as the cutoff, however large their groups. Where only the nearest
counts, with a cutoff or without, the right side is laid out as an octree whose cells split by count; every left row gets a
bound from the points its cells are known by, and meets only the leaves within it. Neither compares a whole group with another, keeps
tables, or gathers rows outside Spark; a side is broadcast only after counting it. Rows are a bag: equal left rows come
out as often as they are there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BROADCAST_ROWS = 50_000
LEAF = 32  # points above which a cell of the octree is split
DEPTH = 20  # levels below which it isn't
ONE = 500  # points that are one leaf to all tasks


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that of it."""
    return df.limit(rows + 1).count() <= rows


def distance(a: str, b: str) -> Column:
    """Euclidean distance between points ``a`` and ``b``, structs or table aliases; no pow()."""
    parts = [(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in "xyz"]
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


def _names(keys: Sequence[str]) -> list[str]:
    return [f"__k{i}" for i in range(len(keys))]


def _packed(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows as a struct beside their keys."""
    return df.select(*[F.col(k).alias(n) for k, n in zip(keys, _names(keys), strict=True)], F.struct(*df.columns).alias(name))


def _numbered(left: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows with a number of their own, given once and carried along."""
    return _packed(left, keys, "l").withColumn("__id", F.monotonically_increasing_id())


def _grid(a: DataFrame, right: DataFrame, keys: Sequence[str], cutoff: float, broadcast: bool) -> DataFrame:
    """``a`` (keys, l, ...) joined with the rows of ``right`` at most ``cutoff`` away, as r. Right rows go to the 27 cells
    around theirs, which Spark's own estimate of a side's size doesn't count: it isn't left to broadcast one."""
    width = F.lit(float(cutoff) if cutoff > 0 else 1.0)
    cell = lambda s, c: F.floor(F.col(f"{s}.{c}") / width).cast("long")
    at = [f"__{c}" for c in "xyz"]
    a = a.select("*", *[cell("l", c).alias(f"__{c}") for c in "xyz"])
    b = _packed(right, keys, "r")
    for c in "xyz":
        b = b.select("*", F.explode(F.sequence(cell("r", c) - 1, cell("r", c) + 1)).alias(f"__{c}"))
    b = F.broadcast(b) if broadcast else b.hint("merge")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*_names(keys), *at]]
    found = a.alias("a").join(b.alias("b"), reduce(lambda x, y: x & y, [*on, distance("a.l", "b.r") <= cutoff]))
    return found.select(*[f"a.{c}" for c in a.columns if c not in at], "b.r")


def _known(strategy: str) -> None:
    if strategy not in ("auto", "grid", "broadcast"):
        raise ValueError(f"no strategy {strategy}")


def _strategy(strategy: str, right: DataFrame) -> bool:
    _known(strategy)
    return strategy != "grid" and bounded(right, BROADCAST_ROWS if strategy == "broadcast" else BROADCAST_ROWS // 27)


def pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], cutoff: float, strategy: str = "auto") -> DataFrame:
    """(l, r, d): structs of the left and right rows of equal ``keys`` at most ``cutoff`` apart
    (inclusive, on the root), with their distance. Null coordinates and null keys match nothing.

    ``strategy``: ``broadcast`` sends the right side's cells to all tasks if it has at most BROADCAST_ROWS rows, counted;
    ``grid`` shuffles them; ``auto`` broadcasts at most so many cells."""
    found = _grid(_packed(left, keys, "l"), right, keys, cutoff, _strategy(strategy, right))
    return found.select("l", "r", distance("l", "r").alias("d"))


def within(left: DataFrame, right: DataFrame, keys: Sequence[str], cutoff: float, strategy: str = "auto", name: str = "min_distance") -> DataFrame:
    """Rows of ``left`` with a row of ``right`` at most ``cutoff`` away, and the least distance."""
    xyz = ["x", "y", "z"]
    near = nearest(left, right.select(*dict.fromkeys([*keys, *xyz])), keys, xyz, cutoff, strategy)
    return near.where("d is not null").select("l.*", F.col("d").alias(name))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], cutoff: float | None = None, strategy: str = "auto") -> DataFrame:
    """Every row of ``left`` as ``l`` with its nearest row of ``right`` as ``r`` and their distance ``d``.

    Equally near rows of ``right`` go by ``order``. Without a right row of equal keys (within the cutoff, if one is given)
    ``r`` and ``d`` are null; so they are for null keys and coordinates. A cutoff doesn't change the way: what meets is a few
    leaves of the octree however many points the cutoff spans; ``strategy`` is that of ``pairs`` and only checked."""
    _known(strategy)
    found = _octree(_numbered(left, keys), _first_of_place(right, keys, order), keys)
    d = distance("l", "r")
    best = F.struct(d, *[F.col(f"r.{c}") for c in order])
    out = found.groupBy("__id").agg(F.first("l").alias("l"), F.min_by("r", F.when(F.col("r").isNotNull(), best)).alias("r"), F.min(d).alias("d")).drop("__id")
    if cutoff is None:
        return out
    return out.select("l", *[F.when(F.col("d") <= cutoff, F.col(c)).alias(c) for c in ("r", "d")])


def _first_of_place(right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows of equal keys and coordinates the first by ``order``: no other can be a nearest one, and a leaf of the
    octree, which can't split equal points, stays small."""
    at = [*keys, *[c for c in "xyz" if c not in keys]]
    row = F.struct(*right.columns)
    return right.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(at)]).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def _cells(s: str, low: Sequence[float], width: float, level: Column) -> Column:
    """The cell of point ``s`` at a level, as a struct; level 0 is one cell of ``width``."""
    return F.struct(*[F.floor((F.col(f"{s}.{c}") - F.lit(a)) / F.lit(width) * F.pow(F.lit(2.0), level)).cast("long").alias(c) for c, a in zip("xyz", low, strict=True)])


def _gap(s: str, farthest: bool = False) -> Column:
    """Distance of point ``s`` to the nearest (or farthest) place of the box in columns lo, hi."""
    parts = []
    for c in "xyz":
        p, lo, hi = F.col(f"{s}.{c}"), F.col(f"lo.{c}"), F.col(f"hi.{c}")
        parts.append(F.greatest(F.abs(p - lo), F.abs(p - hi)) if farthest else F.greatest(lo - p, p - hi, F.lit(0.0)))
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


def octree(right: DataFrame, keys: Sequence[str], low: Sequence[float], width: float, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) over the rows of ``right``: nodes (keys, lvl, cell, lo, hi, some, leaf) with the box of their points, one
    of these, and whether they aren't split; leaves (keys, lvl, cell, r). A cell is split where it has more
    than LEAF points, down to ``depth``; counts are one aggregate over all levels."""
    names = _names(keys)
    b = _packed(right, keys, "r").where(reduce(lambda x, y: x & y, [F.col(f"r.{c}").isNotNull() & ~F.isnan(f"r.{c}") for c in "xyz"]))
    every = b.withColumn("lvl", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("cell", _cells("r", low, width, F.col("lvl")))
    box = lambda f: F.struct(*[f(f"r.{c}").alias(c) for c in "xyz"])
    point = F.struct(*[F.col(f"r.{c}").alias(c) for c in "xyz"])
    made = every.groupBy(*names, "lvl", "cell").agg(F.count("*").alias("n"), box(F.min).alias("lo"), box(F.max).alias("hi"), F.min(point).alias("some"))
    up = [F.shiftright(F.col(f"cell.{c}"), 1) for c in "xyz"]
    # a cell's count is that of its parts
    above = F.sum("n").over(W.partitionBy(*names, "lvl", *up))
    kept = made.withColumn("above", above).where((F.col("lvl") == 0) | (F.col("above") > LEAF))
    nodes = kept.select(*names, "lvl", "cell", "lo", "hi", "some", ((F.col("n") <= LEAF) | (F.col("lvl") == depth)).alias("leaf"))
    own = nodes.where("leaf").select(*names, "lvl", "cell")
    return nodes, every.join(own, [*names, "lvl", "cell"])


def _octree(a: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``a`` (keys, l, __id) with every row of ``right`` that may be its nearest as r, and null where there is none.

    First each left row meets the nodes whose cell it lies in; the distance to a point of theirs is a bound. Then it meets the
    leaves below the cells that its ball of that radius touches, at the level where these are few; the least
    farthest distance to a leaf's box tightens the bound, and only leaves whose box is within it give their points."""
    names = _names(keys)
    xyz = ["x", "y", "z"]
    ends = right.select(*xyz).agg(F.count("*"), *[f(F.when(~F.isnan(c), F.col(c))) for c in xyz for f in (F.min, F.max)]).first()
    if not ends[0] or ends[1] is None:
        return a.withColumn("r", F.lit(None).cast(_packed(right, keys, "r").schema["r"].dataType))
    low = [float(v) for v in ends[1::2]]
    width = max(float(hi) - lo for lo, hi in zip(low, ends[2::2], strict=True)) * 1.0000001 or 1.0
    # a point outside the tree's cube is judged by the nearest place inside
    inside = F.struct(*[F.greatest(F.lit(lo), F.least(F.lit(lo + width * (1 - 1e-9)), F.col(f"l.{c}"))).alias(c) for c, lo in zip(xyz, low, strict=True)])
    if ends[0] <= ONE:  # the root is the only leaf
        b = _packed(right, keys, "r").withColumn("cell", _cells("r", low, width, F.lit(0)))
        known = F.col("l.x").isNotNull() & F.col("l.y").isNotNull() & F.col("l.z").isNotNull()
        root = a.withColumn("__in", inside).withColumn("cell", F.when(known, _cells("__in", low, width, F.lit(0))))
        return root.join(F.broadcast(b), [*names, "cell"], "left").select("__id", "l", "r")
    depth = min(DEPTH, math.ceil(math.log2(max(1.0, ends[0] / LEAF)) / 3) + 4 if ends[0] > LEAF else 0)
    nodes, leaves = octree(right, keys, low, width, depth)

    up = a.withColumn("__in", inside).withColumn("lvl", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("cell", _cells("__in", low, width, F.col("lvl"))).drop("__in")
    met = up.join(nodes.select(*names, "lvl", "cell", "some"), [*names, "lvl", "cell"], "left")
    bound = met.groupBy("__id", *names).agg(F.first("l").alias("l"), (F.min(distance("l", "some")) * (1 + 1e-9) + 1e-300).alias("u"))
    bound = bound.withColumn("u", F.when(~F.isnan("u"), F.col("u")))

    # the deepest level whose cells are at least as wide as the ball: it touches at most three of them along an axis
    fit = F.greatest(F.lit(0), F.least(F.lit(depth), F.floor(F.log2(F.lit(width) / F.greatest(F.col("u"), F.lit(width * 2.0**-40)))).cast("int")))
    steps = bound.withColumn("__top", F.when(F.col("u").isNotNull(), fit)).withColumn("lvl", F.explode_outer(F.sequence(F.lit(0), F.col("__top"))))
    edge = (F.lit(width) / F.pow(F.lit(2.0), F.col("lvl")))
    last = (F.pow(F.lit(2.0), F.col("lvl")) - 1).cast("long")
    for c, lo in zip(xyz, low, strict=True):
        at = lambda v: F.greatest(F.lit(0).cast("long"), F.least(last, F.floor((v - F.lit(lo)) / edge).cast("long")))  # noqa: B023, E731
        steps = steps.withColumn(f"__{c}", F.explode_outer(F.sequence(at(F.col(f"l.{c}") - F.col("u")), at(F.col(f"l.{c}") + F.col("u")))))
    steps = steps.withColumn("cell", F.struct(*[F.col(f"__{c}").alias(c) for c in xyz])).drop("__x", "__y", "__z")
    # a leaf is known by its own cell, and by those above it
    own = nodes.where("leaf").select(*names, F.col("lvl").alias("leaf_lvl"), F.col("cell").alias("leaf_cell"), "lo", "hi")
    above = own.withColumn("lvl", F.explode(F.sequence(F.lit(0), F.col("leaf_lvl"))))
    above = above.withColumn("cell", F.struct(*[F.expr(f"shiftright(leaf_cell.{c}, leaf_lvl - lvl)").alias(c) for c in xyz]))
    near = steps.join(above, [*names, "lvl", "cell"], "left").where("u is null or lo is not null and (lvl = __top or lvl = leaf_lvl)").where(F.col("u").isNull() | (_gap("l") <= F.col("u")))
    tight = F.least("u", F.min(_gap("l", True)).over(W.partitionBy("__id")) * (1 + 1e-9))
    near = near.withColumn("u", F.when(F.col("u").isNotNull(), tight)).where(F.col("u").isNull() | (_gap("l") <= F.col("u")))
    points = leaves.select(*names, F.col("lvl").alias("leaf_lvl"), F.col("cell").alias("leaf_cell"), "r")
    return near.join(points, [*names, "leaf_lvl", "leaf_cell"], "left").select("__id", "l", "r")
