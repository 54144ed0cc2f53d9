"""Chat formatting from reply trees: paths by iterative self-joins, branches ranked by score, each
chosen path one formatted conversation. Built-in expressions only.

Template, for each turn: ``<|turn|>`` role newline text ``<|end|>`` newline. In roles and texts a
backslash, ``<`` and ``[`` become ``\\e``, ``\\l`` and ``\\b`` (a newline in a role ``\\n``), so no
text can hold a marker or another control string; reading back reverses this exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

TURN, END = "<|turn|>", "<|end|>\n"
# fixed order: the escape character first when writing, last when reading
_ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escape(c: Column, newline: bool = False) -> Column:
    for plain, coded in _ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if newline else c


def unescape(c: Column, newline: bool = False) -> Column:
    if newline:
        c = F.replace(c, F.lit("\\n"), F.lit("\n"))
    for plain, coded in reversed(_ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def thread(rows: DataFrame) -> DataFrame:
    """The reply tree of plain conversations: ``rows(conv_id, turn, role, text)`` become
    (tree, node, parent, role, text, score), each row replying to the one before it by turn (ties
    by role, then text; null turns first). Null roles and texts are empty. Score is 0."""
    rows = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select(F.struct("conv_id").alias("tree"), n.alias("node"), F.when(n > 1, n - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, place): the nodes of the chosen root-to-leaf paths.

    ``nodes(tree, node, parent, score)``: a node without parent, or whose parent isn't in the tree,
    is a root; a leaf is nobody's parent. Self-joins double the distance covered in each round, so a
    path of n turns takes about log2(n) of them, on ids alone; a round takes only nodes that have something above them
    still, and looks it up in trees large enough to hold it. A path's score is the sum of its
    nodes' scores, null counting 0, and doubles along with the distance; the best ``per_tree`` leaves of a tree are
    chosen, ties to the smaller leaf, before any path is enumerated. (tree, node) identifies a node. Nodes on or below a cycle have no root above them and,
    like empty tables, give no path.
    """
    scratch = C.Scratch(nodes.sparkSession)
    own = scratch.save(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "nodes")
    sizes = scratch.save(own.groupBy("tree").agg(F.count("*").alias("size")), "sizes")
    largest = sizes.agg(F.max("size")).first()[0] or 0
    found = own.select("tree", F.col("node").alias("parent"), F.col("node").alias("above"))
    start = own.join(sizes, "tree").join(found, ["tree", "parent"], "left")
    # levels[k]: of nodes with something 2**k - 1 above them, what is known of the path from there upwards: its length, the
    # sum of its scores, what is above it
    levels = [scratch.save(start.select("tree", "node", "size", F.lit(1).cast("long").alias("length"), "score", "above"), "level")]
    while 1 << len(levels) - 1 < largest:
        active = levels[-1].where("above is not null")
        if active.isEmpty():
            break
        state = reduce(DataFrame.unionByName, [x.where("above is null") for x in levels[:-1]], levels[-1])
        state = state.where(F.col("size") > 1 << len(levels) - 1)
        more = state.select("tree", F.col("node").alias("above"), F.col("length").alias("l"), F.col("score").alias("s"), F.col("above").alias("further"))
        far = active.join(more, ["tree", "above"]).select("tree", "node", "size", (F.col("length") + F.col("l")).alias("length"), (F.col("score") + F.col("s")).alias("score"), F.col("further").alias("above"))
        levels.append(scratch.save(far, "level"))
    # what still has something above it after as many steps as its tree has nodes is on or below a cycle
    rooted = reduce(DataFrame.unionByName, [x.where("above is null") for x in levels])
    parents = own.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = rooted.select("tree", "node", "length", "score").join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "node"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= per_tree).select("tree", F.col("node").alias("leaf"), "rank", "length", "node")
    paths = [scratch.save(chosen.withColumn("back", F.lit(0).cast("long")), "paths")]  # only the chosen are enumerated
    for k, level in enumerate(levels):
        up = level.where("above is not null").select("tree", "node", "above")
        low = reduce(DataFrame.unionByName, paths).where(F.col("back") + (1 << k) < F.col("length"))
        further = low.join(up, ["tree", "node"]).select("tree", "leaf", "rank", "length", F.col("above").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        paths.append(scratch.save(further, "paths"))
    scratch.drop(own, sizes, *levels)
    return reduce(DataFrame.unionByName, paths).select("tree", "leaf", "rank", "node", (F.col("length") - 1 - F.col("back")).alias("place"))


def format_paths(nodes: DataFrame, per_tree: int = 1, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen path of ``nodes(tree, node, parent, role, text, score)``: tree, rank,
    formatted, and loss_spans, the (start, length) in code points, from 1, of the escaped texts of
    the ``trained`` roles. Marks aren't trained on. Empty texts have spans of length 0."""
    chosen = best_paths(nodes, per_tree)
    turns = chosen.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit("")), True), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    turns = turns.select("tree", "rank", F.struct("place", head.alias("head"), body.alias("body"), F.coalesce(F.col("role").isin(*trained), F.lit(False)).alias("loss")).alias("t"))
    paths = turns.groupBy("tree", "rank").agg(F.array_sort(F.collect_list("t")).alias("t"))
    formatted = F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        here, n = s["at"] + F.length(t["head"]), F.length(t["body"]).cast("long")
        span = F.struct((here + 1).alias("start"), n.alias("length"))
        return F.struct((here + n + len(END)).alias("at"), F.when(t["loss"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return paths.select("tree", "rank", formatted.alias("formatted"), F.aggregate("t", start, step, lambda s: s["spans"]).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, an array of (role, text)."""
    parts = F.split(formatted, r"<\|end\|>\n")
    turns = F.slice(parts, 1, F.size(parts) - 1)
    cut = lambda t: F.instr(t, "\n")
    return F.transform(turns, lambda t: F.struct(unescape(t.substr(F.lit(len(TURN) + 1), cut(t) - len(TURN) - 1), True).alias("role"), unescape(t.substr(cut(t) + 1, F.length(t))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"].cast("int"), s["length"].cast("int")))), "")
