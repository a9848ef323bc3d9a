"""Chat formatting of reply trees, in DataFrame functions only.

Iterative self-joins enumerate the root-to-leaf paths of each tree, doubling
the reach in each round; branches are ranked by score, and each chosen path
becomes one text with a loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspec.llm.common import blocks, cut, let, saved, shared_dir

OPEN, SHUT, END = "<turn ", ">", "</turn>\n"
#: Escapes; every backslash of an escaped text begins one, and the backslash's own comes first when escaping, last when undoing.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escaped(x: Column) -> Column:
    for plain, code in ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def unescaped(x: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def chain(messages: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A linear conversation as a tree: each row answers the one before it by (turn, role, text), nulls first."""
    keys = [F.col(x).asc_nulls_first() for x in (turn, role, text)]
    place = F.row_number().over(Window.partitionBy(tree).orderBy(*keys)).cast("long")
    return messages.select(F.col(tree).alias("tree"), place.alias("node"), F.col(role).alias("role"), F.col(text).alias("text")).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for every node on the way from every leaf to its root, ``up`` counting from the leaf.

    ``nodes`` has tree, node, parent. A parent that is null or missing makes
    a root. Leaves whose way never ends (a cycle) have no path.
    """
    shared_dir(nodes.sparkSession)
    # No way is longer than its tree, so one that still goes on there never ends, and is followed no further.
    whole = F.count("*").over(Window.partitionBy("tree"))
    ids = saved(nodes.select("tree", "node", "parent", whole.alias("whole")), "nodes")
    known = ids.select("tree", F.col("node").alias("parent"))
    up = ids.join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("above"), "whole").checkpoint()
    leaves = ids.join(up.select("tree", F.col("above").alias("node")).distinct(), ["tree", "node"], "left_anti")
    out = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    roots = ids.join(up.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "node")
    reach = 1
    while up.limit(1).count():
        further = out.join(up, ["tree", "node"]).where(F.col("up") + reach < F.col("whole")).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + reach).alias("up"))
        out = out.unionByName(further).checkpoint()
        reach *= 2
        next_up = up.alias("x").where(F.col("x.whole") > reach).join(up.alias("y"), (F.col("x.tree") == F.col("y.tree")) & (F.col("x.above") == F.col("y.node")))
        up = next_up.select("x.tree", "x.node", "y.above", "x.whole").checkpoint()
    return out.join(out.join(roots, ["tree", "node"]).select("tree", "leaf"), ["tree", "leaf"])


def format_trees(nodes: DataFrame, top: int = 1, learn_from: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, leaf, rank, score, formatted, loss (array of start, end; code points of ``formatted``).

    ``nodes`` has tree, node, parent, role, text, score. The ``top`` leaves of
    each tree with the highest mean score along their path are chosen, the
    smaller leaf first on ties. A null role or text is empty, a null score 0;
    rows that repeat a (tree, node) are one, the smallest; rows with a null
    tree or node are left out, as are trees without a root. Further columns
    are ignored. The loss mask covers the texts of role ``learn_from`` alone.
    """
    one = nodes.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m")).select("tree", "node", "m.*")
    one = saved(one, "messages")
    way = paths(one)
    scored = way.join(one.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).where(F.col("rank") <= top)
    rows = way.join(best, ["tree", "leaf"]).join(one.select("tree", "node", "role", "text"), ["tree", "node"])
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    parts = rows.select("tree", "leaf", "rank", "score", "up", F.concat(F.lit(OPEN), escaped(role), F.lit(SHUT)).alias("head"), escaped(text).alias("body"), (role == learn_from).alias("learn"))
    # Where a turn ends in the whole text is a running sum; window and grouping share one shuffle.
    so_far = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shut = F.sum(F.length("head") + F.length("body") + len(END)).over(so_far) - len(END)
    placed = parts.withColumn("end", shut.cast("long")).withColumn("start", F.col("end") - F.length("body"))
    turn = F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(END)).alias("said"), "learn", "start", "end")
    held = placed.groupBy("tree", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return held.select("tree", "leaf", "rank", "score", F.array_join("turns.said", "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns (array of role, text) parsed from the text, and learned (the unescaped text under the loss mask)."""
    pieces = F.filter(F.split("formatted", "</turn>\n", -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        head = F.position(F.lit(SHUT), x)
        return F.struct(unescaped(F.substring(x, F.lit(len(OPEN) + 1), head - len(OPEN) - 1)).alias("role"), unescaped(F.substring(x, head + 1, F.length(x))).alias("text"))

    learned = let(blocks(F.col("formatted")), lambda b: F.array_join(F.transform("loss", lambda x: unescaped(cut(b, x["start"], x["end"]))), ""))
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("learned", learned)
