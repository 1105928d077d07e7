"""Trees and graphs of nodes: paths, levels, roots, merges and back-propagated rewards."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage, its rows in the shared checkpoint folder; a temporary one where none is set, but only in local mode."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandline-"))
    return df.checkpoint(eager=True)


def paths(nodes: DataFrame) -> DataFrame:
    """(node, path) of every node: ids from the root of its tree down to itself, whatever the depth.

    Paths double in length each round, so there are as many rounds as the depth
    has binary digits.  Parents that are no node end a path; a cycle, which has
    no root, is an error.
    """
    x = stored(nodes.select("node", F.array("node").alias("path"), F.col("parent").alias("up")))
    most, length = x.count(), 1
    while not x.where("up is not null").isEmpty():
        if length > most:
            raise ValueError("parents form a cycle")
        above = x.select(F.col("node").alias("up"), F.col("path").alias("upper"), F.col("up").alias("next"))
        longer = x.where("up is not null").join(above, "up", "left")
        longer = longer.select("node", F.concat(F.coalesce("upper", F.array().cast(x.schema["path"].dataType)), "path").alias("path"), F.col("next").alias("up"))
        x, length = stored(x.where("up is null").unionByName(longer)), 2 * length
    return x.select("node", "path")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node, ancestor, hops) for every node and each ancestor, itself included."""
    x = paths(nodes).select("node", F.size("path").alias("n"), F.posexplode("path").alias("at", "ancestor"))
    return x.select("node", "ancestor", (F.col("n") - 1 - F.col("at")).alias("hops"))


def backpropagate(nodes: DataFrame, rewards: DataFrame) -> DataFrame:
    """(node, visits, total, q): how many rewards lie at or under each node, their sum and their mean."""
    x = paths(nodes).join(rewards, "node").select(F.explode("path").alias("node"), "reward")
    return x.groupBy("node").agg(F.count("*").alias("visits"), F.sum("reward").alias("total"), F.avg("reward").alias("q"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """(node, parent, depth): first parent that is not null by ordinal, least depth."""
    return nodes.groupBy("node").agg(F.min_by(F.col("parent"), F.when(F.col("parent").isNotNull(), F.col("ordinal"))).alias("parent"), F.min("depth").alias("depth"))


def roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that no edge (src, dst) from another node enters."""
    entered = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return nodes.select("node").distinct().join(entered, "node", "left_anti")


def root_paths(nodes: DataFrame) -> DataFrame:
    """(leaf, length, path) of every leaf: node ids from the root, joined by >."""
    inner = nodes.select(F.col("parent").alias("node")).where("node is not null").distinct()
    x = paths(nodes).join(inner, "node", "left_anti")
    path = F.array_join(F.transform("path", lambda n: n.cast("string")), ">")
    return x.select(F.col("node").alias("leaf"), F.size("path").cast("bigint").alias("length"), path.alias("path"))


def pending_leaves(nodes: DataFrame, stop: str = "STOP") -> DataFrame:
    """Rows of ``nodes`` (node, parent, action, answered) that still need an answer: leaves below a root, with an action other than ``stop``.

    A null ``answered`` counts as false; a null or blank action, or a null parent, rules a node out.
    """
    open_ = F.col("parent").isNotNull() & (F.trim("action") != "") & (F.col("action") != stop) & ~F.coalesce("answered", F.lit(False))
    parents = nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    return nodes.where(open_).join(parents, "node", "left_anti")


def edges(nodes: DataFrame) -> DataFrame:
    """Distinct (src, dst) from the parents and the children (arrays) of ``nodes`` (node, parent, children)."""
    down = nodes.select(F.col("node").alias("src"), F.explode("children").alias("dst"))
    return nodes.where("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst")).union(down).distinct()


def levels(nodes: DataFrame) -> DataFrame:
    """(node, level): hops from the root of its tree."""
    return paths(nodes).groupBy("node").agg(F.max(F.size("path") - 1).alias("level"))


def chain(nodes: DataFrame, tree: str, order: str) -> DataFrame:
    """``nodes`` (tree, order, node, parent) as a chain: children is the next one alone; a parent outside the chain is replaced by the one before, the first has none."""
    at = W.partitionBy(tree).orderBy(order)
    inside = nodes.select(tree, F.col("node").alias("parent")).distinct().withColumn("kept", F.lit(True))
    x = nodes.withColumns({"prev": F.lag("node").over(at), "next": F.lead("node").over(at)}).join(inside, [tree, "parent"], "left")
    parent = F.when(F.col("prev").isNull(), F.lit(None)).when(F.col("kept"), F.col("parent")).otherwise(F.col("prev"))
    return x.select(tree, order, "node", parent.alias("parent"), F.array_compact(F.array("next")).alias("children"))


def deepest(nodes: DataFrame, tree: str, bad: Column) -> DataFrame:
    """(tree, node) of the deepest leaf of each tree, the first by position, that is ``bad`` and has a parent."""
    inner = nodes.where("parent is not null").select(tree, F.col("parent").alias("node")).distinct()
    leaves = nodes.where(bad & F.col("parent").isNotNull()).join(inner, [tree, "node"], "left_anti")
    return leaves.groupBy(tree).agg(F.min_by("node", F.struct(-F.col("depth"), F.col("pos"))).alias("node"))


def until(rows: DataFrame, group: str, order: str, success: str, most: int) -> DataFrame:
    """Rows of each group up to and with the one of its ``most``-th success."""
    before = F.coalesce(F.sum(F.col(success).cast("int")).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where(F.col("before") < most).drop("before")


def context(steps: DataFrame, sample: str, order: str, text: str, detailed: int = 2, brief: int = 200) -> DataFrame:
    """``steps`` with shown: the last ``detailed`` texts of each sample whole, older ones on one line of up to ``brief`` characters."""
    back = F.row_number().over(W.partitionBy(sample).orderBy(F.desc(order)))
    line = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return steps.withColumn("back", back).withColumn("shown", F.when(F.col("back") <= detailed, F.col(text)).otherwise(F.substring(line, 1, brief))).drop("back")


def best_child(children: DataFrame, parent: str, value: str, node: str) -> DataFrame:
    """(parent, node) of the child with the greatest value, ties to the least node."""
    return children.where("expandable").groupBy(parent).agg(F.min_by(node, F.struct(-F.col(value), F.col(node))).alias(node))
