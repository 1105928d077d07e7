"""Trajectory trees as records: one for each path from the root to a leaf, in depth-first order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import graph

#: How the log of an empty root begins, and where code names the dataset.
ROOT_MARK = "root: start exploration"
ROOT_PATH = r"""root_path\s*=\s*['"]([^'"]+)['"]"""


def tagged_logs(node: DataFrame) -> Column:
    """array<string> of a step's logs from its columns thought, action (JSON), tool_name, observation and final_answer.

    A step without action is an answer, if it has one; STOP ends with its
    thought, or what it observed, as the answer; all others have a result.
    """
    block = lambda tag, body: F.concat(F.lit(f"<{tag}>\n"), body, F.lit(f"\n</{tag}>"))
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    acts = F.coalesce(F.trim("action"), F.lit("")).isin("", "{}", "null") == F.lit(False)
    think = F.when(said("thought").rlike(r"\S"), block("think", F.col("thought")))
    final = T.strip(said("final_answer"))
    stop = F.upper(said("tool_name")) == "STOP"
    closing = F.when(T.strip(said("thought")) != "", T.strip(said("thought"))).otherwise(said("observation"))
    answer = F.when(~acts & (final != ""), block("answer", final)).when(acts & stop, block("answer", closing)).when(acts, block("result", said("observation")))
    return F.array_compact(F.array(think, F.when(acts, block("python", F.col("action"))), answer))


def is_root_placeholder(logs: Column) -> Column:
    """Whether a node's one log only says that exploration starts."""
    think = T.strip(F.regexp_extract(F.get(logs, F.lit(0)), r"(?s)<think>(.*?)</think>", 1))
    return F.coalesce((F.size(logs) == 1) & F.startswith(F.lower(think), F.lit(ROOT_MARK)), F.lit(False))


def first_block(logs: Column, tag: str) -> Column:
    """The outermost block of a tag in the first log that has one."""
    return F.get(F.filter(F.transform(logs, lambda x: T.outer_block(x, tag)), lambda b: b.isNotNull()), F.lit(0))


def path_logs(logs: Column) -> Column:
    """array<string> of a node as part of a path: thought and call in one, then the result, shortened; an answer with its thought."""
    think, python, result, answer = (first_block(logs, t) for t in ("think", "python", "result", "answer"))
    step = F.array(F.nullif(F.concat_ws(" ", think, python), F.lit("")), T.shorten_separators(result))
    out = F.when(answer.isNotNull(), F.array(F.concat_ws(" ", think, answer))).otherwise(step)
    return F.when(is_root_placeholder(logs), F.array().cast("array<string>")).otherwise(F.array_compact(out))


def answer_body(logs: Column) -> Column:
    """The first answer in a node's logs that isn't empty."""
    return F.get(F.filter(F.transform(logs, lambda x: F.nullif(T.outer_body(x, "answer"), F.lit(""))), lambda b: b.isNotNull()), F.lit(0))


def nodes_of(trees: DataFrame, tree: str) -> DataFrame:
    """(tree, pos, node_id, parent_id, children_ids, logs): nodes of ``trees`` (tree, nodes); of equal ids the last counts."""
    x = trees.select(tree, F.posexplode("nodes").alias("pos", "n")).select(tree, "pos", "n.node_id", "n.parent_id", "n.children_ids", "n.logs", "n.depth").where("node_id is not null")
    return x.withColumn("last", F.max("pos").over(W.partitionBy(tree, "node_id"))).where("pos = last").drop("last")


def leaf_paths(trees: DataFrame, tree: str) -> DataFrame:
    """(tree, path_index, path) of all ways from the root to a leaf by ``children_ids``, depth first; path: array of node ids.

    The root is the first node without parent, else the first node.  Children
    that are no node are left out; a node that lists only such ends no path.
    """
    nodes = graph.stored(nodes_of(trees, tree))
    root = nodes.groupBy(tree).agg(F.min_by("node_id", F.struct(F.col("parent_id").isNotNull(), "pos")).alias("root"))
    links = nodes.select(tree, F.col("node_id").alias("parent"), F.posexplode("children_ids").alias("k", "node_id"))
    links = links.groupBy(tree, "node_id").agg(F.min(F.struct("parent", "k")).alias("l")).select(tree, "node_id", "l.parent", "l.k")
    up = nodes.select(tree, "node_id").join(links, [tree, "node_id"], "left").join(root, tree)
    # The root has nothing above it, whoever lists it.
    up = up.withColumns({c: F.when(F.col("node_id") != F.col("root"), F.col(c)) for c in ("parent", "k")})
    key = lambda n: F.struct(F.col(tree).alias("t"), F.col(n).alias("n"))
    found = graph.paths(up.select(key("node_id").alias("node"), F.when(F.col("parent").isNotNull(), key("parent")).alias("parent")))
    leaves = nodes.where(F.coalesce(F.size("children_ids"), F.lit(0)) <= 0).select(key("node_id").alias("node"))
    steps = found.join(leaves, "node", "left_semi").select(F.col("node.t").alias(tree), F.col("node.n").alias("leaf"), F.posexplode("path.n").alias("at", "node_id"))
    steps = steps.join(up.select(tree, "node_id", "k", "root"), [tree, "node_id"])
    x = steps.groupBy(tree, "leaf", "root").agg(F.array_sort(F.collect_list(F.struct("at", "node_id", F.coalesce("k", F.lit(0)).alias("k")))).alias("s"))
    x = x.where(F.get("s", F.lit(0))["node_id"] == F.col("root")).withColumn("turns", F.transform("s", lambda e: e["k"]))
    number = F.row_number().over(W.partitionBy(tree).orderBy("turns")) - 1
    return x.select(tree, number.alias("path_index"), F.transform("s", lambda e: e["node_id"]).alias("path"))


def records(trees: DataFrame, tree: str, task_id: Column, input_path: Column, instruction: str = "") -> DataFrame:
    """(tree, path_index, task_id, instruction, input, input_path, prediction, output, logs): one record for each leaf of each tree."""
    # Each node is rendered once, however many paths it is on.
    shown = nodes_of(trees, tree).select(tree, "node_id", path_logs(F.coalesce("logs", F.array().cast("array<string>"))).alias("own"), answer_body(F.col("logs")).alias("answer"))
    steps = leaf_paths(trees, tree).select(tree, "path_index", F.posexplode("path").alias("at", "node_id")).join(shown, [tree, "node_id"])
    x = steps.groupBy(tree, "path_index").agg(F.array_sort(F.collect_list(F.struct("at", "own", "answer"))).alias("s"))
    logs, answers = F.flatten(F.transform("s", lambda e: e["own"])), F.filter(F.transform("s", lambda e: e["answer"]), lambda a: a.isNotNull())
    x = x.select(tree, "path_index", logs.alias("logs"), F.coalesce(F.when(F.size(answers) > 0, F.element_at(answers, -1)), F.lit("")).alias("prediction"))
    head = trees.select(tree, task_id.alias("task_id"), F.coalesce("seed_data", F.lit("")).alias("input"), input_path.alias("input_path"))
    return x.join(head, tree).select(tree, "path_index", "task_id", F.lit(instruction).alias("instruction"), "input", "input_path", "prediction", F.array_join("logs", "").alias("output"), "logs")


def dataset_path(trees: DataFrame, order: str) -> DataFrame:
    """One row: the first dataset folder that code in the logs names, by tree, node and log; null if none does."""
    logs = trees.select(order, F.posexplode("nodes").alias("i", "n")).select(order, "i", F.posexplode("n.logs").alias("j", "log"))
    found = logs.select(order, "i", "j", F.regexp_extract("log", ROOT_PATH, 1).alias("path")).where("path <> ''")
    return found.agg(F.min_by("path", F.struct(order, "i", "j")).alias("path"))


def selectable_leaves(nodes: DataFrame, min_depth: int) -> DataFrame:
    """Leaves (node, parent, depth) that are deep enough to be selected."""
    inner = nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    return nodes.where(F.col("depth") >= min_depth).join(inner, "node", "left_anti")


def pruned(nodes: DataFrame, tau_pre: float, tau_post: float) -> DataFrame:
    """Nodes whose prior reaches ``tau_pre``; those with a later score under ``tau_post`` can't be expanded."""
    return nodes.where(F.col("r_pre") >= tau_pre).withColumn("expandable", F.col("expandable") & ~F.coalesce(F.col("r_post") < tau_post, F.lit(False)))


def answer_leaves(nodes: DataFrame, answers: DataFrame, new_id: Column) -> DataFrame:
    """``nodes`` (node, parent, depth, logs) with an answer node under every leaf of ``answers`` (node, think, answer)."""
    above = nodes.join(answers, "node")
    logs = F.array(F.concat(F.lit("<think>\n"), F.col("think"), F.lit("\n</think>")), F.concat(F.lit("<answer>\n"), F.col("answer"), F.lit("\n</answer>")))
    return nodes.unionByName(above.select(new_id.alias("node"), F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"), logs.alias("logs")))


def descents(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """(tree, path) of the selection in each tree: from the root, always on to the expandable child with the greatest value, to one without.

    nodes: (tree, node, parent, value, expandable); root: (tree, node).  Each
    node's best child is one edge, so the descent is the path up from the node
    below which no edge leads on.
    """
    best = nodes.where("expandable and parent is not null").groupBy("tree", "parent").agg(F.min_by("node", F.struct(-F.col("value"), F.col("node"))).alias("node"))
    key = lambda n: F.struct(F.col("tree").alias("t"), F.col(n).alias("n"))
    edges = nodes.select("tree", "node").join(best, ["tree", "node"], "left")
    found = graph.paths(edges.select(key("node").alias("node"), F.when(F.col("parent").isNotNull(), key("parent")).alias("parent")))
    x = found.select(F.col("node.t").alias("tree"), F.col("path.n").alias("path"))
    x = x.join(root.select("tree", F.col("node").alias("root")), "tree").where(F.get("path", F.lit(0)) == F.col("root"))
    return x.groupBy("tree").agg(F.max_by("path", F.size("path")).alias("path"))
