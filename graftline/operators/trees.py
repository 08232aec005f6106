"""Rooted trees as edges(tree_id, parent, child, branch_length): roots, layout, states of ancestors, traits, Newick text.

Ways from the root double every round; a cycle fails. Nulls: edges with a null end are invalid, a null length
counts as 0. A child with two parents, a tree with several roots or a cycle is invalid (``problems``). Empty tables give empty
results.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def roots(edges: DataFrame) -> DataFrame:
    parents = edges.select("tree_id", F.col("parent").alias("node")).distinct()
    return parents.join(edges.select("tree_id", F.col("child").alias("node")), ["tree_id", "node"], "left_anti").select("tree_id", F.col("node").alias("root"))


def problems(edges: DataFrame) -> DataFrame:
    """(tree_id, kind, node): two_parents, several_roots, no_root, bad_length."""
    two = edges.groupBy("tree_id", "child").agg(F.count_distinct("parent").alias("n")).where("n > 1").select("tree_id", F.lit("two_parents").alias("kind"), F.col("child").alias("node"))
    r = roots(edges)
    several = r.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("node")).where("n > 1").select("tree_id", F.lit("several_roots").alias("kind"), "node")
    none = edges.select("tree_id").distinct().join(r, "tree_id", "left_anti").select("tree_id", F.lit("no_root").alias("kind"), F.lit(None).cast("string").alias("node"))
    bad = edges.where("isnan(branch_length) or branch_length < 0 or branch_length = double('inf')").select("tree_id", F.lit("bad_length").alias("kind"), F.col("child").alias("node"))
    return two.unionByName(several).unionByName(none).unionByName(bad)


def placed(edges: DataFrame, scratch) -> DataFrame:
    """(tree_id, node, parent, depth, x, path): x is the length from the root, path the sorted way of ids down to the node.

    Every node knows the way from an ancestor; each round the ancestor's own way is put before it, which doubles the way: a tree
    of depth d takes log2(d) rounds. A way that comes back to its ancestor is a cycle and fails."""
    length = F.greatest(F.coalesce(F.col("branch_length").cast("double"), F.lit(0.0)), F.lit(0.0))
    below = edges.select("tree_id", F.col("child").alias("node"), "parent", F.col("parent").alias("up"), F.lit(1).alias("depth"), length.alias("x"), F.array("child").alias("path"))
    top = roots(edges).select("tree_id", F.col("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("up"), F.lit(0).alias("depth"), F.lit(0.0).alias("x"), F.array("root").alias("path"))
    state = scratch.cut(below.unionByName(top), "ways", 2)
    back = F.array_position("path", F.col("up"))
    ring = F.raise_error(F.concat(F.lit("a cycle through "), F.array_min(F.slice("path", F.lit(1), back.cast("int"))).cast("string")))
    while not state.where("up is not null").isEmpty():
        above = state.select("tree_id", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("x").alias("_x"), F.col("path").alias("_path"))
        longer = state.join(above, ["tree_id", "up"], "left").select(
            "tree_id", "node", "parent", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.col("x") + F.coalesce("_x", F.lit(0.0))).alias("x"), F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path")
        )
        state = scratch.cut(longer.withColumn("path", F.when(back > 0, ring).otherwise(F.col("path"))), "ways", 2)
    return state.drop("up")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select("tree_id", F.col("parent").alias("node")).distinct(), ["tree_id", "node"], "left_anti")


def layout(edges: DataFrame, scratch) -> DataFrame:
    """(tree_id, node, x, y): tips in rows by their sorted ways, inner nodes at the mean of their children."""
    nodes = scratch.cut(placed(edges, scratch), "placed")
    tips = leaves(nodes, edges)
    w = Window.partitionBy("tree_id").orderBy(F.array_join("path", "\x01"))
    level = rows = scratch.cut(tips.select("tree_id", "node", "parent", "x", (F.row_number().over(w) - 1).cast("double").alias("y")), "tips")
    todo = nodes.join(rows.select("tree_id", "node"), ["tree_id", "node"], "left_anti")
    top = nodes.agg(F.max("depth")).first()[0] or 0
    for depth in range(top - 1, -1, -1):
        mean = rows.where("parent is not null").groupBy("tree_id", F.col("parent").alias("node")).agg(F.avg("y").alias("y"))
        level = todo.where(F.col("depth") == depth).join(mean, ["tree_id", "node"]).select("tree_id", "node", "parent", "x", "y")
        rows = scratch.cut(rows.unionByName(level), "rows", 2)
    return rows.select("tree_id", "node", "x", "y")


def radial(laid: DataFrame) -> DataFrame:
    """Layout on a circle: the rows of a tree's tips go once around, x is the radius."""
    tips = laid.groupBy("tree_id").agg((F.max("y") + 1).alias("n"))
    angle = 2 * math.pi * F.col("y") / F.col("n")
    return laid.join(tips, "tree_id").select("tree_id", "node", F.round(F.col("x") * F.cos(angle), 6).alias("px"), F.round(F.col("x") * F.sin(angle), 6).alias("py"))


def ancestral_states(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """(tree_id, node, character, cnt): what every tip below a node holds, at the least count. nodes as by ``placed``;
    states(tree_id, node, character, cnt) of the tips. An ancestor's state is an aggregate over its tips, not a bottom-up walk."""
    tips = states.select("tree_id", "node").distinct()
    inside = nodes.select("tree_id", F.explode("path").alias("parent")).distinct().withColumnRenamed("parent", "node")
    bare = nodes.select("tree_id", "node", F.slice("path", 1, F.size("path") - 1).alias("up")).where("size(up) >= 0")
    parents = nodes.where("parent is not null").select("tree_id", F.col("parent").alias("node")).distinct()
    ends = bare.join(parents, ["tree_id", "node"], "left_anti").select("tree_id", F.col("node").alias("tip"), F.explode("up").alias("node"))
    sizes = ends.groupBy("tree_id", "node").agg(F.count(F.lit(1)).alias("n"))
    held = ends.join(states.select("tree_id", F.col("node").alias("tip"), "character", "cnt").where("cnt > 0"), ["tree_id", "tip"]).groupBy("tree_id", "node", "character").agg(F.count(F.lit(1)).alias("k"), F.min("cnt").alias("cnt"))
    del tips, inside
    return held.join(sizes, ["tree_id", "node"]).where("k = n").select("tree_id", "node", "character", "cnt").unionByName(states.where("cnt > 0").select("tree_id", "node", "character", "cnt"))


def edge_traits(edges: DataFrame, all_states: DataFrame) -> DataFrame:
    """(tree_id, parent, child, character, change) where a character is gained or lost along an edge."""
    s = all_states.select("tree_id", "node", "character")
    below = edges.select("tree_id", "parent", "child").join(s.select("tree_id", F.col("node").alias("child"), "character"), ["tree_id", "child"])
    above = edges.select("tree_id", "parent", "child").join(s.select("tree_id", F.col("node").alias("parent"), "character"), ["tree_id", "parent"])
    key = ["tree_id", "parent", "child", "character"]
    return below.join(above, key, "left_anti").select(*key, F.lit("gained").alias("change")).unionByName(above.join(below, key, "left_anti").select(*key, F.lit("lost").alias("change")))


def tip_labels(nodes: DataFrame) -> DataFrame:
    """Inner nodes are called hypothetical ancestor 1, 2, ... by sorted id."""
    inner = nodes.where(F.col("node").startswith("__"))
    w = Window.partitionBy("tree_id").orderBy("node")
    named = inner.select("tree_id", "node", F.concat(F.lit("hypothetical ancestor "), F.row_number().over(w).cast("string")).alias("name"))
    return nodes.select("tree_id", "node").join(named, ["tree_id", "node"], "left").select("tree_id", "node", F.coalesce("name", "node").alias("label"))


def newick(edges: DataFrame) -> DataFrame:
    """(tree_id, newick): children by id, shortest lengths, quoted labels; invalid trees fail. One tree is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree_id": [pdf["tree_id"].iloc[0]], "newick": [newick_text(list(zip(pdf["parent"], pdf["child"], pdf["branch_length"])))]})

    return edges.select(F.col("tree_id").cast("string"), "parent", "child", F.col("branch_length").cast("double").alias("branch_length")).groupBy("tree_id").applyInPandas(run, "tree_id string, newick string")


def newick_text(rows: list[tuple[str, str, float]]) -> str:
    children: dict[str, list[tuple[str, float]]] = {}
    seen = set()
    for parent, child, length in rows:
        if child in seen or not math.isfinite(length) or length < 0:
            raise ValueError(f"edge to {child} is not valid")
        seen.add(child)
        children.setdefault(parent, []).append((child, length))
    tops = [p for p in children if p not in seen]
    if len(tops) != 1:
        raise ValueError(f"{len(tops)} roots")

    def quoted(label: str) -> str:
        return label if label and all(c.isalnum() or c in "._-" for c in label) else "'" + label.replace("'", "''") + "'"

    def number(x: float) -> str:
        return str(int(x)) if x == int(x) else repr(float(x))

    text: dict[str, str] = {}
    stack, reached = [(tops[0], False)], 0
    while stack:
        node, done = stack.pop()
        if node not in children:
            text[node] = quoted(node)
        elif done:
            text[node] = "(" + ",".join(f"{text.pop(c)}:{number(x)}" for c, x in sorted(children[node])) + ")"
        else:
            stack.append((node, True))
            stack.extend((c, False) for c, _ in children[node])
            reached += len(children[node])
    if reached != len(rows):
        raise ValueError("edges that the root doesn't reach")
    return text[tops[0]] + ";"
