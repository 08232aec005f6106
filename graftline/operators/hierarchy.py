"""Parent-child links to full hierarchies by heavy-path decomposition.

Plan, for n nodes (every loop doubles a pointer, so it runs O(log depth) rounds of two equi-joins on the node id):

1. ``subtrees``: pointer doubling; round k adds to a node's size what the nodes 2^k below it gathered. Nodes whose
   pointer never runs off a root lie on or below a cycle; they are separated when a round frees no further node.
2. heavy child = child with the largest subtree. A node that isn't its parent's heavy child heads a chain; positions in
   chains come from doubling along heavy links only.
3. A path crosses at most log2(n) chains. Chains are contracted to one row each and doubled over their attachment, which
   concatenates the chain segments (chain, last position): depth, root and the segments of every node follow.
4. Paths and descendants are read off the segments: ancestors are prefixes of chains, so descendants of a node are the
   nodes with a segment of its chain that reaches at least its position (an equi-join on the chain).

Nulls: links with a null child or parent are ignored (a null parent only makes its child known as a node). Repeated links
count once; a child with several parents takes the smallest. A link to oneself is a cycle. An empty table gives an empty
result. Further columns are ignored. No id may be the empty result marker ``cycle``: root_id is that word for nodes on or
below a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.session import Scratch

SEGMENT = "array<struct<chain:string,upto:int>>"


def _nodes(links: DataFrame, child: str, parent: str) -> DataFrame:
    pairs = links.select(F.col(child).cast("string").alias("node"), F.col(parent).cast("string").alias("parent"))
    both = pairs.where("node is not null").unionByName(pairs.where("parent is not null").select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
    return both.groupBy("node").agg(F.min("parent").alias("parent"))


def subtrees(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """nodes(node, parent) -> (node, parent, size, on_tree): subtree sizes of tree nodes; on_tree false on or below a cycle."""
    state = scratch.cut(nodes.select("node", "parent", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("size")), "subtree", 1)
    open_now = state.where("up is not null").count()
    while open_now:
        gain = state.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.try_sum("size").alias("gain"))
        ahead = state.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        moved = state.where("up is not null").join(ahead, "up").select("node", "parent", F.col("up2").alias("up"), "size")
        step = state.where("up is null").unionByName(moved).join(gain, "node", "left")  # rows without a pointer aren't shuffled by it
        state = scratch.cut(step.select("node", "parent", "up", F.expr("try_add(size, coalesce(gain, 0))").alias("size")), "subtree", 2)
        still = state.where("up is not null").count()
        if still == open_now:
            break
        open_now = still
    return state.select("node", "parent", "size", F.col("up").isNull().alias("on_tree"))


def chains(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """Tree nodes (node, parent, size) -> (node, parent, chain, pos): heavy paths, named by their topmost node."""
    heavy = tree.where("parent is not null").groupBy("parent").agg(F.max(F.struct("size", "node")).alias("h")).select(F.col("h.node").alias("node"), F.lit(True).alias("is_heavy"))
    start = tree.join(heavy, "node", "left")
    state = scratch.cut(
        start.select("node", "parent", F.when(F.col("is_heavy"), F.col("parent")).alias("jump"), F.when(F.col("is_heavy"), F.lit(1)).otherwise(F.lit(0)).alias("pos"), F.when(F.col("is_heavy").isNull(), F.col("node")).alias("chain")),
        "chain",
        1,
    )
    while not state.where("chain is null").isEmpty():
        ahead = state.select(F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("pos").alias("pos2"), F.col("chain").alias("chain2"))
        step = state.where("chain is null").join(ahead, "jump").select("node", "parent", F.col("jump2").alias("jump"), (F.col("pos") + F.col("pos2")).alias("pos"), F.col("chain2").alias("chain"))
        state = scratch.cut(state.where("chain is not null").unionByName(step), "chain", 2)
    return state.select("node", "parent", "chain", "pos")


def chain_tops(labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, parent, chain, pos) -> one row per chain: root, depth of its head, segments of the path above its head."""
    heads = labelled.where("pos = 0").select(F.col("chain"), F.col("parent").alias("node"))
    below = labelled.select("node", F.col("chain").alias("up"), F.col("pos").alias("at"))
    start = heads.join(below, "node", "left")
    state = scratch.cut(
        start.select(
            "chain",
            "up",
            F.coalesce("up", "chain").alias("root"),
            F.coalesce(F.col("at") + 1, F.lit(0)).alias("head_depth"),
            F.when(F.col("up").isNotNull(), F.array(F.struct(F.col("up").alias("chain"), F.col("at").alias("upto")))).otherwise(F.array().cast(SEGMENT)).cast(SEGMENT).alias("above"),
        ),
        "top",
        1,
    )
    while not state.where("up is not null").isEmpty():
        ahead = state.select(F.col("chain").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("head_depth").alias("more"), F.col("above").alias("above2"))
        step = state.where("up is not null").join(ahead, "up").select("chain", F.col("up2").alias("up"), F.col("root2").alias("root"), (F.col("head_depth") + F.col("more")).alias("head_depth"), F.concat("above", "above2").alias("above"))
        state = scratch.cut(state.where("up is null").unionByName(step), "top", 2)
    return state.select("chain", "root", "head_depth", "above")


def decompose(links: DataFrame, child: str = "child", parent: str = "parent", scratch: Scratch | None = None) -> DataFrame:
    """One row per node: node, parent, root_id, tree_depth, chain, pos, subtree_size, segments (from the node upwards).

    Nodes on or below a cycle: root_id ``cycle``, tree_depth -1, the rest null.
    """
    scratch = scratch or Scratch(links.sparkSession, "hierarchy")
    sized = subtrees(_nodes(links, child, parent), scratch)
    tree = sized.where("on_tree").select("node", "parent", "size")
    labelled = chains(tree, scratch)
    tops = chain_tops(labelled, scratch)
    placed = labelled.join(tops, "chain").select(
        "node", "root", (F.col("head_depth") + F.col("pos")).alias("tree_depth"), "chain", "pos", F.concat(F.array(F.struct(F.col("chain").alias("chain"), F.col("pos").alias("upto"))).cast(SEGMENT), F.col("above")).alias("segments")
    )
    return sized.join(placed, "node", "left").select(
        "node",
        "parent",
        F.when(F.col("on_tree"), F.col("root")).otherwise(F.lit("cycle")).alias("root_id"),
        F.when(F.col("on_tree"), F.col("tree_depth")).otherwise(F.lit(-1)).cast("int").alias("tree_depth"),
        "chain",
        "pos",
        F.when(F.col("on_tree"), F.col("size")).alias("subtree_size"),
        "segments",
    )


def ancestors(placed: DataFrame) -> DataFrame:
    """(node, ancestor, ancestor_depth) for every node and each of its ancestors, itself included: chain intervals joined
    to the members of the chain. The result is as large as the sum of depths; nothing is gathered in one task."""
    members = placed.where("chain is not null").select("chain", "pos", F.col("node").alias("ancestor"), F.col("tree_depth").alias("ancestor_depth"))
    spans = placed.where("chain is not null").select("node", F.explode("segments").alias("s")).select("node", F.col("s.chain").alias("chain"), F.col("s.upto").alias("upto"))
    return spans.join(members, "chain").where("pos <= upto").select("node", "ancestor", "ancestor_depth")


def paths(placed: DataFrame, separator: str = "/") -> DataFrame:
    """node, path: ids from the root to the node. A path holds as many ids as the node is deep, so one group is one row."""
    return ancestors(placed).groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ancestor_depth", "ancestor"))), lambda x: x["ancestor"]), separator).alias("path"))


def descendants(placed: DataFrame) -> DataFrame:
    """(node, descendant): the chain intervals read the other way; a node is not its own descendant."""
    return ancestors(placed).where("node <> ancestor").select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"))


def cycles(placed: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(cycle_id, node) for the nodes that lie on a cycle (not those below one); cycle_id is the smallest node on it.

    Images under ever longer jumps shrink to the periodic nodes: once a doubling keeps their number, the jump permutes
    them. Their minimum then spreads by the same doubling.
    """
    scratch = scratch or Scratch(placed.sparkSession, "cycles")
    step = scratch.cut(placed.where("tree_depth = -1").select("node", F.col("parent").alias("up")), "step", 1)
    ring = step.select(F.col("up").alias("node")).distinct()
    size, before = ring.count(), -1
    while size != before:
        ahead = step.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        step = scratch.cut(step.join(ahead, "up").select("node", F.col("up2").alias("up")), "step", 2)
        before, ring = size, step.select(F.col("up").alias("node")).distinct()
        size = ring.count()
    first = placed.where("tree_depth = -1").join(ring, "node", "left_semi")
    state = scratch.cut(first.select("node", F.col("parent").alias("up"), F.least("node", "parent").alias("low")), "low", 1)
    moved = size > 0
    while moved:
        ahead = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        state = scratch.cut(state.join(ahead, "up").select("node", F.col("up2").alias("up"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")), "low", 2)
        moved = not state.where("moved").isEmpty()
    return state.select(F.col("low").alias("cycle_id"), "node")
