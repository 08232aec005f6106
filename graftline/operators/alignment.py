"""Alignment of two operator graphs: matched nodes along a longest common subsequence, edit operations, bounds, replay, validation.

sides(pair_id, side, at, node_id, token): the nodes of both graphs of a pair in canonical order; edges(pair_id, side, source,
target, position, port). A pair needs both sequences at once, so one pair is one group; pairs go in parallel. Beyond ``CELLS``
table cells a pair fails rather than being cut; equal sequences need no table.

Alignments are solved in the order of the graphs' digests and turned back (``oriented``, ``restored``), so that the alignment of
b with a is that of a with b inverted.

Nulls: nodes without a token match nothing. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1_000_000
#: Replay order of the kinds of operations.
KINDS = ["remove_edge", "remove_node", "add_node", "add_edge"]


def longest_common(a: list[str], b: list[str], cells: int = CELLS) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; a match is taken before skipping left, that before skipping right."""
    return _traced(a, b, cells)[0]


def _traced(a: list[str], b: list[str], cells: int = CELLS) -> tuple[list[tuple[int, int]], int]:
    """Index pairs, and at how many places of the way another step would have been as good.

    A row of the table is the running maximum, from the right, of the row below and its diagonal: one numpy step a row."""
    if a == b:
        return [(i, i) for i in range(len(a))], 0
    if (len(a) + 1) * (len(b) + 1) > cells:
        raise ValueError(f"{len(a) + 1} x {len(b) + 1} cells; at most {cells}")
    number = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([number[t] for t in s], np.int64) for s in (a, b))
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        row = np.maximum(best[i + 1, :-1], best[i + 1, 1:] + (y == x[i]))
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    i = j = ties = 0
    found = []
    while i < len(a) and j < len(b):
        now = best[i, j]
        match, left, right = x[i] == y[j], best[i + 1, j] == now, best[i, j + 1] == now
        ties += int(match) + int(left) + int(right) > 1
        if match:
            found.append((i, j))
        i, j = i + int(match or left), j + int(match or not left)
    return found, ties


def oriented(frame: DataFrame, digests: DataFrame) -> DataFrame:
    """``frame`` (pair_id, side, ...) with its sides in the order of digests(pair_id, left_digest, right_digest)."""
    turn = digests.select("pair_id", (F.col("left_digest") > F.col("right_digest")).alias("_turned"))
    other = F.when(F.col("side") == "left", "right").otherwise("left")
    return frame.join(turn, "pair_id").withColumn("side", F.when(F.col("_turned"), other).otherwise(F.col("side"))).drop("_turned")


def restored(frame: DataFrame, digests: DataFrame) -> DataFrame:
    """Matches or operations of oriented pairs turned back to the order that was asked for: left and right columns change places,
    additions become removals."""
    turned = frame.join(digests.where("left_digest > right_digest").select("pair_id"), "pair_id", "left_semi")
    kept = frame.join(digests.where("left_digest > right_digest").select("pair_id"), "pair_id", "left_anti")
    swap = {c: c.replace("left_", "right_", 1) if c.startswith("left_") else c.replace("right_", "left_", 1) if c.startswith("right_") else c for c in frame.columns}
    back = turned.select(*[F.col(swap[c]).alias(c) for c in frame.columns])
    return kept.unionByName(inverted(back) if "kind" in frame.columns else back)


def node_matches(sides: DataFrame) -> DataFrame:
    """(pair_id, left_id, right_id, ties): ties is the same for all rows of a pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = {k: g.sort_values("at") for k, g in pdf[pdf["token"].notna()].groupby("side")}
        none = pdf.iloc[:0]
        left, right = s.get("left", none), s.get("right", none)
        m, ties = _traced(left["token"].tolist(), right["token"].tolist())
        l_ids, r_ids = left["node_id"].tolist(), right["node_id"].tolist()
        return pd.DataFrame({"pair_id": [pdf["pair_id"].iloc[0]] * len(m), "left_id": [l_ids[i] for i, _ in m], "right_id": [r_ids[j] for _, j in m], "ties": [ties] * len(m)}, dtype=object)

    return sides.select("pair_id", "side", "at", "node_id", "token").groupBy("pair_id").applyInPandas(run, f"pair_id {sides.schema['pair_id'].dataType.simpleString()}, left_id string, right_id string, ties int")


def _numbered(edges: DataFrame) -> DataFrame:
    """edges + no: parallel edges of one port in the order of their positions."""
    w = Window.partitionBy("pair_id", "side", "source", "target", "port").orderBy("position")
    return edges.withColumn("no", F.row_number().over(w))


def edge_matches(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pair_id, left_source, left_target, right_source, right_target, port, no): edges between matched nodes with one port
    label; parallel edges are matched in order."""
    e = _numbered(edges)
    left = e.where("side = 'left'").select("pair_id", F.col("source").alias("left_source"), F.col("target").alias("left_target"), "port", "no")
    right = e.where("side = 'right'").select("pair_id", F.col("source").alias("right_source"), F.col("target").alias("right_target"), "port", "no")
    m = left.join(nodes.select("pair_id", F.col("left_id").alias("left_source"), F.col("right_id").alias("right_source")), ["pair_id", "left_source"]).join(nodes.select("pair_id", F.col("left_id").alias("left_target"), F.col("right_id").alias("right_target")), ["pair_id", "left_target"])
    return m.join(right, ["pair_id", "right_source", "right_target", "port", "no"]).select("pair_id", "left_source", "left_target", "right_source", "right_target", "port", "no")


def operations(sides: DataFrame, edges: DataFrame, nodes: DataFrame, matched: DataFrame, costs: dict[str, float] | None = None) -> DataFrame:
    """(pair_id, kind, ref, cost, at, token, source, target, position, port, operation_id): what turns the left graph into the right
    one; an operation carries all that it adds or removes. The id is a digest of it. ``costs``: by kind, 1 where missing, positive."""
    for kind, cost in (costs or {}).items():
        if kind not in KINDS or isinstance(cost, bool) or not 0 < cost < float("inf"):
            raise ValueError(f"no cost of an operation: {kind} {cost}")
    e = _numbered(edges)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    ref = F.concat(F.col("source"), F.lit("->"), F.col("target"), F.lit("@"), F.col("position"))
    out = []
    for side, verb in (("left", "remove"), ("right", "add")):
        cost = lambda what: F.lit(float((costs or {}).get(f"{verb}_{what}", 1.0))).alias("cost")  # noqa: B023, E731
        gone = sides.where(F.col("side") == side).join(nodes.select("pair_id", F.col(f"{side}_id").alias("node_id")), ["pair_id", "node_id"], "left_anti")
        out.append(gone.select("pair_id", F.lit(f"{verb}_node").alias("kind"), F.col("node_id").alias("ref"), cost("node"), F.col("at").cast("int").alias("at"), "token", *none("string", "source", "target", "position", "port")))
        left = e.where(F.col("side") == side).join(matched.select("pair_id", F.col(f"{side}_source").alias("source"), F.col(f"{side}_target").alias("target"), "port", "no"), ["pair_id", "source", "target", "port", "no"], "left_anti")
        out.append(left.select("pair_id", F.lit(f"{verb}_edge").alias("kind"), ref.alias("ref"), cost("edge"), *none("int", "at"), *none("string", "token"), "source", "target", "position", "port"))
    every = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    return _identified(every)


def _identified(ops: DataFrame) -> DataFrame:
    return ops.withColumn("operation_id", F.sha2(F.to_json(F.struct("cost", "kind", "port", "position", "ref", "token")), 256))


def replay_order(ops: DataFrame) -> DataFrame:
    """ops + step: 1, 2, ... within each pair: edges go before their nodes and come after them; ties by id."""
    rank = F.array_position(F.lit(KINDS), F.col("kind"))
    return ops.withColumn("step", F.row_number().over(Window.partitionBy("pair_id").orderBy(rank, "operation_id")))


def inverted(ops: DataFrame) -> DataFrame:
    """The operations that lead back."""
    swap = F.when(F.col("kind").startswith("add"), F.regexp_replace("kind", "^add", "remove")).otherwise(F.regexp_replace("kind", "^remove", "add"))
    back = ops.withColumn("kind", swap)
    return _identified(back) if "operation_id" in ops.columns else back


def _gap(labelled: DataFrame, keys: list[str]) -> DataFrame:
    n = labelled.groupBy("pair_id", *keys).agg(F.count_if(F.col("side") == "left").alias("l"), F.count_if(F.col("side") == "right").alias("r"))
    return n.groupBy("pair_id").agg(F.sum(F.abs(F.col("l") - F.col("r"))).cast("bigint").alias("bound"))


def node_lower_bound(sides: DataFrame) -> DataFrame:
    """(pair_id, bound): nodes that no alignment can match, from the counts of tokens on both sides."""
    return _gap(sides, ["token"])


def _tokened(edges: DataFrame, sides: DataFrame) -> DataFrame:
    key = lambda end: sides.select("pair_id", "side", F.col("node_id").alias(end), F.col("token").alias(f"{end}_token"))
    return edges.join(key("source"), ["pair_id", "side", "source"]).join(key("target"), ["pair_id", "side", "target"])


def edge_lower_bound(sides: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair_id, bound): edges that no alignment can match, from the counts of (source token, target token, port)."""
    return _gap(_tokened(edges, sides), ["source_token", "target_token", "port"])


def ambiguities(sides: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pair_id, context, left_ids, right_ids, matched): local contexts (a node's token and those of its neighbours by port) that both
    graphs have and one of them more than once: their nodes could be matched otherwise. matched counts matches inside one."""
    t = _tokened(edges, sides)
    around = lambda own, other, out: t.groupBy("pair_id", "side", F.col(own).alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("port", F.col(f"{other}_token").alias("token")))).alias(out))
    none = F.array().cast("array<struct<port:string,token:string>>")
    full = sides.join(around("target", "source", "ins"), ["pair_id", "side", "node_id"], "left").join(around("source", "target", "outs"), ["pair_id", "side", "node_id"], "left")
    context = full.select("pair_id", "side", "node_id", F.sha2(F.to_json(F.struct(F.coalesce("ins", none).alias("incoming"), F.col("token").alias("node"), F.coalesce("outs", none).alias("outgoing"))), 256).alias("context")).hint("merge")  # a row a node, packed small
    ids = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("node_id"))))
    groups = context.groupBy("pair_id", "context").agg(ids("left").alias("left_ids"), ids("right").alias("right_ids")).where("size(left_ids) > 0 and size(right_ids) > 0 and size(left_ids) + size(right_ids) > 2")
    own = lambda side: context.where(F.col("side") == side).select("pair_id", F.col("node_id").alias(f"{side}_id"), F.col("context").alias(f"{side}_context"))
    hits = nodes.join(own("left"), ["pair_id", "left_id"]).join(own("right"), ["pair_id", "right_id"]).where("left_context = right_context").groupBy("pair_id", F.col("left_context").alias("context")).agg(F.count(F.lit(1)).alias("matched"))
    return groups.join(hits, ["pair_id", "context"], "left").select("pair_id", "context", "left_ids", "right_ids", F.coalesce("matched", F.lit(0)).alias("matched"))


def replay(left_nodes: DataFrame, left_edges: DataFrame, ops: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The right graph rebuilt from the left one (pair_id, node_id, token; pair_id, source, target, position, port), the operations
    and the matches alone: (pair_id, node_id, token) and (pair_id, source, target, port, n), ids being the right graph's.

    What no operation removes keeps its place under its partner's id. Parallel edges of one port are counted."""
    of = lambda kind: ops.where(F.col("kind") == kind)
    stay = left_nodes.join(of("remove_node").select("pair_id", F.col("ref").alias("node_id")), ["pair_id", "node_id"], "left_anti")
    name = nodes.select("pair_id", F.col("left_id").alias("node_id"), F.col("right_id").alias("new"))
    kept = stay.join(name, ["pair_id", "node_id"]).select("pair_id", F.col("new").alias("node_id"), "token")
    new_nodes = kept.unionByName(of("add_node").select("pair_id", F.col("ref").alias("node_id"), "token"))
    left = left_edges.join(of("remove_edge").select("pair_id", "source", "target", "position"), ["pair_id", "source", "target", "position"], "left_anti")
    for end in ("source", "target"):
        left = left.join(name.select("pair_id", F.col("node_id").alias(end), F.col("new").alias(f"new_{end}")), ["pair_id", end])
    moved = left.select("pair_id", F.col("new_source").alias("source"), F.col("new_target").alias("target"), "port")
    new_edges = moved.unionByName(of("add_edge").select("pair_id", "source", "target", "port"))
    return new_nodes, new_edges.groupBy("pair_id", "source", "target", "port").agg(F.count(F.lit(1)).alias("n"))


def validation(sides: DataFrame, edges: DataFrame, nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """(pair_id, total_cost, lower_bound, bound_closed, replayed): whether the operations rebuild the right graph from the left, and
    whether their number is the least that any alignment needs (unit costs)."""
    plain = lambda side: sides.where(F.col("side") == side).select("pair_id", "node_id", "token")
    wires = lambda side: edges.where(F.col("side") == side).select("pair_id", "source", "target", "position", "port")
    n, e = replay(plain("left"), wires("left"), ops, nodes)
    want = wires("right").groupBy("pair_id", "source", "target", "port").agg(F.count(F.lit(1)).alias("n"))
    odd = n.exceptAll(plain("right")).select("pair_id").unionByName(plain("right").exceptAll(n).select("pair_id")).unionByName(e.exceptAll(want).select("pair_id")).unionByName(want.exceptAll(e).select("pair_id")).distinct()
    cost = ops.groupBy("pair_id").agg(F.sum("cost").alias("total_cost"), F.count(F.lit(1)).alias("steps"))
    bound = node_lower_bound(sides).withColumnRenamed("bound", "nb").join(edge_lower_bound(sides, edges).withColumnRenamed("bound", "eb"), "pair_id", "left")
    full = bound.join(cost, "pair_id", "left").join(odd.withColumn("odd", F.lit(True)), "pair_id", "left")
    low = F.col("nb") + F.coalesce("eb", F.lit(0))
    return full.select("pair_id", F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"), low.alias("lower_bound"), (F.coalesce("steps", F.lit(0)) == low).alias("bound_closed"), F.col("odd").isNull().alias("replayed"))
