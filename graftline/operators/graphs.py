"""Operator graphs as plain tables.

vertices(graph_id, node_id, operation, attributes) and edges(graph_id, source, target, position); attributes is canonical JSON
text. Any number of graphs is processed at once: everything is keyed by (graph_id, node_id).

Nulls: rows with a null key column are invalid (``invariant_violations`` reports them) and take no part in joins. Repeated
rows are reported as duplicates. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = ["graph_id", "node_id"]


def graph_summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    v = vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("vertex_count"))
    e = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edge_count"))
    return v.join(e, "graph_id", "left").select("graph_id", "vertex_count", F.coalesce("edge_count", F.lit(0).cast("bigint")).alias("edge_count"))


def edge_id(source: Column, target: Column, position: Column) -> Column:
    return F.concat(source, F.lit("->"), target, F.lit("@"), position)


def argument_positions(nodes: DataFrame) -> DataFrame:
    """nodes(graph_id, name, inputs array) -> edges with default positions arg:000000, arg:000001, ... in input order."""
    return nodes.select("graph_id", F.col("name").alias("target"), F.posexplode("inputs").alias("at", "source")).select("graph_id", "source", "target", F.format_string("arg:%06d", "at").alias("position"))


def port_labels(edges: DataFrame, commutative: DataFrame) -> DataFrame:
    """edges + port: ``operand`` where the consumer declares itself commutative (commutative(graph_id, node_id)), resources
    excepted; else the position."""
    flag = commutative.select("graph_id", F.col("node_id").alias("target"), F.lit(True).alias("free")).distinct()
    port = F.when(F.col("free") & ~F.col("position").startswith("resource:"), F.lit("operand")).otherwise(F.col("position"))
    return edges.join(flag, ["graph_id", "target"], "left").withColumn("port", port).drop("free")


def renumber_operands(edges: DataFrame) -> DataFrame:
    """Operands of a target numbered operand:000000, ... by source, then position: order of writing no longer matters."""
    w = Window.partitionBy("graph_id", "target").orderBy("source", "position")
    return edges.withColumn("position", F.format_string("operand:%06d", F.row_number().over(w) - 1))


def invariant_violations(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, kind, subject): duplicate_node, duplicate_edge, unknown_source, unknown_target, null_key."""
    twice = vertices.groupBy(*NODE).count().where("count > 1").select("graph_id", F.lit("duplicate_node").alias("kind"), F.col("node_id").alias("subject"))
    again = edges.groupBy("graph_id", "source", "target", "position").count().where("count > 1").select("graph_id", F.lit("duplicate_edge").alias("kind"), edge_id(F.col("source"), F.col("target"), F.col("position")).alias("subject"))
    known = vertices.select(*NODE).distinct()
    ends = [
        edges.select("graph_id", F.col(end).alias("node_id")).join(known, NODE, "left_anti").select("graph_id", F.lit(f"unknown_{end}").alias("kind"), F.col("node_id").alias("subject")).distinct()
        for end in ("source", "target")
    ]
    empty = vertices.where("graph_id is null or node_id is null").select("graph_id", F.lit("null_key").alias("kind"), F.col("node_id").alias("subject"))
    return twice.unionByName(again).unionByName(ends[0]).unionByName(ends[1]).unionByName(empty)


def cyclic_graphs(vertices: DataFrame, edges: DataFrame, scratch) -> DataFrame:
    """graph_id of graphs with a cycle: nodes without incoming edges are peeled off until none is left to peel."""
    nodes, left = vertices.select(*NODE).distinct(), edges.select("graph_id", "source", "target").distinct()
    while True:
        targets = left.select("graph_id", F.col("target").alias("node_id")).distinct()
        inner = scratch.cut(left.join(targets.withColumnRenamed("node_id", "source"), ["graph_id", "source"], "left_semi"), "peel", 2)
        a, b = left.count(), inner.count()
        left = inner
        if b == 0 or a == b:
            return left.select("graph_id").distinct().join(nodes.select("graph_id").distinct(), "graph_id", "left_semi")


def json_text(c: Column) -> Column:
    """A string as JSON text in quotes, escapes included."""
    plain = F.concat(F.lit('"'), c, F.lit('"'))
    return F.when(c.rlike(r'["\\\\\x00-\x1f]'), F.regexp_extract(F.to_json(F.struct(c.alias("s"))), r'^\{"s":([\s\S]*)\}$', 1)).otherwise(plain)


def structural_digest(vertices: DataFrame, edges: DataFrame, schema_version: str = "2.0.0") -> DataFrame:
    """graph_id, structural_digest: SHA-256 of the canonical JSON of sorted edges and nodes; empty attributes are omitted.

    A graph's rows are gathered, as its digest covers them in order."""
    node = F.concat(F.when(F.col("attributes") == "{}", F.lit("{")).otherwise(F.concat(F.lit('{"attributes":'), F.col("attributes"), F.lit(","))), F.lit('"id":'), json_text(F.col("node_id")), F.lit(',"operation":'), json_text(F.col("operation")), F.lit("}"))
    edge = F.concat(F.lit('{"position":'), json_text(F.col("position")), F.lit(',"source":'), json_text(F.col("source")), F.lit(',"target":'), json_text(F.col("target")), F.lit("}"))
    line = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("json")))), lambda x: x["json"]), ",")
    n = vertices.groupBy("graph_id").agg(line(["node_id"], node).alias("nodes"))
    e = edges.groupBy("graph_id").agg(line(["source", "target", "position"], edge).alias("edges"))
    text = F.concat(F.lit('{"edges":['), F.coalesce("edges", F.lit("")), F.lit('],"nodes":['), F.col("nodes"), F.lit('],"schema_version":"' + schema_version + '"}'))
    return n.join(e, "graph_id", "left").select("graph_id", F.sha2(text, 256).alias("structural_digest"))


def ancestors(edges: DataFrame, scratch) -> DataFrame:
    """(graph_id, node_id, ancestor, depth): least number of edges up to each ancestor.

    Depths double every round: an ancestor at a depth of k + 1 to 2 k lies at 1 to k above one at exactly k. A round joins
    the pairs of exactly k with all found so far, so a graph of depth d takes log2(d) rounds; a cycle ends, too."""
    key = ["graph_id", "node_id", "ancestor"]
    up = edges.select("graph_id", F.col("target").alias("node_id"), F.col("source").alias("ancestor")).distinct()
    folder, k = scratch.path("closure"), 1
    level, found = scratch.grow(up.withColumn("depth", F.lit(1)), folder)
    while not level.isEmpty():
        first = level.where(F.col("depth") == k).select("graph_id", "node_id", F.col("ancestor").alias("via"))
        above = found.select("graph_id", F.col("node_id").alias("via"), "ancestor", "depth")
        far = first.join(above, ["graph_id", "via"]).groupBy(*key).agg((F.min("depth") + k).cast("int").alias("depth"))
        level, found = scratch.grow(far.join(found.select(*key), key, "left_anti"), folder)
        k *= 2
    return found


def canonical_order(vertices: DataFrame, edges: DataFrame, budget: int = 100_000) -> DataFrame:
    """(graph_id, node_id, canonical_id): n000000, ... in a topological order that doesn't depend on the given ids.

    Colours are refined from operation, attributes and the labelled in- and out-neighbours to a stable partition; of the ready
    nodes the one of least colour comes first, and among equal ones each is tried, the order with the least certificate winning.
    Nodes with the same neighbours in the same ports are interchangeable, so only one of them is tried. A graph that needs more
    than ``budget`` tries fails. One graph is one group.
    """
    packed = vertices.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", "operation", "attributes")).alias("nodes")).join(
        edges.groupBy("graph_id").agg(F.collect_list(F.struct("source", "target", "position")).alias("links")), "graph_id", "left"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for graph, nodes, links in zip(pdf["graph_id"], pdf["nodes"], pdf["links"]):
                order = _canonical([(n["node_id"], n["operation"], n["attributes"]) for n in nodes], [] if links is None else [(e["source"], e["target"], e["position"]) for e in links], budget)
                yield pd.DataFrame({"graph_id": [graph] * len(order), "node_id": order, "canonical_id": [f"n{i:06d}" for i in range(len(order))]})

    return packed.mapInPandas(run, f"graph_id {vertices.schema['graph_id'].dataType.simpleString()}, node_id string, canonical_id string")


def _canonical(nodes: list[tuple[str, str, str]], links: list[tuple[str, str, str]], budget: int) -> list[str]:
    ins: dict[str, list] = {n: [] for n, _, _ in nodes}
    outs: dict[str, list] = {n: [] for n, _, _ in nodes}
    for s, t, p in links:
        ins[t].append((p, s))
        outs[s].append((p, t))
    label = {n: (op, at or "{}") for n, op, at in nodes}
    rank = {k: i for i, k in enumerate(sorted(set(label.values())))}
    colour = {n: rank[label[n]] for n in label}
    while True:
        full = {n: (colour[n], tuple(sorted((p, colour[s]) for p, s in ins[n])), tuple(sorted((p, colour[t]) for p, t in outs[n]))) for n in colour}
        rank = {k: i for i, k in enumerate(sorted(set(full.values())))}
        new = {n: rank[full[n]] for n in full}
        if len(rank) == len(set(colour.values())):
            break
        colour = new
    return _least_order(colour, ins, outs, budget)


def _least_order(colour: dict[str, int], ins: dict[str, list], outs: dict[str, list], budget: int) -> list[str]:
    """The topological order with the least certificate among those that take nodes of least colour first. Choices are kept on a
    stack and undone, so one step costs what the node's edges cost, however large the graph is."""
    waiting = {n: len(ins[n]) for n in colour}
    ready: dict[int, set[str]] = {}
    for n, k in waiting.items():
        if k == 0:
            ready.setdefault(colour[n], set()).add(n)
    order: list[str] = []
    place: dict[str, int] = {}
    path: list[tuple] = []  # certificate so far
    best: list[tuple] | None = None
    best_order: list[str] = []
    choices: list[tuple[int, list[str], bool]] = []  # length of the order, what is still to try, whether equal to the best so far
    tries, equal = 0, False  # equal: the path is a prefix of the best certificate

    def take(n: int | str) -> None:
        ready[colour[n]].discard(n)
        if not ready[colour[n]]:
            del ready[colour[n]]
        place[n] = len(order)
        order.append(n)
        for _, t in outs[n]:
            waiting[t] -= 1
            if waiting[t] == 0:
                ready.setdefault(colour[t], set()).add(t)

    def untake() -> None:
        n = order.pop()
        for _, t in outs[n]:
            if waiting[t] == 0:
                ready[colour[t]].discard(t)
                if not ready[colour[t]]:
                    del ready[colour[t]]
            waiting[t] += 1
        del place[n]
        path.pop()
        ready.setdefault(colour[n], set()).add(n)

    def step(n: str) -> bool:
        """Take a node; False if its certificate is worse than the best."""
        nonlocal equal
        sign = (colour[n], tuple(sorted((p, place[s]) for p, s in ins[n])))
        if best is not None and equal:
            other = best[len(path)]
            if sign > other:
                return False
            equal = sign == other
        take(n)
        path.append(sign)
        return True

    alive = True
    while True:
        while alive and len(order) < len(colour):
            if not ready:
                raise ValueError("the graph has a cycle")
            least = ready[min(ready)]
            if len(least) == 1:
                alive = step(next(iter(least)))
                continue
            twins: dict[tuple, str] = {}
            for n in sorted(least):
                twins.setdefault((tuple(sorted(ins[n])), tuple(sorted(outs[n]))), n)
            options = list(twins.values())
            tries += len(options) - 1
            if tries > budget:
                raise ValueError(f"more than {budget} choices to label a graph")
            if len(options) > 1:
                choices.append((len(order), options[1:], equal))
            alive = step(options[0])
        if alive and (best is None or not equal):
            best, best_order = list(path), list(order)
        if not choices:
            return best_order
        length, rest, was_equal = choices.pop()
        while len(order) > length:
            untake()
        if len(rest) > 1:
            choices.append((length, rest[1:], was_equal))
        # what was equal to an older best may differ from a newer one only behind this point
        equal = best is not None and path == best[: len(path)]
        alive = step(rest[0])
