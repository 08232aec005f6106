"""Anonymous structural characters: neighbourhood labels over radii, fork and join regions, counts and occurrences.

Labels are SHA-256 digests of canonical JSON that is put together as text. A round is two joins of the edges with the labels of the round before; graphs of any number go through at once.

Nulls: nodes with a null operation have no label and take no part. Repeated rows count as often as they occur, as in the
graph they would be distinct nodes. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.operators.graphs import ancestors, edge_id, json_text

#: Levels that branches are walked up one by one.
WALK = 4

# Names of the generators, part of every character's identity.
NEIGHBOURHOOD, REGION = "directed_wl_neighborhood.v1", "fork_join_region.v1"
DISCOVERY = "fork_join.v1"


def character_id(generator: str, signature: Column, radius: Column | None = None) -> Column:
    """SHA-256 of {"generator", "parameters", "structural_signature"}."""
    parameters = F.lit("{}") if radius is None else F.concat(F.lit('{"radius":'), radius.cast("string"), F.lit("}"))
    return F.sha2(F.concat(F.lit(f'{{"generator":"{generator}","parameters":'), parameters, F.lit(',"structural_signature":"'), signature, F.lit('"}')), 256)


def _lists(edges: DataFrame, labels: DataFrame, own: str, other: str, out: str) -> DataFrame:
    pair = F.concat(F.lit("["), json_text(F.col("port")), F.lit(',"'), F.col("label"), F.lit('"]'))
    near = edges.join(labels.withColumnRenamed("node_id", other), ["graph_id", other])
    return near.groupBy("graph_id", F.col(own).alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("port", "label", pair.alias("json")))), lambda x: x["json"]), ",").alias(out))


def labels(vertices: DataFrame, edges: DataFrame, radius: int, scratch=None) -> DataFrame:
    """(graph_id, node_id, radius, label) for radii 0 .. ``radius``; edges with their port labels (column ``port``)."""
    start = F.sha2(F.concat(F.lit('["operator",'), json_text(F.col("operation")), F.lit(',"attributes",'), F.coalesce("attributes", F.lit("{}")), F.lit("]")), 256)
    edges = scratch.cut(edges.select("graph_id", "source", "target", "port"), "edges", weigh=True) if scratch and radius else edges
    now = vertices.where("operation is not null").select("graph_id", "node_id", start.alias("label"))
    now = scratch.cut(now, "labels", weigh=True) if scratch else now
    rounds = [now.withColumn("radius", F.lit(0))]
    for r in range(1, radius + 1):
        i, o = _lists(edges, now, "target", "source", "ins"), _lists(edges, now, "source", "target", "outs")
        text = F.concat(F.lit('{"in":['), F.coalesce("ins", F.lit("")), F.lit('],"out":['), F.coalesce("outs", F.lit("")), F.lit('],"self":"'), F.col("label"), F.lit('"}'))
        now = now.join(i, ["graph_id", "node_id"], "left").join(o, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.sha2(text, 256).alias("label"))
        now = scratch.cut(now, "labels", weigh=True) if scratch else now
        rounds.append(now.withColumn("radius", F.lit(r)))
    return reduce(DataFrame.unionByName, rounds).select("graph_id", "node_id", "radius", "label")


def fingerprint(labelled: DataFrame) -> DataFrame:
    """(graph_id, radius, feature, cnt)."""
    return labelled.groupBy("graph_id", "radius", F.col("label").alias("feature")).agg(F.count(F.lit(1)).alias("cnt"))


def states(labelled: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(graph_id, character_id, cnt): counts of neighbourhood characters, and of regions(graph_id, signature) if given."""
    rows = labelled.select("graph_id", character_id(NEIGHBOURHOOD, F.col("label"), F.col("radius")).alias("character_id"))
    if regions is not None:
        rows = rows.unionByName(regions.select("graph_id", character_id(REGION, F.col("signature")).alias("character_id")))
    return rows.groupBy("graph_id", "character_id").agg(F.count(F.lit(1)).alias("cnt"))


def occurrences(labelled: DataFrame) -> DataFrame:
    """(graph_id, character_id, node_id, occurrence_id) of neighbourhood characters, each supported by its node."""
    cid = character_id(NEIGHBOURHOOD, F.col("label"), F.col("radius"))
    text = F.concat(F.lit('{"character_id":"'), F.col("character_id"), F.lit('","edge_ids":[],"node_ids":["'), F.col("node_id"), F.lit('"]}'))
    return labelled.select("graph_id", cid.alias("character_id"), "node_id").withColumn("occurrence_id", F.sha2(text, 256))


def regions(vertices: DataFrame, edges: DataFrame, scratch) -> DataFrame:
    """(graph_id, entry, exit, left_path, right_path, left_edges, right_edges): two branches that fork at an entry and join at an exit.

    For each join node and pair of its predecessors, the common ancestor by (greatest distance, sum of distances, id). Its
    shortest paths have no inner node in common, as that would be a nearer common ancestor. Resource edges carry no data and
    don't count, nor do two edges of one source. A path is the shortest one, ties broken by the least sequence of edge ids.

    Both branches are walked up level by level, only until they meet, so near regions cost as many rounds as they are deep,
    whatever the depth of the graphs. What hasn't met after ``WALK`` levels is found in the closure of its graphs, which doubles.
    Paths are then walked down from the chosen entries, those longer than ``WALK`` along their pointers in one pass."""
    data = edges.where(~F.col("position").startswith("resource:"))
    hop = data.withColumn("eid", edge_id(F.col("source"), F.col("target"), F.col("position"))).groupBy("graph_id", "source", "target").agg(F.min("eid").alias("eid"))
    hop = scratch.cut(hop, "hops")
    skip = vertices.where("operation in ('graph.input', 'graph.output', 'data.attribute')").select("graph_id", F.col("node_id").alias("exit"))
    joins = hop.groupBy("graph_id", F.col("target").alias("exit")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(skip, ["graph_id", "exit"], "left_anti")
    preds = joins.join(hop.select("graph_id", F.col("target").alias("exit"), F.col("source").alias("pred")), ["graph_id", "exit"]).select("graph_id", "exit", "pred")
    sides = [preds.withColumnRenamed("pred", f"pred_{s}") for s in "ab"]
    pairs = scratch.cut(sides[0].join(sides[1], ["graph_id", "exit"]).where("pred_a < pred_b"), "open")
    seen, met, depth = scratch.path("seen"), scratch.path("met"), 0
    level, found = scratch.grow(preds.select("graph_id", F.col("pred").alias("node")).distinct().select("graph_id", "node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")), seen)
    chosen = None
    while True:
        side = lambda rows, s: rows.select("graph_id", F.col("node").alias(f"pred_{s}"), "ancestor", F.col("depth").alias(f"depth_{s}"))
        both = lambda a, b: pairs.join(side(a, "a"), ["graph_id", "pred_a"]).join(side(b, "b"), ["graph_id", "pred_b", "ancestor"])
        hits = both(found, found).where(F.lit(depth > 0))  # open pairs have nothing in common above the last level; no node is another one
        best = hits.groupBy("graph_id", "exit", "pred_a", "pred_b").agg(F.min(F.struct((F.col("depth_a") + F.col("depth_b")).alias("sum"), F.col("ancestor").alias("entry"), "depth_a", "depth_b")).alias("r"))
        new, chosen = scratch.grow(best.select("graph_id", "exit", "pred_a", "pred_b", "r.entry", "r.depth_a", "r.depth_b"), met)
        pairs = scratch.cut(pairs.join(new, ["graph_id", "exit", "pred_a", "pred_b"], "left_anti"), "open", 2)
        if pairs.isEmpty():
            break
        active = pairs.select("graph_id", F.explode(F.array("pred_a", "pred_b")).alias("node")).distinct()
        if depth == WALK:
            graph = hop.join(pairs.select("graph_id").distinct(), "graph_id", "left_semi")
            above = ancestors(graph, scratch).withColumnRenamed("node_id", "node").join(active, ["graph_id", "node"], "left_semi")
            level, found = scratch.grow(above.join(found, ["graph_id", "node", "ancestor"], "left_anti").select("graph_id", "node", "ancestor", "depth"), seen)
            hits = both(found, found).withColumn("far", F.greatest("depth_a", "depth_b"))
            best = hits.groupBy("graph_id", "exit", "pred_a", "pred_b").agg(F.min(F.struct("far", (F.col("depth_a") + F.col("depth_b")).alias("sum"), F.col("ancestor").alias("entry"), "depth_a", "depth_b")).alias("r"))
            _, chosen = scratch.grow(best.select("graph_id", "exit", "pred_a", "pred_b", "r.entry", "r.depth_a", "r.depth_b"), met)
            break
        depth += 1
        up = level.join(active, ["graph_id", "node"], "left_semi").select("graph_id", "node", F.col("ancestor").alias("target")).join(hop, ["graph_id", "target"]).select("graph_id", "node", F.col("source").alias("ancestor")).distinct()
        level, found = scratch.grow(up.join(found, ["graph_id", "node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), seen)
        if level.isEmpty():
            break
    ends = chosen.select("graph_id", "entry", F.explode(F.array(F.struct(F.col("pred_a").alias("pred"), F.col("depth_a").alias("depth")), F.struct(F.col("pred_b").alias("pred"), F.col("depth_b").alias("depth")))).alias("e")).select("graph_id", "entry", "e.pred", "e.depth").distinct()
    ends = scratch.cut(ends, "ends")
    toward = found.select("graph_id", F.col("node").alias("pred"), F.col("ancestor").alias("target"), F.col("depth").alias("left"))
    walked, moved = scratch.path("walked"), ends.where(F.col("depth") <= WALK).select("graph_id", "entry", "pred", "depth", F.col("entry").alias("at"), F.array("entry").alias("nodes"), F.array().cast("array<string>").alias("eids"))
    for _ in range(depth + 1):
        _, paths = scratch.grow(moved.where("depth = 0").select("graph_id", "entry", "pred", "nodes", "eids"), walked)
        stepped = moved.where("depth > 0").join(hop.withColumnRenamed("source", "at"), ["graph_id", "at"]).join(toward, ["graph_id", "pred", "target"]).where(F.col("left") == F.col("depth") - 1)
        best = stepped.groupBy("graph_id", "entry", "pred").agg(F.min(F.struct("eid", "target", "nodes", "eids", "left")).alias("s"))
        moved = scratch.cut(best.select("graph_id", "entry", "pred", F.col("s.left").alias("depth"), F.col("s.target").alias("at"), F.concat("s.nodes", F.array("s.target")).alias("nodes"), F.concat("s.eids", F.array("s.eid")).alias("eids")), "going", 2)
    long = ends.where(F.col("depth") > WALK)
    if not long.isEmpty():
        near = toward.join(long.select("graph_id", "pred").distinct(), ["graph_id", "pred"], "left_semi")
        here = near.select("graph_id", "pred", F.col("target").alias("source"), F.col("left").alias("depth"))
        pointers = here.join(hop, ["graph_id", "source"]).join(near, ["graph_id", "pred", "target"]).where(F.col("left") == F.col("depth") - 1).groupBy("graph_id", "pred", "source").agg(F.min(F.struct("eid", "target")).alias("s")).select("graph_id", "pred", "source", "s.eid", "s.target")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paths.schema)
        _, paths = scratch.grow(long.groupBy("graph_id", "pred").cogroup(pointers.groupBy("graph_id", "pred")).applyInPandas(_chased, schema), walked)
    last = hop.select("graph_id", F.col("source").alias("pred"), F.col("target").alias("exit"), F.col("eid").alias("last"))
    named = lambda s: paths.join(last, ["graph_id", "pred"]).select("graph_id", "entry", "exit", F.col("pred").alias(f"pred_{s}"), F.concat("nodes", F.array("exit")).alias(f"nodes_{s}"), F.concat("eids", F.array("last")).alias(f"eids_{s}"))
    full = chosen.join(named("a"), ["graph_id", "entry", "exit", "pred_a"]).join(named("b"), ["graph_id", "entry", "exit", "pred_b"])
    return full.select("graph_id", "entry", "exit", F.col("nodes_a").alias("left_path"), F.col("nodes_b").alias("right_path"), F.col("eids_a").alias("left_edges"), F.col("eids_b").alias("right_edges"))


def _chased(ends: pd.DataFrame, pointers: pd.DataFrame) -> pd.DataFrame:
    """Paths from the entries of one predecessor down to it, along the pointers of its ancestors."""
    ahead = {s: (e, t) for s, e, t in zip(pointers["source"], pointers["eid"], pointers["target"])}
    rows = []
    for graph, entry, pred in zip(ends["graph_id"], ends["entry"], ends["pred"]):
        nodes, eids = [entry], []
        while nodes[-1] != pred:
            eid, target = ahead[nodes[-1]]
            nodes.append(target)
            eids.append(eid)
        rows.append((graph, entry, pred, nodes, eids))
    return pd.DataFrame(rows, columns=["graph_id", "entry", "pred", "nodes", "eids"], dtype=object)


def region_signatures(found: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """found regions + signature: digest of the two branches' operations and input ports, without ids or side."""
    branches = found.select("graph_id", "entry", "exit", "left_path", "right_path", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("left_path").alias("path"), F.col("left_edges").alias("via")), F.struct(F.lit("r").alias("side"), F.col("right_path").alias("path"), F.col("right_edges").alias("via")))).alias("b"))
    steps = branches.select("graph_id", "entry", "exit", "left_path", "right_path", "b.side", "b.via", F.posexplode("b.path").alias("at", "node_id")).withColumn("eid", F.when(F.col("at") > 0, F.element_at("via", F.col("at"))))
    ports = edges.select("graph_id", edge_id(F.col("source"), F.col("target"), F.col("position")).alias("eid"), "port")
    full = steps.join(vertices.select("graph_id", "node_id", "operation", F.coalesce("attributes", F.lit("{}")).alias("attributes")), ["graph_id", "node_id"]).join(ports, ["graph_id", "eid"], "left")
    node = F.concat(F.lit('{"attributes":'), F.col("attributes"), F.when(F.col("at") > 0, F.concat(F.lit(',"input_port":'), json_text(F.col("port")))).otherwise(F.lit("")), F.lit(',"operation":'), json_text(F.col("operation")), F.lit("}"))
    key = ["graph_id", "entry", "exit", "left_path", "right_path"]
    lines = full.groupBy(*key, "side").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", node.alias("json")))), lambda x: x["json"]), ","), F.lit("]")).alias("json"))
    whole = lines.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("json")), ",").alias("paths"))
    return whole.select(*key, F.sha2(F.concat(F.lit(f'{{"discovery":"{DISCOVERY}","paths":['), F.col("paths"), F.lit("]}")), 256).alias("signature"))
