"""Sinks: normalised graph and lineage tables, datasets for publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPTIONS = {"compression": "zstd"}


def write_table(df: DataFrame, path: str, key: list[str]) -> None:
    """Parquet, sorted within partitions by the key; the commit protocol replaces the folder only on success."""
    df.sortWithinPartitions(*key).write.mode("overwrite").options(**OPTIONS).parquet(path)


def write_graphs(vertices: DataFrame, edges: DataFrame, folder: str) -> None:
    from graftline.operators import graphs as G

    write_table(G.graph_summary(vertices, edges), f"{folder}/graphs", ["graph_id"])
    write_table(vertices, f"{folder}/graph_vertices", ["graph_id", "node_id"])
    write_table(edges.withColumn("edge_id", G.edge_id(F.col("source"), F.col("target"), F.col("position"))), f"{folder}/graph_edges", ["graph_id", "edge_id"])


def write_lineage(tree_edges: DataFrame, states: DataFrame, distances: DataFrame, folder: str) -> None:
    """Tree edges, taxa, states above 0 and distances of lineages, each with its tree_id."""
    write_table(tree_edges, f"{folder}/tree_edges", ["tree_id", "child"])
    write_table(tree_edges.where("child_is_taxon").select("tree_id", F.col("child").alias("model_id")), f"{folder}/taxa", ["tree_id", "model_id"])
    write_table(states.where("cnt > 0"), f"{folder}/character_states", ["tree_id", "taxon", "character"])
    write_table(distances, f"{folder}/distances", ["tree_id", "left_id", "right_id"])


def export_dataset(tables: dict[str, DataFrame], folder: str, drop: tuple[str, ...] = ("payload_cbor",)) -> str:
    """Each table as a config of its own, without payload columns; returns the card's text."""
    for name, df in tables.items():
        df.drop(*drop).write.mode("overwrite").options(**OPTIONS).parquet(f"{folder}/data/{name}")
    lines = [x for name in sorted(tables) for x in (f"- config_name: {name}", f"  data_files: data/{name}/*.parquet")]
    return "\n".join(["---", "configs:", *lines, "---", ""])
