"""Whole analyses put together from the operators: graph profiles, lineages, trees of bound entries, contact networks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.operators import binding, characters, distance, graphs, trees
from graftline.session import Scratch


@dataclass(frozen=True)
class LineageConfig:
    """Radii of the characters, the tolerance of the audits and the number of taxa that an exact tree may have."""

    radius: int = 3
    tolerance: float = 0.0
    max_taxa: int = distance.MAX_TAXA

    def __post_init__(self):
        for name, low in (("radius", 0), ("tolerance", 0), ("max_taxa", 1)):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value < float("inf"):
                raise ValueError(f"{name} must be a number of at least {low}")


def graph_profiles(vertices: DataFrame, edges: DataFrame, commutative: DataFrame, config: LineageConfig = LineageConfig(), scratch: Scratch | None = None) -> dict[str, DataFrame]:
    """vertices and edges of any number of graphs -> graphs (digest and counts), regions, character_states (neighbourhoods and
    regions) and occurrences."""
    scratch = scratch or Scratch(vertices.sparkSession, "profiles")
    v = scratch.cut(vertices, "vertices")
    e = scratch.cut(graphs.port_labels(edges, commutative), "edges")
    if not (bad := graphs.invariant_violations(v, e)).isEmpty():
        raise ValueError(f"invalid graphs, such as {bad.first().asDict()}")
    labelled = scratch.cut(characters.labels(v, e, config.radius, scratch), "labelled")
    found = scratch.cut(characters.region_signatures(characters.regions(v, e, scratch), v, e), "regions")
    return {
        "graphs": graphs.structural_digest(v, e).join(graphs.graph_summary(v, e), "graph_id"),
        "regions": found,
        "character_states": scratch.cut(characters.states(labelled, found), "states"),
        "occurrences": characters.occurrences(labelled),
    }


def lineage(states: DataFrame, digests: DataFrame, config: LineageConfig = LineageConfig(), scratch: Scratch | None = None) -> dict[str, DataFrame]:
    """states(taxon, character, cnt), digests(artifact_id, digest) -> distances, audit, tree_edges (identical artifacts on a star), newick.

    Artifacts of one digest are one taxon, whose states are those of its first artifact."""
    scratch = scratch or Scratch(states.sparkSession, "lineage")
    groups = scratch.cut(distance.collapse_identical(digests), "groups")
    lead = groups.where("artifact_id = representative").select(F.col("artifact_id").alias("taxon"))
    n = lead.count()
    if n > config.max_taxa:
        raise ValueError(f"{n} taxa; an exact tree takes at most {config.max_taxa}")
    distances = scratch.cut(distance.compare(states.join(lead, "taxon", "left_semi")).select("left_id", "right_id", "distance"), "distances")
    backbone = scratch.cut(distance.neighbor_joining(distances.withColumn("tree_id", F.lit("lineage"))), "backbone")
    return {"groups": groups, "distances": distances, "audit": distance.tree_likeness(distances, config.tolerance), "tree_edges": distance.compact_edges(backbone, groups), "newick": trees.newick(backbone)}


def modelome_tree(entries: DataFrame, profiles: DataFrame, bindings: DataFrame, relations: DataFrame, states: DataFrame, digests: DataFrame, config: LineageConfig = LineageConfig(), scratch: Scratch | None = None) -> dict[str, DataFrame]:
    """Entries bound to their profiles, their relations resolved, how many are covered, and the lineage of those that are bound; taxa
    carry the entries' ids."""
    scratch = scratch or Scratch(entries.sparkSession, "modelome")
    bound = scratch.cut(binding.bind_profiles(entries, profiles, bindings), "bound")
    name = bound.where("status = 'bound'").select(F.col("profile_id").alias("taxon"), "entry_id")
    own = states.join(name, "taxon").select(F.col("entry_id").alias("taxon"), "character", "cnt")
    ids = digests.join(name.withColumnRenamed("taxon", "artifact_id"), "artifact_id").select(F.col("entry_id").alias("artifact_id"), "digest")
    return {"bound": bound, "coverage": bound.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "relations": binding.resolve_relations(relations, entries), **lineage(own, ids, config, scratch)}


def contact_network(artifacts: DataFrame, evidence: DataFrame, states: DataFrame, every_pair: bool = False) -> dict[str, DataFrame]:
    """Evidence once each and checked, admitted by date; edges by role, diagnostics of pairs, and where characters came from."""
    clean = binding.normalized_evidence(evidence)
    valid = clean.where("problem is null").drop("problem")
    admitted = binding.admit_evidence(valid, artifacts)
    pairs = binding.contact_pairs(artifacts, admitted) if every_pair else admitted.select("source_id", "target_id", "relation", "gap_days").distinct()
    return {"rejected": clean.where("problem is not null"), "edges": binding.contact_edges(admitted), "pairs": pairs, "sources": binding.character_sources(states, admitted)}
