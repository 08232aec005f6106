"""Joins by exact identity: profiles to entries, relations to entries, targets of extraction, evidence between dated artifacts.

Nulls: a null key matches nothing and is reported as missing or unresolved. Repeated bindings of one entry take the least
profile. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bind_profiles(entries: DataFrame, profiles: DataFrame, bindings: DataFrame) -> DataFrame:
    """(entry_id, profile_id, status): an explicit binding first, else the equal id; bound or missing_profile."""
    b = bindings.where("profile_id is not null").groupBy("entry_id").agg(F.min("profile_id").alias("named"))
    want = entries.select("entry_id").distinct().join(b, "entry_id", "left").withColumn("profile_id", F.coalesce("named", "entry_id"))
    have = profiles.select("profile_id", F.lit(True).alias("there")).distinct()
    return want.join(have, "profile_id", "left").select("entry_id", F.when(F.col("there"), F.col("profile_id")).alias("profile_id"), F.when(F.col("there"), "bound").otherwise("missing_profile").alias("status"))


def unused_profiles(profiles: DataFrame, bound: DataFrame) -> DataFrame:
    return profiles.select("profile_id").distinct().join(bound.where("status = 'bound'"), "profile_id", "left_anti")


def resolve_relations(relations: DataFrame, entries: DataFrame) -> DataFrame:
    """relations + status: resolved, dangling (an id without entry) or unidentified (no id); self links are kept and marked."""
    known = entries.select(F.col("entry_id").alias("target_id"), F.lit(True).alias("there")).distinct()
    status = F.when(F.col("target_id").isNull(), "unidentified").when(F.col("there"), "resolved").otherwise("dangling")
    return relations.join(known, "target_id", "left").withColumn("status", status).withColumn("is_self", F.coalesce(F.col("source_id") == F.col("target_id"), F.lit(False))).drop("there")


def resolve_targets(identifiers: DataFrame, pins: DataFrame, namespace: str) -> DataFrame:
    """identifiers(entry_id, namespace, value 'repo@revision') -> (entry_id, status, target, candidates): ready with one candidate
    or a pinned one, ambiguous with several, unsupported if the namespace names none, missing without identifiers."""
    own = identifiers.select("entry_id", F.when(F.col("namespace") == namespace, F.regexp_extract("value", r"^(.+@[0-9a-fA-F]{40})$", 1)).alias("c"))
    c = own.groupBy("entry_id").agg(F.array_sort(F.collect_set(F.nullif("c", F.lit("")))).alias("candidates"), F.count("c").alias("asked"))
    p = pins.groupBy("entry_id").agg(F.min("target").alias("pin"))
    j = c.join(p, "entry_id", "left")
    pinned = F.array_contains("candidates", F.col("pin"))
    status = F.when(pinned, "ready").when(F.size("candidates") == 1, "ready").when(F.size("candidates") > 1, "ambiguous").when(F.col("asked") > 0, "unsupported").otherwise("missing")
    return j.select("entry_id", status.alias("status"), F.when(pinned, F.col("pin")).when(F.size("candidates") == 1, F.get("candidates", F.lit(0))).alias("target"), F.size("candidates").alias("candidates"))


def temporal_relation(source_max, target_min) -> F.Column:
    return F.when(source_max.isNull() | target_min.isNull(), "missing_date").when(source_max < target_min, "earlier").otherwise("not_strictly_earlier")


def admit_evidence(evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """evidence(source_id, target_id, ...) joined to artifacts(artifact_id, date_min, date_max) + relation, gap_days."""
    s = artifacts.select(F.col("artifact_id").alias("source_id"), F.col("date_max").alias("source_max"))
    t = artifacts.select(F.col("artifact_id").alias("target_id"), F.col("date_min").alias("target_min"))
    j = evidence.join(s, "source_id", "left").join(t, "target_id", "left")
    return j.withColumn("relation", temporal_relation(F.col("source_max"), F.col("target_min"))).withColumn("gap_days", F.greatest(F.lit(0), F.datediff("target_min", "source_max")))


def contact_edges(admitted: DataFrame) -> DataFrame:
    """(source_id, target_id, causal_role, strength, n_evidence) of evidence from strictly earlier artifacts."""
    e = admitted.where("relation = 'earlier'").groupBy("source_id", "target_id", "causal_role").agg(F.max("strength").alias("strength"), F.count(F.lit(1)).alias("n_evidence"))
    return e


def character_sources(states: DataFrame, admitted: DataFrame) -> DataFrame:
    """(taxon, character, donors, origin): donors are earlier artifacts whose transfer of the character is evidenced and that
    hold it as the taxon does; origin transfer or unexplained."""
    t = admitted.where("relation = 'earlier' and causal_role = 'character_transfer'").select(F.col("source_id").alias("donor"), F.col("target_id").alias("taxon"), "character")
    held = t.join(states.select(F.col("taxon").alias("donor"), "character"), ["donor", "character"], "left_semi")
    d = held.groupBy("taxon", "character").agg(F.array_join(F.array_sort(F.collect_set("donor")), ",").alias("donors"))
    return states.select("taxon", "character").join(d, ["taxon", "character"], "left").withColumn("origin", F.when(F.col("donors").isNotNull(), "transfer").otherwise("unexplained"))


# Roles that evidence of contact may have.
ROLES = ["awareness", "character_transfer", "provenance"]


def normalized_evidence(evidence: DataFrame) -> DataFrame:
    """evidence(source_id, target_id, causal_role, strength[, character, value, ...]) once for each content, with evidence_id (a digest) and
    problem: null_end, self, unknown_role, bad_strength (not in [0, 1]) or null."""
    columns = sorted(c for c in evidence.columns if c not in ("evidence_id", "problem"))
    once = evidence.select(*columns).withColumn("evidence_id", F.sha2(F.to_json(F.struct(*columns)), 256)).dropDuplicates(["evidence_id"])
    strength = F.col("strength").cast("double")
    return once.withColumn(
        "problem", F.when(F.col("source_id").isNull() | F.col("target_id").isNull(), "null_end").when(F.col("source_id") == F.col("target_id"), "self").when(~F.coalesce(F.col("causal_role").isin(ROLES), F.lit(False)), "unknown_role").when(strength.isNull() | F.isnan(strength) | (strength < 0) | (strength > 1), "bad_strength")
    )


def transfer_problems(evidence: DataFrame, states: DataFrame) -> DataFrame:
    """(source_id, target_id, character, problem) of evidenced transfers(..., character, value) against states(taxon, character, cnt):
    not_in_source, not_in_target, or value_differs from the target's count."""
    t = evidence.where("causal_role = 'character_transfer'").select("source_id", "target_id", "character", "value")
    of = lambda end, name: states.select(F.col("taxon").alias(end), "character", F.col("cnt").alias(name))
    j = t.join(of("source_id", "s"), ["source_id", "character"], "left").join(of("target_id", "t"), ["target_id", "character"], "left")
    problem = F.when(F.col("s").isNull(), "not_in_source").when(F.col("t").isNull(), "not_in_target").when(F.col("value").isNotNull() & (F.col("value") != F.col("t")), "value_differs")
    return j.select("source_id", "target_id", "character", problem.alias("problem")).where("problem is not null")


def contact_pairs(artifacts: DataFrame, admitted: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, gap_days, n_evidence) for every ordered pair of artifacts, which is the result asked for; a
    list of pairs with evidence alone comes from ``admit_evidence``."""
    end = lambda name: artifacts.select(F.col("artifact_id").alias(f"{name}_id"), F.col("date_max" if name == "source" else "date_min").alias("source_max" if name == "source" else "target_min"))
    every = end("source").join(end("target"), F.col("source_id") != F.col("target_id"))
    n = admitted.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    j = every.join(n, ["source_id", "target_id"], "left")
    return j.select("source_id", "target_id", temporal_relation(F.col("source_max"), F.col("target_min")).alias("relation"), F.greatest(F.lit(0), F.datediff("target_min", "source_max")).alias("gap_days"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def entry_candidates(entries: DataFrame) -> DataFrame:
    """entries(entry_id, identifiers, releases array<struct<release_name, identifiers>>) -> (entry_id, namespace, value): what identifies
    an entry or one of its releases, each once."""
    own = entries.select("entry_id", F.explode("identifiers").alias("i"))
    released = entries.select("entry_id", F.explode("releases").alias("r")).select("entry_id", F.explode("r.identifiers").alias("i"))
    return own.unionByName(released).select("entry_id", "i.namespace", "i.value").where("value is not null").distinct()
