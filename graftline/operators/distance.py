"""Distances between taxa over character counts, audits of them, and neighbour joining.

states(taxon, character, cnt) is a sparse long table with at most one row per taxon and character and counts above 0. The L1
distance uses |a - b| = a + b - 2 min(a, b): one equi-join on the character finds the shared mass, and pairs without any keep
their totals, so absent zeros are never written. Pairs of taxa are the result itself, so their number is what the caller
asks for; skewed characters are split by the adaptive join.

Nulls: rows with a null taxon or character are ignored, a null count is 0. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.session import Scratch

#: Exact audits grow with the fourth power of the taxa.
MAX_TAXA = 100
#: Taxa of a group whose distances to another group are one task.
SIDE = 1024


def totals(states: DataFrame) -> DataFrame:
    return states.where("taxon is not null and character is not null").groupBy("taxon").agg(F.sum(F.coalesce("cnt", F.lit(0))).alias("total"))


def pairs(taxa: DataFrame) -> DataFrame:
    """Every unordered pair of taxa, the smaller id left: the result has as many rows, whatever joins it."""
    return taxa.select(F.col("taxon").alias("left_id")).join(taxa.select(F.col("taxon").alias("right_id")), F.col("left_id") < F.col("right_id"))


def shared(states: DataFrame) -> DataFrame:
    """(left_id, right_id, shared, kinds): shared mass and number of shared characters of pairs that share any."""
    s = states.where("taxon is not null and character is not null and cnt > 0")
    return (
        s.select("character", F.col("taxon").alias("left_id"), F.col("cnt").alias("a"))
        .join(s.select("character", F.col("taxon").alias("right_id"), F.col("cnt").alias("b")), "character")
        .where("left_id < right_id")
        .groupBy("left_id", "right_id")
        .agg(F.sum(F.least("a", "b")).alias("shared"), F.count(F.lit(1)).alias("kinds"))
    )


def compare(states: DataFrame) -> DataFrame:
    """(left_id, right_id, distance, shared, left_only, right_only) for every pair of taxa."""
    states = Scratch(states.sparkSession, "compared").cut(states.select("taxon", "character", "cnt"), "states")  # read five times
    t = totals(states)
    both = pairs(t).join(shared(states), ["left_id", "right_id"], "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("bigint")))
    both = both.join(t.select(F.col("taxon").alias("left_id"), F.col("total").alias("ta")), "left_id").join(t.select(F.col("taxon").alias("right_id"), F.col("total").alias("tb")), "right_id")
    return both.select("left_id", "right_id", (F.col("ta") + F.col("tb") - 2 * F.col("shared")).alias("distance"), "shared", (F.col("ta") - F.col("shared")).alias("left_only"), (F.col("tb") - F.col("shared")).alias("right_only"))


def weighted(states_by_radius: DataFrame, weights: DataFrame) -> DataFrame:
    """(left_id, right_id, distance) summed over radii with weights(radius, weight); states has a column radius."""
    s = states_by_radius.select("taxon", F.concat(F.col("radius").cast("string"), F.lit(":"), F.col("character")).alias("character"), "cnt", "radius")
    w = s.join(F.broadcast(weights), "radius").select("taxon", "character", (F.col("cnt") * F.col("weight")).alias("cnt"))
    return distances(w)


def distances(states: DataFrame, side: int = SIDE) -> DataFrame:
    """(left_id, right_id, distance) of ``compare`` for many taxa that share their characters: taxa are dealt into groups of about
    ``side``, and two groups are one task that sums the shared mass of all their pairs in place."""
    s = Scratch(states.sparkSession, "dealt").cut(states.where("taxon is not null and character is not null").select("taxon", "character", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt")), "states")
    groups = -(-s.select("taxon").distinct().count() // side)
    g = F.pmod(F.xxhash64("taxon"), F.lit(max(groups, 1))).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.lit(max(groups, 1) - 1)), lambda k: F.struct(F.least(g, k).alias("i"), F.greatest(g, k).alias("j")))
    tiles = s.withColumn("g", g).withColumn("tile", F.explode(others)).select("tile.i", "tile.j", "g", "taxon", "character", "cnt")
    kind = s.schema["taxon"].dataType.simpleString()
    return tiles.groupBy("i", "j").applyInArrow(_tile, f"left_id {kind}, right_id {kind}, distance bigint")


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches))
    one = t.column("i")[0].as_py() == t.column("j")[0].as_py()
    first = t.column("g").to_numpy() == t.column("i")[0].as_py()
    names, taxon = np.unique(np.array(t.column("taxon").to_pylist(), object), return_inverse=True)
    character, cnt = t.column("character").dictionary_encode().combine_chunks().indices.to_numpy(), t.column("cnt").to_numpy()
    left, right = np.unique(taxon[first]), np.unique(taxon[first if one else ~first])
    total = np.bincount(taxon, cnt, len(names)).astype(np.int64)
    apart = total[left][:, None] + total[right][None, :]
    order = np.lexsort((taxon, character))
    for at in np.split(order, np.flatnonzero(np.diff(character[order])) + 1):
        a, b = at[first[at]], at[first[at] if one else ~first[at]]
        if len(a) and len(b):
            apart[np.ix_(np.searchsorted(left, taxon[a]), np.searchsorted(right, taxon[b]))] -= 2 * np.minimum.outer(cnt[a], cnt[b])
    kind = t.schema.field("taxon").type
    for k in range(len(left)):
        other = np.flatnonzero(right > left[k]) if one else np.arange(len(right))
        x, y = np.full(len(other), left[k]), right[other]
        yield pa.RecordBatch.from_arrays([pa.array(names[np.minimum(x, y)], kind), pa.array(names[np.maximum(x, y)], kind), pa.array(apart[k, other])], ["left_id", "right_id", "distance"])


def similarity(states: DataFrame) -> DataFrame:
    """Dice: twice the shared mass over the mass of both, 1 for two empty taxa, rounded to 12 places."""
    c = compare(states)
    mass = F.col("left_only") + F.col("right_only") + 2 * F.col("shared")
    return c.select("left_id", "right_id", F.round(F.when(mass == 0, F.lit(1.0)).otherwise(2 * F.col("shared") / mass), 12).alias("similarity"))


def matrix(distances: DataFrame, taxa: DataFrame) -> DataFrame:
    """Both orientations and the diagonal."""
    flip = distances.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), "distance")
    same = taxa.select(F.col("taxon").alias("left_id"), F.col("taxon").alias("right_id"), F.lit(0).cast(distances.schema["distance"].dataType).alias("distance"))
    return distances.select("left_id", "right_id", "distance").unionByName(flip).unionByName(same)


def incomplete(distances: DataFrame, taxa: DataFrame) -> DataFrame:
    """Pairs that are missing, given twice or not a distance: (left_id, right_id, reason)."""
    key = distances.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), F.col("distance").cast("double").alias("distance"))
    twice = key.groupBy("left_id", "right_id").count().where("count > 1").select("left_id", "right_id", F.lit("duplicate").alias("reason"))
    bad = key.where("distance is null or isnan(distance) or distance < 0 or distance = double('inf')").select("left_id", "right_id", F.lit("invalid").alias("reason"))
    gone = pairs(taxa).join(key, ["left_id", "right_id"], "left_anti").select("left_id", "right_id", F.lit("missing").alias("reason"))
    return twice.unionByName(bad.distinct()).unionByName(gone)


def conflicts(comparisons: DataFrame) -> DataFrame:
    """(subject, problem) of comparisons(left_id, right_id, distance, left_digest, right_digest, distance_signature): an artifact with
    several digests, or more than one signature of distances, can't be compared in one tree."""
    ends = comparisons.select(F.col("left_id").alias("subject"), F.col("left_digest").alias("digest")).unionByName(comparisons.select(F.col("right_id").alias("subject"), F.col("right_digest").alias("digest")))
    split = ends.groupBy("subject").agg(F.count_distinct("digest").alias("n")).where("n > 1").select("subject", F.lit("conflicting_digest").alias("problem"))
    mixed = comparisons.agg(F.count_distinct("distance_signature").alias("n"), F.min("distance_signature").alias("subject")).where("n > 1").select("subject", F.lit("mixed_signatures").alias("problem"))
    return split.unionByName(mixed)


def triangles(distances: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(a, b, c, violation) for every triple, the excess of its longest side over the other two, 0 if within tolerance."""
    d = distances.select("left_id", "right_id", F.col("distance").cast("double").alias("distance"))
    ab = d.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.col("distance").alias("ab"))
    ac = d.select(F.col("left_id").alias("a"), F.col("right_id").alias("c"), F.col("distance").alias("ac"))
    bc = d.select(F.col("left_id").alias("b"), F.col("right_id").alias("c"), F.col("distance").alias("bc"))
    excess = 2 * F.greatest("ab", "ac", "bc") - (F.col("ab") + F.col("ac") + F.col("bc"))
    return ab.join(ac, "a").where("b < c").join(bc, ["b", "c"]).select("a", "b", "c", F.when(excess > tolerance, excess).otherwise(F.lit(0.0)).alias("violation"))


def quartets(distances: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(a, b, c, d, violation): largest minus middle of the three pair sums, 0 if within tolerance."""
    n = distances.select("left_id").union(distances.select("right_id")).distinct().count()
    if n > MAX_TAXA:
        raise ValueError(f"{n} taxa; the exact audit takes at most {MAX_TAXA}")
    d = lambda x, y: distances.select(F.col("left_id").alias(x), F.col("right_id").alias(y), F.col("distance").cast("double").alias(x + y))
    q = d("a", "b").join(d("a", "c"), "a").where("b < c").join(d("b", "c"), ["b", "c"]).join(d("a", "d"), "a").where("c < d").join(d("b", "d"), ["b", "d"]).join(d("c", "d"), ["c", "d"])
    sums = F.array_sort(F.array(F.col("ab") + F.col("cd"), F.col("ac") + F.col("bd"), F.col("ad") + F.col("bc")))
    gap = sums[2] - sums[1]
    return q.select("a", "b", "c", "d", F.when(gap > tolerance, gap).otherwise(F.lit(0.0)).alias("violation"))


def tree_likeness(distances: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row: checks and violations of the triangle and four-point conditions and their greatest violation."""
    d = Scratch(distances.sparkSession, "audit").cut(distances.select("left_id", "right_id", F.col("distance").cast("double").alias("distance")), "distances")
    agg = lambda df, p: df.agg(F.count(F.lit(1)).alias(f"{p}_checks"), F.count_if(F.col("violation") > 0).alias(f"{p}_violations"), F.coalesce(F.max("violation"), F.lit(0.0)).alias(f"max_{p}_violation"))
    t, q = agg(triangles(d, tolerance), "triangle"), agg(quartets(d, tolerance), "four_point")
    one = t.join(q, F.lit(True))  # one row each
    return one.withColumn("is_metric", F.col("triangle_violations") == 0).withColumn("is_additive", (F.col("triangle_violations") == 0) & (F.col("four_point_violations") == 0))


EDGES = "tree_id string, parent string, child string, branch_length double, raw_branch_length double, length_clamped boolean, child_is_taxon boolean"


def neighbor_joining(distances: DataFrame) -> DataFrame:
    """distances(tree_id, left_id, right_id, distance), one complete set per tree -> rooted edges of every tree.

    The pair of least (n - 2) d - r_i - r_j is joined, ties by ids; negative limbs are cut to 0 and marked; the last edge is
    split in half under a root. A tree needs its whole matrix, so one tree is one group; trees go in parallel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = pdf["tree_id"].iloc[0]
        return pd.DataFrame([(tree, *e) for e in join_neighbors(list(zip(pdf["left_id"], pdf["right_id"], pdf["distance"])))], columns=[c.split()[0] for c in EDGES.split(", ")])

    return distances.select(F.col("tree_id").cast("string"), "left_id", "right_id", F.col("distance").cast("double").alias("distance")).groupBy("tree_id").applyInPandas(run, EDGES)


def join_neighbors(rows: list[tuple[str, str, float]]) -> list[tuple]:
    """Edges (parent, child, length, raw length, clamped, child is a taxon) of one complete distance table."""
    taxa = sorted({x for a, b, _ in rows for x in (a, b)})
    n = len(taxa)
    if len(taxa) < 2:
        raise ValueError("a tree needs two taxa or more")
    at = {t: i for i, t in enumerate(taxa)}
    d = np.full((2 * n, 2 * n), np.nan)
    np.fill_diagonal(d, 0)
    for a, b, x in rows:
        if not np.isfinite(x) or x < 0 or a == b or not np.isnan(d[at[a], at[b]]):
            raise ValueError(f"no valid single distance of {a} and {b}")
        d[at[a], at[b]] = d[at[b], at[a]] = x
    if np.isnan(d[:n, :n]).any():
        raise ValueError("a pair has no distance")
    names, live, edges, made = list(taxa), list(range(n)), [], 0

    def limb(parent: str, k: int, raw: float) -> None:
        edges.append((parent, names[k], max(0.0, raw), raw, raw < 0, k < n))

    while len(live) > 2:
        live.sort(key=lambda k: names[k])
        m = d[np.ix_(live, live)]
        r = m.sum(1)
        q = (len(live) - 2) * m - r[:, None] - r[None, :]
        q[np.tril_indices(len(live))] = np.inf
        i, j = np.unravel_index(np.argmin(q), q.shape)
        delta = (r[i] - r[j]) / (len(live) - 2)
        new = f"__internal__:{made:06d}"
        made += 1
        limb(new, live[i], (m[i, j] + delta) / 2)
        limb(new, live[j], (m[i, j] - delta) / 2)
        k = len(names)
        names.append(new)
        rest = [x for p, x in enumerate(live) if p not in (i, j)]
        for x in rest:
            d[k, x] = d[x, k] = (d[live[i], x] + d[live[j], x] - m[i, j]) / 2
        d[k, k] = 0
        live = [*rest, k]
    root = f"__internal__:{made:06d}"
    a, b = sorted(live, key=lambda k: names[k])
    for k in (a, b):
        limb(root, k, d[a, b] / 2)
    return edges


def collapse_identical(artifacts: DataFrame) -> DataFrame:
    """artifacts(artifact_id, digest) -> (artifact_id, representative): the least id of each digest stands for its copies."""
    known = artifacts.where("digest is not null and artifact_id is not null").distinct()
    rep = known.groupBy("digest").agg(F.min("artifact_id").alias("representative"))
    return known.join(rep, "digest").select("artifact_id", "representative", "digest")


def alias_distances(asked: DataFrame, aliases: DataFrame, distances: DataFrame) -> DataFrame:
    """asked(left_id, right_id) -> distance through representatives; copies of one graph are 0 apart, unknown ids null."""
    a = aliases.select(F.col("artifact_id").alias("left_id"), F.col("representative").alias("ra"))
    b = aliases.select(F.col("artifact_id").alias("right_id"), F.col("representative").alias("rb"))
    k = asked.join(a, "left_id", "left").join(b, "right_id", "left").withColumn("x", F.least("ra", "rb")).withColumn("y", F.greatest("ra", "rb"))
    d = distances.select(F.least("left_id", "right_id").alias("x"), F.greatest("left_id", "right_id").alias("y"), F.col("distance").cast("double").alias("d"))
    return k.join(d, ["x", "y"], "left").select("left_id", "right_id", F.when(F.col("ra") == F.col("rb"), F.lit(0.0)).otherwise(F.col("d")).alias("distance"))


def compact_edges(tree: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges of the representatives' tree with their copies as a star of length 0: the representative's tip becomes an inner
    node ``__group__:<representative>`` that holds it and its copies."""
    many = aliases.groupBy("representative").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("representative")
    group = F.concat(F.lit("__group__:"), F.col("child"))
    tagged = tree.join(many.select(F.col("representative").alias("child"), F.lit(True).alias("many")), "child", "left")
    kept = tagged.select("parent", F.when(F.col("many"), group).otherwise(F.col("child")).alias("child"), "branch_length", F.coalesce(F.col("many"), F.lit(False)).alias("is_group"))
    star = aliases.join(many, "representative").select(F.concat(F.lit("__group__:"), F.col("representative")).alias("parent"), F.col("artifact_id").alias("child"), F.lit(0.0).alias("branch_length"), F.lit(False).alias("is_group"))
    return kept.unionByName(star)
