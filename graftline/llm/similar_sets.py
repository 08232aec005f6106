"""All pairs of records whose sets overlap by at least a threshold: sorted sketch forests over minhash signatures.

Equal sets are collapsed to one class first. Every class gets ``BASE`` minhashes; each of ``TREES`` trees orders them its own
way, and classes whose ordered signatures share a prefix of ``START`` values are neighbours in that tree. At the threshold
s = 0.7 a tree finds a pair with probability 0.34 and a signature with X of 32 equal values leaves it in none of the 40 trees
with probability about (1 - C(X,3)/C(32,3))^40: the expected recall is 0.9997 at 0.7 exactly and nearer 1 above.

Neighbourhoods of more than ``CROWD`` classes, which share a very common element or are variants of one set, are not compared
pair by pair, and no deeper prefix would keep that recall. Their classes go to an exact prefix-filter join instead: elements are
ordered rarest first, and two sets above the threshold share one of the first few. So a pair of a crowded neighbourhood is
found for certain, and the recall of the forest holds for the others.

Neighbours are first held against two bounds that no pair above the threshold can fail: the ratio of the sizes, and the bits
by which 64-bit maps of the elements differ. What is left is verified exactly by joining the elements. Nothing is collected
into arrays; sets of any size are rows, and all aggregates combine before the shuffle.

Nulls: rows without a set id or element are left out, so an empty set is no record. Repeated rows count once. Further
columns are ignored. Empty tables give no pairs. Elements are compared by a 64-bit hash of their text.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.session import Scratch

BASE, TREES, START, CROWD = 32, 40, 3, 512


def _orders() -> list[list[int]]:
    return [random.Random(t).sample(range(BASE), 8)[:START] for t in range(TREES)]


def elements(df: DataFrame, set_id: str, element: Column) -> DataFrame:
    """(set_id, e): distinct elements as 64-bit hashes."""
    return df.select(F.col(set_id).alias("set_id"), F.xxhash64(element).alias("e"), element.isNotNull().alias("ok")).where("ok and set_id is not null").groupBy("set_id", "e").agg(F.lit(1).alias("one")).select("set_id", "e")


def classes(sets: DataFrame) -> DataFrame:
    """(set_id, cls, n, bits, m0..): digest of the set, its size, its bit map and its minhashes, in one aggregation."""
    mixed = F.xxhash64("e", F.lit(-1))
    return sets.groupBy("set_id").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.bit_xor("e").alias("x"),
        F.bit_xor(mixed).alias("y"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(mixed, F.lit(64)).cast("int"))).alias("bits"),
        *[F.min(F.xxhash64("e", F.lit(i))).alias(f"m{i}") for i in range(BASE)],
    ).withColumn("cls", F.xxhash64("x", "y", "n")).drop("x", "y")


def _keyed(signatures: DataFrame) -> DataFrame:
    """(tree, key, cls, n, bits): the neighbourhoods of every class."""
    prefix = F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), *[F.col(f"m{i}") for i in order]).alias("key")) for t, order in enumerate(_orders())])
    return signatures.select("cls", "n", "bits", F.explode(prefix).alias("p")).select("p.tree", "p.key", "cls", "n", "bits")


def _alike(threshold: float) -> Column:
    """Bounds on the sizes and bit maps that no pair above the threshold fails."""
    slack = (1 - threshold) / (1 + threshold)
    return (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold) & (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= (F.col("na") + F.col("nb")) * slack + 1e-9)


def _sides(rows: DataFrame, *more: str) -> list[DataFrame]:
    return [rows.select("key", F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in more]) for s in "ab"]


def _neighbours(rows: DataFrame, threshold: float) -> DataFrame:
    a, b = _sides(rows)
    return a.join(b, "key").where((F.col("a") < F.col("b")) & _alike(threshold)).select("a", "b", "na", "nb").distinct()


def _by_prefix(crowd: DataFrame, members: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b, na, nb): candidates among ``crowd`` (cls, n, bits) that no pair at or above the threshold is missing from.

    With elements in one order, the first that two sets share is at places i and j that leave room for the overlap they need:
    1 + min(na - i, nb - j) >= t (na + nb) / (1 + t). So a set is found through its first n - t n + 1 elements by sets that aren't
    larger, and through its first n - 2 t n / (1 + t) + 1 by those that aren't smaller. Only sizes of one band or the next can
    meet, as a band is as wide as the threshold.
    """
    held = members.join(crowd, "cls")
    common = held.groupBy("e").agg(F.count(F.lit(1)).alias("c"))
    placed = held.join(common, "e").withColumn("at", F.row_number().over(Window.partitionBy("cls").orderBy("c", "e")))
    first = placed.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    band = F.floor(F.log(F.col("n")) / math.log(1 / threshold) + 1e-9) if threshold < 1 else F.col("n").cast("bigint")
    rows = scratch.cut(first.select("cls", "n", "bits", "e", "at", band.alias("band")), "prefixes")
    short = rows.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * threshold / (1 + threshold)) - 1e-9) + 1)
    a = _sides(short.withColumn("key", F.xxhash64("e", "band")), "e", "at")[0]
    b = _sides(rows.withColumn("key", F.explode(F.array(F.xxhash64("e", "band"), F.xxhash64("e", F.col("band") - 1)))), "e", "at")[1]
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    room = (F.least(F.col("na") - F.col("at_a"), F.col("nb") - F.col("at_b")) + 1) * (1 + threshold) >= threshold * (F.col("na") + F.col("nb")) - 1e-9
    near = a.join(b, "key").where((F.col("e_a") == F.col("e_b")) & ordered & room & _alike(threshold))
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    return near.select(pick("a", "b"), pick("b", "a"), pick("na", "nb"), pick("nb", "na")).distinct()


def class_pairs(signatures: DataFrame, members: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b, similarity) between classes; ``signatures`` one row per class, ``members`` (cls, e) its elements."""
    rows = _keyed(signatures)
    crowded = scratch.cut(rows.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CROWD).select("tree", "key"), "crowded")
    if crowded.isEmpty():
        pairs = _neighbours(rows, threshold)
    else:
        crowd = scratch.cut(rows.join(crowded, ["tree", "key"], "left_semi").select("cls", "n", "bits").distinct(), "crowd")
        calm = _neighbours(rows.join(crowded, ["tree", "key"], "left_anti"), threshold)
        pairs = calm.unionByName(_by_prefix(crowd, members, threshold, scratch)).distinct()
    shared = pairs.join(members.select(F.col("cls").alias("a"), "e"), "a").join(members.select(F.col("cls").alias("b"), "e"), ["b", "e"])
    exact = shared.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("both"))
    similarity = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return exact.withColumn("similarity", similarity).where(F.col("both") * (1 + threshold) >= threshold * (F.col("na") + F.col("nb")) - 1e-9).select("a", "b", "similarity")


def similar_classes(df: DataFrame, set_id: str, element: Column, threshold: float = 0.7, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members(set_id, cls) of every record, and pairs(a, b, similarity) of classes of equal sets. However often
    a set is repeated, it is one class, so nothing grows with the square of its copies; pairs of records are spelled out of
    this by ``similar_pairs``."""
    scratch = scratch or Scratch(df.sparkSession, "sets")
    sets = scratch.cut(elements(df, set_id, element), "elements")
    records = scratch.cut(classes(sets), "classes")
    member = records.select("set_id", "cls")
    head = member.groupBy("cls").agg(F.min("set_id").alias("set_id"))
    signatures = scratch.cut(records.join(head.select("set_id"), "set_id", "left_semi").drop("set_id"), "signatures")
    held = scratch.cut(sets.join(head, "set_id").select("cls", "e"), "held")
    return member, class_pairs(signatures, held, threshold, scratch)


def similar_pairs(df: DataFrame, set_id: str, element: Column, threshold: float = 0.7, scratch: Scratch | None = None) -> DataFrame:
    """(left_id, right_id, similarity), smaller id first: every pair of records at or above the threshold, copies included."""
    member, pairs = similar_classes(df, set_id, element, threshold, scratch)
    across = pairs.join(member.select(F.col("cls").alias("a"), F.col("set_id").alias("x")), "a").join(member.select(F.col("cls").alias("b"), F.col("set_id").alias("y")), "b").select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "similarity")
    within = member.select("cls", F.col("set_id").alias("left_id")).join(member.select("cls", F.col("set_id").alias("right_id")), "cls").where("left_id < right_id").select("left_id", "right_id", F.lit(1.0).alias("similarity"))
    return across.unionByName(within)
