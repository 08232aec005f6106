"""Equi-joins whose large side may hold very many rows of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task joins.
HOT = 200_000


def hot_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", hot: int = HOT) -> DataFrame:
    """``big`` joined to ``small`` (inner or left). Keys with more than ``hot`` rows in ``big`` are spread over as many parts as
    keep a part at about ``hot`` rows; their rows of ``small`` are repeated for each part.

    Counting combines before its shuffle, and at most one key in ``hot`` rows is hot. Null keys match nothing."""
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot)
    parts = counts.select(*on, F.ceil(F.col("_n") / hot).cast("int").alias("_parts"))
    spread = big.join(parts, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = small.join(parts, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")
