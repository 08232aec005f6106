"""Free-entered names mapped to a reference list by a partition-based pigeonhole join, in built-in functions only.

Names are parsed to (family, generation, size, tuning); the last three must agree exactly. Families that stand in the list
letter by letter are mapped by an equality join. For the others, reference families are cut into k + 1 segments: of k edits
at least one segment is untouched and stands in the name at a shift that the edits before and after it can cause, so an
equality join on (generation, size, tuning, length, segment number, segment text) finds every family within k edits, which
the built-in levenshtein verifies. The shifts are those of the multi-match-aware selection (Li et al., PassJoin, VLDB 2011),
about k^2 / 2 + k + 1 substrings per length. Names are distinct before the join, so a name entered very often is one row. The
nearest entry is taken; a name with two nearest entries, or none, is unmatched, and is reported through an anti-join.

Three edits are slips in a family of ``LONG`` letters or more, two in one of ``LONG`` - 1, none in a shorter one (such as an
abbreviation); four (k) only where the letters are the same in another order, which two swapped pairs of letters cost.

Nulls: null, blank and unreadable names are unmatched. Reference entries without a name are ignored, repeated ones count
once. Very long names are read whole. Empty tables give no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.llm import names

K, LONG = 4, 7


def _edits(family: Column) -> Column:
    return F.when(F.length(family) >= LONG, F.lit(K - 1)).when(F.length(family) == LONG - 1, F.lit(2)).otherwise(F.lit(0))


def _letters(word: Column) -> Column:
    return F.array_sort(F.split(word, ""))


def _bounds(n: Column, seg: Column, k: int) -> tuple[Column, Column]:
    """0-based start and width of segment ``seg`` (from 0) of a word of ``n`` letters cut into k + 1 parts."""
    start = F.floor(n * seg / F.lit(k + 1)).cast("int")
    return start, F.floor(n * (seg + 1) / F.lit(k + 1)).cast("int") - start


def _segments(reference: DataFrame, k: int) -> DataFrame:
    cut = reference.withColumn("ref_len", F.length("ref_family")).withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(k))))
    start, width = _bounds(F.col("ref_len"), F.col("seg"), k)
    return cut.withColumn("text", F.substring(F.col("ref_family"), start + 1, width))


def _substrings(queries: DataFrame, k: int) -> DataFrame:
    """For each reference length within k and each segment, the name's substrings at the shifts that k edits can cause."""
    cut = queries.withColumn("n", F.length("family")).withColumn("ref_len", F.explode(F.sequence(F.greatest(F.col("n") - k, F.lit(1)), F.col("n") + k))).withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(k))))
    start, width = _bounds(F.col("ref_len"), F.col("seg"), k)
    before, after, gap = F.col("seg"), F.lit(k) - F.col("seg"), F.col("n") - F.col("ref_len")
    low = F.greatest(start - before, start + gap - after, F.lit(0))
    high = F.least(start + before, start + gap + after, F.col("n") - width)
    placed = cut.withColumn("w", width).withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    return placed.select("name", "family", "generation", "size_m", "tuning", "ref_len", "seg", F.expr("substring(family, at + 1, w)").alias("text")).distinct()


def match(free: DataFrame, reference: DataFrame, k: int = K) -> DataFrame:
    """free(name) and reference(ref_id, names array) -> (name, ref_id, distance) for every matched distinct name."""
    key = ["generation", "size_m", "tuning"]
    queries = free.where("name is not null").select("name").distinct().select("name", names.parse(F.col("name")).alias("n")).select("name", "n.family", *[f"n.{c}" for c in key]).where("family is not null")
    listed = reference.where("ref_id is not null").select("ref_id", F.explode("names").alias("n")).select("ref_id", names.parse(F.col("n")).alias("n")).select("ref_id", "n.family", *[f"n.{c}" for c in key]).where("family is not null").distinct()
    none = F.coalesce(F.col("size_m"), F.lit(-1)).alias("size_m")
    queries = queries.select("name", "family", "generation", none, "tuning")
    listed = listed.select("ref_id", F.col("family").alias("ref_family"), "generation", none, "tuning")
    same = queries.withColumnRenamed("family", "ref_family").join(listed, [*key, "ref_family"]).select("name", "ref_id", F.lit(0).alias("distance"))
    rest = queries.join(same.select("name"), "name", "left_anti")
    long = lambda df, c: df.where(F.length(c) >= LONG - 1)  # noqa: E731  shorter ones allow no edit, and their segments would be empty
    near = _substrings(long(rest, "family"), k).join(_segments(long(listed, "ref_family"), k), [*key, "ref_len", "seg", "text"]).select("name", "family", "ref_id", "ref_family").distinct().withColumn("distance", F.levenshtein("family", "ref_family"))
    allowed = F.least(_edits(F.col("family")), _edits(F.col("ref_family")))
    swapped = (F.col("distance") == k) & (allowed == k - 1) & (_letters(F.col("family")) == _letters(F.col("ref_family")))
    scored = same.unionByName(near.where((F.col("distance") <= allowed) | swapped).select("name", "ref_id", "distance")).groupBy("name", "ref_id").agg(F.min("distance").alias("distance"))
    best = scored.groupBy("name").agg(F.min(F.struct("distance", "ref_id")).alias("b"), F.min("distance").alias("d"))
    nearest = scored.join(best, "name").where("distance = d").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("ref_id").alias("ref_id"), F.min("distance").alias("distance"))
    return nearest.where("n = 1").select("name", "ref_id", "distance")


def unmatched(free: DataFrame, matched: DataFrame) -> DataFrame:
    """Rows of ``free`` whose name means nothing in the list, null names included."""
    return free.join(matched.select("name"), "name", "left_anti")
