"""Catalogs of versioned entries: windows, search, ranking, top-k and top-p, papers, observations, current records.

entries(version_id, name, created_at, score, paper, ...). Ranks are global orders, so they are windows over sorted ranges:
``global_rank`` counts per range first and adds the ranges' offsets, so no task sorts all rows.

Nulls: a null date is in no window, a null score is unranked (``missing_metric``), a null paper is paperless. Ties are ordered
by id. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.session import Scratch


def in_window(df: DataFrame, at: str, since: str | None, until: str | None) -> DataFrame:
    """Half-open [since, until)."""
    cond = F.col(at).isNotNull()
    if since:
        cond &= F.col(at) >= F.lit(since).cast("timestamp")
    if until:
        cond &= F.col(at) < F.lit(until).cast("timestamp")
    return df.where(cond)


def search(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    return df.where(F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))


def global_rank(df: DataFrame, order: list[Column], out: str = "rank", scratch: Scratch | None = None) -> DataFrame:
    """``df`` with 1, 2, ... in ``order`` (a total order): range partitioned, numbered inside, offset by the ranges before.

    The offsets are one row per partition. The numbered rows are written once, so both uses see the same ranges."""
    scratch = scratch or Scratch(df.sparkSession, "rank")
    parted = scratch.cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "parted")
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return parted.join(F.broadcast(before), "_part").withColumn(out, (F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")).cast("bigint")).drop("_part", "_before")


def ranked(df: DataFrame) -> DataFrame:
    return global_rank(df.where("score is not null and not isnan(score)"), [F.col("score").desc(), F.col("version_id").asc()])


def missing_metric(df: DataFrame) -> DataFrame:
    return df.where("score is null or isnan(score)").select("version_id")


def top_k(df: DataFrame, k: int) -> DataFrame:
    return df.where("score is not null and not isnan(score)").orderBy(F.col("score").desc(), "version_id").limit(k)


def top_p(df: DataFrame, p: float) -> DataFrame:
    """The first ceil(p n) of the n entries that have a score."""
    r = ranked(df)
    n = df.where("score is not null and not isnan(score)").count()
    keep = -int(-(p * n) // 1)
    return r.where(F.col("rank") <= keep)


def select_papers(df: DataFrame, paperless_quota: int | None = None) -> DataFrame:
    """The best entry of each paper; of the paperless ones the best ``paperless_quota`` (all if None); ranked anew."""
    scored = df.where("score is not null and not isnan(score)")
    rest = [c for c in df.columns if c != "paper"]
    order = F.struct(-F.col("score").cast("double"), F.col("version_id"))
    best = scored.where("paper is not null").groupBy("paper").agg(F.min_by(F.struct(*rest), order).alias("r"))
    kept = best.select("paper", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)
    loose = scored.where("paper is null")
    if paperless_quota is not None:
        loose = loose.orderBy(F.col("score").desc(), "version_id").limit(paperless_quota)
    return global_rank(kept.unionByName(loose), [F.col("score").desc(), F.col("version_id").asc()])


def bind_papers(entries: DataFrame, bindings: DataFrame) -> DataFrame:
    """bindings(version_id, paper) -> version_id, bound_paper, status: bound, paperless (bound to none) or unresolved."""
    b = bindings.select("version_id", F.col("paper").alias("bound_paper"), F.lit(True).alias("named"))
    status = F.when(F.col("bound_paper").isNotNull(), "bound").when(F.col("named"), "paperless").otherwise("unresolved")
    return entries.select("version_id").join(b, "version_id", "left").select("version_id", "bound_paper", status.alias("status"))


def order_violations(df: DataFrame, group: str, arrival: str, score: str) -> DataFrame:
    """Rows whose score is greater than the one that arrived before them in their group (nulls must come last)."""
    w = Window.partitionBy(group).orderBy(arrival)
    before = F.lag(F.struct(F.col(score).alias("s"))).over(w)
    return df.withColumn("_b", before).where(F.col("_b").isNotNull() & (F.col(score) > F.col("_b.s")) | (F.col("_b").isNotNull() & F.col("_b.s").isNull() & F.col(score).isNotNull())).drop("_b")


def first_observations(df: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """(key, first value, observations, conflicts): the first observation wins; conflicts are later ones of another value."""
    rows = df.where(F.col(key).isNotNull()).select(key, F.struct(*order).alias("o"), value.alias("v"))
    first = rows.groupBy(key).agg(F.min_by("v", "o").alias("first_value"))
    counted = rows.groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(first, key)
    return joined.groupBy(key, "first_value").agg(F.sum("n").alias("observations"), F.coalesce(F.sum(F.when(~F.col("v").eqNullSafe(F.col("first_value")), F.col("n"))), F.lit(0)).alias("conflicts"))


def current_records(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest observation of each key, by a combining aggregate rather than a window over all of a key's rows."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *[f"_r.{c}" for c in rest])


def coalesce_duplicates(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key: the most complete row wins, blanks are filled where only one value is known, conflicts are named."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    best = F.max_by(F.struct(*columns), F.struct(filled, F.xxhash64(*columns)))
    sets = [F.collect_set(c).alias(f"_{c}") for c in columns]
    g = df.groupBy(key).agg(best.alias("_b"), F.count(F.lit(1)).alias("rows"), *sets)
    value = lambda c: F.coalesce(F.col(f"_b.{c}"), F.when(F.size(f"_{c}") == 1, F.get(f"_{c}", F.lit(0)))).alias(c)
    conflicts = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"_{c}") > 1, F.lit(c)) for c in columns])))
    return g.select(key, *[value(c) for c in columns], "rows", conflicts.alias("conflicts"))


def merge_metadata(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, name, value, n_values): a value all rows agree on is kept, else null and their number."""
    d = df.where(F.col(value).isNotNull()).groupBy(key, name).agg(F.min(value).alias("low"), F.count_distinct(value).alias("n_values"))
    return d.select(key, name, F.when(F.col("n_values") == 1, F.col("low")).alias("value"), "n_values")


def older_than(df: DataFrame, at: str, since: str) -> DataFrame:
    """Rows before the window: what tells that a stream sorted by date has passed it."""
    return df.where(F.col(at) < F.lit(since).cast("timestamp"))


def merge_profiles(df: DataFrame, key: str) -> DataFrame:
    """profiles(key, profile_digest, name, kind, date_min, date_max) -> one row per key: the widest dates, the kind or ``composite``, how
    many were merged, and problem: digest_differs or name_differs, which no merge may have."""
    g = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("merged"), F.count_distinct("profile_digest").alias("_d"), F.count_distinct("name").alias("_n"), F.count_distinct("kind").alias("_k"), F.min("kind").alias("kind"), F.min("name").alias("name"), F.min("profile_digest").alias("profile_digest"), F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max")
    )
    problem = F.when(F.col("_d") > 1, "digest_differs").when(F.col("_n") > 1, "name_differs")
    return g.select(key, "name", F.when(F.col("_k") > 1, "composite").otherwise(F.col("kind")).alias("kind"), "profile_digest", "date_min", "date_max", "merged", problem.alias("problem"))


def set_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that one table has and the other lacks, with side: missing or unexpected. None means the tables hold the same set."""
    actual = actual.select(*expected.columns)
    return expected.subtract(actual).withColumn("side", F.lit("missing")).unionByName(actual.subtract(expected).withColumn("side", F.lit("unexpected")))
