"""Processing only new or changed records: partition fingerprints and atomic replacement of changed partitions.

Observations are assigned to batches (a complete run takes its own and those of the incomplete runs before it) and spread over
partitions by key. A refresh first fingerprints each partition by its row count and an additive hash of its raw rows: one scan,
joined to the runs, of which only two numbers a partition and task are shuffled. Only partitions whose fingerprint differs from
the one stored with their last result are then deduplicated, processed and written. Result and fingerprint of a partition lie in
the same directory and are replaced together by dynamic partition overwrite, so a run that fails leaves each partition either
old or new; the next run finds the old ones by their fingerprint.

The result of a partition depends on nothing else, so nothing is skipped or repeated whenever rows come late or twice.

The number of partitions follows the number of rows (a power of two that keeps a partition at ``PART_ROWS`` or fewer on average)
and names a layout of its own below the state; a layout is read once all its partitions are there, so the state stays whole
while a larger one is written.

Nulls: observations with a null run, key or version are left out, those of runs that no report names only date their version. A version
without any time can't be ordered and is never processed. Of versions of one time in one batch the greatest id is taken. A
version belongs to one key. Empty tables give an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

STORED = "run_id string, version_id string, fp_rows bigint, fp_hash decimal(38,0), parts int, part int"
PART_ROWS, LEAST_PARTS = 500_000, 32


def batches(reports: DataFrame) -> DataFrame:
    """Incremental runs -> (run_id, feed_id, batch_no, batch_run): the complete run that processes a run's observations."""
    runs = reports.where("sync_mode = 'incremental' and run_id is not null and feed_id is not null").select("run_id", "feed_id", "started_at", F.coalesce("complete", F.lit(False)).alias("complete"))
    w = Window.partitionBy("feed_id").orderBy(F.col("started_at").asc_nulls_first(), "run_id")
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    numbered = runs.withColumn("no", F.row_number().over(w).cast("bigint"))
    taken = F.first(F.when(F.col("complete"), F.struct("no", "run_id")), ignorenulls=True).over(ahead)
    return numbered.withColumn("taken", taken).where("taken is not null").select("run_id", "feed_id", F.col("taken.no").alias("batch_no"), F.col("taken.run_id").alias("batch_run"))


def layout(rows: int) -> int:
    """Partitions for so many rows."""
    parts = LEAST_PARTS
    while rows > parts * PART_ROWS:
        parts *= 2
    return parts


def delivered(observations: DataFrame, reports: DataFrame, parts: int) -> DataFrame:
    """Raw rows with their partition, and feed and batch if their run is in one; nothing is shuffled but the runs."""
    seen = observations.where("run_id is not null and catalog_id is not null and version_id is not null")
    rows = seen.select("run_id", "catalog_id", "version_id", "modified_at", "observed_at", F.pmod(F.xxhash64("catalog_id"), F.lit(parts)).cast("int").alias("part"))
    return rows.join(batches(reports), "run_id", "left")


def fingerprints(rows: DataFrame) -> DataFrame:
    """(part, fp_rows, fp_hash) of ``delivered`` rows."""
    line = F.xxhash64("feed_id", "catalog_id", "batch_no", "batch_run", "version_id", F.col("modified_at").cast("string"), F.col("observed_at").cast("string"))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("fp_rows"), F.sum(line.cast("decimal(20,0)")).cast("decimal(38,0)").alias("fp_hash"))


def versions(rows: DataFrame) -> DataFrame:
    """One row per (feed, key, batch, version) with the version's time, without repeats."""
    times = rows.groupBy("part", "catalog_id", "version_id").agg(F.max("modified_at").alias("m"), F.min("observed_at").alias("o")).select("part", "catalog_id", "version_id", F.coalesce("m", "o").alias("at")).where("at is not null")
    once = rows.where("batch_no is not null").groupBy("part", "catalog_id", "version_id", "feed_id", "batch_no", "batch_run").agg(F.lit(1).alias("one")).drop("one")
    return once.join(times, ["part", "catalog_id", "version_id"])


def process(rows: DataFrame) -> DataFrame:
    """Per key and batch its latest version; it is processed if later than all that earlier batches brought.

    The latest of a batch either becomes the latest processed or is no later than it, so the running maximum over the
    batches before is the latest processed version. A key has at most one row per batch when the window sees it.
    """
    best = rows.groupBy("part", "feed_id", "catalog_id", "batch_no", "batch_run").agg(F.max(F.struct("at", "version_id")).alias("v"))
    before = Window.partitionBy("part", "feed_id", "catalog_id").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("done", F.max("v.at").over(before)).where("done is null or v.at > done").select("part", F.col("batch_run").alias("run_id"), F.col("v.version_id").alias("version_id"))


def _marks(spark, state: str) -> tuple[int | None, DataFrame | None]:
    """The number of partitions of the layout that holds (the largest with marks of all its partitions), and all marks."""
    try:
        marks = spark.read.schema(STORED).parquet(state).where("version_id is null").select("parts", "part", "fp_rows", "fp_hash")
    except AnalysisException:
        return None, None
    whole = marks.groupBy("parts").agg(F.count_distinct("part").alias("n")).where("n = parts").agg(F.max("parts").alias("parts")).first()
    return (whole.parts if whole else None), marks


def refresh(observations: DataFrame, reports: DataFrame, state: str, partitions: int | None = None) -> list[int]:
    """Bring the stored results at ``state`` up to date; returns the partitions that were recomputed.

    ``partitions``: by default from the number of observations, which the files' footers give."""
    spark = observations.sparkSession
    parts = partitions or layout(observations.count())
    rows = delivered(observations, reports, parts)
    every = spark.range(parts).select(F.col("id").cast("int").alias("part"))
    now = every.join(fingerprints(rows), "part", "left").select("part", F.coalesce("fp_rows", F.lit(0)).alias("fp_rows"), F.coalesce("fp_hash", F.lit(0).cast("decimal(38,0)")).alias("fp_hash"))
    _, marks = _marks(spark, state)
    if marks is not None:
        old = marks.where(F.col("parts") == parts).select("part", F.col("fp_rows").alias("o_rows"), F.col("fp_hash").alias("o_hash"))
        now = now.join(old, "part", "left").where(~F.col("o_rows").eqNullSafe(F.col("fp_rows")) | ~F.col("o_hash").eqNullSafe(F.col("fp_hash")))
    else:
        now = now.withColumn("o_rows", F.lit(None).cast("bigint"))
    stale = now.collect()  # one row for each partition
    if not stale:
        return []
    todo = sorted(r.part for r in stale)
    touched = rows if len(todo) == parts else rows.where(F.col("part").isin(todo))
    result = process(versions(touched)).select("run_id", "version_id", F.lit(None).cast("bigint").alias("fp_rows"), F.lit(None).cast("decimal(38,0)").alias("fp_hash"), "part")
    marked = spark.createDataFrame([(None, None, r.fp_rows, r.fp_hash, r.part) for r in stale], "run_id string, version_id string, fp_rows bigint, fp_hash decimal(38,0), part int")
    both = result.unionByName(marked).withColumn("parts", F.lit(parts))
    both.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("parts", "part").parquet(state)
    return sorted(r.part for r in stale if r.fp_rows or r.o_rows)  # empty ones only got their marks


def processed(spark, state: str) -> DataFrame:
    """run_id, version_id of all that was processed so far."""
    parts, _ = _marks(spark, state)
    return spark.read.schema(STORED).parquet(state).where((F.col("parts") == (parts or 0)) & F.col("version_id").isNotNull()).select("run_id", "version_id")
