"""References to records that do not exist, were withdrawn or arrived only later.

The distinct non-null foreign keys are anti-joined against the parent keys (missing) and inner-joined to the parents'
state (deleted, late); both sides hold one row per key, so a key that a third of all rows refer to is one row there. The
verdicts are joined back to references that were counted per record, key and period beforehand.

Nulls: references with a null or blank key aren't references. A null time can't be late and has a null period. Repeated
rows count once per record in the result and each in ``n_references``. Parents with a null id are ignored; of repeated
parents the earliest arrival and, if any row is withdrawn, the withdrawal hold. Empty tables give no rows, or all
references as missing. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_form(c: Column) -> Column:
    """Entry ids compare without regard to case and surrounding blanks."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def references(df: DataFrame, table_name: str, record: Column, key: Column, at: Column) -> DataFrame:
    """Pre-aggregated references: table_name, record_key, fk, period_month, first_at, last_at, n_references."""
    rows = df.select(record.alias("record_key"), key_form(key).alias("fk"), at.alias("at")).where("fk is not null")
    return (
        rows.withColumn("period_month", F.date_format("at", "yyyy-MM"))
        .groupBy("record_key", "fk", "period_month")
        .agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n_references"))
        .select(F.lit(table_name).alias("table_name"), "record_key", "fk", "period_month", "first_at", "n_references")
    )


def parents(df: DataFrame, key: str, arrived: str, withdrawn: str) -> DataFrame:
    return df.select(key_form(F.col(key)).alias("fk"), F.col(arrived).alias("arrived_at"), F.col(withdrawn).isNotNull().alias("gone")).where("fk is not null").groupBy("fk").agg(F.min("arrived_at").alias("arrived_at"), F.bool_or("gone").alias("gone"))


def orphans(refs: DataFrame, known: DataFrame) -> DataFrame:
    """table_name, record_key, orphan_kind, period_month, n_references: kind is the first of missing, deleted, late."""
    keys = refs.select("fk").distinct()
    missing = keys.join(known, "fk", "left_anti").select("fk", F.lit("missing").alias("verdict"), F.lit(None).cast("timestamp").alias("arrived_at"))
    there = keys.join(known, "fk").select("fk", F.when(F.col("gone"), F.lit("deleted")).otherwise(F.lit("late")).alias("verdict"), "arrived_at")
    judged = refs.join(missing.unionByName(there), "fk").where("verdict <> 'late' or first_at < arrived_at")
    return judged.groupBy("table_name", "record_key", F.col("verdict").alias("orphan_kind"), "period_month").agg(F.sum("n_references").alias("n_references"))


def report(found: DataFrame) -> DataFrame:
    """Records with orphaned references and their references, per table, kind and month."""
    return found.groupBy("table_name", "orphan_kind", "period_month").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_references").alias("n_references"))
