"""Reading the test tables and the current rows of revisioned ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def current_rows(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key with the greatest version; nulls of the version sort lowest, ties keep one row.

    A partial ``max`` over (version, row) runs before the shuffle, so a key with very many revisions never gathers
    in one task. Rows with a null key are left out. Columns that Spark cannot order (maps) are carried as they are.
    """
    plain = [c for c in df.columns if c != key]
    kept = df.where(F.col(key).isNotNull())
    order = F.struct(F.col(version).isNotNull().alias("_has"), F.col(version).alias("_version"), F.xxhash64(*[F.col(c) for c in plain if not _has_map(df.schema[c].dataType)]).alias("_tie"))
    best = kept.groupBy(key).agg(F.max_by(F.struct(*plain), order).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in plain]).select(*df.columns)


def _has_map(kind) -> bool:
    from pyspark.sql import types as T

    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return False
