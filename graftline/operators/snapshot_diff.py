"""What changed between consecutive full snapshots: sorted hash arrays per bucket, full values only for what differs.

Every record becomes four integers: the snapshot's number, a key hash, its row number and a hash of its normalised
values. They are spread over hash buckets of the key (never over feeds or snapshots, whose sizes may be very uneven), so a
bucket holds a bounded share of the rows whatever one feed holds. Inside a bucket numpy sorts them once; consecutive
snapshots are compared by ``searchsorted``. Only the keys that differ are joined back to the records.

Hashes have 64 bits. Values are only compared for one key in two snapshots, so a change is missed with a probability of 2^-64
each; keys of one feed must differ in their hash, which a billion of them do with a probability of 0.97.

Nulls: records with a null snapshot or key are left out; a null row number sorts last. Null, blank and empty values are
equal. A snapshot without records counts as delivered empty. Further columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of four integers that one bucket sorts at once, about 50 MB.
BUCKET_ROWS = 1_000_000


def ordered_snapshots(reports: DataFrame) -> DataFrame:
    """Complete full runs -> (feed_id, snapshot_digest, snap_no, prev_digest): a feed's snapshots by their first start."""
    first = (
        reports.where("complete and sync_mode = 'full' and snapshot_digest is not null and feed_id is not null")
        .groupBy("feed_id", "snapshot_digest")
        .agg(F.min("started_at").alias("first_at"))
    )
    w = Window.partitionBy("feed_id").orderBy(F.col("first_at").asc_nulls_first(), "snapshot_digest")
    return first.select("feed_id", "snapshot_digest", F.row_number().over(w).cast("bigint").alias("snap_no"), F.lag("snapshot_digest").over(w).alias("prev_digest"))


def row_hash(values: list[str], lists: list[str], df: DataFrame) -> Column:
    """64-bit hash of the values: text trimmed, blank as null; list elements trimmed, blanks dropped, sorted."""
    kinds = dict(df.dtypes)
    parts = []
    for c in values:
        text = F.nullif(F.trim(F.col(c)), F.lit("")) if kinds[c] == "string" else F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.lit("v"), text), F.lit("n")))
    for c in lists:
        tidy = F.array_sort(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
        parts.append(F.array_join(F.transform(tidy, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), ","))
    return F.xxhash64(*parts)


def _bucket_changes(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py()
    feed, snap, key, row, value, last = (table.column(c).to_numpy() for c in ("feed_hash", "snap_no", "key_hash", "row_no", "value_hash", "last_no"))
    order = np.lexsort((value, row, key, snap, feed))
    feed, snap, key, value, last = feed[order], snap[order], key[order], value[order], last[order]
    first = np.ones(len(key), bool)
    first[1:] = (feed[1:] != feed[:-1]) | (snap[1:] != snap[:-1]) | (key[1:] != key[:-1])
    feed, snap, key, value, last = feed[first], snap[first], key[first], value[first], last[first]
    outs: list[tuple[np.ndarray, ...]] = []
    starts = np.flatnonzero(np.r_[True, feed[1:] != feed[:-1]]) if len(feed) else np.array([], int)
    for a, b in zip(starts, np.r_[starts[1:], len(feed)]):
        edges = a + np.flatnonzero(np.r_[True, snap[a + 1 : b] != snap[a : b - 1]])
        spans = {int(snap[s]): (s, e) for s, e in zip(edges, np.r_[edges[1:], b])}
        none = (a, a)
        for n in sorted({*spans, *(x + 1 for x in spans)}):
            if n < 2 or n > last[a]:
                continue
            (s0, e0), (s1, e1) = spans.get(n - 1, none), spans.get(n, none)
            old, new = key[s0:e0], key[s1:e1]
            at = np.searchsorted(old, new)
            hit = np.zeros(len(new), bool)
            ok = at < len(old)
            hit[ok] = old[at[ok]] == new[ok]
            back = np.searchsorted(new, old)
            gone = np.ones(len(old), bool)
            ok = back < len(new)
            gone[ok] = new[back[ok]] != old[ok]
            changed = np.flatnonzero(hit)[value[s1:e1][hit] != value[s0:e0][at[hit]]]
            for kind, keys in (("added", new[~hit]), ("removed", old[gone]), ("changed", new[changed])):
                if len(keys):
                    outs.append((np.full(len(keys), feed[a]), np.full(len(keys), n), keys, np.full(len(keys), kind)))
    feeds, numbers, keys, kinds = (np.concatenate([o[i] for o in outs]) if outs else np.array([], "int64" if i < 3 else "str") for i in range(4))
    return pa.table({"part": pa.array(np.full(len(keys), part), pa.int32()), "feed_hash": pa.array(feeds, pa.int64()), "snap_no": pa.array(numbers, pa.int64()), "key_hash": pa.array(keys, pa.int64()), "change_kind": pa.array(kinds.tolist(), pa.string())})


def changes(records: DataFrame, reports: DataFrame, values: list[str], lists: list[str], key: str = "catalog_id", buckets: int | None = None) -> DataFrame:
    """(feed_id, snapshot_digest, key, change_kind) for each pair of consecutive snapshots; the digest is the later one's.

    ``buckets``: number of hash buckets; by default as many as keep a bucket at ``BUCKET_ROWS`` rows or fewer on average, at
    least eight per shuffle partition. The count of rows comes from the files' footers.
    """
    spark = records.sparkSession
    buckets = buckets or max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-records.count() // BUCKET_ROWS))
    snaps = ordered_snapshots(reports)
    ends = snaps.groupBy("feed_id").agg(F.max("snap_no").alias("last_no"))
    numbered = snaps.join(ends, "feed_id")
    keyed = records.where(F.col(key).isNotNull() & F.col("snapshot_digest").isNotNull()).select(
        "feed_id", "snapshot_digest", F.xxhash64(key).alias("key_hash"), F.coalesce(F.col("row_no").cast("bigint"), F.lit(2**62)).alias("row_no"), row_hash(values, lists, records).alias("value_hash")
    )
    compact = keyed.join(numbered, ["feed_id", "snapshot_digest"]).select(
        F.pmod(F.xxhash64("key_hash"), F.lit(buckets)).cast("int").alias("part"), F.xxhash64("feed_id").alias("feed_hash"), "snap_no", "key_hash", "row_no", "value_hash", "last_no"
    )
    differing = compact.groupBy("part").applyInArrow(_bucket_changes, "part int, feed_hash bigint, snap_no bigint, key_hash bigint, change_kind string")
    named = differing.join(numbered.withColumn("feed_hash", F.xxhash64("feed_id")), ["feed_hash", "snap_no"]).select(
        "feed_id", "snapshot_digest", "key_hash", "change_kind", F.when(F.col("change_kind") == "removed", F.col("prev_digest")).otherwise(F.col("snapshot_digest")).alias("held_in")
    )
    full = records.where(F.col(key).isNotNull()).select("feed_id", F.col("snapshot_digest").alias("held_in"), F.xxhash64(key).alias("key_hash"), F.col(key))
    return named.join(full, ["feed_id", "held_in", "key_hash"]).select("feed_id", "snapshot_digest", key, "change_kind").distinct()
