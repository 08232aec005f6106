"""Queries of the general problems 3, 5, 6 and 7 over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.operators import hierarchy, incremental, orphans, snapshot_diff
from graftline.session import Scratch, shared_dir
from graftline.tables import current_rows, load

SNAPSHOT_VALUES = ["name", "access_kind", "license", "citations", "parameters", "modified_at", "revision"]


def current_entries(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return current_rows(load(spark, sf, "entries").select("id", "modified_at", *columns), "id", "modified_at")


def relations(spark: SparkSession, sf: str) -> DataFrame:
    return current_entries(spark, sf, "model_relations").select("id", F.explode("model_relations").alias("r"))


def derived_links(spark: SparkSession, sf: str) -> DataFrame:
    """(child, parent) of the derived-from relations; parent is null where no such entry exists. A subject's local id stands
    behind the same prefix as in the id of the entry that carries the relation."""
    entries = load(spark, sf, "entries").select(orphans.key_form(F.col("id")).alias("id")).where("id is not null").distinct()
    stated = (
        relations(spark, sf)
        .where(F.regexp_replace(F.lower(F.trim("r.predicate")), r"[\s_-]+", "-") == "derived-from")
        .select(orphans.key_form(F.coalesce(F.concat(F.regexp_extract("id", "^(.*:)", 1), F.col("r.subject_model_local_id")), F.col("id"))).alias("child"), orphans.key_form(F.col("r.target.entry_id")).alias("parent"))
        .where("parent is not null")
        .distinct()
    )
    known = stated.join(entries.select(F.col("id").alias("parent"), F.lit(True).alias("there")), "parent", "left").select("child", F.when(F.col("there"), F.col("parent")).alias("parent"))
    own = known.join(entries.select(F.col("id").alias("child")), "child", "left_semi")
    lone = known.where("parent is not null").join(entries.select(F.col("id").alias("child")), "child", "left_anti").select(F.col("parent").alias("child"), F.lit(None).cast("string").alias("parent"))
    return own.unionByName(lone)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.decompose(derived_links(spark, sf)).select(F.col("node").alias("entry_id"), "root_id", "tree_depth")


def p3_paths(spark: SparkSession, sf: str) -> DataFrame:
    placed = hierarchy.decompose(derived_links(spark, sf))
    return hierarchy.paths(placed).join(placed.select("node", "subtree_size"), "node").select(F.col("node").alias("entry_id"), "path", (F.col("subtree_size") - 1).alias("n_descendants"))


def p3_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.decompose(derived_links(spark, sf))).select(F.col("node").alias("entry_id"), F.col("descendant").alias("descendant_id"))


def p3_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.cycles(hierarchy.decompose(derived_links(spark, sf))).select("cycle_id", F.col("node").alias("entry_id"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = snapshot_diff.changes(load(spark, sf, "snapshot_records"), load(spark, sf, "sync_reports"), SNAPSHOT_VALUES, ["tags"])
    return found.select("snapshot_digest", "catalog_id", "change_kind")


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    entries = current_entries(spark, sf, "recorded_at", "withdrawn_at")
    stated = relations(spark, sf)
    refs = orphans.references(stated, "entries", F.col("r.source_record_id"), F.col("r.target.entry_id"), F.col("r.stated_at")).unionByName(
        orphans.references(load(spark, sf, "profile_characters"), "profile_characters", F.col("model_id"), F.col("model_id"), F.col("extracted_at"))
    )
    return orphans.orphans(refs, orphans.parents(entries, "id", "recorded_at", "withdrawn_at"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("table_name", "record_key", "orphan_kind", "period_month")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.report(_orphans(spark, sf))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """A fresh state in the shared folder and two refreshes: one with what the runs before the last day of reports delivered, one with
    everything, late rows and repeats included; only the partitions that the second finds changed are computed again."""
    state = Scratch(spark, "p7").root + "/state-" + uuid.uuid4().hex
    observations, reports = load(spark, sf, "observations"), load(spark, sf, "sync_reports")
    last = reports.agg((F.max("started_at") - F.expr("interval 1 day")).alias("last_day"))
    earlier = reports.join(F.broadcast(last), F.col("started_at") < F.col("last_day")).drop("last_day")
    incremental.refresh(observations, earlier, state)
    incremental.refresh(observations, reports, state)
    return incremental.processed(spark, state)


def queries():
    return {f.__name__: f for f in (p3_found, p3_paths, p3_descendants, p3_cycles, p5_found, p6_found, p6_report, p7_found)}


_CURRENT = "cur AS (SELECT * FROM entries e WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_at DESC NULLS LAST) = 1), rel AS (SELECT id, unnest(model_relations) AS r FROM cur)"

_FOREST = f"""{_CURRENT},
ids AS (SELECT DISTINCT lower(trim(id)) AS id FROM entries WHERE id IS NOT NULL),
stated AS (SELECT DISTINCT lower(trim(coalesce(regexp_extract(id, '^(.*:)', 1) || r.subject_model_local_id, id))) AS child, nullif(lower(trim(r.target.entry_id)), '') AS parent FROM rel
  WHERE regexp_replace(lower(trim(r.predicate)), '[\\s_-]+', '-', 'g') = 'derived-from' AND nullif(trim(r.target.entry_id), '') IS NOT NULL),
links AS (SELECT s.child, p.id AS parent FROM stated s LEFT JOIN ids p ON s.parent = p.id),
nodes AS (SELECT DISTINCT n FROM (SELECT child AS n FROM links UNION SELECT parent FROM links) JOIN ids ON n = id),
edge AS (SELECT child, min(parent) AS parent FROM links JOIN ids ON child = id WHERE parent IS NOT NULL GROUP BY child),
walk AS (SELECT n AS node, n AS root, 0 AS depth, n AS path FROM nodes WHERE n NOT IN (SELECT child FROM edge)
  UNION ALL SELECT e.child, w.root, w.depth + 1, w.path || '/' || e.child FROM walk w JOIN edge e ON e.parent = w.node)"""

_BATCHES = """runs AS (SELECT run_id, feed_id, started_at, coalesce(complete, false) AS complete FROM sync_reports WHERE sync_mode = 'incremental'),
done AS (SELECT r.run_id, r.feed_id, (SELECT min(struct_pack(s := c.started_at, i := c.run_id)) FROM runs c WHERE c.feed_id = r.feed_id AND c.complete AND c.started_at >= r.started_at) AS b FROM runs r),
times AS (SELECT version_id, coalesce(max(modified_at), min(observed_at)) AS t FROM observations GROUP BY version_id),
best AS (SELECT d.feed_id, o.catalog_id, d.b.s AS started, d.b.i AS run_id, max(struct_pack(t := t.t, v := o.version_id)) AS m
  FROM observations o JOIN done d USING (run_id) JOIN times t USING (version_id) WHERE d.b IS NOT NULL AND t.t IS NOT NULL GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    orphan = f"""{_CURRENT},
refs AS (SELECT 'entries' AS table_name, r.source_record_id AS record_key, nullif(lower(trim(r.target.entry_id)), '') AS fk, r.stated_at AS ts FROM rel
  UNION ALL SELECT 'profile_characters', model_id, nullif(lower(trim(model_id)), ''), extracted_at FROM profile_characters),
judged AS (SELECT table_name, record_key, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS period_month, CASE WHEN c.id IS NULL THEN 'missing' WHEN c.withdrawn_at IS NOT NULL THEN 'deleted' WHEN c.recorded_at > ts THEN 'late' END AS orphan_kind
  FROM refs LEFT JOIN cur c ON fk = lower(trim(c.id)) WHERE fk IS NOT NULL)"""
    tidy = ", ".join(f"nullif(trim({c}), '')" if c not in ("citations", "parameters", "modified_at") else c for c in SNAPSHOT_VALUES)
    return {
        "p3_found": f"WITH RECURSIVE {_FOREST} SELECT n AS entry_id, coalesce(root, 'cycle') AS root_id, CAST(coalesce(depth, -1) AS INTEGER) AS tree_depth FROM nodes LEFT JOIN walk ON n = node",
        "p3_paths": f"WITH RECURSIVE {_FOREST} SELECT w.node AS entry_id, w.path, count(d.node) AS n_descendants FROM walk w LEFT JOIN walk d ON starts_with(d.path, w.path || '/') GROUP BY ALL",
        "p3_descendants": f"WITH RECURSIVE {_FOREST}, up AS (SELECT node, unnest(string_split(path, '/')) AS a FROM walk) SELECT a AS entry_id, node AS descendant_id FROM up WHERE a <> node",
        "p3_cycles": f"WITH RECURSIVE {_FOREST}, ring AS (SELECT child AS start, parent AS here, child AS low, 1 AS n FROM edge WHERE child NOT IN (SELECT node FROM walk) UNION ALL SELECT start, e.parent, least(low, here), n + 1 FROM ring JOIN edge e ON e.child = here WHERE start <> here AND n < 200) SELECT low AS cycle_id, start AS entry_id FROM ring WHERE start = here",
        "p5_found": f"""WITH firsts AS (SELECT feed_id, snapshot_digest, min(started_at) AS s FROM sync_reports WHERE complete AND sync_mode = 'full' AND snapshot_digest IS NOT NULL GROUP BY ALL),
snaps AS (SELECT *, lag(snapshot_digest) OVER (PARTITION BY feed_id ORDER BY s, snapshot_digest) AS prev FROM firsts),
held AS (SELECT feed_id, snapshot_digest, catalog_id, row({tidy}, list_sort(list_transform(tags, lambda x: trim(x)))) AS v FROM snapshot_records QUALIFY row_number() OVER (PARTITION BY feed_id, snapshot_digest, catalog_id ORDER BY row_no) = 1),
new AS (SELECT s.feed_id, s.snapshot_digest, catalog_id, v FROM snaps s JOIN held USING (feed_id, snapshot_digest) WHERE prev IS NOT NULL),
old AS (SELECT s.feed_id, s.snapshot_digest, catalog_id, v FROM snaps s JOIN held h ON s.feed_id = h.feed_id AND s.prev = h.snapshot_digest)
SELECT coalesce(n.snapshot_digest, o.snapshot_digest) AS snapshot_digest, coalesce(n.catalog_id, o.catalog_id) AS catalog_id, CASE WHEN o.catalog_id IS NULL THEN 'added' WHEN n.catalog_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM new n FULL JOIN old o ON n.feed_id = o.feed_id AND n.snapshot_digest = o.snapshot_digest AND n.catalog_id = o.catalog_id WHERE o.catalog_id IS NULL OR n.catalog_id IS NULL OR n.v IS DISTINCT FROM o.v""",
        "p6_found": f"WITH {orphan} SELECT DISTINCT table_name, record_key, orphan_kind, period_month FROM judged WHERE orphan_kind IS NOT NULL",
        "p6_report": f"""WITH {orphan}, per AS (SELECT table_name, record_key, orphan_kind, period_month, count(*) AS c FROM judged WHERE orphan_kind IS NOT NULL GROUP BY ALL)
SELECT table_name, orphan_kind, period_month, count(*) AS n_records, CAST(sum(c) AS BIGINT) AS n_references FROM per GROUP BY ALL""",
        "p7_found": f"WITH {_BATCHES}, seen AS (SELECT *, max(m.t) OVER (PARTITION BY feed_id, catalog_id ORDER BY started ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best) SELECT run_id, m.v AS version_id FROM seen WHERE before IS NULL OR m.t > before",
    }
