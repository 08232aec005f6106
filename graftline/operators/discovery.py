"""Discovery of catalogs page by page, as a relation: which pages a scan would have read, why it stopped, what it found.

pages(scan_id, page_no, next_cursor, total_count, population, ordered_by, results_complete) and entries(scan_id, page_no, pos,
version_id, at, score, digest) hold what a provider delivered, in the order of its cursor; ``digest`` covers an entry without its
volatile fields. A scan reads pages until the first that gives a reason to stop; everything is told from sums over pages, so
scans of any number and length go through at once, and no scan's entries gather in one task.

A scan is resumed by giving its ``prior`` members; they count as observed before the first page.

Nulls: entries without a version or page are left out; a null score is a missing metric, a null date lies in no window. Repeated
versions count once, the first observation wins. Empty tables give no scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graftline.operators import catalog

# Why a scan stops.
EXHAUSTED, BUDGET, INCOMPLETE, BOUND, WINDOW, CAP, REPEATED = (
    "provider_exhausted", "page_budget", "provider_reported_incomplete_results", "importance_bound_satisfied", "date_window_exhausted", "provider_result_cap_requires_partition", "cursor_repeated",
)


@dataclass(frozen=True)
class CatalogQuery:
    """What is asked of a provider: a half-open window of a date field, and how many entries by a metric, at most one of both given."""

    date_field: str | None = None
    since: str | None = None
    until: str | None = None
    metric: str | None = None
    top_k: int | None = None
    top_p: float | None = None

    def __post_init__(self):
        if self.metric is None and (self.top_k is not None or self.top_p is not None):
            raise ValueError("a rank needs a metric")
        if self.metric is not None and (self.top_k is None) == (self.top_p is None):
            raise ValueError("either top_k or top_p")
        if self.top_k is not None and (isinstance(self.top_k, bool) or not isinstance(self.top_k, int) or self.top_k < 1):
            raise ValueError("top_k is a positive whole number")
        if self.top_p is not None and (isinstance(self.top_p, bool) or not 0 < self.top_p <= 1):
            raise ValueError("top_p lies in (0, 1]")
        if (self.since or self.until) and not self.date_field:
            raise ValueError("a window needs a date field")
        if self.since and self.until and self.since >= self.until:
            raise ValueError("the window is empty")


def observation_digest(df: DataFrame, volatile: list[str]) -> DataFrame:
    """df + digest of all columns but the volatile ones."""
    kept = sorted(c for c in df.columns if c not in volatile)
    return df.withColumn("digest", F.sha2(F.to_json(F.struct(*kept)), 256))


def scan(pages: DataFrame, entries: DataFrame, query: CatalogQuery, max_pages: int | None = None, result_cap: int | None = None, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, scans): members(scan_id, version_id, page_no, pos, at, score, digest), and per scan pages_fetched, records_seen,
    eligible_entries, conflicts, stopped_reason, complete, population_exhausted, order_verified, next_cursor."""
    windowed = bool(query.since or query.until)
    of_scan = Window.partitionBy("scan_id").orderBy("page_no")
    upto = of_scan.rowsBetween(Window.unboundedPreceding, 0)
    before = of_scan.rowsBetween(Window.unboundedPreceding, -1)
    p = pages.where("scan_id is not null and page_no is not null").withColumn("nth", F.row_number().over(of_scan))
    if max_pages is not None:
        p = p.where(F.col("nth") <= max_pages)
    rows = entries.where("version_id is not null and page_no is not null").select("scan_id", "page_no", "pos", "version_id", "at", "score", "digest")
    held = catalog.in_window(rows, "at", query.since, query.until) if windowed else rows
    if prior is not None:
        held = held.unionByName(prior.select("scan_id", F.lit(-1).cast(rows.schema["page_no"].dataType).alias("page_no"), F.lit(0).cast(rows.schema["pos"].dataType).alias("pos"), "version_id", "at", "score", "digest"))
    first = held.groupBy("scan_id", "version_id").agg(F.min_by(F.struct("page_no", "pos", "at", "score", "digest"), F.struct("page_no", "pos")).alias("f")).select("scan_id", "version_id", "f.*")
    again = held.join(first.select("scan_id", "version_id", F.col("digest").alias("first_digest")), ["scan_id", "version_id"]).where(~F.col("digest").eqNullSafe(F.col("first_digest")))
    within = Window.partitionBy("scan_id", "page_no").orderBy("pos")
    worse = F.lag(F.struct("score")).over(within)
    ordered = first.withColumn("broken", worse.isNotNull() & F.col("score").isNotNull() & (worse["score"].isNull() | (F.col("score") > worse["score"])))
    per_page = ordered.groupBy("scan_id", "page_no").agg(F.count(F.lit(1)).alias("new"), F.count("score").alias("scored"), F.min("score").alias("low"), F.max("score").alias("high"), F.bool_or("broken").alias("broken"), F.bool_or(F.col("score").isNull()).alias("unscored"))
    seen = rows.groupBy("scan_id", "page_no").agg(F.count(F.lit(1)).alias("seen"), F.coalesce(F.bool_or(F.col("at") < F.lit(query.since).cast("timestamp")), F.lit(False)).alias("older") if query.since else F.lit(False).alias("older"))
    clash = again.groupBy("scan_id", "page_no").agg(F.count(F.lit(1)).alias("clashes"))
    full = p.join(per_page, ["scan_id", "page_no"], "left").join(seen, ["scan_id", "page_no"], "left").join(clash, ["scan_id", "page_no"], "left")
    if prior is not None:  # what was known before weighs on the first page
        known = per_page.where("page_no = -1").select("scan_id", F.col("scored").alias("p_scored"), F.col("low").alias("p_low"), F.col("unscored").alias("p_unscored"), F.col("new").alias("p_new"))
        full = full.join(known, "scan_id", "left")
    else:
        full = full.withColumn("p_scored", F.lit(0)).withColumn("p_low", F.lit(None).cast("double")).withColumn("p_unscored", F.lit(False)).withColumn("p_new", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    low, gap = F.least(F.min("low").over(before), F.col("p_low")), F.coalesce(F.bool_or("unscored").over(before), F.lit(False)) | F.coalesce("p_unscored", F.lit(False))
    wrong = F.coalesce("broken", F.lit(False)) | F.coalesce(F.col("high") > low, F.lit(False)) | (gap & F.col("high").isNotNull())
    if query.metric is not None and not windowed:
        wrong = wrong | ~F.col("ordered_by").eqNullSafe(F.lit(query.metric))
    full = full.withColumn("wrong", wrong).withColumn("verified", ~F.bool_or("wrong").over(upto)).withColumn("all_scored", F.sum(zero(F.col("scored"))).over(upto) + zero(F.col("p_scored"))).withColumn("all_seen", F.sum(zero(F.col("seen"))).over(upto))
    full = full.withColumn("all_new", F.sum(zero(F.col("new"))).over(upto) + zero(F.col("p_new"))).withColumn("all_clashes", F.sum(zero(F.col("clashes"))).over(upto)).withColumn("total", F.last("total_count", ignorenulls=True).over(upto)).withColumn("ranked", F.last("population", ignorenulls=True).over(upto))
    target = F.lit(None).cast("bigint") if query.metric is None or windowed else F.lit(query.top_k) if query.top_k is not None else F.ceil(F.lit(query.top_p) * F.col("ranked"))
    capped = F.coalesce(F.col("total") > F.col("all_seen"), F.lit(False)) if result_cap is not None else F.lit(False)
    same = Window.partitionBy("scan_id", "next_cursor").orderBy("page_no")
    full = full.withColumn("turn", F.row_number().over(same))
    reason = (
        F.when(~F.coalesce("results_complete", F.lit(True)), INCOMPLETE)
        .when(F.col("verified") & (F.col("all_scored") >= target), BOUND)
        .when(F.coalesce("older", F.lit(False)) & F.col("ordered_by").eqNullSafe(F.lit(query.date_field)), WINDOW)
        .when(F.col("next_cursor").isNull() & capped, CAP)
        .when(F.col("next_cursor").isNull(), EXHAUSTED)
        .when(F.col("turn") > 1, REPEATED)
    )
    full = full.withColumn("reason", reason)
    last = full.groupBy("scan_id").agg(F.coalesce(F.min(F.when(F.col("reason").isNotNull(), F.col("page_no"))), F.max("page_no")).alias("last_page"))
    end = full.join(last, "scan_id").where("page_no = last_page")
    why = F.coalesce("reason", F.lit(BUDGET))
    exhausted = why.isin(EXHAUSTED, WINDOW)
    scans = end.select(
        "scan_id", F.col("nth").cast("bigint").alias("pages_fetched"), F.col("all_seen").alias("records_seen"), F.col("all_new").cast("bigint").alias("eligible_entries"), F.col("all_clashes").alias("conflicts"), why.alias("stopped_reason"),
        why.isin(EXHAUSTED, WINDOW, BOUND).alias("complete"), exhausted.alias("population_exhausted"), F.col("verified").alias("order_verified"), F.when(~exhausted, F.col("next_cursor")).alias("next_cursor"),
    )
    members = first.join(last, "scan_id").where("page_no <= last_page").drop("last_page")
    return members, scans


def snapshot_problems(snapshot: DataFrame) -> DataFrame:
    """(scan_id, problem, subject) of catalog snapshots or ranked manifests (scan_id, version_id[, rank]): null_version,
    duplicate_version, ranks_not_contiguous."""
    blank = snapshot.where("version_id is null or trim(version_id) = ''").select("scan_id", F.lit("null_version").alias("problem"), F.lit(None).cast("string").alias("subject"))
    twice = snapshot.where("version_id is not null").groupBy("scan_id", "version_id").count().where("count > 1").select("scan_id", F.lit("duplicate_version").alias("problem"), F.col("version_id").alias("subject"))
    found = blank.unionByName(twice)
    if "rank" in snapshot.columns:
        r = snapshot.where("rank is not null").groupBy("scan_id").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("d"))
        found = found.unionByName(r.where("low <> 1 or high <> n or d <> n").select("scan_id", F.lit("ranks_not_contiguous").alias("problem"), F.lit(None).cast("string").alias("subject")))
    return found


def plan_extraction(targets: DataFrame, policy: str, attempts: DataFrame, retry_failed: bool = False) -> DataFrame:
    """targets(entry_id, target), attempts(run_key, status) of earlier runs -> (entry_id, target, run_key, action): a target's run is named
    by a digest of it and the policy; one that succeeded is cached, one that failed is cached too unless retried, others are pending."""
    key = F.sha2(F.to_json(F.struct(F.lit(policy).alias("policy"), "target")), 256)
    done = attempts.groupBy("run_key").agg(F.bool_or(F.col("status") == "success").alias("won"))
    j = targets.select("entry_id", "target", key.alias("run_key")).join(done, "run_key", "left")
    return j.select("entry_id", "target", "run_key", F.when(F.col("won"), "cached_success").when(F.col("won").isNotNull() & ~F.lit(retry_failed), "cached_failure").otherwise("pending").alias("action"))


def popularity_manifest(entries: DataFrame, limit: int, citations: DataFrame | None = None) -> DataFrame:
    """entries(version_id, revision, score, papers array) -> the ``limit`` best pinned ones: rank, version_id, revision, score, papers and,
    with citations(paper, cited), the most cited of their papers."""
    top = catalog.top_k(entries.where("revision is not null"), limit)
    ranked = catalog.ranked(top).select("rank", "version_id", "revision", "score", "papers")
    if citations is None:
        return ranked
    cited = ranked.select("version_id", F.explode("papers").alias("paper")).join(citations.groupBy("paper").agg(F.max("cited").alias("cited")), "paper")
    most = cited.groupBy("version_id").agg(F.max("cited").alias("cited"))
    return ranked.join(most, "version_id", "left").select("rank", "version_id", "revision", "score", "papers", "cited")
