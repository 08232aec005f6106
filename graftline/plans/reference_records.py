"""Queries on catalogs, bindings, evidence, registries, text and sources, each with its SQL where SQL can say it."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graftline.functions import canonical
from graftline.functions import text as T
from graftline.operators import binding, catalog, discovery, documents, source_graph
from graftline.plans import bindings as B
from graftline.session import Scratch
from graftline.sources import feeds, writers
from graftline.streaming import registry
from graftline.tables import load

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_C = f"WITH {B.CATALOG}"


@query(f"{_C} SELECT version_id FROM cat WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1997-01-01'")
def catalog_date_window(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.in_window(B.catalog(spark, sf), "created_at", "1996-01-01", "1997-01-01").select("version_id")


@query(f"{_C} SELECT version_id FROM cat WHERE contains(lower(name || ' ' || o_orderstatus), 'urgent f')")
def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.search(B.catalog(spark, sf), ["name", "o_orderstatus"], "URGENT F").select("version_id")


@query(f"{_C} SELECT version_id, row_number() OVER (ORDER BY score DESC, version_id) AS rank FROM cat WHERE score IS NOT NULL")
def catalog_rank(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.ranked(B.catalog(spark, sf)).select("version_id", "rank")


@query(f"{_C} SELECT version_id, score FROM cat WHERE score IS NOT NULL ORDER BY score DESC, version_id LIMIT 100")
def catalog_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.top_k(B.catalog(spark, sf), 100).select("version_id", "score")


@query(f"{_C} SELECT version_id FROM (SELECT *, row_number() OVER (ORDER BY score DESC, version_id) AS r, count(*) OVER () AS n FROM cat WHERE score IS NOT NULL) WHERE r <= ceil(0.01 * n)")
def catalog_top_p(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.top_p(B.catalog(spark, sf), 0.01).select("version_id")


@query(f"{_C} SELECT version_id FROM cat WHERE score IS NULL")
def catalog_missing_metric(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.missing_metric(B.catalog(spark, sf))


_BEST = "best AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY score DESC, version_id) AS k FROM cat WHERE score IS NOT NULL AND paper IS NOT NULL), loose AS (SELECT *, row_number() OVER (ORDER BY score DESC, version_id) AS k FROM cat WHERE score IS NOT NULL AND paper IS NULL)"


@query(f"{_C}, {_BEST} SELECT version_id, row_number() OVER (ORDER BY score DESC, version_id) AS rank FROM (SELECT version_id, score FROM best WHERE k = 1 UNION ALL SELECT version_id, score FROM loose)")
def select_distinct_papers(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.select_papers(B.catalog(spark, sf)).select("version_id", "rank")


@query(f"{_C}, {_BEST} SELECT version_id, row_number() OVER (ORDER BY score DESC, version_id) AS rank FROM (SELECT version_id, score FROM best WHERE k = 1 UNION ALL SELECT version_id, score FROM loose WHERE k <= 25)")
def paperless_quota(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.select_papers(B.catalog(spark, sf), 25).select("version_id", "rank")


def _bound(spark: SparkSession, sf: str) -> DataFrame:
    c = B.catalog(spark, sf)
    named = c.where("o_orderkey % 5 <> 0").select("version_id", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")).alias("paper"))
    return catalog.bind_papers(c, named)


_BIND = "CASE WHEN o_orderkey % 5 = 0 THEN 'unresolved' WHEN o_orderkey % 3 = 0 THEN 'paperless' ELSE 'bound' END"


@query(f"{_C} SELECT version_id, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS bound_paper, {_BIND} AS status FROM cat")
def bind_primary_papers(spark: SparkSession, sf: str) -> DataFrame:
    return _bound(spark, sf)


@query(f"{_C} SELECT {_BIND} AS status, count(*) AS n FROM cat GROUP BY ALL")
def paper_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _bound(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("WITH o AS (SELECT user_id, event_type AS v, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) SELECT user_id, f AS first_value, count(*) AS observations, count(*) FILTER (v <> f) AS conflicts FROM o GROUP BY ALL")
def dedupe_first_observation(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.first_observations(load(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type"))


@query("SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE value > b")
def order_verification(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.order_violations(load(spark, sf, "events"), "user_id", "event_id", "value").select("event_id")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def registry_current_records(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.current_records(load(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT event_type, count(*) AS observations, count(DISTINCT user_id) AS records FROM events GROUP BY ALL")
def registry_totals(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("user_id").alias("records"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def registry_stream_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The same current records, from a stream over four files."""
    scratch = Scratch(spark, "stream")
    events = load(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    events.repartition(4, "event_id").write.parquet(f"{scratch.root}/in")
    return registry.replay(spark, f"{scratch.root}/in", events.schema, f"{scratch.root}/state", f"{scratch.root}/checkpoint", "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT version_id, max(modified_at) AS modified_at, count(*) AS observations, count(DISTINCT run_id) AS runs FROM observations GROUP BY ALL")
def registry_versions(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "observations").groupBy("version_id").agg(F.max("modified_at").alias("modified_at"), F.count(F.lit(1)).alias("observations"), F.count_distinct("run_id").alias("runs"))


@query("SELECT feed_id, sync_mode, count(*) AS runs, count(*) FILTER (complete) AS complete_runs, CAST(coalesce(sum(records_seen), 0) AS BIGINT) AS records_seen FROM sync_reports GROUP BY ALL")
def registry_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "sync_reports").groupBy("feed_id", "sync_mode").agg(F.count(F.lit(1)).alias("runs"), F.count_if("complete").alias("complete_runs"), F.coalesce(F.sum("records_seen"), F.lit(0)).alias("records_seen"))


@query("SELECT o_custkey, min(o_orderstatus) FILTER (o_orderstatus = 'F') AS final, count(*) AS rows FROM orders GROUP BY ALL")
def coalesce_duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as one record: the final status where any order has it."""
    o = load(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).alias("final"))
    return catalog.coalesce_duplicates(o, "o_custkey", ["final"]).select("o_custkey", "final", "rows")


@query("SELECT o_custkey, 'status' AS name, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS value, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY o_custkey")
def merge_metadata(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select("o_custkey", F.lit("status").alias("name"), F.col("o_orderstatus").alias("v"))
    return catalog.merge_metadata(o, "o_custkey", "name", "v")


# ---------------------------------------------------------------- bindings and evidence


def _profiles(spark: SparkSession, sf: str):
    c = load(spark, sf, "customer")
    entries = c.select(F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("entry_id"))
    k = F.col("c_custkey").cast("string")
    profiles = c.where("c_custkey % 3 <> 0").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("e"), k)).otherwise(F.concat(F.lit("p"), k)).alias("profile_id"))
    explicit = c.where("c_custkey % 2 = 1 and c_custkey % 5 <> 0").select(F.concat(F.lit("e"), k).alias("entry_id"), F.concat(F.lit("p"), k).alias("profile_id"))
    return entries, profiles, explicit


_BOUND = "CASE WHEN c_custkey % 3 = 0 OR (c_custkey % 2 = 1 AND c_custkey % 5 = 0) THEN NULL WHEN c_custkey % 2 = 0 THEN 'e' || c_custkey ELSE 'p' || c_custkey END"


@query(f"SELECT 'e' || c_custkey AS entry_id, {_BOUND} AS profile_id, CASE WHEN {_BOUND} IS NULL THEN 'missing_profile' ELSE 'bound' END AS status FROM customer")
def bind_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return binding.bind_profiles(*_profiles(spark, sf))


@query(f"SELECT CASE WHEN {_BOUND} IS NULL THEN 'missing_profile' ELSE 'bound' END AS status, count(*) AS n FROM customer GROUP BY ALL")
def binding_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return bind_profiles(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'p' || c_custkey AS profile_id FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 1 AND c_custkey % 5 = 0")
def unused_profiles(spark: SparkSession, sf: str) -> DataFrame:
    e, p, b = _profiles(spark, sf)
    return binding.unused_profiles(p, binding.bind_profiles(e, p, b))


_REL = "cur AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_at DESC NULLS LAST) = 1), rel AS (SELECT id AS source_id, unnest(model_relations) AS r FROM cur), rr AS (SELECT source_id, r.source_record_id AS record, nullif(lower(trim(r.target.entry_id)), '') AS target_id FROM rel)"


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    from graftline.operators.orphans import key_form
    from graftline.plans.core_problems import relations

    rel = relations(spark, sf).select(F.col("id").alias("source_id"), F.col("r.source_record_id").alias("record"), key_form(F.col("r.target.entry_id")).alias("target_id"))
    return binding.resolve_relations(rel, load(spark, sf, "entries").select(F.col("id").alias("entry_id")))


@query(f"WITH {_REL} SELECT source_id, record, target_id, source_id = target_id AS is_self FROM rr WHERE target_id IN (SELECT id FROM entries)")
def relations_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return _relations(spark, sf).where("status = 'resolved'").select("source_id", "record", "target_id", "is_self")


@query(f"WITH {_REL} SELECT source_id, record, CASE WHEN target_id IS NULL THEN 'unidentified' ELSE 'dangling' END AS status FROM rr WHERE target_id IS NULL OR target_id NOT IN (SELECT id FROM entries)")
def relations_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    return _relations(spark, sf).where("status <> 'resolved'").select("source_id", "record", "status")


@query("""WITH i AS (SELECT 'e' || o_custkey AS entry_id, CASE WHEN o_orderkey % 4 = 0 THEN 'other' ELSE 'hub' END AS ns, 'repo-' || (o_orderkey % 2) || '@' || substr(sha256(CAST(o_orderkey % 2 AS VARCHAR)), 1, 40) AS v FROM orders),
c AS (SELECT entry_id, count(DISTINCT v) FILTER (ns = 'hub') AS n, min(v) FILTER (ns = 'hub') AS v FROM i GROUP BY ALL)
SELECT entry_id, CASE WHEN n = 1 THEN 'ready' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN n = 1 THEN v END AS target, n AS candidates FROM c""")
def resolve_targets(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    half = (F.col("o_orderkey") % 2).cast("string")
    ids = o.select(F.concat(F.lit("e"), F.col("o_custkey").cast("string")).alias("entry_id"), F.when(F.col("o_orderkey") % 4 == 0, "other").otherwise("hub").alias("namespace"), F.concat(F.lit("repo-"), half, F.lit("@"), F.substring(F.sha2(half, 256), 1, 40)).alias("value"))
    return binding.resolve_targets(ids, spark.createDataFrame([], "entry_id string, target string"), "hub").withColumn("candidates", F.col("candidates").cast("bigint"))


@query(f"WITH {B.CONTACT} SELECT source_id, target_id, causal_role, max(strength) AS strength, count(*) AS n_evidence FROM adm WHERE relation = 'earlier' GROUP BY ALL")
def contact_edges(spark: SparkSession, sf: str) -> DataFrame:
    a, e = B.contact(spark, sf)
    return binding.contact_edges(binding.admit_evidence(e, a))


@query(f"WITH {B.CONTACT} SELECT source_id, target_id, relation, gap_days FROM adm")
def contact_pair_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    a, e = B.contact(spark, sf)
    return binding.admit_evidence(e, a).select("source_id", "target_id", "relation", "gap_days")


@query(f"WITH {B.CONTACT} SELECT relation, count(*) AS n FROM adm WHERE relation <> 'earlier' GROUP BY ALL")
def temporal_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    a, e = B.contact(spark, sf)
    return binding.admit_evidence(e, a).where("relation <> 'earlier'").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {B.CONTACT}, st AS (SELECT DISTINCT c_custkey AS taxon, c_mktsegment AS character FROM customer), d AS (SELECT target_id AS taxon, adm.character, string_agg(DISTINCT CAST(source_id AS VARCHAR), ',' ORDER BY CAST(source_id AS VARCHAR)) AS donors FROM adm JOIN st s ON s.taxon = source_id AND s.character = adm.character WHERE relation = 'earlier' AND causal_role = 'character_transfer' GROUP BY ALL)
SELECT st.taxon, st.character, donors, CASE WHEN donors IS NULL THEN 'unexplained' ELSE 'transfer' END AS origin FROM st LEFT JOIN d ON st.taxon = d.taxon AND st.character = d.character""")
def character_sources(spark: SparkSession, sf: str) -> DataFrame:
    a, e = B.contact(spark, sf)
    states = load(spark, sf, "customer").select(F.col("c_custkey").alias("taxon"), F.col("c_mktsegment").alias("character"))
    return binding.character_sources(states, binding.admit_evidence(e, a))


# ---------------------------------------------------------------- scalar functions and text


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))


@query("SELECT o_orderkey AS k, '10.1000/abc.' || o_orderkey AS doi FROM orders")
def normalize_doi(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k").cast("string")
    raw = F.when(F.col("k") % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/ABC."), k)).when(F.col("k") % 3 == 1, F.concat(F.lit(" DOI: 10.1000/Abc."), k, F.lit("."))).otherwise(F.concat(F.lit("http://dx.doi.org/10.1000/abc."), k, F.lit(")")))
    return _keys(spark, sf).select("k", T.normalize_doi(raw).alias("doi"))


@query("SELECT o_orderkey AS k, printf('2101.%05d', o_orderkey % 100000) AS arxiv FROM orders")
def normalize_arxiv(spark: SparkSession, sf: str) -> DataFrame:
    k = F.format_string("2101.%05d", F.col("k") % 100000)
    raw = F.when(F.col("k") % 3 == 0, F.concat(F.lit("https://arxiv.org/pdf/"), k, F.lit("v2.pdf"))).when(F.col("k") % 3 == 1, F.concat(F.lit("arXiv:"), k, F.lit("v10"))).otherwise(F.concat(k, F.lit(".")))
    return _keys(spark, sf).select("k", T.normalize_arxiv(raw).alias("arxiv"))


_FORMS = [(chr(n), unicodedata.normalize("NFKC", chr(n))) for n in range(0xA0, 0xFFF0) if unicodedata.decomposition(chr(n)).startswith("<") and len(unicodedata.normalize("NFKC", chr(n))) == 1 and unicodedata.category(chr(n))[0] in "LN"]


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(replace(replace(translate(text, '" + "".join(a for a, _ in _FORMS) + "', '" + "".join(b for _, b in _FORMS) + "'), 'ﬁ', 'fi'), 'ﬂ', 'fl')), '[\\p{L}\\p{N}]+'), ' ') AS title FROM documents WHERE text IS NOT NULL")
def normalize_title(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").where("text is not null").select("doc_id", T.normalize_title(F.col("text")).alias("title"))


@query("""SELECT o_orderkey AS k, array_to_string(list_sort(list_distinct(list_concat(list_transform(range(o_orderkey % 5 + 1, o_orderkey % 5 + 4), lambda x: 'marker:' || x), ['marker:' || (o_orderkey % 7 + 1)]))), ' ') AS keys FROM orders""")
def citation_marker_keys(spark: SparkSession, sf: str) -> DataFrame:
    low = F.col("k") % 5 + 1
    raw = F.concat(F.lit("["), low.cast("string"), F.lit("–"), (low + 2).cast("string"), F.lit(", "), (F.col("k") % 7 + 1).cast("string"), F.lit("]"))
    return _keys(spark, sf).select("k", F.array_join(T.marker_keys(raw), " ").alias("keys"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'https://a.org/x' || o_orderkey || ' https://b.org/' || o_orderkey ELSE 'https://b.org/' || o_orderkey END AS links FROM orders")
def extract_urls(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k").cast("string")
    raw = F.concat(F.lit("see https://b.org/"), k, F.lit("."), F.when(F.col("k") % 2 == 0, F.concat(F.lit(" and (https://a.org/x"), k, F.lit("), https://b.org/"), k)).otherwise(""))
    return _keys(spark, sf).select("k", F.array_join(T.urls(raw), " ").alias("links"))


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'graph.input' WHEN 'error' THEN 'graph.output' WHEN 'view' THEN 'module.torch.nn.linear' WHEN 'click' THEN 'function.view.' || user_id ELSE 'method.purchase_' || user_id END AS operation FROM events")
def normalize_operator(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    op = F.when(t == "signup", "placeholder").when(t == "error", "output").when(t == "view", "call_module").when(t == "click", "call_function").otherwise("call_method")
    user = F.col("user_id").cast("string")
    target = F.when(t == "click", F.concat(F.lit("<function VIEW::"), user, F.lit(" at 0x7f3a>"))).otherwise(F.concat(F.lit("Purchase_"), user))
    return load(spark, sf, "events").select("event_id", T.normalize_operator(op, target, F.lit("torch.nn.modules.linear.Linear")).alias("operation"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderkey * 1000.5 END::DOUBLE AS number FROM orders")
def finite_number(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    raw = F.when(k % 4 == 3, F.element_at(F.array(F.lit("NaN"), F.lit("inf"), F.lit("n/a")), (k % 3 + 1).cast("int"))).otherwise(F.concat(F.lit(" "), F.format_number(k * 1000.5, 1)))
    return _keys(spark, sf).select("k", T.finite_number(raw).alias("number"))


@query("""SELECT snapshot_digest, row_no, catalog_id, CASE WHEN access_kind = 'api_access' THEN 'api_access' WHEN access_kind = 'hosted_access' THEN 'hosted_access' WHEN access_kind = 'unreleased' THEN 'unreleased' WHEN access_kind = 'open_weights_unrestricted' THEN 'open_weights_unrestricted' WHEN access_kind = 'open_weights_restricted' THEN 'open_weights_restricted' ELSE 'metadata_only' END AS access FROM snapshot_records""")
def access_kinds(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("access_kind")
    words = F.when(a == "api_access", "API  access").when(a == "hosted_access", "Hosted access (no API)").when(a == "unreleased", " Unreleased").when(a == "open_weights_unrestricted", "Open weights (unrestricted)").when(a == "open_weights_restricted", "Open weights (restricted use)")
    return load(spark, sf, "snapshot_records").select("snapshot_digest", "row_no", "catalog_id", T.access_kind(words).alias("access"))


@query("SELECT event_id, sha256(props) AS digest FROM (SELECT event_id, '{\"a\":[1,0.5],\"k\":' || CAST(props->>'$.k' AS VARCHAR) || '}' AS props FROM events)")
def content_digests(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": [1, 0.50]}'))
    return load(spark, sf, "events").select("event_id", canonical.digest(raw).alias("digest"))


_ENTRIES = r"""WITH d AS (SELECT doc_id, regexp_extract(text, '(?im)^\s*(?:(?:\d+(?:\.\d+)*|[IVXLC]+)[.)]?\s+)?(?:references|bibliography)\s*:?\s*$([\s\S]*)$', 1) AS t FROM documents WHERE regexp_matches(text, '(?im)^\s*(?:(?:\d+(?:\.\d+)*|[IVXLC]+)[.)]?\s+)?(?:references|bibliography)\s*:?\s*$')),
e AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?m)^[ \t]*(?:\[(\d{1,4})\]|\d{1,4}[.)])', 0)) AS marker, unnest(string_split_regex(t, '(?m)^[ \t]*(?:\[\d{1,4}\]|\d{1,4}[.)])')[2:]) AS raw FROM d),
b AS (SELECT doc_id, CAST(CAST(regexp_extract(marker, '\d+') AS INTEGER) AS VARCHAR) AS marker, trim(regexp_replace(raw, '[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS entry FROM e WHERE true)"""


@query(_ENTRIES + " SELECT * FROM b WHERE entry <> ''")
def bibliography_entries(spark: SparkSession, sf: str) -> DataFrame:
    return documents.bibliography(load(spark, sf, "documents")).select("doc_id", "marker", "entry")


@query("SELECT o_orderkey AS doc_id, unnest(['[1, 3–4]', 'Doe et al. (2020)']) AS marker, unnest([4, 17]) AS start, unnest([12, 34]) AS end, unnest(['marker:1 marker:3 marker:4', 'author_year:doe:2020']) AS keys FROM orders")
def citation_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """One text with both forms of citations for each order; what stands behind the references isn't cited."""
    d = load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("See [1, 3–4] and Doe et al. (2020).\n1. References\n[1] Roe (1999)").alias("text"))
    return documents.mentions(d).withColumn("keys", F.array_join("keys", " "))


@query("""WITH c AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS k FROM orders) SELECT doc_id, unnest(['author_year:doe:2020', 'marker:1', 'marker:2', 'marker:3']) AS key, unnest([1, 1, 1, 1]) AS n, unnest(['resolved', 'resolved', CASE k WHEN 0 THEN 'ambiguous' ELSE 'resolved' END, 'unresolved']) AS status, unnest(['1', '1', CASE k WHEN 0 THEN NULL ELSE '2' END, NULL]) AS marker FROM c""")
def resolve_citations(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the texts list two entries under one number."""
    twice = F.when(F.col("o_orderkey") % 3 == 0, "\n2. Poe, 2002").otherwise("")
    d = load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("In [1-3] and by Doe, 2020.\nREFERENCES\n1. On trees. A. Doe, 2020\n2) B. Roe 2001"), twice).alias("text"))
    return documents.resolve_mentions(documents.mentions(d), documents.bibliography(d))


@query("""WITH e AS (SELECT o_orderkey AS k FROM orders) SELECT 'e' || k AS entry_id, CASE WHEN k % 4 = 0 THEN 'resolved' WHEN k % 4 = 1 THEN 'resolved' WHEN k % 4 = 2 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE k % 4 WHEN 0 THEN 'doi' WHEN 1 THEN 'title' WHEN 2 THEN 'author_year' END AS rule, CASE k % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.92 END::DOUBLE AS confidence, CASE WHEN k % 4 IN (0, 1) THEN 't' || k END AS target_id FROM e""")
def resolve_bibliography(spark: SparkSession, sf: str) -> DataFrame:
    """Entries hold a DOI, or the title somewhere in their text, or only author and year, which two targets share."""
    k = F.col("k")
    s = k.cast("string")
    none = lambda kind: F.lit(None).cast(kind)
    title = F.concat(F.lit("The long title number "), s, F.lit(" of all"))
    e = _keys(spark, sf).select(
        F.concat(F.lit("e"), s).alias("entry_id"), F.when(k % 4 == 1, F.concat(F.lit("Doe, J. ("), F.upper(title), F.lit("). 2020"))).otherwise(F.concat(F.lit("short "), s)).alias("entry"), F.when(k % 4 == 0, F.concat(F.lit("10.1/"), s)).alias("doi"), none("string").alias("arxiv_id"),
        F.array().cast("array<string>").alias("urls"), F.when(k % 4 == 2, F.concat(F.lit("author"), s)).alias("author"), F.when(k % 4 == 2, F.lit(2020)).alias("year"),
    )
    c = _keys(spark, sf).withColumn("twice", F.explode(F.when(k % 4 == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("")))))
    c = c.select(F.concat(F.lit("t"), s, F.col("twice")).alias("target_id"), F.concat(title, F.col("twice")).alias("title"), F.concat(F.lit("10.1/"), s).alias("doi"), none("string").alias("arxiv_id"), F.array().cast("array<string>").alias("urls"), F.concat(F.lit("author"), s).alias("author"), F.lit(2020).alias("year"))
    return documents.resolve_bibliography(e, c)


@query()
def paper_sections(spark: SparkSession, sf: str) -> DataFrame:
    return documents.paper_sections(documents.normalized_papers(load(spark, sf, "documents")))


@query()
def paper_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return documents.paper_sentences(documents.normalized_papers(load(spark, sf, "documents")))


@query(f"""WITH {B.ORDERS}, pc AS (SELECT DISTINCT model_id, character_id FROM profile_characters WHERE character_id IS NOT NULL AND radius IS NOT NULL), pr AS (SELECT DISTINCT model_id, structural_signature FROM profile_characters WHERE structural_signature IS NOT NULL AND radius IS NULL)
SELECT 'graph' AS target_kind, count(*) AS n FROM g UNION ALL SELECT 'operator', count(*) FROM vertices UNION ALL SELECT 'edge', count(*) FROM edges UNION ALL SELECT 'character', count(*) FROM pc UNION ALL SELECT 'region', count(*) FROM pr""")
def annotation_targets(spark: SparkSession, sf: str) -> DataFrame:
    """All five kinds of what an annotation may point to, counted."""
    v, e = B.orders_dag(spark, sf)
    held = load(spark, sf, "profile_characters").select(F.col("model_id").alias("graph_id"), "character_id", F.col("structural_signature").alias("signature"), "radius")
    found = documents.target_catalog(v.select("graph_id").distinct(), v, e, held.where("character_id is not null and radius is not null"), held.where("signature is not null and radius is null"))
    return found.groupBy("target_kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS annotation_id, CASE WHEN doc_id % 4 = 0 THEN 'excerpt_differs' WHEN doc_id % 4 = 1 THEN 'bad_span' WHEN doc_id % 4 = 2 THEN 'unknown_target' END AS problem FROM documents WHERE text IS NOT NULL AND length(text) >= 10")
def annotation_validation(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").where("text is not null and length(text) >= 10")
    k = F.col("doc_id") % 4
    excerpt = F.when(k == 0, F.concat(F.lit("\x01"), F.substring("text", 2, 9))).otherwise(F.substring("text", 1, 10))
    a = d.select(F.col("doc_id").alias("annotation_id"), "doc_id", F.lit(0).alias("start"), F.when(k == 1, F.length("text") + 5).otherwise(F.lit(10)).alias("end"), excerpt.alias("excerpt"), F.lit("operator").alias("target_kind"), F.when(k == 2, F.lit("nothing")).otherwise(F.lit("click")).alias("target_id"))
    return documents.check_annotations(a, d, load(spark, sf, "events").select(F.lit("operator").alias("target_kind"), F.col("event_type").alias("target_id")))


@query("SELECT path, field, kind FROM (SELECT 'e' || event_id AS path, unnest(['', 'k']) AS field, unnest(['object', 'number']) AS kind FROM events)")
def json_syntax_graph(spark: SparkSession, sf: str) -> DataFrame:
    return source_graph.flat_json_nodes(load(spark, sf, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("path"), F.col("props").alias("content")))


_SOURCES = "ev AS (SELECT event_id, event_id % 3 AS k FROM events)"
_NODES = {
    0: (["n000000", "n000001", "n000002"], ["data", "data", "data"], ["data.object", "data.number", "data.array"]),
    1: (
        [f"n{i:06d}" for i in range(8)], ["syntax", "control", "operator", "operator", "syntax", "operator", "operator", "syntax"],
        ["python.ast:module", "python.ast:assign", "python.ast:name", "python.call:f", "python.ast:store", "python.ast:name", "python.ast:constant", "python.ast:load"],
    ),
    2: (["n000000", "n000001", "n000002"], ["data", "data", "data"], ["data.object", "data.object", "data.boolean"]),
}
_SUFFIX = ["json", "py", "toml"]
_SYNTAX_SQL = f"WITH {_SOURCES} " + " UNION ALL ".join(f"SELECT 'e' || event_id || '.{_SUFFIX[k]}' AS path, unnest({ids}) AS node_id, unnest({kinds}) AS kind, unnest({ops}) AS operation FROM ev WHERE k = {k}" for k, (ids, kinds, ops) in _NODES.items())


def _source_files(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON, Python or TOML file for each event."""
    k, n = F.col("event_id") % 3, F.col("event_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit('{"b": [], "a": '), n, F.lit("}"))).when(k == 1, F.concat(F.lit("x = f("), n, F.lit(")\n"))).otherwise(F.lit("[part]\non = true\n"))
    return load(spark, sf, "events").select(F.concat(F.lit("e"), n, F.lit("."), F.element_at(F.array(*map(F.lit, _SUFFIX)), (k + 1).cast("int"))).alias("path"), text.alias("content"))


@query(_SYNTAX_SQL)
def source_syntax_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return source_graph.syntax_nodes(_source_files(spark, sf)).select("path", "node_id", "kind", "operation")


@query(f"WITH {_SOURCES} SELECT CASE k WHEN 0 THEN 'json' WHEN 1 THEN 'py' ELSE 'toml' END AS suffix, CASE k WHEN 1 THEN 'syntax' ELSE 'field' END AS kind, count(*) * (CASE k WHEN 1 THEN 7 ELSE 2 END) AS n FROM ev GROUP BY k")
def source_syntax_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the syntax graphs, counted by kind of file and edge."""
    e = source_graph.syntax_edges(_source_files(spark, sf))
    return e.groupBy(F.regexp_extract("path", r"([a-z]+)$", 1).alias("suffix"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT status, count(*) AS files FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'excluded_folder' WHEN event_id % 5 = 1 THEN 'unknown_suffix' WHEN event_id % 5 = 2 THEN 'outside' ELSE 'kept' END AS status FROM events) GROUP BY status")
def scan_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("event_id") % 5, F.col("event_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("a/vendor/"), n, F.lit(".py"))).when(k == 1, F.concat(n, F.lit(".bin"))).when(k == 2, F.concat(F.lit("../"), n, F.lit(".py"))).otherwise(F.concat(F.lit("build/"), n, F.lit(".JSON")))
    return source_graph.exclusions(load(spark, sf, "events").select(path.alias("path"), F.col("props").alias("content")))


@query("SELECT source, count(*) AS files, sha256(string_agg(printf('%09d', doc_id) || ' ' || sha256(coalesce(text, '')), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def source_tree_digest(spark: SparkSession, sf: str) -> DataFrame:
    return source_graph.tree_digest(load(spark, sf, "documents").select("source", F.format_string("%09d", "doc_id").alias("path"), F.col("text").alias("content")), "source")


@query("SELECT source, path FROM (SELECT source, printf('%09d', doc_id) AS path, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents) WHERE upto <= 50000")
def scan_truncation(spark: SparkSession, sf: str) -> DataFrame:
    """The budget of a source scan is the feature."""
    return source_graph.within_budget(load(spark, sf, "documents").select("source", F.format_string("%09d", "doc_id").alias("path"), "n_chars"), "source", "n_chars", 50000).select("source", "path")


@query(f"WITH {B.ORDERS} SELECT 'vertices' AS kind, count(*) AS n FROM vertices UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'graphs', count(*) FROM g")
def dataset_export_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    from graftline.sources import readers

    folder = Scratch(spark, "export").root
    v, e = B.orders_dag(spark, sf)
    writers.write_graphs(v, e, folder)
    g, v, e = readers.graph_tables(spark, folder)
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(v, "vertices").unionByName(n(e, "edges")).unionByName(n(g, "graphs"))


# ---------------------------------------------------------------- discovery, feeds, evidence


_SCAN = """pg AS (SELECT o_custkey AS scan_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page_no, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderstatus FROM orders),
rs AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'provider_reported_incomplete_results' WHEN page_no = n - 1 THEN 'provider_exhausted' END AS reason FROM pg WHERE page_no < 5),
lp AS (SELECT scan_id, coalesce(min(page_no) FILTER (reason IS NOT NULL), max(page_no)) AS last_page FROM rs GROUP BY scan_id),
en AS (SELECT o_custkey AS scan_id, p.page_no, l_linenumber AS pos, l_partkey AS version_id, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = orders.o_orderkey JOIN pg p ON p.o_orderkey = orders.o_orderkey),
fo AS (SELECT * FROM en JOIN lp USING (scan_id) WHERE page_no <= last_page), fi AS (SELECT *, first_value(q) OVER (PARTITION BY scan_id, version_id ORDER BY page_no, pos) AS fq, row_number() OVER (PARTITION BY scan_id, version_id ORDER BY page_no, pos) AS k FROM fo)"""


def _scans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A customer's orders are the pages of a scan, their lines the entries, parts the versions; pending orders are incomplete pages."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    p = o.withColumn("page_no", (F.row_number().over(w) - 1)).withColumn("next_cursor", F.lead(F.col("o_orderkey").cast("string")).over(w))
    pages = p.select(F.col("o_custkey").alias("scan_id"), "page_no", "next_cursor", F.lit(None).cast("bigint").alias("total_count"), F.lit(None).cast("bigint").alias("population"), F.lit(None).cast("string").alias("ordered_by"), (F.col("o_orderstatus") != "P").alias("results_complete"))
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("version_id"), F.col("l_quantity").alias("q"))
    entries = lines.join(p, "o_orderkey").select(F.col("o_custkey").alias("scan_id"), "page_no", "pos", "version_id", F.lit(None).cast("timestamp").alias("at"), F.col("q").cast("double").alias("score"), F.sha2(F.col("q").cast("string"), 256).alias("digest"))
    return pages, entries


@query(f"WITH {_SCAN}, c AS (SELECT scan_id, count(*) AS records_seen, count(*) FILTER (k = 1) AS eligible_entries, count(*) FILTER (q <> fq) AS conflicts FROM fi GROUP BY scan_id) SELECT l.scan_id, l.last_page + 1 AS pages_fetched, coalesce(records_seen, 0) AS records_seen, coalesce(eligible_entries, 0) AS eligible_entries, coalesce(conflicts, 0) AS conflicts, coalesce(r.reason, 'page_budget') AS stopped_reason FROM lp l JOIN rs r ON r.scan_id = l.scan_id AND r.page_no = l.last_page LEFT JOIN c ON c.scan_id = l.scan_id")
def discovery_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Scans under a budget of five pages, which is the feature."""
    pages, entries = _scans(spark, sf)
    return discovery.scan(pages, entries, discovery.CatalogQuery(), max_pages=5)[1].select("scan_id", "pages_fetched", "records_seen", "eligible_entries", "conflicts", "stopped_reason")


@query(f"WITH {_SCAN} SELECT scan_id, version_id, page_no FROM fi WHERE k = 1")
def discovery_members(spark: SparkSession, sf: str) -> DataFrame:
    pages, entries = _scans(spark, sf)
    return discovery.scan(pages, entries, discovery.CatalogQuery(), max_pages=5)[0].select("scan_id", "version_id", "page_no")


@query("SELECT 'hub:org/' || o_orderkey AS catalog_id, 'hub:org/' || o_orderkey || '@' || sha256(CAST(o_orderkey AS VARCHAR)) AS version_id, CASE o_orderstatus WHEN 'P' THEN 'private' WHEN 'F' THEN 'gated' ELSE 'public_artifact' END AS access_kind, CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_custkey AS DOUBLE) AS likes, 'arxiv:2101.' || printf('%05d', o_orderkey % 100000) AS paper FROM orders")
def feed_hub_rows(spark: SparkSession, sf: str) -> DataFrame:
    """An order as a listing of a hub in JSON, brought to a catalog row."""
    k = F.col("o_orderkey").cast("string")
    tags = F.array(F.lit("text"), F.format_string("arxiv:2101.%05dv2", F.col("o_orderkey") % 100000))
    gated = F.when(F.col("o_orderstatus") == "F", "manual")
    raw = load(spark, sf, "orders").select(F.to_json(F.struct(F.concat(F.lit("org/"), k).alias("id"), F.sha2(k, 256).alias("sha"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"), F.col("o_custkey").alias("likes"), (F.col("o_orderstatus") == "P").alias("private"), gated.alias("gated"), tags.alias("tags"))).alias("raw"))
    rows = feeds.hub_feed(raw, "2026-01-01 00:00:00")
    return rows.where("problem is null").select("catalog_id", "version_id", "access_kind", "created_at", F.col("metrics")["likes"].alias("likes"), F.col("papers")[0].alias("paper"))


@query("SELECT CASE WHEN event_id % 5 = 0 THEN 'no_native_id' WHEN event_id % 5 = 1 THEN 'unknown_entity_kind' WHEN event_id % 5 = 2 THEN 'not_an_object' WHEN event_id % 5 = 3 THEN 'metric_not_finite' END AS problem, count(*) AS n FROM events GROUP BY ALL")
def feed_problems(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("event_id") % 5, F.col("event_id").cast("string")
    raw = F.when(k == 0, F.lit('{"name": "x"}')).when(k == 1, F.concat(F.lit('{"id": "'), n, F.lit('", "entity_kind": "thing"}'))).when(k == 2, F.concat(F.lit("{"), n)).when(k == 3, F.concat(F.lit('{"id": "'), n, F.lit('", "metrics": {"likes": true}}'))).otherwise(F.concat(F.lit('{"id": "'), n, F.lit('", "metrics": {"likes": 2.5}, "paper_candidates": ["arxiv:1"]}')))
    return feeds.plain_feed(load(spark, sf, "events").select(raw.alias("raw")), "feed", "2026-01-01 00:00:00").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("WITH a AS (SELECT c_nationkey AS id, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) SELECT s.id AS source_id, t.id AS target_id, CASE WHEN s.lo < t.lo THEN 'earlier' ELSE 'not_strictly_earlier' END AS relation, greatest(0, date_diff('day', s.lo, t.lo)) AS gap_days FROM a s, a t WHERE s.id <> t.id")
def contact_all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every ordered pair of nations, dated by the first orders of their customers."""
    o = load(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d")).join(load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    a = o.groupBy(F.col("c_nationkey").alias("artifact_id")).agg(F.min("d").alias("date_min")).withColumn("date_max", F.col("date_min"))
    none = spark.createDataFrame([], "source_id bigint, target_id bigint")
    return binding.contact_pairs(a, none).select("source_id", "target_id", "relation", "gap_days")


@query("SELECT o_custkey AS id, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'composite' ELSE min(o_orderpriority) END AS kind, min(o_orderdate) AS date_min, max(o_orderdate) AS date_max, count(*) AS merged, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'digest_differs' END AS problem FROM orders GROUP BY o_custkey")
def merge_profiles(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("profile_digest"), F.lit("x").alias("name"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("date_min"), F.col("o_orderdate").alias("date_max"))
    return catalog.merge_profiles(o, "id").select("id", "kind", "date_min", "date_max", "merged", "problem")


@query("SELECT problem, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CASE WHEN event_type = 'view' THEN 'self' WHEN event_type = 'click' THEN 'unknown_role' WHEN event_type = 'error' THEN 'bad_strength' END AS problem FROM events) GROUP BY ALL")
def evidence_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Events as evidence, each content once, counted by what is wrong with it."""
    t = F.col("event_type")
    e = load(spark, sf, "events").select(F.col("user_id").alias("source_id"), F.when(t == "view", F.col("user_id")).otherwise(F.lit(-1)).alias("target_id"), F.when(t == "click", "rumour").otherwise("provenance").alias("causal_role"), F.when(t == "error", 2.0).when(t == "purchase", 0.5).otherwise(1.0).alias("strength"), t.alias("character"))
    return binding.normalized_evidence(e).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'cached_success' WHEN o_orderkey % 4 = 1 THEN 'cached_failure' ELSE 'pending' END AS action, count(*) AS n FROM orders GROUP BY ALL")
def extraction_plan(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    targets = load(spark, sf, "orders").select(k.alias("entry_id"), F.concat(F.lit("org/"), k.cast("string")).alias("target"))
    first = discovery.plan_extraction(targets, "policy-1", spark.createDataFrame([], "run_key string, status string"))
    attempts = first.where("entry_id % 4 < 2").select("run_key", F.when(F.col("entry_id") % 4 == 0, "success").otherwise("failure").alias("status"))
    return discovery.plan_extraction(targets, "policy-1", attempts).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_C}, r AS (SELECT version_id, paper, score, row_number() OVER (ORDER BY score DESC, version_id) AS rank FROM cat WHERE score IS NOT NULL AND paper IS NOT NULL) SELECT rank, version_id, score, (SELECT count(*) FROM orders WHERE o_custkey = paper) AS cited FROM r WHERE rank <= 50")
def popularity_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty best pinned entries with the citations of their paper; the limit is the feature."""
    c = B.catalog(spark, sf).where("paper is not null").select("version_id", F.lit("r").alias("revision"), "score", F.array(F.col("paper").cast("string")).alias("papers"))
    cited = load(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("paper")).agg(F.count(F.lit(1)).alias("cited"))
    return discovery.popularity_manifest(c, 50, cited).select("rank", "version_id", "score", "cited")


def queries():
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
