"""Discovery, feeds, paged sources, readers with their checks, evidence, merges and whole pipelines on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from graftline.functions import canonical
from graftline.functions import text as T
from graftline.operators import binding, catalog, discovery, distance
from graftline.plans import pipelines
from graftline.session import Scratch
from graftline.sources import feeds, readers, writers

PAGE = "scan_id string, page_no int, next_cursor string, total_count bigint, population bigint, ordered_by string, results_complete boolean"
ENTRY = "scan_id string, page_no int, pos int, version_id string, at timestamp, score double, digest string"


def scanned(spark, pages, entries, query, **more):
    from datetime import datetime

    rows = [(s, p, i, v, datetime(2020, 1, d) if d else None, x, g) for s, p, i, v, d, x, g in entries]
    members, scans = discovery.scan(spark.createDataFrame(pages, PAGE), spark.createDataFrame(rows, ENTRY), query, **more)
    return {r.version_id for r in members.collect()}, scans.collect()


def test_scan_reasons(spark):
    pages = [("s", i, str(i + 1) if i < 3 else None, None, None, "stars", True) for i in range(4)]
    entries = [("s", i, k, f"v{i}{k}", 20 - 4 * i - k, 40.0 - 10 * i - k, "d") for i in range(4) for k in range(2)] + [("s", 1, 2, "v00", 19, 7.0, "other"), ("s", 1, 3, "v00", 19, 40.0, "d"), ("s", 2, 9, None, 1, 1.0, "d")]
    got, (r,) = scanned(spark, pages, entries, discovery.CatalogQuery())
    assert len(got) == 8 and (r.pages_fetched, r.records_seen, r.conflicts, r.stopped_reason, r.complete, r.next_cursor) == (4, 10, 1, "provider_exhausted", True, None)
    ranked = [e for e in entries if e[3] != "v00" or e[2] == 0]
    got, (r,) = scanned(spark, pages, ranked, discovery.CatalogQuery(metric="stars", top_k=3))
    assert (r.pages_fetched, r.stopped_reason, r.order_verified, r.next_cursor) == (2, "importance_bound_satisfied", True, "2") and got == {"v00", "v01", "v10", "v11"}
    _, (r,) = scanned(spark, pages, [(*e[:5], -e[5], e[6]) for e in ranked], discovery.CatalogQuery(metric="stars", top_k=3))
    assert (r.stopped_reason, r.order_verified) == ("provider_exhausted", False)
    dated = [(*p[:5], "created", True) for p in pages]
    got, (r,) = scanned(spark, dated, ranked, discovery.CatalogQuery(date_field="created", since="2020-01-14"))
    assert (r.pages_fetched, r.stopped_reason) == (3, "date_window_exhausted") and got == {"v00", "v01", "v10", "v11"}
    _, (r,) = scanned(spark, pages, ranked, discovery.CatalogQuery(), max_pages=2)
    assert (r.stopped_reason, r.complete, r.next_cursor) == ("page_budget", False, "2")
    _, (r,) = scanned(spark, [(*p[:3], 5000, *p[4:]) for p in pages], ranked, discovery.CatalogQuery(), result_cap=1000)
    assert (r.stopped_reason, r.complete) == ("provider_result_cap_requires_partition", False)
    _, (r,) = scanned(spark, [(*p[:6], p[1] != 1) for p in pages], ranked, discovery.CatalogQuery())
    assert (r.pages_fetched, r.stopped_reason) == (2, "provider_reported_incomplete_results")
    _, (r,) = scanned(spark, [("s", i, "again", None, None, None, True) for i in range(4)], ranked, discovery.CatalogQuery())
    assert (r.pages_fetched, r.stopped_reason) == (2, "cursor_repeated")
    first, _ = discovery.scan(spark.createDataFrame(pages[:2], PAGE), spark.createDataFrame([], ENTRY), discovery.CatalogQuery())
    assert first.count() == 0


def test_resumed_scan_equals_one_scan(spark):
    pages = [("s", i, str(i + 1) if i < 3 else None, None, None, None, True) for i in range(4)]
    entries = [("s", i, k, f"v{(i * 2 + k) % 6}", None, None, f"d{i}") for i in range(4) for k in range(2)]
    p, e = spark.createDataFrame(pages, PAGE), spark.createDataFrame(entries, ENTRY)
    whole, _ = discovery.scan(p, e, discovery.CatalogQuery())
    some, _ = discovery.scan(p, e, discovery.CatalogQuery(), max_pages=2)
    rest, scans = discovery.scan(p.where("page_no >= 2"), e.where("page_no >= 2"), discovery.CatalogQuery(), prior=some)
    assert {(r.version_id, r.digest) for r in rest.collect()} == {(r.version_id, r.digest) for r in whole.collect()}
    assert scans.first().stopped_reason == "provider_exhausted" and scans.first().eligible_entries == 6


@pytest.mark.parametrize("bad", [{"top_k": 1}, {"metric": "m"}, {"metric": "m", "top_k": 0}, {"metric": "m", "top_k": True}, {"metric": "m", "top_p": 1.5}, {"since": "2020-01-01"}, {"date_field": "d", "since": "2021-01-01", "until": "2020-01-01"}])
def test_queries_are_checked(bad):
    with pytest.raises(ValueError):
        discovery.CatalogQuery(**bad)


def test_snapshots_and_plans(spark):
    s = spark.createDataFrame([("a", "v1", 1), ("a", "v2", 3), ("a", "v2", 4), ("b", None, None), ("c", "x", 1), ("c", "y", 2)], "scan_id string, version_id string, rank int")
    assert {tuple(r) for r in discovery.snapshot_problems(s).collect()} == {("a", "duplicate_version", "v2"), ("a", "ranks_not_contiguous", None), ("b", "null_version", None)}
    t = spark.createDataFrame([("e1", "r@1"), ("e2", "r@2")], "entry_id string, target string")
    none = spark.createDataFrame([], "run_key string, status string")
    plan = discovery.plan_extraction(t, "p", none)
    failed = plan.where("entry_id = 'e1'").select("run_key", F.lit("failure").alias("status"))
    assert [r.action for r in discovery.plan_extraction(t, "p", failed).orderBy("entry_id").collect()] == ["cached_failure", "pending"]
    assert [r.action for r in discovery.plan_extraction(t, "p", failed, True).collect()] == ["pending", "pending"]
    assert [r.action for r in discovery.plan_extraction(t, "other", failed).collect()] == ["pending", "pending"]
    d = discovery.observation_digest(spark.createDataFrame([("v", 1, 5), ("v", 1, 6)], "version_id string, size int, downloads int"), ["downloads"])
    assert d.select("digest").distinct().count() == 1


def test_feeds(spark):
    lines = ['{"id": "o/m", "sha": "abc", "createdAt": "2024-01-02T03:04:05Z", "likes": 3, "gated": "auto", "tags": ["arxiv:2101.00001v2", "x"]}', '{"id": " "}', "not json", None, '{"id": "o/n", "createdAt": "yesterday"}']
    rows = feeds.hub_feed(spark.createDataFrame([(x,) for x in lines], "raw string"), "2026-01-01").collect()
    assert [r.problem for r in rows] == [None, "no_native_id", "not_an_object", "not_an_object", "bad_date"]
    assert (rows[0].catalog_id, rows[0].version_id, rows[0].access_kind, rows[0].metrics["likes"], rows[0].papers) == ("hub:o/m", "hub:o/m@abc", "gated", 3.0, ["arxiv:2101.00001"])
    code = feeds.code_feed(spark.createDataFrame([('{"full_name": "a/b", "stargazers_count": 7, "pushed_at": "2024-05-06T00:00:00Z", "html_url": "https://x.y/a/b"}',)], "raw string"), "2026-01-01").first()
    assert (code.version_id, code.metrics["stars"], code.locators, code.entity_kind) == ("code:a/b", 7.0, ["https://x.y/a/b"], "model_artifact")
    paper = feeds.paper_feed(spark.createDataFrame([('{"id": "https://x.org/W12/", "display_name": "T", "cited_by_count": 4, "ids": {"doi": "https://doi.org/10.1/AB"}}',)], "raw string"), "2026-01-01").first()
    assert (paper.native_id, paper.name, paper.metrics["citations"], paper.papers) == ("W12", "T", 4.0, ["doi:10.1/ab"])
    assert feeds.plain_feed(spark.createDataFrame([], "raw string"), "p", "2026-01-01").count() == 0


def test_paged_source(spark, tmp_path):
    path = tmp_path / "feed.jsonl"
    path.write_text("\n".join(json.dumps({"id": f"m{i}"}) for i in range(25)) + "\n\n")
    spark.dataSource.register(feeds.PagedCatalog)
    arguments = json.dumps({"path": str(path), "size": 10})
    rows = spark.read.format("paged_catalog").option("arguments", arguments).load()
    assert {(r.page_no, r.n, r.c) for r in rows.groupBy("page_no").agg(F.count(F.lit(1)).alias("n"), F.max("next_cursor").alias("c")).collect()} == {(0, 10, "10"), (1, 10, "20"), (2, 5, None)}
    stream = spark.readStream.format("paged_catalog").option("arguments", arguments).load()
    q = stream.writeStream.format("memory").queryName("paged_rows").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.raw for r in spark.table("paged_rows").collect()} == {json.dumps({"id": f"m{i}"}) for i in range(25)}


def test_scalars_of_headers_and_dates(spark):
    df = spark.createDataFrame([('<https://a.b/?p=1>; rel="prev", <https://a.b/?p=3>; rel="next"', " 12 ", "2024-02-30", "2024-02-29T10:00:00+02:00", "Ｆｕｌｌ ² ﬁ"), (None, "-1", "2024-02-29", "now", None)], "l string, n string, d string, t string, c string")
    a, b = df.select(T.link_next(F.col("l")), T.header_integer(F.col("n")), T.iso_date(F.col("d")).cast("string"), T.instant_text(T.instant(F.col("t"))), T.compatible(F.col("c"))).collect()
    assert tuple(a) == ("https://a.b/?p=3", 12, None, "2024-02-29T08:00:00Z", "Full 2 fi") and tuple(b) == (None, None, "2024-02-29", None, None)
    ids = spark.createDataFrame([("T", ["https://x.y", "https://arxiv.org/pdf/2101.00001v3.pdf"]), ("T", ["https://doi.org/10.1/Ab/"]), ("T", ["https://openreview.net/forum?id=xY1"]), (" A  title", [])], "t string, l array<string>")
    got = [r[0] for r in ids.select(T.publication_id(F.col("t"), F.col("l"))).collect()]
    assert got[:3] == ["arxiv:2101.00001", "doi:10.1/ab", "openreview:xY1"] and got[3] == "epoch-reference:" + hashlib.sha256(b'{"title":"a title"}').hexdigest()


def test_cbor():
    for value, data in ((0, "00"), (23, "17"), (24, "1818"), (1000, "1903e8"), (-1, "20"), (1.5, "f93e00"), (1.1, "fb3ff199999999999a"), ("IETF", "6449455446"), ([1, [2, 3]], "8201820203"), ({"b": [], "a": True, "aa": None}, "a36161f5616280626161f6"), ({}, "a0")):
        assert canonical.cbor(value).hex() == data and canonical.decode_cbor(bytes.fromhex(data)) == value
    with pytest.raises(ValueError):
        canonical.decode_cbor(bytes.fromhex("1817"))  # not the shortest head
    with pytest.raises(ValueError):
        canonical.cbor(float("nan"))


def test_readers_check(spark, tmp_path):
    relation = {"predicate": "derived_from", "subject_model_local_id": "m1", "stated_at": "2024-01-01T00:00:00Z", "target": {"entry_id": "e2", "identifiers": [{"namespace": "n", "value": "v"}]}}
    (tmp_path / "e.jsonl").write_text(json.dumps({"id": "e1", "canonical_name": "One", "model_relations": [relation]}) + "\n\nbroken\n" + json.dumps({"id": "e3", "aliases": "x"}) + "\n[]\n")
    e = readers.entry_lines(spark, str(tmp_path / "e.jsonl"))
    r = e.where("id = 'e1'").first().model_relations[0]
    assert e.count() == 4 and r.subject_model_local_id == "m1" and r.stated_at is not None and r.target.identifiers[0].value == "v"
    assert {(x.line[:4], x.problem) for x in readers.entry_type_problems(spark, str(tmp_path / "e.jsonl")).collect()} == {("brok", "not_an_object"), ("[]", "not_an_object"), ('{"id', "not_a_list:aliases")}
    good = {"artifact_id": "a", "x": 1.0}
    good["profile_digest"] = canonical.content_digest(good)
    p = spark.createDataFrame([("1", json.dumps(good)), ("2", json.dumps({**good, "artifact_id": "b"})), ("3", "{"), ("4", json.dumps({"x": 1})), ("5", json.dumps({"artifact_id": "c"}))], "path string, text string")
    assert {tuple(x) for x in readers.profile_problems(p).collect()} == {("2", "digest_differs"), ("3", "not_json"), ("4", "no_artifact_id"), ("5", "no_digest")}
    edges = spark.createDataFrame([("t", "r", "a", 1.0, True), ("t", "r", "b", 1.0, True)], "tree_id string, parent string, child string, branch_length double, child_is_taxon boolean")
    states = spark.createDataFrame([("t", "a", "c", 1), ("t", "b", "c", 0)], "tree_id string, taxon string, character string, cnt int")
    distances = spark.createDataFrame([("t", "a", "b", 2.0)], "tree_id string, left_id string, right_id string, distance double")
    writers.write_lineage(edges, states, distances, str(tmp_path / "l"))
    held = readers.lineage_tables(spark, str(tmp_path / "l"))
    assert held["character_states"].count() == 1 and catalog.set_differences(held["distances"], distances).isEmpty()
    writers.write_lineage(edges, spark.createDataFrame([("t", "z", "c", 1)], states.schema), distances, str(tmp_path / "m"))
    with pytest.raises(readers.FormatError):
        readers.lineage_tables(spark, str(tmp_path / "m"))


def test_evidence_and_merges(spark):
    e = spark.createDataFrame([("a", "b", "provenance", 0.5, "c")] * 3 + [("a", "a", "provenance", 0.5, "c"), ("a", None, "provenance", 0.5, "c"), ("a", "b", "x", 0.5, "c"), ("a", "b", "awareness", 1.5, "c"), ("a", "b", "awareness", None, "c")], "source_id string, target_id string, causal_role string, strength double, character string")
    assert sorted((r.problem or "") for r in binding.normalized_evidence(e).collect()) == ["", "bad_strength", "bad_strength", "null_end", "self", "unknown_role"]
    s = spark.createDataFrame([("a", "c", 2), ("b", "c", 3), ("a", "d", 1)], "taxon string, character string, cnt int")
    t = spark.createDataFrame([("a", "b", "character_transfer", "c", 3), ("a", "b", "character_transfer", "c", 9), ("a", "b", "character_transfer", "d", 1), ("b", "a", "character_transfer", "d", None)], "source_id string, target_id string, causal_role string, character string, value int")
    assert sorted(r.problem for r in binding.transfer_problems(t, s).collect()) == ["not_in_source", "not_in_target", "value_differs"]
    m = catalog.merge_profiles(spark.createDataFrame([("x", "d", "n", "k1", "2020", "2021"), ("x", "d", "n", "k2", "2019", "2020"), ("y", "d", "n", "k", None, None), ("y", "e", "n", "k", None, None)], "id string, profile_digest string, name string, kind string, date_min string, date_max string"), "id")
    assert {(r.id, r.kind, r.date_min, r.date_max, r.merged, r.problem) for r in m.collect()} == {("x", "composite", "2019", "2021", 2, None), ("y", "k", None, None, 2, "digest_differs")}
    c = spark.createDataFrame([("a", "b", 1.0, "1", "2", "s"), ("a", "c", 1.0, "9", "3", "t")], "left_id string, right_id string, distance double, left_digest string, right_digest string, distance_signature string")
    assert {tuple(r) for r in distance.conflicts(c).collect()} == {("a", "conflicting_digest"), ("s", "mixed_signatures")}
    ids = spark.createDataFrame([("e", [("n", "v"), ("n", "v")], [("r", [("n", "w")])])], "entry_id string, identifiers array<struct<namespace:string,value:string>>, releases array<struct<release_name:string,identifiers:array<struct<namespace:string,value:string>>>>")
    assert {tuple(r) for r in binding.entry_candidates(ids).collect()} == {("e", "n", "v"), ("e", "n", "w")}


def test_pipelines(spark):
    v = [(g, n, op, "{}") for g, mid in (("a", "relu"), ("b", "tanh"), ("c", "relu")) for n, op in (("n0", "graph.input"), ("n1", mid), ("n2", "sum"), ("n3", "graph.output"))]
    e = [(g, s, t, p) for g in "abc" for s, t, p in (("n0", "n1", "arg:000000"), ("n1", "n2", "arg:000000"), ("n0", "n2", "arg:000001"), ("n2", "n3", "arg:000000"))]
    vertices, edges = spark.createDataFrame(v, "graph_id string, node_id string, operation string, attributes string"), spark.createDataFrame(e, "graph_id string, source string, target string, position string")
    held = pipelines.graph_profiles(vertices, edges, vertices.limit(0), pipelines.LineageConfig(radius=1))
    assert held["graphs"].count() == 3 and held["graphs"].select("structural_digest").distinct().count() == 2 and held["regions"].count() == 3
    states = held["character_states"].withColumnRenamed("graph_id", "taxon").withColumnRenamed("character_id", "character")
    digests = held["graphs"].select(F.col("graph_id").alias("artifact_id"), F.col("structural_digest").alias("digest"))
    entries = spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "entry_id string")
    profiles = spark.createDataFrame([("a",), ("b",), ("c",)], "profile_id string")
    bindings = spark.createDataFrame([], "entry_id string, profile_id string")
    relations = spark.createDataFrame([("a", "b"), ("b", "gone")], "source_id string, target_id string")
    out = pipelines.modelome_tree(entries, profiles, bindings, relations, states, digests)
    assert {tuple(r) for r in out["coverage"].collect()} == {("bound", 3), ("missing_profile", 1)} and out["distances"].count() == 1
    assert {r.child for r in out["tree_edges"].collect()} >= {"a", "b", "c"} and {r.status for r in out["relations"].collect()} == {"resolved", "dangling"}
    with pytest.raises(ValueError):
        pipelines.lineage(states, digests, pipelines.LineageConfig(max_taxa=1))
    with pytest.raises(ValueError):
        pipelines.graph_profiles(vertices, edges.where("graph_id = 'a'").withColumn("source", F.lit("zz")), vertices.limit(0))
    dated = spark.createDataFrame([("a", "2020-01-01", "2020-01-01"), ("b", "2021-01-01", "2021-01-01")], "artifact_id string, date_min string, date_max string").select("artifact_id", F.to_date("date_min").alias("date_min"), F.to_date("date_max").alias("date_max"))
    evidence = spark.createDataFrame([("a", "b", "provenance", 0.5, "c"), ("b", "a", "provenance", 0.5, "c")], "source_id string, target_id string, causal_role string, strength double, character string")
    net = pipelines.contact_network(dated, evidence, states.select("taxon", "character"), True)
    assert [(r.source_id, r.target_id) for r in net["edges"].collect()] == [("a", "b")] and net["pairs"].count() == 2
    assert Scratch(spark, "x").root
