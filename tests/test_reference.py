"""Small fixtures with known results: graphs, characters, distances, trees, alignment, text, catalogs, sources."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from graftline.functions import canonical
from graftline.functions import text as T
from graftline.operators import alignment, binding, catalog, characters, distance, documents, graphs, source_graph, trees
from graftline.session import Scratch
from graftline.sources import readers, writers

VERTEX, EDGE = "graph_id string, node_id string, operation string, attributes string", "graph_id string, source string, target string, position string"
TOY_V = [("alpha", "n000000", "graph.input", "{}"), ("alpha", "n000001", "function.toy.linear", '{"width":4}'), ("alpha", "n000002", "function.toy.relu", "{}"), ("alpha", "n000003", "graph.output", "{}"), ("beta", "n000000", "graph.input", "{}"), ("beta", "n000001", "function.toy.add", "{}"), ("beta", "n000002", "graph.output", "{}")]
TOY_E = [("alpha", "n000000", "n000001", "arg:000000"), ("alpha", "n000001", "n000002", "arg:000000"), ("alpha", "n000002", "n000003", "arg:000000"), ("beta", "n000000", "n000001", "arg:000000"), ("beta", "n000000", "n000001", "arg:000001"), ("beta", "n000001", "n000002", "arg:000000")]


@pytest.fixture(scope="module")
def toys(spark):
    return spark.createDataFrame(TOY_V, VERTEX), spark.createDataFrame(TOY_E, EDGE)


def test_structural_digests(toys):
    got = {r.graph_id: r.structural_digest for r in graphs.structural_digest(*toys).collect()}
    assert got == {"alpha": "d0ea60f5626194f69ead87f8bbeb0810f3bec79b6aa92c4eac933866ef39c39f", "beta": "6c7939e087006c0a86e100fc4f33c776ac1e67b9cb0d87b1bb72531fa06925a5"}


def test_characters_and_distance(spark, toys):
    v, e = toys
    labelled = characters.labels(v, graphs.port_labels(e, v.limit(0)), 3)
    states = characters.states(labelled)
    assert {r.graph_id: r["count"] for r in states.groupBy("graph_id").count().collect()} == {"alpha": 16, "beta": 12}
    by_radius = characters.fingerprint(labelled).select(F.col("graph_id").alias("taxon"), F.col("feature").alias("character"), "radius", "cnt")
    each = [distance.weighted(by_radius.where(F.col("radius") == r), spark.createDataFrame([(r, 1)], "radius int, weight bigint")).first().distance for r in range(4)]
    assert each == [3, 7, 7, 7]
    assert distance.compare(states.withColumnsRenamed({"graph_id": "taxon", "character_id": "character"})).first().distance == 24
    shuffled = characters.states(characters.labels(v.repartition(3), graphs.port_labels(e.repartition(5, "position"), v.limit(0)), 3))
    assert states.exceptAll(shuffled).isEmpty()
    assert characters.labels(v.limit(0), graphs.port_labels(e.limit(0), v.limit(0)), 1).count() == 0


def test_regions(spark):
    v = [("bypass", n, op, "{}") for n, op in (("n000000", "graph.input"), ("n000001", "layer"), ("n000002", "sum"), ("n000003", "graph.output"))] + [("two", n, op, "{}") for n, op in (("a", "graph.input"), ("b", "graph.input"), ("c", "sum"))] + [("res", n, "x", "{}") for n in "abcd"]
    e = [("bypass", "n000000", "n000001", "arg:000000"), ("bypass", "n000001", "n000002", "arg:000000"), ("bypass", "n000000", "n000002", "arg:000001"), ("bypass", "n000002", "n000003", "arg:000000"), ("two", "a", "c", "arg:000000"), ("two", "b", "c", "arg:000001"), ("res", "a", "b", "resource:0"), ("res", "a", "c", "resource:0"), ("res", "b", "d", "arg:000000"), ("res", "c", "d", "arg:000001")]
    vd, ed = spark.createDataFrame(v, VERTEX), spark.createDataFrame(e, EDGE)
    ported = graphs.port_labels(ed, vd.limit(0))
    found = characters.regions(vd, ported, Scratch(spark, "t"))
    rows = found.collect()
    assert [(r.graph_id, r.entry, r.exit) for r in rows] == [("bypass", "n000000", "n000002")]
    assert {"n000000->n000001@arg:000000", "n000001->n000002@arg:000000"} <= {*rows[0].left_edges, *rows[0].right_edges}
    assert len(characters.region_signatures(found, vd, ported).first().signature) == 64


def test_deep_graphs(spark):
    """A chain far beyond the depth of published graphs, beside a shallow graph and a cycle, is walked whole."""
    n = 500
    chain = [("deep", f"n{i:06d}", f"n{i + 1:06d}", "arg:000000") for i in range(n)]
    edges = spark.createDataFrame([*chain, ("deep", "n000000", f"n{n:06d}", "arg:000001"), ("flat", "a", "b", "arg:000000"), ("ring", "a", "b", "arg:000000"), ("ring", "b", "a", "arg:000000")], EDGE)
    near = {(r.graph_id, r.node_id, r.ancestor): r.depth for r in graphs.ancestors(edges, Scratch(spark, "t")).collect()}
    assert near == {("flat", "b", "a"): 1, **{("ring", x, y): 1 + (x == y) for x in "ab" for y in "ab"}, **{("deep", f"n{j:06d}", f"n{i:06d}"): 1 if (i, j) == (0, n) else j - i for j in range(n + 1) for i in range(j)}}
    nodes = spark.createDataFrame([("deep", f"n{i:06d}", "x", "{}") for i in range(n + 1)], VERTEX)
    found = characters.regions(nodes, graphs.port_labels(edges.where("graph_id = 'deep'"), nodes.limit(0)), Scratch(spark, "t")).collect()
    assert [(r.entry, r.exit, sorted(map(len, (r.left_path, r.right_path)))) for r in found] == [("n000000", f"n{n:06d}", [2, n + 1])]


def test_outputs_of_attributes_are_no_joins(spark):
    v = spark.createDataFrame([("g", n, op, "{}") for n, op in (("a", "graph.input"), ("b", "x"), ("c", "x"), ("d", "data.attribute"), ("e", "quote \"it\""))], VERTEX)
    e = spark.createDataFrame([("g", s, t, "arg:000000") for s, t in (("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("b", "e"), ("c", "e"))], EDGE)
    ported = graphs.port_labels(e, v.limit(0))
    found = characters.regions(v, ported, Scratch(spark, "t"))
    assert [(r.entry, r.exit) for r in found.collect()] == [("a", "e")]
    digest = graphs.structural_digest(v, e).first().structural_digest
    payload = {"edges": sorted(({"position": "arg:000000", "source": s, "target": t} for s, t in (("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("b", "e"), ("c", "e"))), key=lambda x: (x["source"], x["target"])), "nodes": [{"id": n, "operation": op} for n, op in (("a", "graph.input"), ("b", "x"), ("c", "x"), ("d", "data.attribute"), ("e", "quote \"it\""))], "schema_version": "2.0.0"}
    assert digest == hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_canonical_order_of_large_and_tied_graphs(spark):
    rng = random.Random(3)
    links = [(f"{i}", f"{i + 1}", "p") for i in range(2999)] + [(f"{i}", f"{i + 2}", "q") for i in range(0, 2990, 5)]
    ids = [str(i) for i in range(3000)]
    assert graphs._canonical([(n, "x", "{}") for n in ids], links, 100) == ids
    for _ in range(30):  # equal graphs under shuffled names get equal certificates
        n = rng.randrange(2, 8)
        ops = [rng.choice("ab") for _ in range(n)]
        edges = [(i, j, rng.choice("pq")) for j in range(n) for i in range(j) if rng.random() < 0.4]
        forms = set()
        for _ in range(4):
            name = rng.sample([f"v{k}" for k in range(n)], n)
            nodes = [(name[i], ops[i], "{}") for i in range(n)]
            rng.shuffle(nodes)
            order = graphs._canonical(nodes, [(name[i], name[j], p) for i, j, p in rng.sample(edges, len(edges))], 10_000)
            at = {x: k for k, x in enumerate(order)}
            forms.add((tuple(dict((a, b) for a, b, _ in nodes)[x] for x in order), tuple(sorted((at[name[i]], at[name[j]], p) for i, j, p in edges))))
            assert all(at[name[i]] < at[name[j]] for i, j, _ in edges)
        assert len(forms) == 1


def test_deep_trees(spark):
    tree = "tree_id string, parent string, child string, branch_length double"
    placed = trees.placed(spark.createDataFrame([("t", f"n{i}", f"n{i + 1}", 0.5) for i in range(220)], tree), Scratch(spark, "t"))
    assert {(r.node, r.depth, r.x, len(r.path)) for r in placed.collect()} == {(f"n{i}", i, i / 2, i + 1) for i in range(221)}
    with pytest.raises(Exception, match="a cycle through a"):
        trees.placed(spark.createDataFrame([("t", "r", "a", 1.0), ("t", "a", "b", 1.0), ("t", "b", "a", 1.0)], tree), Scratch(spark, "t"))


def test_canonical_order_ignores_ids(spark):
    rng = random.Random(3)
    v, e = [("g", f"x{i}", rng.choice("ab"), "{}") for i in range(9)], []
    for i in range(9):
        for j in range(i + 1, 9):
            if rng.random() < 0.3:
                e.append(("g", f"x{i}", f"x{j}", f"arg:{len(e):06d}"[:10]))
    name = dict(zip([f"x{i}" for i in range(9)], rng.sample([f"y{i}" for i in range(9)], 9)))
    shape = []
    for vs, es in ((v, e), ([(g, name[n], o, a) for g, n, o, a in v], [(g, name[s], name[t], p) for g, s, t, p in e])):
        order = {r.node_id: r.canonical_id for r in graphs.canonical_order(spark.createDataFrame(vs, VERTEX), spark.createDataFrame(es, EDGE)).collect()}
        shape.append((sorted((order[n], o) for _, n, o, _ in vs), sorted((order[s], order[t], p) for _, s, t, p in es)))
    assert shape[0] == shape[1]
    with pytest.raises(Exception):
        graphs.canonical_order(spark.createDataFrame(v[:2], VERTEX), spark.createDataFrame([("g", "x0", "x1", "a"), ("g", "x1", "x0", "a")], EDGE)).collect()


def test_invariants(spark, toys):
    v, e = toys
    bad = e.unionByName(e.limit(1)).unionByName(spark.createDataFrame([("beta", "nope", "n000002", "arg:000009")], EDGE))
    kinds = {r.kind for r in graphs.invariant_violations(v.unionByName(v.where("node_id = 'n000000' and graph_id = 'beta'")), bad).collect()}
    assert kinds == {"duplicate_node", "duplicate_edge", "unknown_source"}
    assert graphs.cyclic_graphs(v, e, Scratch(spark, "t")).count() == 0


def D(*rows):
    return [(a, b, float(x)) for a, b, x in rows]


def limbs(edges):
    return {c: x for _, c, x, _, _, taxon in edges if taxon}


def test_neighbor_joining():
    four = D(("a", "b", 2), ("c", "d", 2), ("a", "c", 4), ("a", "d", 4), ("b", "c", 4), ("b", "d", 4))
    assert limbs(distance.join_neighbors(four))["a"] == limbs(distance.join_neighbors(four))["b"] == 1
    three = distance.join_neighbors(D(("a", "b", 1), ("a", "c", 1), ("b", "c", 3)))
    assert [(c, x, raw, cut) for _, c, x, raw, cut, _ in three] == [("a", 0, -0.5, True), ("b", 1.5, 1.5, False), ("__internal__:000000", 0.75, 0.75, False), ("c", 0.75, 0.75, False)]
    published = limbs(distance.join_neighbors(D(("bert", "gpt", 3529), ("gpt", "mini", 3451), ("bert", "mini", 762))))
    assert published["gpt"] + 0 == 3109 and published["bert"] == 420 and published["mini"] == 171
    for bad in (four[:5], four + four[:1], D(("a", "b", float("nan")))):
        with pytest.raises(ValueError):
            distance.join_neighbors(bad)


def test_additive_trees_come_back():
    rng = random.Random(8)
    for _ in range(20):
        n = rng.randrange(4, 9)
        parent, length = {}, {}
        nodes = [f"t{i}" for i in range(n)]
        k = 0
        while len(nodes) > 1:
            pair = rng.sample(nodes, 2)
            new = f"i{k}"
            k += 1
            for x in pair:
                nodes.remove(x)
                parent[x], length[x] = new, rng.randrange(1, 9)
            nodes.append(new)

        def way(x):
            out = {x: 0}
            s = 0
            while x in parent:
                s += length[x]
                x = parent[x]
                out[x] = s
            return out

        rows = []
        for i in range(n):
            for j in range(i + 1, n):
                a, b = way(f"t{i}"), way(f"t{j}")
                rows.append((f"t{i}", f"t{j}", float(min(a[x] + b[x] for x in a if x in b))))
        edges = distance.join_neighbors(rows)
        up = {c: (p, x) for p, c, x, *_ in edges}

        def dist(a, b):
            def path(x):
                out, s = {x: 0.0}, 0.0
                while x in up:
                    x, d = up[x]
                    s += d
                    out[x] = s
                return out

            pa, pb = path(a), path(b)
            return min(pa[x] + pb[x] for x in pa if x in pb)

        assert all(abs(dist(a, b) - x) < 1e-9 for a, b, x in rows)


def test_audits(spark):
    d = lambda rows: spark.createDataFrame(rows, "left_id string, right_id string, distance double")
    good = distance.tree_likeness(d(D(("a", "b", 2), ("c", "d", 2), ("a", "c", 4), ("a", "d", 4), ("b", "c", 4), ("b", "d", 4)))).first()
    assert good.is_metric and good.is_additive and good.four_point_checks == 1
    bad = distance.tree_likeness(d(D(("a", "b", 1), ("c", "d", 1), ("a", "c", 2), ("b", "d", 2), ("a", "d", 5), ("b", "c", 1)))).first()
    assert bad.four_point_violations == 1
    tri = distance.tree_likeness(d(D(("a", "b", 1), ("a", "c", 1), ("b", "c", 3)))).first()
    assert tri.triangle_violations == 1 and tri.max_triangle_violation == 1.0
    taxa = spark.createDataFrame([("a",), ("b",), ("c",)], "taxon string")
    assert {r.reason for r in distance.incomplete(d(D(("a", "b", 1), ("b", "a", 1), ("a", "c", -1))), taxa).collect()} == {"duplicate", "invalid", "missing"}


def test_newick():
    assert trees.newick_text([("root", "z", 1.0), ("root", "a,b", 0.25), ("root", "O'Brien", 0.0)]) == "('O''Brien':0,'a,b':0.25,z:1);"
    for bad in ([("a", "b", 1.0), ("b", "a", 1.0)], [("a", "c", 1.0), ("b", "c", 1.0)], [("a", "b", float("nan"))], []):
        with pytest.raises(ValueError):
            trees.newick_text(bad)


def test_ancestral_states(spark):
    e = spark.createDataFrame([("t", "r", "i1", 1.0), ("t", "r", "i2", 1.0), ("t", "i1", "a1", 1.0), ("t", "i1", "a2", 1.0), ("t", "i2", "b1", 1.0), ("t", "i2", "b2", 1.0)], "tree_id string, parent string, child string, branch_length double")
    s = spark.createDataFrame([("t", "a1", "c0", 1), ("t", "a2", "c0", 2), ("t", "a2", "c1", 1), ("t", "b1", "c1", 1)], "tree_id string, node string, character string, cnt int")
    st = trees.ancestral_states(trees.placed(e, Scratch(spark, "t")), s)
    assert {(r.character, r.cnt) for r in st.where("node = 'i1'").collect()} == {("c0", 1)}
    assert st.where("node in ('r', 'i2')").count() == 0
    assert {(r.child, r.character) for r in trees.edge_traits(e, st).where("change = 'gained'").collect()} == {("i1", "c0"), ("a2", "c1"), ("b1", "c1")}
    assert {r.kind for r in trees.problems(e.union(e.limit(1).withColumn("parent", F.lit("q")).select(*e.columns))).collect()} == {"two_parents", "several_roots"}


def test_compact(spark):
    a = distance.collapse_identical(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("c", "2"), ("d", None)], "artifact_id string, digest string"))
    assert {(r.artifact_id, r.representative) for r in a.collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    asked = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "zz")], "left_id string, right_id string")
    d = distance.alias_distances(asked, a, spark.createDataFrame([("a", "c", 7)], "left_id string, right_id string, distance int"))
    assert {tuple(r) for r in d.collect()} == {("a", "b", 0.0), ("b", "c", 7.0), ("b", "zz", None)}


def test_alignment(spark):
    s = spark.createDataFrame([("p", "left", 0, "l0", "alpha"), ("p", "left", 1, "l1", "end"), ("p", "right", 0, "r0", "alpha"), ("p", "right", 1, "r1", "inserted"), ("p", "right", 2, "r2", "end")], "pair_id string, side string, at int, node_id string, token string")
    e = spark.createDataFrame([("p", "left", "l0", "l1", "a", "a"), ("p", "right", "r0", "r1", "a", "a"), ("p", "right", "r1", "r2", "a", "a")], "pair_id string, side string, source string, target string, position string, port string")
    nodes = alignment.node_matches(s)
    ops = alignment.operations(s, e, nodes, alignment.edge_matches(e, nodes))
    assert {r.kind: r["count"] for r in ops.groupBy("kind").count().collect()} == {"add_node": 1, "remove_edge": 1, "add_edge": 2}
    assert {r.kind: r["count"] for r in alignment.inverted(ops).groupBy("kind").count().collect()} == {"remove_node": 1, "add_edge": 1, "remove_edge": 2}
    assert alignment.node_lower_bound(s).first().bound == 1
    assert {tuple(r) for r in alignment.validation(s, e, nodes, ops).collect()} == {("p", 4.0, 4, True, True)}  # 1 node and 3 edges can never match
    assert [r.kind for r in alignment.replay_order(ops).orderBy("step").collect()] == ["remove_edge", "add_node", "add_edge", "add_edge"]
    assert alignment.edge_lower_bound(s, e).first().bound == 3
    digests = spark.createDataFrame([("p", "b", "a")], "pair_id string, left_digest string, right_digest string")
    so, eo = alignment.oriented(s, digests), alignment.oriented(e, digests)
    turned = alignment.node_matches(so)
    back = alignment.restored(turned, digests)
    assert {(r.left_id, r.right_id) for r in back.collect()} == {("l0", "r0"), ("l1", "r2")}
    solved = alignment.operations(so, eo, turned, alignment.edge_matches(eo, turned))
    assert {(r.kind, r.ref, r.operation_id) for r in alignment.restored(solved, digests).collect()} == {(r.kind, r.ref, r.operation_id) for r in ops.collect()}
    assert alignment.ambiguities(s, e, nodes).count() == 0
    with pytest.raises(ValueError):
        alignment.operations(s, e, nodes, alignment.edge_matches(e, nodes), {"add_node": 0.0})
    rng = random.Random(1)
    for _ in range(50):
        a, b = (["".join(rng.choices("abc", k=1)) for _ in range(rng.randrange(8))] for _ in "ab")
        best = max(bin(m).count("1") for m in range(1 << len(a)) if is_sub([x for i, x in enumerate(a) if m >> i & 1], b))
        assert len(alignment.longest_common(a, b)) == best
    same = list(map(str, range(5000)))
    assert alignment.longest_common(same, list(same))[-1] == (4999, 4999)  # equal graphs need no table


def is_sub(x, b):
    it = iter(b)
    return all(c in it for c in x)


def test_scalars(spark):
    df = spark.createDataFrame([("https://doi.org/10.1/AbC).", "arXiv:2101.00001v3", "[1, 2–4; 9]", "Example et al. (2023)", " 1,234.5 ", "see https://a.b/c, (https://a.b/d)."), (None,) * 6, ("",) * 6], "d string, a string, m string, y string, n string, u string")
    r = df.select(T.normalize_doi(F.col("d")).alias("d"), T.normalize_arxiv(F.col("a")).alias("a"), T.marker_keys(F.col("m")).alias("m"), T.marker_keys(F.col("y")).alias("y"), T.finite_number(F.col("n")).alias("n"), T.urls(F.col("u")).alias("u")).collect()
    assert r[0].d == "10.1/abc" and r[0].a == "2101.00001" and r[0].m == ["marker:1", "marker:2", "marker:3", "marker:4", "marker:9"]
    assert r[0].y == ["author_year:example:2023"] and r[0].n == 1234.5 and r[0].u == ["https://a.b/c", "https://a.b/d"]
    assert r[1].d is None and r[1].n is None and r[2].m == [] and r[2].u == []
    assert canonical.canonical_json({"b": -0.0, "a": {2.5, 1}}) == '{"a":[1,2.5],"b":0.0}'
    with pytest.raises(ValueError):
        canonical.canonical_json(float("inf"))


def test_text(spark):
    text = "Intro words here [1], [2–3].\n1 Method\nWe use e.g. two steps. Fig. 2 shows 3.5 points. Done!\nReferences\n[1] Doe, A. On trees. 2020. doi:10.1000/x\n[2] Roe, B. 2021.\n[3] Poe, C. a title\nmore. 2022."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "plain")], "doc_id int, text string")
    assert documents.sentences("We use e.g. two steps. Fig. 2 shows 3.5 points. Done!") == [(0, 22), (23, 47), (48, 53)]
    assert [s[0] for s in documents.sections(text)] == ["Front matter", "Method", "References"]
    b = documents.bibliography(docs)
    assert {(r.marker, r.year, r.author, r.doi) for r in b.collect()} == {("1", 2020, "trees", "10.1000/x"), ("2", 2021, "b", None), ("3", 2022, "more", None)}
    assert all(text[r.start : r.end].split() == f"[{r.marker}] {r.entry}".split() and r.source_digest == hashlib.sha256(text.encode()).hexdigest() for r in b.collect())
    listed = documents.references("x\n2. Bibliography:\n1. Doe, J. https://a.b/c. 2019a\n 2) arXiv: hep-th/9901001v2, 1999\n")
    assert [(r[0], r[5], r[6], r[7], r[8]) for r in listed] == [("1", None, 2019, "c", ["https://a.b/c"]), ("2", "hep-th/9901001", 1999, "v", [])]
    targets = spark.createDataFrame([("t1", "On trees and their long branches", None, None, [], None, None), ("t2", "x", "10.1000/x", None, [], None, None), ("t3", "y", None, None, ["https://a.b/c"], "b", 2021), ("t4", "z", None, None, [], "b", 2021)], "target_id string, title string, doi string, arxiv_id string, urls array<string>, author string, year int")
    evidence = {(r.marker, r.start): (r.target_ids, r.confidence) for r in documents.citation_evidence(docs, targets).collect()}
    assert evidence == {("[1]", 17): (["t2"], 1.0), ("[2–3]", 22): ([], 0.0)}
    entries = spark.createDataFrame([("e1", "Doe. On Trees, and THEIR long branches. 2020", None, None, [], None, None), ("e2", "short title", None, None, [], "b", 2021), ("e3", "none", None, None, ["https://a.b/c"], "b", 2021)], "entry_id string, entry string, doi string, arxiv_id string, urls array<string>, author string, year int")
    assert {(r.entry_id, r.status, r.rule, r.confidence, r.target_id) for r in documents.resolve_bibliography(entries, targets).collect()} == {("e1", "resolved", "title", 0.92, "t1"), ("e2", "ambiguous", "author_year", None, None), ("e3", "resolved", "url", 0.98, "t3")}
    m = documents.resolve_mentions(documents.mentions(docs), b)
    assert {(r.key, r.status) for r in m.collect()} == {("marker:1", "resolved"), ("marker:2", "resolved"), ("marker:3", "resolved")}
    once = documents.normalize_paper("A wrap-\nped line\nof text.\r\n\r\nMETHOD\nmore text")
    assert once == "A wrapped line of text.\n\nMETHOD\nmore text" and documents.normalize_paper(once) == once
    assert documents.normalize_paper("one\x07two state-of\n\nthe well-\nknown\n\n\nIV. results here\n\nthe body") == "one two state-of\n\nthe wellknown\n\nIV. results here\nthe body"
    assert [documents.heading(x) for x in ("iv) some results", "2.1 the data:", "some words", "Method", "A B.", "x" * 101, "")] == ["some results", "the data", None, "Method", None, None, None]
    two = "A line that\ngoes on. The U.S. Army (see fig. 2) won.\" Next"
    assert [two[a:b] for a, b in documents.sentences(two)] == ["A line that\ngoes on.", "The U.", "S.", "Army (see fig. 2) won.\"", "Next"]  # a capital behind a mark begins a sentence
    assert documents.paper_profiles(docs).where("doc_id = 1").first().n_sections == 3


def test_catalog(spark):
    rows = [(f"v{i}", float(10 - i) if i != 4 else None, f"p{i % 3}" if i < 6 else None) for i in range(10)]
    c = spark.createDataFrame(rows, "version_id string, score double, paper string")
    assert [r.version_id for r in catalog.ranked(c).orderBy("rank").collect()] == [f"v{i}" for i in range(10) if i != 4]
    assert {r.version_id for r in catalog.top_p(c, 0.2).collect()} == {"v0", "v1"}
    assert [r.version_id for r in catalog.select_papers(c, 1).orderBy("rank").collect()] == ["v0", "v1", "v2", "v6"]
    assert catalog.ranked(c.limit(0)).count() == 0
    d = catalog.coalesce_duplicates(spark.createDataFrame([("a", "x", None), ("a", None, "y"), ("b", "1", "2"), ("b", "3", "2")], "k string, p string, q string"), "k", ["p", "q"])
    assert {(r.k, r.p, r.q, tuple(r.conflicts)) for r in d.where("k = 'a'").collect()} == {("a", "x", "y", ())}
    assert d.where("k = 'b'").first().conflicts == ["p"]


def test_binding(spark):
    e, p, b = (spark.createDataFrame(x, s) for x, s in (([("a",), ("b",), ("c",)], "entry_id string"), ([("a",), ("x",), ("z",)], "profile_id string"), ([("b", "x"), ("c", "nope")], "entry_id string, profile_id string")))
    bound = binding.bind_profiles(e, p, b)
    assert {tuple(r) for r in bound.collect()} == {("a", "a", "bound"), ("b", "x", "bound"), ("c", None, "missing_profile")}
    assert [r[0] for r in binding.unused_profiles(p, bound).collect()] == ["z"]


def test_sources(spark, tmp_path, toys):
    entry = {"id": "e1", "canonical_name": "One", "aliases": ["o"]}
    for name, content in (("a.json", json.dumps([entry, {"id": "e2", "canonical_name": "Two"}])), ("b.json", json.dumps({"entries": [entry]})), ("c.jsonl", json.dumps(entry) + "\n" + json.dumps(entry)), ("d.json", json.dumps(entry))):
        (tmp_path / name).write_text(content)
    counts = [readers.entries(spark, str(tmp_path / n)).where("id is not null").count() for n in ("a.json", "b.json", "c.jsonl", "d.json")]
    assert counts == [2, 1, 2, 1]
    assert {r.problem for r in readers.entry_problems(readers.entries(spark, str(tmp_path / "c.jsonl"))).collect()} == {"duplicate_id"}
    writers.write_graphs(*toys, str(tmp_path / "g"))
    g, v, e = readers.graph_tables(spark, str(tmp_path / "g"))
    assert v.exceptAll(toys[0]).isEmpty() and g.where("graph_id = 'beta' and edge_count = 3").count() == 1
    assert "config_name: x" in writers.export_dataset({"x": v.withColumn("payload_cbor", F.lit("z"))}, str(tmp_path / "out"))
    files = spark.createDataFrame([("m.py", "def f(x):\n    return g(x) + 1\n"), ("bad.py", "def ("), ("j.json", '{"a":[1,null]}'), ("node_modules/x.json", "{}")], "path string, content string")
    rows = source_graph.syntax_nodes(source_graph.wanted(files)).collect()
    kinds = {(r.path, r.kind, r.operation) for r in rows}
    assert ("m.py", "operator", "python.call:g") in kinds and ("bad.py", "parse_error", "SyntaxError") in kinds and ("j.json", "data", "data.null") in kinds and not any(p.startswith("node") for p, _, _ in kinds)
    assert [(r.operation, r.attributes) for r in rows if r.path == "m.py"][:3] == [("python.ast:module", "{}"), ("python.ast:functiondef", '{"parameter_count":1}'), ("python.ast:arguments", "{}")]
    assert {r.status: r.files for r in source_graph.exclusions(files).collect()} == {"kept": 3, "excluded_folder": 1}


def test_toml_and_unparsed_sources(spark):
    text = '[tool]\nname = "x"\nwhen = 2020-01-02\nsizes = [1, 2.5, true]\n'
    files = spark.createDataFrame([("p.toml", text), ("UP.TOML", "a = 1"), ("bad.toml", "a ="), ("none.toml", None), ("c.yaml", "a: 1"), ("d.yml", None)], "path string, content string")
    rows = source_graph.syntax_nodes(files).collect()
    assert [(r.node_id, r.operation) for r in rows if r.path == "p.toml"] == [
        ("n000000", "data.object"), ("n000001", "data.object"), ("n000002", "data.string"), ("n000003", "data.array"), ("n000004", "data.number"), ("n000005", "data.number"), ("n000006", "data.boolean"), ("n000007", "data.date"),
    ]
    assert [(r.source, r.target, r.kind, r.position, r.field) for r in source_graph.syntax_edges(files).where("path = 'p.toml'").collect()][:4] == [
        ("n000001", "n000000", "field", "000000", "tool"), ("n000002", "n000001", "field", "000000", "name"), ("n000003", "n000001", "field", "000001", "sizes"), ("n000004", "n000003", "item", "000000", None),
    ]
    assert sorted((r.path, r.kind, r.operation) for r in rows if r.path != "p.toml") == [
        ("UP.TOML", "data", "data.number"), ("UP.TOML", "data", "data.object"), ("bad.toml", "parse_error", "TOMLDecodeError"), ("c.yaml", "not_parsed", ".yaml"), ("d.yml", "not_parsed", ".yml"), ("none.toml", "data", "data.object"),
    ]


def test_compact_lineage_doubles_every_nation(spark):
    from graftline.plans import reference_graphs

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(f"{sf}/nation.parquet"):
        pytest.skip("no test tables here")
    tips = {r.n_name for r in spark.read.parquet(f"{sf}/nation.parquet").select("n_name").collect()}
    rows = reference_graphs.compact_lineage_edges(spark, sf).collect()
    assert {(r.parent, r.child) for r in rows if r.parent.startswith("__group__:")} == {(f"__group__:{n}", f"{n}{x}") for n in tips for x in ("", "_copy")}
    assert {r.child for r in rows if r.is_group} <= {f"__group__:{n}" for n in tips}


def test_packed_tables_are_not_broadcast(spark):
    """Millions of alike rows are a small file, but no small table."""
    from pyspark.sql import functions as F

    scratch = Scratch(spark, "t")
    alike = lambda n: spark.range(n).select((F.col("id") * 0).alias("k"), F.lit("n000001").alias("source"), F.lit("n000002").alias("target"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = spark.range(3).withColumnRenamed("id", "k")
    large, small, none = (scratch.cut(alike(n), "alike", weigh=True) for n in (1_000_000, 1000, 0))
    other = scratch.cut(alike(1_000_000), "alike", weigh=True)
    assert "SortMergeJoin" in plan(large.where("k = 1").join(other, "k", "left")) and "BroadcastHashJoin" in plan(small.join(few, "k"))
    assert large.count() == 1_000_000 and none.join(few, "k").count() == 0

    rows = 300_000
    v = spark.range(rows).select(F.floor(F.col("id") / 50).cast("string").alias("graph_id"), F.format_string("n%06d", F.col("id") % 50).alias("node_id"), F.lit("view").alias("operation"), F.lit("{}").alias("attributes"))
    e = v.where("node_id > 'n000000'").select("graph_id", F.lit("n000000").alias("source"), F.col("node_id").alias("target"), F.lit("arg:000000").alias("port"))
    seen = []
    cut = scratch.cut
    scratch.cut = lambda df, *a, **k: seen.append(plan(df)) or cut(df, *a, **k)
    assert characters.labels(v, e, 1, scratch).count() == 2 * rows
    assert len(seen) == 3 and "SortMergeJoin" in seen[2] and "BroadcastHashJoin" not in seen[2]


def test_titles_that_begin_alike_meet_few_entries(spark):
    """Titles with one beginning are told apart by another piece of them; titles inside titles and copies are still found."""
    from pyspark.sql import functions as F

    known = spark.range(3000).select(F.concat(F.lit("the long title number "), (F.col("id") + 10000).cast("string"), F.lit(" of all")).alias("norm"))
    pieces = documents.title_pieces(known)
    assert pieces.count() == 3000 and pieces.groupBy("piece").count().agg(F.max("count")).first()[0] == 1
    targets = "target_id string, title string, doi string, arxiv_id string, urls array<string>, author string, year int"
    entries = "entry_id string, entry string, doi string, arxiv_id string, urls array<string>, author string, year int"
    titles = ["a survey of large trees", "a survey of large trees and forests", "a survey of large tables", "sixteen letters!", "a survey of large ships", "a survey of large ships"]
    c = spark.createDataFrame([(f"t{k}", x, None, None, [], None, None) for k, x in enumerate(titles)], targets)
    texts = ["Doe. A Survey of Large Tables. 2020", "Roe. A survey of large trees and forests", "A survey of large", "x a survey of large ships y", "A survey of large trees"]
    e = spark.createDataFrame([(f"e{k}", x, None, None, [], None, None) for k, x in enumerate(texts)], entries)
    got = {r.entry_id: (r.status, r.target_id) for r in documents.resolve_bibliography(e, c).collect()}
    assert got == {"e0": ("resolved", "t2"), "e1": ("ambiguous", None), "e2": ("unresolved", None), "e3": ("ambiguous", None), "e4": ("resolved", "t0")}


def test_distances_in_tiles(spark):
    """However the taxa are dealt into groups, every pair comes once with the distance of the plain join."""
    rng = random.Random(5)
    rows = [(f"t{k}", f"c{c}", rng.randrange(0, 9)) for k in range(40) for c in range(12) if rng.random() < 0.5] + [("empty", "c0", None), ("odd", None, 3), (None, "c1", 2), ("alone", "c99", 4)]
    states = spark.createDataFrame(rows, "taxon string, character string, cnt bigint")
    key = lambda df: sorted((r.left_id, r.right_id, r.distance) for r in df.select("left_id", "right_id", "distance").collect())
    want = key(distance.compare(states))
    for side in (1000, 7):
        assert key(distance.distances(states, side)) == want
    assert distance.distances(states.limit(0)).count() == 0
