"""Queries on graphs, characters, distances and trees, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.operators import alignment, characters, distance, graphs, trees
from graftline.plans import bindings as B
from graftline.session import Scratch
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


def _ported(pair, commutative: bool = False) -> tuple[DataFrame, DataFrame]:
    v, e = pair
    return v, graphs.port_labels(e, v.where("operation = 'function.merge'") if commutative else v.limit(0))


@query(f"WITH {B.ORDERS} SELECT graph_id, node_id, operation FROM vertices")
def graph_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return B.orders_dag(spark, sf)[0].select("graph_id", "node_id", "operation")


@query(f"WITH {B.ORDERS} SELECT graph_id, source || '->' || target || '@' || position AS edge_id, position FROM edges")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = B.orders_dag(spark, sf)[1]
    return e.select("graph_id", graphs.edge_id(F.col("source"), F.col("target"), F.col("position")).alias("edge_id"), "position")


@query(f"WITH {B.ORDERS} SELECT graph_id, (SELECT count(*) FROM vertices v WHERE v.graph_id = g.graph_id) AS vertex_count, (SELECT count(*) FROM edges e WHERE e.graph_id = g.graph_id) AS edge_count FROM g")
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.graph_summary(*B.orders_dag(spark, sf))


@query(f"WITH {B.ORDERS} SELECT graph_id, source, target, CASE WHEN target = 'n000008' THEN 'operand' ELSE position END AS port FROM edges")
def port_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _ported(B.orders_dag(spark, sf), True)[1].select("graph_id", "source", "target", "port")


@query(f"WITH {B.ORDERS} SELECT graph_id, source, target, printf('operand:%06d', row_number() OVER (PARTITION BY graph_id, target ORDER BY source, position) - 1) AS position FROM edges WHERE target = 'n000008'")
def operand_renumber(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.renumber_operands(B.orders_dag(spark, sf)[1].where("target = 'n000008'")).select("graph_id", "source", "target", "position")


@query(f"""WITH {B.ORDERS}, damaged AS (SELECT * FROM vertices WHERE NOT (node_id = 'n000001' AND operation = 'AO')), known AS (SELECT DISTINCT graph_id, node_id FROM damaged)
SELECT DISTINCT graph_id, 'unknown_source' AS kind, source AS subject FROM edges WHERE (graph_id, source) NOT IN (SELECT (graph_id, node_id) FROM known) UNION ALL SELECT DISTINCT graph_id, 'unknown_target', target FROM edges WHERE (graph_id, target) NOT IN (SELECT (graph_id, node_id) FROM known)""")
def graph_invariant_violations(spark: SparkSession, sf: str) -> DataFrame:
    v, e = B.orders_dag(spark, sf)
    return graphs.invariant_violations(v.where("not (node_id = 'n000001' and operation = 'AO')"), e)


@query(f"WITH {B.ORDERS} SELECT graph_id FROM lines WHERE node_id = 'n000001' AND operation = 'NF'")
def acyclic_check(spark: SparkSession, sf: str) -> DataFrame:
    """Graphs whose first line gets an edge back from the merge are found to be cyclic."""
    v, e = B.orders_dag(spark, sf)
    back = v.where("node_id = 'n000001' and operation = 'NF'").select("graph_id", F.lit("n000008").alias("source"), F.lit("n000001").alias("target"), F.lit("arg:000001").alias("position"))
    return graphs.cyclic_graphs(v, e.unionByName(back), Scratch(spark, "acyclic"))


def _wl_sql(base: str, port: str, radius: int) -> str:
    ctes = [base, f"pe AS (SELECT *, {port} AS port FROM edges)", "l0 AS (SELECT graph_id, node_id, sha256('[\"operator\",\"' || operation || '\",\"attributes\",{}]') AS label FROM vertices)"]
    pair = "'[\"' || port || '\",\"' || label || '\"]'"
    for r in range(1, radius + 1):
        p = f"l{r - 1}"
        ctes.append(f"i{r} AS (SELECT e.graph_id, e.target AS node_id, string_agg({pair}, ',' ORDER BY port, label) AS s FROM pe e JOIN {p} l ON e.graph_id = l.graph_id AND e.source = l.node_id GROUP BY ALL)")
        ctes.append(f"o{r} AS (SELECT e.graph_id, e.source AS node_id, string_agg({pair}, ',' ORDER BY port, label) AS s FROM pe e JOIN {p} l ON e.graph_id = l.graph_id AND e.target = l.node_id GROUP BY ALL)")
        ctes.append(f"l{r} AS (SELECT p.graph_id, p.node_id, sha256('{{\"in\":[' || coalesce(i.s, '') || '],\"out\":[' || coalesce(o.s, '') || '],\"self\":\"' || p.label || '\"}}') AS label FROM {p} p LEFT JOIN i{r} i USING (graph_id, node_id) LEFT JOIN o{r} o USING (graph_id, node_id))")
    return "WITH " + ", ".join(ctes)


def _labels(spark: SparkSession, sf: str, radius: int, dag: bool = False) -> DataFrame:
    v, e = _ported(B.orders_dag(spark, sf), True) if dag else _ported(B.chains(spark, sf))
    return characters.labels(v, e, radius, Scratch(spark, "labels"))


_ALL = " UNION ALL ".join(f"SELECT graph_id, node_id, {r} AS radius, label FROM l{r}" for r in range(4))
for _r in range(4):

    def _wl(spark: SparkSession, sf: str, r=_r) -> DataFrame:
        return _labels(spark, sf, r).where(F.col("radius") == r).select("graph_id", "node_id", "label")

    Q[f"wl_radius{_r}"] = _wl
    SQL[f"wl_radius{_r}"] = _wl_sql(B.CHAINS, "position", _r) + f" SELECT graph_id, node_id, label FROM l{_r}"


@query(_wl_sql(B.ORDERS, "CASE WHEN target = 'n000008' THEN 'operand' ELSE position END", 2) + " SELECT label, count(*) AS cnt FROM l2 GROUP BY label")
def wl_commutative(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf, 2, True).where("radius = 2").groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))


@query(_wl_sql(B.CHAINS, "position", 3) + f" SELECT graph_id, radius, label AS feature, count(*) AS cnt FROM ({_ALL}) GROUP BY ALL")
def fingerprint_counts(spark: SparkSession, sf: str) -> DataFrame:
    return characters.fingerprint(_labels(spark, sf, 3))


_CID = "sha256('{\"generator\":\"directed_wl_neighborhood.v1\",\"parameters\":{\"radius\":' || radius || '},\"structural_signature\":\"' || label || '\"}')"


@query(_wl_sql(B.CHAINS, "position", 3) + f" SELECT graph_id, {_CID} AS character_id, count(*) AS cnt FROM ({_ALL}) GROUP BY ALL")
def character_counts(spark: SparkSession, sf: str) -> DataFrame:
    return characters.states(_labels(spark, sf, 3))


@query(_wl_sql(B.CHAINS, "position", 3) + f" SELECT graph_id, character_id, node_id, sha256('{{\"character_id\":\"' || character_id || '\",\"edge_ids\":[],\"node_ids\":[\"' || node_id || '\"]}}') AS occurrence_id FROM (SELECT *, {_CID} AS character_id FROM ({_ALL}))")
def character_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return characters.occurrences(_labels(spark, sf, 3))


def _regions(spark: SparkSession, sf: str):
    v, e = _ported(B.orders_dag(spark, sf), True)
    scratch = Scratch(spark, "regions")
    v, e = scratch.cut(v, "v"), scratch.cut(e, "e")
    return characters.regions(v, e, scratch), v, e


@query(f"WITH {B.ORDERS} SELECT a.graph_id, 'n000000' AS entry, 'n000008' AS exit, a.node_id AS left_branch, b.node_id AS right_branch FROM lines a JOIN lines b ON a.graph_id = b.graph_id AND a.node_id < b.node_id")
def fork_join_regions(spark: SparkSession, sf: str) -> DataFrame:
    r = _regions(spark, sf)[0]
    return r.select("graph_id", "entry", "exit", F.element_at("left_path", 2).alias("left_branch"), F.element_at("right_path", 2).alias("right_branch"))


@query(f"""WITH {B.CHAINS}, n AS (SELECT graph_id, max(at_no) AS last FROM vertices GROUP BY graph_id) SELECT graph_id, 'n000000' AS entry, printf('n%06d', last) AS exit, last + 1 AS long_branch FROM n WHERE last > 1""")
def long_skip_regions(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as a chain with one more edge from the first to the last: one region as deep as the graph."""
    v, e = B.chains(spark, sf)
    scratch = Scratch(spark, "skips")
    v, e = scratch.cut(v, "v"), scratch.cut(e, "e")
    ends = v.groupBy("graph_id").agg(F.max("node_id").alias("target")).where("target > 'n000001'").select("graph_id", F.lit("n000000").alias("source"), "target", F.lit("arg:000001").alias("position"))
    r = characters.regions(v, graphs.port_labels(e.unionByName(ends), v.limit(0)), scratch)
    return r.select("graph_id", "entry", "exit", F.greatest(F.size("left_path"), F.size("right_path")).cast("bigint").alias("long_branch"))


_PATH = "'[{\"attributes\":{},\"operation\":\"graph.input\"},{\"attributes\":{},\"input_port\":\"arg:000000\",\"operation\":\"' || X || '\"},{\"attributes\":{},\"input_port\":\"operand\",\"operation\":\"function.merge\"}]'"


@query(f"""WITH {B.ORDERS}, b AS (SELECT graph_id, node_id, {_PATH.replace("X", "operation")} AS j FROM lines)
SELECT sha256('{{"discovery":"fork_join.v1","paths":[' || least(x.j, y.j) || ',' || greatest(x.j, y.j) || ']}}') AS signature, count(*) AS cnt FROM b x JOIN b y ON x.graph_id = y.graph_id AND x.node_id < y.node_id GROUP BY ALL""")
def region_signature_counts(spark: SparkSession, sf: str) -> DataFrame:
    return characters.region_signatures(*_regions(spark, sf)).groupBy("signature").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"""WITH {B.ORDERS}, d AS (SELECT graph_id, node_id, 'n000000' AS ancestor, 1 AS depth FROM lines UNION ALL SELECT graph_id, 'n000008', node_id, 1 FROM lines UNION ALL SELECT graph_id, 'n000008', 'n000000', 2 FROM g
  UNION ALL SELECT graph_id, 'n000009', 'n000008', 1 FROM g UNION ALL SELECT graph_id, 'n000009', node_id, 2 FROM lines UNION ALL SELECT graph_id, 'n000009', 'n000000', 3 FROM g) SELECT * FROM d""")
def ancestor_distances(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.ancestors(B.orders_dag(spark, sf)[1], Scratch(spark, "ancestors"))


_DIGEST = """'{"edges":[' || coalesce((SELECT string_agg('{"position":"' || position || '","source":"' || source || '","target":"' || target || '"}', ',' ORDER BY source, target, position) FROM edges e WHERE e.graph_id = v.graph_id), '') || '],"nodes":[' || string_agg('{"id":"' || node_id || '","operation":"' || operation || '"}', ',' ORDER BY node_id) || '],"schema_version":"2.0.0"}'"""


@query(f"WITH {B.CHAINS} SELECT graph_id, sha256({_DIGEST}) AS structural_digest FROM vertices v GROUP BY graph_id")
def structural_digest(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.structural_digest(*B.chains(spark, sf))


@query(f"WITH {B.CHAINS} SELECT graph_id, node_id, node_id AS canonical_id FROM vertices")
def canonical_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Chains are labelled along their only topological order."""
    return graphs.canonical_order(*B.chains(spark, sf))


# ---------------------------------------------------------------- distances


@query(f"WITH {B.PAIRS} SELECT left_id, right_id, distance FROM sh")
def pairwise_l1(spark: SparkSession, sf: str) -> DataFrame:
    return distance.compare(B.nation_states(spark, sf)).select("left_id", "right_id", "distance")


@query(f"WITH {B.PAIRS} SELECT left_id, right_id, shared, l.total - shared AS left_only, r.total - shared AS right_only FROM sh JOIN t l ON left_id = l.taxon JOIN t r ON right_id = r.taxon")
def shared_left_right_characters(spark: SparkSession, sf: str) -> DataFrame:
    return distance.compare(B.nation_states(spark, sf)).select("left_id", "right_id", "shared", "left_only", "right_only")


@query(f"WITH {B.PAIRS} SELECT left_id, right_id, round(2.0 * shared / (l.total + r.total), 12) AS similarity FROM sh JOIN t l ON left_id = l.taxon JOIN t r ON right_id = r.taxon")
def graph_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return distance.similarity(B.nation_states(spark, sf))


@query(f"WITH {B.PAIRS} SELECT left_id, right_id, distance FROM sh UNION ALL SELECT right_id, left_id, distance FROM sh UNION ALL SELECT taxon, taxon, 0 FROM t")
def distance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    s = Scratch(spark, "matrix").cut(B.nation_states(spark, sf), "states")
    return distance.matrix(distance.compare(s), s.select("taxon").distinct())


@query(
    _wl_sql(B.CHAINS, "position", 1)
    + """, s AS (SELECT graph_id, 0 AS radius, label, count(*) AS cnt FROM l0 GROUP BY ALL UNION ALL SELECT graph_id, 1, label, count(*) FROM l1 GROUP BY ALL), f AS (SELECT DISTINCT radius, label FROM s), gs AS (SELECT DISTINCT graph_id FROM s),
d AS (SELECT g.graph_id, f.radius, f.label, coalesce(s.cnt, 0) AS cnt FROM gs g CROSS JOIN f LEFT JOIN s USING (graph_id, radius, label))
SELECT a.graph_id AS left_id, b.graph_id AS right_id, CAST(sum(abs(a.cnt - b.cnt) * (CASE a.radius WHEN 0 THEN 2 ELSE 1 END)) AS BIGINT) AS distance FROM d a JOIN d b ON a.radius = b.radius AND a.label = b.label AND a.graph_id < b.graph_id GROUP BY ALL"""
)
def weighted_multiradius_distance(spark: SparkSession, sf: str) -> DataFrame:
    states = characters.fingerprint(_labels(spark, sf, 1)).select(F.col("graph_id").alias("taxon"), F.col("feature").alias("character"), "radius", "cnt")
    weights = spark.createDataFrame([(0, 2), (1, 1)], "radius int, weight bigint")
    return distance.weighted(Scratch(spark, "radii").cut(states, "states"), weights)


_TRI = f"""{B.PAIRS}, tri AS (SELECT ab.left_id AS a, ab.right_id AS b, ac.right_id AS c, CAST(greatest(0, 2 * greatest(ab.distance, ac.distance, bc.distance) - ab.distance - ac.distance - bc.distance) AS DOUBLE) AS violation
  FROM sh ab JOIN sh ac ON ab.left_id = ac.left_id AND ab.right_id < ac.right_id JOIN sh bc ON bc.left_id = ab.right_id AND bc.right_id = ac.right_id)"""
_QUA = f"""{_TRI}, qs AS (SELECT ab.left_id AS a, ab.right_id AS b, cd.left_id AS c, cd.right_id AS d, list_sort([ab.distance + cd.distance, ac.distance + bd.distance, ad.distance + bc.distance]) AS s
  FROM sh ab JOIN sh cd ON ab.right_id < cd.left_id JOIN sh ac ON ac.left_id = ab.left_id AND ac.right_id = cd.left_id JOIN sh bd ON bd.left_id = ab.right_id AND bd.right_id = cd.right_id JOIN sh ad ON ad.left_id = ab.left_id AND ad.right_id = cd.right_id JOIN sh bc ON bc.left_id = ab.right_id AND bc.right_id = cd.left_id),
qua AS (SELECT a, b, c, d, CAST(s[3] - s[2] AS DOUBLE) AS violation FROM qs)"""


def _nation_distances(spark: SparkSession, sf: str) -> DataFrame:
    return Scratch(spark, "distances").cut(distance.compare(B.nation_states(spark, sf)).select("left_id", "right_id", "distance"), "distances")


@query(f"WITH {_TRI} SELECT * FROM tri")
def triangle_audit(spark: SparkSession, sf: str) -> DataFrame:
    return distance.triangles(_nation_distances(spark, sf))


@query(f"WITH {_QUA} SELECT * FROM qua")
def four_point_audit(spark: SparkSession, sf: str) -> DataFrame:
    return distance.quartets(_nation_distances(spark, sf))


@query(f"WITH {_QUA} SELECT t.*, q.*, t.triangle_violations = 0 AS is_metric, t.triangle_violations = 0 AND q.four_point_violations = 0 AS is_additive FROM (SELECT count(*) AS triangle_checks, count(*) FILTER (violation > 0) AS triangle_violations, max(violation) AS max_triangle_violation FROM tri) t, (SELECT count(*) AS four_point_checks, count(*) FILTER (violation > 0) AS four_point_violations, max(violation) AS max_four_point_violation FROM qua) q")
def tree_likeness_summary(spark: SparkSession, sf: str) -> DataFrame:
    return distance.tree_likeness(_nation_distances(spark, sf))


@query(f"WITH {B.STATES} SELECT t.taxon, c.character, coalesce(s.cnt, 0) AS cnt FROM (SELECT DISTINCT taxon FROM states) t CROSS JOIN (SELECT DISTINCT character FROM states) c LEFT JOIN states s ON t.taxon = s.taxon AND c.character = s.character")
def character_matrix_dense(spark: SparkSession, sf: str) -> DataFrame:
    s = Scratch(spark, "dense").cut(B.nation_states(spark, sf), "states")
    cells = s.select("taxon").distinct().join(s.select("character").distinct(), F.lit(True))  # the dense matrix is the result
    return cells.join(s, ["taxon", "character"], "left").select("taxon", "character", F.coalesce("cnt", F.lit(0)).alias("cnt"))


@query(f"WITH {B.STATES} SELECT * FROM states")
def character_states_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return B.nation_states(spark, sf)


@query(f"""WITH {B.PAIRS}, three AS (SELECT taxon, row_number() OVER (ORDER BY taxon) AS k FROM t), d AS (SELECT max(distance) FILTER (l.k = 1 AND r.k = 2) AS ab, max(distance) FILTER (l.k = 1 AND r.k = 3) AS ac, max(distance) FILTER (l.k = 2 AND r.k = 3) AS bc FROM sh JOIN three l ON left_id = l.taxon JOIN three r ON right_id = r.taxon)
SELECT taxon AS child, CASE k WHEN 1 THEN greatest(0, (ab + ac - bc) / 2.0) WHEN 2 THEN greatest(0, (ab + bc - ac) / 2.0) ELSE (ac + bc - ab) / 4.0 END::DOUBLE AS branch_length FROM three, d WHERE k <= 3""")
def nj_three_taxa(spark: SparkSession, sf: str) -> DataFrame:
    """The first three nations by name; the tree of three taxa has a closed form."""
    d = _nation_distances(spark, sf)
    first = d.select(F.col("left_id").alias("t")).union(d.select("right_id")).distinct().orderBy("t").limit(3)
    three = d.join(F.broadcast(first.withColumnRenamed("t", "left_id")), "left_id", "left_semi").join(F.broadcast(first.withColumnRenamed("t", "right_id")), "right_id", "left_semi")
    return distance.neighbor_joining(three.withColumn("tree_id", F.lit("three"))).where("child_is_taxon").select("child", "branch_length")


@query()
def nj_tree(spark: SparkSession, sf: str) -> DataFrame:
    return distance.neighbor_joining(_nation_distances(spark, sf).withColumn("tree_id", F.lit("nations")))


@query()
def lineage_newick(spark: SparkSession, sf: str) -> DataFrame:
    return trees.newick(nj_tree(spark, sf))


@query()
def compact_lineage_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every nation and its double: the doubles share the nation's digest and hang on its star."""
    tree = nj_tree(spark, sf)
    taxa = load(spark, sf, "nation").select(F.col("n_name").alias("digest"))
    doubles = taxa.select(F.col("digest").alias("artifact_id"), "digest").unionByName(taxa.select(F.concat("digest", F.lit("_copy")).alias("artifact_id"), "digest"))
    return distance.compact_edges(tree, distance.collapse_identical(doubles))


@query("SELECT doc_id AS artifact_id, min(doc_id) OVER (PARTITION BY text) AS representative FROM documents WHERE text IS NOT NULL")
def collapse_identical(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("artifact_id"), F.sha2("text", 256).alias("digest"))
    return distance.collapse_identical(docs).select("artifact_id", "representative")


@query(f"WITH {B.PAIRS}, asked AS (SELECT a.n_name AS left_id, b.n_name AS right_id, 'NATION_' || (a.n_nationkey // 2) AS x, 'NATION_' || (b.n_nationkey // 2) AS y FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey) SELECT q.left_id, q.right_id, CASE WHEN x = y THEN 0.0 ELSE s.distance END::DOUBLE AS distance FROM asked q LEFT JOIN sh s ON s.left_id = least(x, y) AND s.right_id = greatest(x, y)")
def alias_distance(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation")
    aliases = n.select(F.col("n_name").alias("artifact_id"), F.concat(F.lit("NATION_"), F.floor(F.col("n_nationkey") / 2).cast("string")).alias("representative"))
    k = n.select(F.col("n_nationkey").alias("k"), "n_name")
    asked = k.alias("a").join(k.alias("b"), F.col("a.k") < F.col("b.k")).select(F.col("a.n_name").alias("left_id"), F.col("b.n_name").alias("right_id"))
    return distance.alias_distances(asked, aliases, _nation_distances(spark, sf))


# ---------------------------------------------------------------- trees

_WALK = f"{B.TREE}, w AS (SELECT tree_id, '__root' AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, 0.0::DOUBLE AS x FROM (SELECT 't' AS tree_id) UNION ALL SELECT e.tree_id, e.child, e.parent, w.depth + 1, w.x + e.branch_length FROM w JOIN te e ON e.parent = w.node)"


@query(f"WITH {B.TREE} SELECT DISTINCT tree_id, parent AS root FROM te WHERE parent NOT IN (SELECT child FROM te)")
def tree_root(spark: SparkSession, sf: str) -> DataFrame:
    return trees.roots(B.customer_tree(spark, sf))


_LAYOUT = f"""{_WALK}, tips AS (SELECT *, (row_number() OVER (ORDER BY n.parent, w.parent, w.node) - 1)::DOUBLE AS y FROM (SELECT node, parent, x FROM w WHERE depth = 3) w JOIN (SELECT child, parent FROM te) n ON w.parent = n.child),
ty AS (SELECT node, w_parent AS parent, x, y FROM (SELECT w.node AS node, w.parent AS w_parent, w.x AS x, (row_number() OVER (ORDER BY n.parent, w.parent, w.node) - 1)::DOUBLE AS y FROM w JOIN te n ON w.parent = n.child WHERE w.depth = 3)),
ny AS (SELECT w.node, w.parent, w.x, avg(ty.y) AS y FROM w JOIN ty ON ty.parent = w.node GROUP BY ALL), ry AS (SELECT w.node, w.parent, w.x, avg(ny.y) AS y FROM w JOIN ny ON ny.parent = w.node GROUP BY ALL), oy AS (SELECT w.node, w.x, avg(ry.y) AS y FROM w JOIN ry ON ry.parent = w.node GROUP BY ALL),
lay AS (SELECT 't' AS tree_id, node, x, y FROM ty UNION ALL SELECT 't', node, x, y FROM ny UNION ALL SELECT 't', node, x, y FROM ry UNION ALL SELECT 't', node, x, y FROM oy)"""
_LAYOUT = _LAYOUT.replace(_LAYOUT[_LAYOUT.index("tips AS (") : _LAYOUT.index("ty AS (")], "")


@query(f"WITH RECURSIVE {_LAYOUT} SELECT tree_id, node, x, round(y, 6) AS y FROM lay")
def tree_layout(spark: SparkSession, sf: str) -> DataFrame:
    return trees.layout(B.customer_tree(spark, sf), Scratch(spark, "layout")).withColumn("y", F.round("y", 6))


@query()
def tree_radial(spark: SparkSession, sf: str) -> DataFrame:
    return trees.radial(trees.layout(B.customer_tree(spark, sf), Scratch(spark, "radial")))


_STATES = f"""{_WALK}, {B.TIP_STATES}, up AS (SELECT w.node AS tip, w.parent AS node FROM w WHERE depth = 3 UNION ALL SELECT up.tip, e.parent FROM up JOIN te e ON e.child = up.node),
parents AS (SELECT DISTINCT parent FROM te), tips AS (SELECT node FROM w WHERE node NOT IN (SELECT parent FROM parents)),
closure AS (SELECT t.node AS tip, t.node AS node FROM tips t UNION ALL SELECT c.tip, e.parent FROM closure c JOIN te e ON e.child = c.node),
n AS (SELECT node, count(*) AS n FROM closure WHERE tip <> node GROUP BY node), k AS (SELECT c.node, ts.character, count(*) AS k, min(ts.cnt) AS cnt FROM closure c JOIN ts ON ts.node = c.tip WHERE c.tip <> c.node GROUP BY ALL),
st AS (SELECT 't' AS tree_id, k.node, k.character, k.cnt FROM k JOIN n ON k.node = n.node AND k.k = n.n UNION ALL SELECT tree_id, node, character, cnt FROM ts)"""
_STATES = _STATES.replace(_STATES[_STATES.index("up AS (") : _STATES.index("parents AS (")], "")


def _all_states(spark: SparkSession, sf: str):
    e = B.customer_tree(spark, sf)
    return e, trees.ancestral_states(trees.placed(e, Scratch(spark, "states")), B.customer_states(spark, sf))


@query(f"WITH RECURSIVE {_STATES} SELECT * FROM st")
def ancestral_states(spark: SparkSession, sf: str) -> DataFrame:
    return _all_states(spark, sf)[1]


@query(f"WITH RECURSIVE {_STATES} SELECT e.tree_id, e.parent, e.child, s.character, 'gained' AS change FROM te e JOIN st s ON s.node = e.child LEFT JOIN st p ON p.node = e.parent AND p.character = s.character WHERE p.node IS NULL UNION ALL SELECT e.tree_id, e.parent, e.child, s.character, 'lost' FROM te e JOIN st s ON s.node = e.parent LEFT JOIN st p ON p.node = e.child AND p.character = s.character WHERE p.node IS NULL")
def edge_traits(spark: SparkSession, sf: str) -> DataFrame:
    return trees.edge_traits(*_all_states(spark, sf))


@query(f"WITH RECURSIVE {_WALK}, i AS (SELECT tree_id, node, 'hypothetical ancestor ' || row_number() OVER (ORDER BY node) AS label FROM w WHERE starts_with(node, '__')) SELECT w.tree_id, w.node, coalesce(i.label, w.node) AS label FROM w LEFT JOIN i ON w.node = i.node")
def tip_labels(spark: SparkSession, sf: str) -> DataFrame:
    return trees.tip_labels(trees.placed(B.customer_tree(spark, sf), Scratch(spark, "labels")))


@query(f"""WITH {B.TREE}, n AS (SELECT parent, child FROM te), len AS (SELECT parent, child, CASE WHEN branch_length = floor(branch_length) THEN CAST(CAST(branch_length AS BIGINT) AS VARCHAR) ELSE CAST(branch_length AS VARCHAR) END AS l FROM te),
c AS (SELECT n.child AS node, '(' || string_agg(k.child || ':' || k.l, ',' ORDER BY k.child) || ')' AS s FROM n JOIN len k ON k.parent = n.child WHERE starts_with(n.child, '__nation') GROUP BY ALL),
r AS (SELECT n.child AS node, '(' || string_agg(coalesce(c.s, k.child) || ':' || k.l, ',' ORDER BY k.child) || ')' AS s FROM n JOIN len k ON k.parent = n.child LEFT JOIN c ON c.node = k.child WHERE starts_with(n.child, '__region') GROUP BY ALL)
SELECT 't' AS tree_id, '(' || string_agg(coalesce(r.s, k.child) || ':' || k.l, ',' ORDER BY k.child) || ');' AS newick FROM len k LEFT JOIN r ON r.node = k.child WHERE k.parent = '__root'""")
def newick(spark: SparkSession, sf: str) -> DataFrame:
    return trees.newick(B.customer_tree(spark, sf))


# ---------------------------------------------------------------- alignment

_SIDES = """lr AS (SELECT 'p' || (user_id // 2) AS pair_id, CASE WHEN user_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS at_no, event_type AS token FROM events)"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v, e = B.chains(spark, sf)
    user = F.substring("graph_id", 2, 20).cast("bigint")
    key = [F.concat(F.lit("p"), F.floor(user / 2).cast("string")).alias("pair_id"), F.when(user % 2 == 0, "left").otherwise("right").alias("side")]
    return v.select(*key, "at", "node_id", F.col("operation").alias("token")), e.select(*key, "source", "target", "position", F.col("position").alias("port"))


def _aligned(spark: SparkSession, sf: str):
    scratch = Scratch(spark, "alignment")
    sides, edges = (scratch.cut(x, "side", weigh=True) for x in _sides(spark, sf))
    nodes = scratch.cut(alignment.node_matches(sides), "nodes", weigh=True)
    matched = alignment.edge_matches(edges, nodes)
    return sides, edges, nodes, matched, alignment.operations(sides, edges, nodes, matched)


_LCS = f"""WITH RECURSIVE {_SIDES}, s AS (SELECT pair_id, list(token ORDER BY at_no) FILTER (side = 'left') AS a, list(token ORDER BY at_no) FILTER (side = 'right') AS b FROM lr GROUP BY pair_id),
p AS (SELECT pair_id, coalesce(a, []) AS a, coalesce(b, []) AS b, len(coalesce(a, [])) AS n, len(coalesce(b, [])) AS m FROM s),
t AS (SELECT pair_id, a, b, n, m, n AS i, list_transform(range(m + 1), lambda x: 0) AS cur, [list_transform(range(m + 1), lambda x: 0)] AS held FROM p
  UNION ALL SELECT pair_id, a, b, n, m, i - 1, nxt, list_prepend(nxt, held) FROM (SELECT *, list_reverse(list_transform(range(1, m + 2), lambda k: list_max(list_transform(range(m + 2 - k, m + 2), lambda j: greatest(cur[j], CASE WHEN j <= m AND a[i] = b[j] THEN cur[j + 1] + 1 ELSE 0 END))))) AS nxt FROM t WHERE i > 0)),
f AS (SELECT pair_id, a, b, n, m, held FROM t WHERE i = 0),
w AS (SELECT pair_id, a, b, n, m, held, 1 AS i, 1 AS j, FALSE AS hit FROM f
  UNION ALL SELECT pair_id, a, b, n, m, held, CASE WHEN a[i] = b[j] OR held[i + 1][j] = held[i][j] THEN i + 1 ELSE i END, CASE WHEN a[i] = b[j] OR held[i + 1][j] <> held[i][j] THEN j + 1 ELSE j END, a[i] = b[j] FROM w WHERE i <= n AND j <= m),
mt AS (SELECT pair_id, printf('n%06d', i - 2) AS l, printf('n%06d', j - 2) AS r, i - 2 AS li, j - 2 AS ri FROM w WHERE hit),
el AS (SELECT pair_id, side, at_no FROM lr WHERE at_no > 0), kept AS (SELECT x.pair_id, x.li, x.ri FROM mt x JOIN mt y ON x.pair_id = y.pair_id AND x.li = y.li + 1 AND x.ri = y.ri + 1)"""
_OPS = """SELECT pair_id, CASE side WHEN 'left' THEN 'remove_node' ELSE 'add_node' END AS kind, printf('n%06d', at_no) AS ref FROM lr WHERE (side = 'left' AND (pair_id, at_no) NOT IN (SELECT (pair_id, li) FROM mt)) OR (side = 'right' AND (pair_id, at_no) NOT IN (SELECT (pair_id, ri) FROM mt))
UNION ALL SELECT pair_id, CASE side WHEN 'left' THEN 'remove_edge' ELSE 'add_edge' END, printf('n%06d->n%06d@arg:000000', at_no - 1, at_no) FROM el WHERE (side = 'left' AND (pair_id, at_no) NOT IN (SELECT (pair_id, li) FROM kept)) OR (side = 'right' AND (pair_id, at_no) NOT IN (SELECT (pair_id, ri) FROM kept))"""


@query(f"{_LCS} SELECT pair_id, l AS left_id, r AS right_id FROM mt")
def lcs_node_matches(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.node_matches(_sides(spark, sf)[0]).select("pair_id", "left_id", "right_id")


@query(f"{_LCS} {_OPS}")
def lcs_alignment_ops(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf)[4].select("pair_id", "kind", "ref")


@query(f"WITH {_SIDES}, n AS (SELECT pair_id, token, count(*) FILTER (side = 'left') AS l, count(*) FILTER (side = 'right') AS r FROM lr GROUP BY ALL) SELECT pair_id, CAST(sum(abs(l - r)) AS BIGINT) AS bound FROM n GROUP BY pair_id")
def alignment_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.node_lower_bound(_sides(spark, sf)[0])


@query(f"WITH {_SIDES}, e AS (SELECT x.pair_id, x.side, y.token AS s, x.token AS t FROM lr x JOIN lr y ON x.pair_id = y.pair_id AND x.side = y.side AND x.at_no = y.at_no + 1), n AS (SELECT pair_id, s, t, count(*) FILTER (side = 'left') AS l, count(*) FILTER (side = 'right') AS r FROM e GROUP BY ALL) SELECT pair_id, CAST(sum(abs(l - r)) AS BIGINT) AS bound FROM n GROUP BY pair_id")
def alignment_edge_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.edge_lower_bound(*_sides(spark, sf))


@query(f"WITH {_SIDES} SELECT pair_id, printf('n%06d', at_no) AS node_id, token FROM lr WHERE side = 'right'")
def alignment_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The right graphs' nodes, rebuilt from the left ones and the operations."""
    sides, edges, nodes, _, ops = _aligned(spark, sf)
    return alignment.replay(sides.where("side = 'left'").select("pair_id", "node_id", "token"), edges.where("side = 'left'").drop("side"), ops, nodes)[0]


@query(f"WITH {_SIDES} SELECT pair_id, printf('n%06d', at_no - 1) AS source, printf('n%06d', at_no) AS target, 'arg:000000' AS port, 1 AS n FROM lr WHERE side = 'right' AND at_no > 0")
def alignment_replay_edges(spark: SparkSession, sf: str) -> DataFrame:
    sides, edges, nodes, _, ops = _aligned(spark, sf)
    return alignment.replay(sides.where("side = 'left'").select("pair_id", "node_id", "token"), edges.where("side = 'left'").drop("side"), ops, nodes)[1]


@query(f"WITH {_SIDES} SELECT DISTINCT pair_id, true AS replayed FROM lr")
def alignment_validation(spark: SparkSession, sf: str) -> DataFrame:
    sides, edges, nodes, _, ops = _aligned(spark, sf)
    return alignment.validation(sides, edges, nodes, ops).select("pair_id", "replayed")


@query(f"""WITH {_SIDES}, c AS (SELECT pair_id, side, at_no, token, lag(token) OVER w AS p, lead(token) OVER w AS f FROM lr WINDOW w AS (PARTITION BY pair_id, side ORDER BY at_no)),
g AS (SELECT pair_id, token, p, f, count(*) FILTER (side = 'left') AS n_left, count(*) FILTER (side = 'right') AS n_right FROM c GROUP BY ALL) SELECT pair_id, n_left, n_right, count(*) AS contexts FROM g WHERE n_left > 0 AND n_right > 0 AND n_left + n_right > 2 GROUP BY ALL""")
def alignment_ambiguities(spark: SparkSession, sf: str) -> DataFrame:
    sides, edges, nodes, _, _ = _aligned(spark, sf)
    a = alignment.ambiguities(sides, edges, nodes)
    return a.groupBy("pair_id", F.size("left_ids").cast("bigint").alias("n_left"), F.size("right_ids").cast("bigint").alias("n_right")).agg(F.count(F.lit(1)).alias("contexts"))


def queries():
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
