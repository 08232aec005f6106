"""The star-schema tables seen as graphs, taxa, trees, catalogs and evidence, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graftline.tables import load


def chains(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A user's events in time order as a chain: operation = event type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = load(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("graph_id"), (F.row_number().over(w) - 1).alias("at"), F.col("event_type").alias("operation"))
    v = v.select("graph_id", "at", F.format_string("n%06d", "at").alias("node_id"), "operation", F.lit("{}").alias("attributes"))
    e = v.where("at > 0").select("graph_id", F.format_string("n%06d", F.col("at") - 1).alias("source"), F.col("node_id").alias("target"), F.lit("arg:000000").alias("position"))
    return v, e


CHAINS = """v AS (SELECT 'u' || user_id AS graph_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS at_no, event_type AS operation FROM events),
vertices AS (SELECT graph_id, at_no, printf('n%06d', at_no) AS node_id, operation, '{}' AS attributes FROM v),
edges AS (SELECT graph_id, printf('n%06d', at_no - 1) AS source, node_id AS target, 'arg:000000' AS position FROM vertices WHERE at_no > 0)"""


def orders_dag(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An order as input -> one node for each line number -> merge -> output."""
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("op")).select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("graph_id"), F.format_string("n%06d", "l_linenumber").alias("node_id"), F.col("op").alias("operation"), "l_linenumber")
    g = lines.select("graph_id").distinct()
    fixed = lambda n, op: g.select("graph_id", F.lit(n).alias("node_id"), F.lit(op).alias("operation"))
    v = fixed("n000000", "graph.input").unionByName(lines.select("graph_id", "node_id", "operation")).unionByName(fixed("n000008", "function.merge")).unionByName(fixed("n000009", "graph.output")).withColumn("attributes", F.lit("{}"))
    e = (
        lines.select("graph_id", F.lit("n000000").alias("source"), F.col("node_id").alias("target"), F.lit("arg:000000").alias("position"))
        .unionByName(lines.select("graph_id", F.col("node_id").alias("source"), F.lit("n000008").alias("target"), F.format_string("arg:%06d", F.col("l_linenumber") - 1).alias("position")))
        .unionByName(g.select("graph_id", F.lit("n000008").alias("source"), F.lit("n000009").alias("target"), F.lit("arg:000000").alias("position")))
    )
    return v, e


ORDERS = """lines AS (SELECT 'o' || l_orderkey AS graph_id, printf('n%06d', l_linenumber) AS node_id, min(l_returnflag || l_linestatus) AS operation, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber),
g AS (SELECT DISTINCT graph_id FROM lines),
vertices AS (SELECT graph_id, 'n000000' AS node_id, 'graph.input' AS operation, '{}' AS attributes FROM g UNION ALL SELECT graph_id, node_id, operation, '{}' FROM lines UNION ALL SELECT graph_id, 'n000008', 'function.merge', '{}' FROM g UNION ALL SELECT graph_id, 'n000009', 'graph.output', '{}' FROM g),
edges AS (SELECT graph_id, 'n000000' AS source, node_id AS target, 'arg:000000' AS position FROM lines UNION ALL SELECT graph_id, node_id, 'n000008', printf('arg:%06d', l_linenumber - 1) FROM lines UNION ALL SELECT graph_id, 'n000008', 'n000009', 'arg:000000' FROM g)"""


def nation_states(spark: SparkSession, sf: str, character: str = "p_brand") -> DataFrame:
    """taxon = the supplier's nation, character = brand, cnt = line items; the joins of dimension tables are on their keys."""
    li = load(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("c"))
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    n = load(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("taxon"))
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col(character).alias("character"))
    return li.join(s, "l_suppkey").join(n, "n_nationkey").join(p, "l_partkey").groupBy("taxon", "character").agg(F.sum("c").alias("cnt"))


STATES = "states AS (SELECT n_name AS taxon, p_brand AS character, count(*) AS cnt FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
TAXA = f"{STATES}, t AS (SELECT taxon, CAST(sum(cnt) AS BIGINT) AS total FROM states GROUP BY taxon)"
PAIRS = f"""{TAXA}, sh AS (SELECT a.taxon AS left_id, b.taxon AS right_id, CAST(sum(abs(coalesce(a.cnt, 0) - coalesce(b.cnt, 0))) AS BIGINT) AS distance, CAST(sum(least(a.cnt, b.cnt)) AS BIGINT) AS shared
  FROM (SELECT t.taxon, c.character, coalesce(s.cnt, 0) AS cnt FROM t CROSS JOIN (SELECT DISTINCT character FROM states) c LEFT JOIN states s ON s.taxon = t.taxon AND s.character = c.character) a
  JOIN (SELECT t.taxon, c.character, coalesce(s.cnt, 0) AS cnt FROM t CROSS JOIN (SELECT DISTINCT character FROM states) c LEFT JOIN states s ON s.taxon = t.taxon AND s.character = c.character) b ON a.character = b.character AND a.taxon < b.taxon GROUP BY ALL)"""


def customer_tree(spark: SparkSession, sf: str) -> DataFrame:
    """root -> region -> nation -> customer; lengths are quarters made of the keys."""
    r, n, c = load(spark, sf, "region"), load(spark, sf, "nation"), load(spark, sf, "customer")
    edge = lambda df, p, k, x: df.select(F.lit("t").alias("tree_id"), p.alias("parent"), k.alias("child"), (x / 4).cast("double").alias("branch_length"))
    name = lambda p, col: F.concat(F.lit(p), F.lpad(F.col(col).cast("string"), 9, "0"))
    return (
        edge(r, F.lit("__root"), name("__region", "r_regionkey"), F.col("r_regionkey") + 1)
        .unionByName(edge(n, name("__region", "n_regionkey"), name("__nation", "n_nationkey"), F.col("n_nationkey") % 7 + 1))
        .unionByName(edge(c, name("__nation", "c_nationkey"), name("customer", "c_custkey"), F.col("c_custkey") % 11))
    )


TREE = """te AS (SELECT 't' AS tree_id, '__root' AS parent, '__region' || lpad(CAST(r_regionkey AS VARCHAR), 9, '0') AS child, (r_regionkey + 1) / 4.0::DOUBLE AS branch_length FROM region
  UNION ALL SELECT 't', '__region' || lpad(CAST(n_regionkey AS VARCHAR), 9, '0'), '__nation' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0'), (n_nationkey % 7 + 1) / 4.0::DOUBLE FROM nation
  UNION ALL SELECT 't', '__nation' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0'), 'customer' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), (c_custkey % 11) / 4.0::DOUBLE FROM customer)"""


def customer_states(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of the tree's tips: order priorities and their number."""
    o = load(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("character")).agg(F.count(F.lit(1)).alias("cnt"))
    return o.join(load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select(F.lit("t").alias("tree_id"), F.concat(F.lit("customer"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("node"), "character", "cnt")


TIP_STATES = "ts AS (SELECT 't' AS tree_id, 'customer' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS node, o_orderpriority AS character, count(*) AS cnt FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """An order as a catalog entry: score = price (none for every 17th), paper = customer, paperless when pending."""
    o = load(spark, sf, "orders")
    return o.select(
        F.format_string("v%09d", "o_orderkey").alias("version_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("score"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("paper"), "o_orderstatus", "o_orderkey"
    )


CATALOG = "cat AS (SELECT printf('v%09d', o_orderkey) AS version_id, o_orderpriority AS name, o_orderdate AS created_at, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS score, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS paper, o_orderstatus, o_orderkey FROM orders)"


def contact(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers dated by their orders; evidence from each to another given by a rule on the keys."""
    a = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("artifact_id")).agg(F.to_date(F.min("o_orderdate")).alias("date_min"), F.to_date(F.max("o_orderdate")).alias("date_max"))
    a = a.withColumn("date_max", F.least("date_max", F.date_add("date_min", 30)))
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    role = F.when(F.col("c_custkey") % 3 == 0, "provenance").when(F.col("c_custkey") % 3 == 1, "character_transfer").otherwise("awareness")
    e = c.select(F.col("c_custkey").alias("source_id"), ((F.col("c_custkey") * 7 + 3) % 1000).alias("target_id"), role.alias("causal_role"), ((F.col("c_custkey") % 10) / 10).alias("strength"), F.col("c_mktsegment").alias("character"))
    return a, e


CONTACT = """art AS (SELECT o_custkey AS artifact_id, CAST(min(o_orderdate) AS DATE) AS date_min, least(CAST(max(o_orderdate) AS DATE), CAST(min(o_orderdate) AS DATE) + 30) AS date_max FROM orders GROUP BY o_custkey),
ev AS (SELECT c_custkey AS source_id, (c_custkey * 7 + 3) % 1000 AS target_id, CASE c_custkey % 3 WHEN 0 THEN 'provenance' WHEN 1 THEN 'character_transfer' ELSE 'awareness' END AS causal_role, (c_custkey % 10) / 10.0::DOUBLE AS strength, c_mktsegment AS character FROM customer),
adm AS (SELECT ev.*, s.date_max AS source_max, t.date_min AS target_min, CASE WHEN s.date_max IS NULL OR t.date_min IS NULL THEN 'missing_date' WHEN s.date_max < t.date_min THEN 'earlier' ELSE 'not_strictly_earlier' END AS relation, greatest(0, date_diff('day', s.date_max, t.date_min)) AS gap_days
  FROM ev LEFT JOIN art s ON source_id = s.artifact_id LEFT JOIN art t ON target_id = t.artifact_id)"""
