"""Sources: entry bundles, profiles, documents, tables with their own checks, record feeds.

All of them are lazy readers of shared storage; what a file says about itself is checked as a query, not on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RELATION = "struct<predicate:string,source:string,source_record_id:string,confidence:double,locator:string,subject_model_local_id:string,stated_at:timestamp,target:struct<entry_id:string,local_id:string,name:string,status:string,aliases:array<string>,identifiers:array<struct<namespace:string,value:string>>,confidence:double,locator:string>>"
ENTRY = f"id string, canonical_name string, aliases array<string>, citations array<string>, identifiers array<struct<namespace:string,value:string>>, members array<struct<member_kind:string,name:string>>, model_relations array<{RELATION}>, releases array<struct<release_name:string,released_at:string>>, resources array<struct<kind:string,locator:string>>, tags array<string>"


class FormatError(ValueError):
    """A file or table isn't what it should be."""


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSONL, a JSON array, {"entries": [...]} or a single object; a malformed file gives a row with a null id."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    each = F.forall(F.filter(F.split("t", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: x.rlike(r"^\s*\{.*\}\s*$"))  # an object a line
    kind = F.when(F.col("t").startswith("["), "array").when(F.col("t").rlike(r'^\{\s*"entries"\s*:'), "wrapped").when(each, "lines").otherwise("single")
    k = text.withColumn("kind", kind)
    one = T._parse_datatype_string(ENTRY)
    many = k.where("kind = 'array'").select(F.explode(F.from_json("t", T.ArrayType(one))).alias("e"))
    wrapped = k.where("kind = 'wrapped'").select(F.explode(F.from_json("t", T.StructType([T.StructField("entries", T.ArrayType(one))]))["entries"]).alias("e"))
    lines = k.where("kind in ('lines', 'single')").select(F.explode(F.when(F.col("kind") == "single", F.array("t")).otherwise(F.split("t", r"\r?\n"))).alias("l")).where("trim(l) <> ''").select(F.from_json("l", one).alias("e"))
    return many.unionByName(wrapped).unionByName(lines).select("e.*")


def bundle_problems(spark: SparkSession, folder: str) -> DataFrame:
    """(file, problem): files of a bundle whose SHA-256 isn't the manifest's."""
    manifest = spark.read.text(f"{folder}/manifest.json", wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.files"), "map<string,string>")).alias("file", "sha"))
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("got"))
    j = manifest.join(held, "file", "left")
    return j.select("file", F.when(F.col("got").isNull(), "missing").when(F.col("got") != F.regexp_replace("sha", "^sha256:", ""), "digest differs").alias("problem")).where("problem is not null")


def entry_problems(df: DataFrame) -> DataFrame:
    """(id, problem): null_id, duplicate_id, null_name."""
    twice = df.where("id is not null").groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_id").alias("problem"))
    blank = df.where("id is null or trim(id) = ''").select("id", F.lit("null_id").alias("problem"))
    name = df.where("canonical_name is null or trim(canonical_name) = ''").select("id", F.lit("null_name").alias("problem"))
    return twice.unionByName(blank).unionByName(name)


def entry_lines(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON lines, a line a row, so files of any size are split; a malformed line gives a row with a null id."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", T._parse_datatype_string(ENTRY)).alias("e")).select("e.*")


def entry_type_problems(spark: SparkSession, path: str) -> DataFrame:
    """(line, problem) of JSON lines: not_an_object, or not_a_list:<field> for a field that must be a list."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("line"), F.try_parse_json("value").alias("v"))
    lists = ["aliases", "citations", "identifiers", "members", "model_relations", "releases", "resources", "tags"]
    bad = F.array_compact(F.array(*[F.when(F.coalesce(~F.schema_of_variant(F.try_variant_get("v", f"$.{c}", "variant")).startswith("ARRAY"), F.lit(False)), F.lit(f"not_a_list:{c}")) for c in lists]))
    object_ = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return lines.select("line", F.explode(F.when(~object_, F.array(F.lit("not_an_object"))).otherwise(bad)).alias("problem"))


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, problem) of JSON files, one object each; the problem names what is wrong."""
    t = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    kind = F.schema_of_variant(F.try_parse_json("text"))
    return t.withColumn("problem", F.when(kind.isNull(), "not_json").when(~kind.startswith("OBJECT"), "not_an_object"))


def profile_problems(profiles: DataFrame) -> DataFrame:
    """profiles(path, text) -> (path, problem): not_json, no_artifact_id, no_digest, digest_differs (the canonical JSON without its own
    digest is hashed again), duplicate_artifact_id."""
    from graftline.functions import canonical

    p = profiles.select("path", F.get_json_object("text", "$.artifact_id").alias("artifact_id"), F.get_json_object("text", "$.profile_digest").alias("digest"), canonical.digest_without(F.col("text"), "profile_digest").alias("again"))
    twice = p.where("artifact_id is not null").groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n"))
    j = p.join(twice, "artifact_id", "left")
    problem = F.when(F.col("again").isNull(), "not_json").when(F.col("artifact_id").isNull(), "no_artifact_id").when(F.col("digest").isNull(), "no_digest").when(F.regexp_replace("digest", "^sha256:", "") != F.col("again"), "digest_differs").when(F.col("n") > 1, "duplicate_artifact_id")
    return j.select("path", problem.alias("problem")).where("problem is not null")


def lineage_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """tree_edges, taxa, character_states and distances of lineages; the taxa must be the tips of the edges, and states and distances
    must belong to them."""
    from graftline.operators import catalog

    held = {n: spark.read.parquet(f"{folder}/{n}") for n in ("tree_edges", "taxa", "character_states", "distances")}
    tips = held["tree_edges"].where("child_is_taxon").select("tree_id", F.col("child").alias("model_id"))
    if not catalog.set_differences(tips.distinct(), held["taxa"].select("tree_id", "model_id").distinct()).isEmpty():
        raise FormatError(f"{folder}: the taxa aren't the tips of the tree")
    for name, column in (("character_states", "taxon"), ("distances", "left_id"), ("distances", "right_id")):
        if not held[name].select("tree_id", F.col(column).alias("model_id")).join(held["taxa"], ["tree_id", "model_id"], "left_anti").isEmpty():
            raise FormatError(f"{folder}: {name} has unknown taxa")
    return held


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """(path, artifact_id, text) of all JSON profiles under a folder, failures left out."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return t.where(~F.col("path").endswith(".failure.json") & ~F.col("path").endswith("manifest.json")).select("path", F.get_json_object("value", "$.artifact_id").alias("artifact_id"), F.col("value").alias("text"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of text and Markdown files; other kinds need a reader that isn't here and are refused."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md,markdown}").text(folder, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return b.select(F.col("path"), F.col("content").cast("string").alias("content"), "length")


def feed_page(records: DataFrame, offset: int, size: int) -> DataFrame:
    """A page of a feed in the order of its version ids."""
    return records.orderBy("version_id").offset(offset).limit(size)


def curated_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def graph_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graphs, vertices, edges of a folder; rows that belong to no graph make it invalid."""
    g, v, e = (spark.read.parquet(f"{folder}/{n}") for n in ("graphs", "graph_vertices", "graph_edges"))
    for t in (v, e):
        if not t.join(g, "graph_id", "left_anti").isEmpty():
            raise FormatError(f"{folder} has rows of unknown graphs")
    counts = v.groupBy("graph_id").count().withColumnRenamed("count", "n")
    if not g.join(counts, "graph_id", "left").where("vertex_count <> coalesce(n, 0)").isEmpty():
        raise FormatError(f"{folder}: vertex counts differ")
    return g, v, e
