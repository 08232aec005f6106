"""Feed records of any provider brought to the row of a catalog, and a data source that reads a provider page by page.

raw(raw string) holds one JSON object a row. Records that break a rule keep their row, with the rule in ``problem``.

Nulls: a null or unreadable record has the problem ``not_an_object``. Repeated rows stay. Empty tables give empty results.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from graftline.functions import text as T

# Kinds of entities that a feed may name.
ENTITY_KINDS = ["model", "model_artifact", "model_offering", "paper_candidate", "repository", "vendor_model"]
COLUMNS = ["catalog_id", "version_id", "native_id", "provider", "name", "entity_kind", "access_kind", "revision", "created_at", "modified_at", "observed_at", "metrics", "papers", "locators", "problem"]


def _field(path: str) -> Column:
    return F.nullif(F.trim(F.get_json_object("raw", "$." + path)), F.lit(""))


def _list(path: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object("raw", "$." + path), "array<string>"), F.array().cast("array<string>"))


def _numbers(fields: dict[str, str]) -> Column:
    """A map of metrics from JSON fields; what is missing counts 0."""
    return F.map_from_arrays(F.lit(list(fields)), F.array(*[F.coalesce(_field(p).try_cast("double"), F.lit(0.0)) for p in fields.values()]))


def _row(raw: DataFrame, provider: str, observed_at: str, native: Column, **given: Column) -> DataFrame:
    named = F.concat(F.lit(provider), F.lit(":"), native)
    catalog_id = F.coalesce(given["catalog_id"], named) if "catalog_id" in given else named
    revision = given.get("revision", F.lit(None).cast("string"))
    version = F.coalesce(given.get("version_id", F.lit(None).cast("string")), F.concat(catalog_id, F.lit("@"), revision), catalog_id)
    dates = {c: given.get(c, F.lit(None).cast("string")) for c in ("created_at", "modified_at")}
    bad_date = F.lit(False)
    for c in dates.values():
        bad_date = bad_date | (c.isNotNull() & T.instant(c).isNull())
    metrics = given.get("metrics", F.create_map().cast("map<string,double>"))
    infinite = F.exists(F.map_values(metrics), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = given.get("entity_kind", F.lit("model"))
    problem = F.when(F.try_parse_json("raw").isNull(), "not_an_object").when(native.isNull(), "no_native_id").when(~kind.isin(ENTITY_KINDS), "unknown_entity_kind").when(infinite, "metric_not_finite").when(bad_date, "bad_date").otherwise(given.get("problem", F.lit(None).cast("string")))
    return raw.select(
        catalog_id.alias("catalog_id"), version.alias("version_id"), native.alias("native_id"), F.lit(provider).alias("provider"), F.coalesce(given.get("name", native), native).alias("name"), kind.alias("entity_kind"), given.get("access_kind", F.lit("metadata_only")).alias("access_kind"), revision.alias("revision"),
        T.instant(dates["created_at"]).alias("created_at"), T.instant(dates["modified_at"]).alias("modified_at"), F.lit(observed_at).cast("timestamp").alias("observed_at"), metrics.alias("metrics"),
        F.array_sort(F.array_distinct(given.get("papers", F.array().cast("array<string>")))).alias("papers"), given.get("locators", F.array().cast("array<string>")).alias("locators"), problem.alias("problem"),
    )


def plain_feed(raw: DataFrame, provider: str, observed_at: str) -> DataFrame:
    """Records that already use the catalog's names: native_id (or id), revision, version_id, entity_kind, metrics, paper_candidates."""
    metrics = F.from_json(F.coalesce(F.get_json_object("raw", "$.metrics"), F.lit("{}")), "map<string,double>")
    spelled = F.from_json(F.get_json_object("raw", "$.metrics"), "map<string,string>")
    not_number = F.exists(F.map_values(spelled), lambda x: x.isNull() | x.isin("true", "false") | x.try_cast("double").isNull())
    strings = F.filter(F.transform(_list("paper_candidates"), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.identifier")).otherwise(x)), lambda x: x.isNotNull())
    unnamed = F.size(strings) < F.size(_list("paper_candidates"))
    return _row(
        raw, provider, observed_at, F.coalesce(_field("native_id"), _field("id")), catalog_id=_field("catalog_id"), revision=_field("revision"), version_id=_field("version_id"), entity_kind=F.coalesce(_field("entity_kind"), F.lit("vendor_model")), access_kind=F.coalesce(_field("access_kind"), F.lit("metadata_only")),
        name=_field("name"), created_at=_field("created_at"), modified_at=_field("modified_at"), metrics=metrics, papers=strings, locators=_list("source_locators"), problem=F.when(not_number, "metric_not_finite").when(unnamed, "paper_without_identifier"),
    )


def hub_feed(raw: DataFrame, observed_at: str, provider: str = "hub") -> DataFrame:
    """Listings of a model hub: id, sha, createdAt, lastModified, likes, downloads, private, gated, tags with arxiv: ids."""
    gated = F.coalesce(_field("gated"), F.lit("false"))
    access = F.when(_field("private") == "true", "private").when(gated != "false", "gated").otherwise("public_artifact")
    papers = F.transform(T.prefixed_tags(_list("tags"), "arxiv:"), lambda x: F.concat(F.lit("arxiv:"), T.normalize_arxiv(x)))
    return _row(raw, provider, observed_at, F.coalesce(_field("id"), _field("modelId")), revision=_field("sha"), access_kind=access, created_at=_field("createdAt"), modified_at=_field("lastModified"), metrics=_numbers({"downloads": "downloads", "downloads_all_time": "downloadsAllTime", "likes": "likes"}), papers=papers)


def code_feed(raw: DataFrame, observed_at: str, provider: str = "code") -> DataFrame:
    """Search results of a code host: full_name, pushed_at, stargazers_count, forks_count; they name no revision."""
    counts = {"forks": "forks_count", "stars": "stargazers_count", "open_issues": "open_issues_count", "watchers": "watchers_count"}
    return _row(raw, provider, observed_at, _field("full_name"), entity_kind=F.lit("model_artifact"), access_kind=F.when(_field("private") == "true", "private").otherwise("public_source"), created_at=_field("created_at"), modified_at=F.coalesce(_field("pushed_at"), _field("updated_at")), metrics=_numbers(counts), locators=F.array_compact(F.array(_field("html_url"))))


def paper_feed(raw: DataFrame, observed_at: str, provider: str = "papers") -> DataFrame:
    """Works of a paper index: id (a link whose last part is the name), display_name, publication_date, cited_by_count, ids.doi."""
    native = F.nullif(F.element_at(F.split(F.rtrim(_field("id"), F.lit("/")), "/"), -1), F.lit(""))
    doi = F.concat(F.lit("doi:"), T.normalize_doi(F.coalesce(_field("ids.doi"), _field("doi"))))
    return _row(raw, provider, observed_at, native, entity_kind=F.lit("paper_candidate"), name=_field("display_name"), created_at=_field("publication_date"), metrics=_numbers({"citations": "cited_by_count"}), papers=F.array_compact(F.array(doi)))


class FeedFile:
    """A provider over a file of JSON lines: pages of ``size`` records, the cursor is the offset of the next."""

    def __init__(self, path: str, size: int = 100):
        self.path, self.size = path, int(size)

    def fetch_page(self, cursor: str | None) -> tuple[list[str], str | None]:
        """Records as JSON text, and the cursor of the next page or none."""
        start = int(cursor or 0)
        with open(self.path, encoding="utf-8") as f:
            lines = [x.strip() for x in f if x.strip()]
        end = start + self.size
        return lines[start:end], str(end) if end < len(lines) else None


def _provider(options) -> object:
    """The provider that the option ``provider`` names as module:class, made from the JSON option ``arguments``."""
    module, _, name = options.get("provider", f"{__name__}:FeedFile").partition(":")
    return getattr(importlib.import_module(module), name)(**json.loads(options.get("arguments", "{}")))


class _Pages(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]  # a cursor is known only from the page before

    def read(self, partition) -> Iterator[tuple]:
        provider, cursor, page, seen = _provider(self.options), None, 0, set()
        while True:
            records, following = provider.fetch_page(cursor)
            yield from ((page, i, r, following) for i, r in enumerate(records))
            if following is None:
                return
            if following in seen:
                raise ValueError("the provider repeats a cursor")
            seen.add(following)
            cursor, page = following, page + 1


class _PageStream(SimpleDataSourceStreamReader):
    """A micro-batch is a page; the offset is its cursor, so a restarted stream goes on where it was."""

    def __init__(self, options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"cursor": "", "page": 0, "done": 0}

    def read(self, start: dict):
        if start["done"]:
            return iter([]), start
        records, following = _provider(self.options).fetch_page(start["cursor"] or None)
        rows = [(start["page"], i, r, following) for i, r in enumerate(records)]
        return iter(rows), {"cursor": following or "", "page": start["page"] + 1, "done": int(following is None)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = dict(start)
        while at != end and not at["done"]:
            rows, at = self.read(at)
            yield from rows

    def commit(self, end: dict) -> None:
        pass


class PagedCatalog(DataSource):
    """spark.read.format("paged_catalog").option("provider", "module:class").option("arguments", "{...}"): (page_no, pos, raw, next_cursor).

    A provider has ``fetch_page(cursor) -> (records, next cursor or None)``. Register it with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "paged_catalog"

    def schema(self) -> str:
        return "page_no int, pos int, raw string, next_cursor string"

    def reader(self, schema):
        return _Pages(self.options)

    def simpleStreamReader(self, schema):
        return _PageStream(self.options)
