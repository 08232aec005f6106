"""Syntax graphs of source files: Python through its own parser, JSON and TOML through their values; bounded scans and tree digests.

files(path, content). Nulls: a null content is an empty file. Files that can't be parsed give a diagnostic, never an error.
"""

from __future__ import annotations

import ast
import json
import os
import tomllib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Folders that hold no sources of their own, and the suffixes of sources.
EXCLUDED_FOLDERS = [
    ".git", ".hg", ".svn", ".old", "__pycache__", ".cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "venv", "node_modules", "vendor", "vendors", "third_party", "third-party", "external",
]
SUFFIXES = [".py", ".json", ".toml", ".yaml", ".yml"]
NODES = "path string, node_id string, kind string, operation string, attributes string"
EDGES = "path string, source string, target string, kind string, position string, field string"


def normal_path(path):
    """Forward slashes, no leading ./ (a column)."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")


def scan_status(files: DataFrame, max_bytes: int = 2 << 20) -> DataFrame:
    """files + status: excluded_folder, unknown_suffix, too_large, outside (an absolute path or one with ..), or kept."""
    parts = F.split(normal_path(F.col("path")), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    kind = F.regexp_extract(F.lower("path"), r"(\.[a-z0-9]+)$", 1)
    outside = F.col("path").startswith("/") | F.array_contains(parts, "..")
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    return files.withColumn("status", F.when(outside, "outside").when(F.arrays_overlap(folders, F.lit(EXCLUDED_FOLDERS)), "excluded_folder").when(~kind.isin(SUFFIXES), "unknown_suffix").when(size > max_bytes, "too_large").otherwise("kept"))


def wanted(files: DataFrame, max_bytes: int = 2 << 20) -> DataFrame:
    """Files of a known suffix outside excluded folders and within the size."""
    return scan_status(files, max_bytes).where("status = 'kept'").drop("status")


def manifest(files: DataFrame, max_bytes: int = 2 << 20) -> DataFrame:
    """(path, bytes, sha256, status) of every file of a scan, kept or not."""
    return scan_status(files, max_bytes).select(normal_path(F.col("path")).alias("path"), F.coalesce(F.octet_length("content"), F.lit(0)).alias("bytes"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha256"), "status")


def exclusions(files: DataFrame, max_bytes: int = 2 << 20) -> DataFrame:
    """(status, files): how many files a scan keeps, and why others aren't."""
    return scan_status(files, max_bytes).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def _called(node: ast.AST) -> str:
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        names.append(node.id)
    return ".".join(reversed(names))


_KINDS = ((ast.stmt, "control"), (ast.expr, "operator"), (ast.operator, "operator_token"), (ast.unaryop, "operator_token"), (ast.boolop, "operator_token"), (ast.cmpop, "operator_token"))


def _described(node: ast.AST) -> tuple[str, str, dict]:
    """Kind, operation and the counts and types that say nothing about names."""
    kind = next((k for cls, k in _KINDS if isinstance(node, cls)), "syntax")
    plain = f"python.ast:{type(node).__name__.lower()}"
    match node:
        case ast.Call():
            target = _called(node.func)
            return kind, f"python.call:{target}" if target else "python.call", {"keyword_count": len(node.keywords), "positional_count": len(node.args)}
        case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.Lambda():
            return kind, plain, {"parameter_count": len(node.args.args)}
        case ast.Constant():
            return kind, plain, {"literal_type": "null" if node.value is None else type(node.value).__name__}
        case ast.Dict():
            return kind, plain, {"element_count": len(node.keys)}
        case ast.List() | ast.Tuple() | ast.Set():
            return kind, plain, {"element_count": len(node.elts)}
    return kind, plain, {}


def _python(text: str) -> tuple[list[tuple], list[tuple]]:
    """Nodes numbered breadth first and edges from child to parent; what the parser shares between parents is one node."""
    root = ast.parse(text)
    number, queue = {id(root): 0}, deque([root])
    nodes, links = [], []
    while queue:
        node = queue.popleft()
        nodes.append((f"n{number[id(node)]:06d}", *_described(node)))
        for field, value in ast.iter_fields(node):
            held = [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, ast.AST)]
            for at, child in enumerate(held):
                if id(child) not in number:
                    number[id(child)] = len(number)
                    queue.append(child)
                links.append((id(child), id(node), f"{field}:{at:06d}"))
    return nodes, [(f"n{number[c]:06d}", f"n{number[p]:06d}", "syntax", position, None) for c, p, position in links]


# What values of data files are.
_DATA = ((dict, "object"), (list, "array"), (bool, "boolean"), ((int, float), "number"), (str, "string"), (type(None), "null"))


def _data(value: object) -> tuple[list[tuple], list[tuple]]:
    """Values numbered parents first, members in the order of their keys; edges from the inner value to the outer."""
    nodes, edges, stack = [], [], [(value, None, "", "", None)]
    while stack:
        v, parent, kind, position, field = stack.pop()
        me = f"n{len(nodes):06d}"
        name = next((k for cls, k in _DATA if isinstance(v, cls)), type(v).__name__.lower())
        nodes.append((me, "data", f"data.{name}", {"entry_count": len(v)} if isinstance(v, dict) else {"element_count": len(v)} if isinstance(v, list) else {}))
        if parent is not None:
            edges.append((me, parent, kind, position, field))
        inner = [("field", str(k), v[k]) for k in sorted(v, key=str)] if isinstance(v, dict) else [("item", None, x) for x in v] if isinstance(v, list) else []
        stack.extend(reversed([(x, me, k, f"{i:06d}", f) for i, (k, f, x) in enumerate(inner)]))
    return nodes, edges


def _strict(constant: str):
    raise ValueError(f"{constant} is no JSON number")


#: Parsers by suffix; YAML is kept by ``wanted`` but has none.
PARSERS = {".py": _python, ".json": lambda text: _data(json.loads(text, parse_constant=_strict)), ".toml": lambda text: _data(tomllib.loads(text))}


def _parsed(files: DataFrame, edges: bool) -> DataFrame:
    schema = EDGES if edges else NODES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, text in zip(pdf["path"], pdf["content"]):
                suffix = os.path.splitext(str(path).lower())[1]
                problem = None
                if suffix not in PARSERS:
                    problem = ("not_parsed", suffix)
                else:
                    try:
                        nodes, links = PARSERS[suffix]((text or "").removeprefix("﻿"))
                        rows += [(path, *x) for x in links] if edges else [(path, i, k, o, json.dumps(a, sort_keys=True, separators=(",", ":"))) for i, k, o, a in nodes]
                    except (SyntaxError, ValueError, RecursionError) as e:
                        problem = ("parse_error", type(e).__name__)
                if problem and not edges:
                    rows.append((path, "n000000", *problem, "{}"))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")], dtype=object)

    return files.select("path", "content").mapInPandas(run, schema)


def syntax_nodes(files: DataFrame) -> DataFrame:
    """(path, node_id, kind, operation, attributes): one row per syntax node; a file that doesn't parse gives one row of kind
    ``parse_error``, a file without a parser one of kind ``not_parsed``."""
    return _parsed(files, False)


def syntax_edges(files: DataFrame) -> DataFrame:
    """(path, source, target, kind, position, field), from the inner node to the outer; files without a graph have none."""
    return _parsed(files, True)


def flat_json_nodes(files: DataFrame) -> DataFrame:
    """Root and members of flat JSON objects by built-in functions: (path, field, kind)."""
    v = files.select("path", F.try_parse_json("content").alias("v"))
    root = v.select("path", F.lit("").alias("field"), F.when(F.col("v").isNull(), "parse_error").otherwise("object").alias("kind"))
    keys = files.select("path", "content", F.explode(F.json_object_keys("content")).alias("field"))
    member = F.element_at(F.from_json("content", "map<string,string>"), F.col("field"))
    kind = F.when(member.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), "number").when(member.isin("true", "false"), "boolean").when(member.isNull(), "null").when(member.startswith("{"), "object").when(member.startswith("["), "array").otherwise("string")
    return root.unionByName(keys.select("path", "field", kind.alias("kind")))


def tree_digest(files: DataFrame, group: str) -> DataFrame:
    """(group, files, digest) over the sorted paths and content digests of a group's files."""
    line = F.concat(F.col("path"), F.lit(" "), F.sha2(F.coalesce("content", F.lit("")), 256))
    return files.groupBy(group).agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def within_budget(files: DataFrame, group: str, size: str, budget: int) -> DataFrame:
    """Files of each group in path order while their sizes add up to at most ``budget``."""
    w = Window.partitionBy(group).orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("upto", F.sum(size).over(w)).where(F.col("upto") <= budget)
