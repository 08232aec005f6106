"""Mixing sources to target weights by iterative proportional fitting and sampling with calibrated probabilities.

Sizes are tokens of a public tokenizer, counted over whole texts in Arrow batches. Documents are summed to cells of (source,
language, topic); raking runs on the cells: their weight is a product of one factor for each source, language and topic, never
above the source's ``max_repeats``, and the factors are scaled to the marginals in turn until they rest (last the sources,
whose shares are the target).

The weight of its cell is a document's expected number of copies. Documents are laid out in order (source, language, topic,
size) along a line, each as long as its weight, and a comb of unit spacing and random start picks the copies: a document of
weight w is taken floor(w) or floor(w) + 1 times, with exactly w as the mean, and sources, cells and sizes are all hit evenly, so
the tokens drawn deviate from the shares by a few documents at most. The start and the order are fixed by ``seed`` and ids:
a rerun takes the same. The line is cut into ranges, which are summed before, so no source gathers in a task.

Sources: the target shares, over the sources that have documents. Languages and topics: their shares of the pool's tokens.
Total: by default the largest for which each source reaches its share within its cap (a cap of null is none).

Up to ``CELLS`` cells are raked on the driver; more stay a table, whose marginals are summed by the executors each round (the
factors, one for each category, are what the driver keeps).

Nulls: a null language or topic is a category of its own; documents without id, text or source, and those of sources without
a target, take no part. Repeated rows are repeated documents. Empty texts have no tokens and no influence. Empty tables give
an empty mix.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graftline.session import Scratch

CELLS, ROUNDS, REST = 200_000, 1_000, 1e-6
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that belongs to the tokenizer's vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(docs: DataFrame, text_col: str, vocabulary: str = TOKENIZER, out: str = "n_tokens") -> DataFrame:
    """``docs`` without the text, with its number of tokens. ``vocabulary``: a file of base64 tokens and ranks on all executors."""
    others = [c for c in docs.columns if c not in (text_col, out)]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*others, out])

    return docs.select(*others, text_col).mapInArrow(run, ", ".join([*fields, f"{out} bigint"]))


def _fit(sums: Callable[[list[np.ndarray], int], np.ndarray], margins: list[np.ndarray]) -> list[np.ndarray]:
    """Factors of sources, languages and topics for which the marginals hold, as far as the caps allow. ``sums(factors, k)``: the
    tokens that the weights give the categories of kind k."""
    factors = [np.ones(len(m)) for m in margins]

    def scale(k: int) -> float:
        have = sums(factors, k)
        step = np.where((have > 0) & (margins[k] > 0), margins[k] / np.maximum(have, 1e-300), np.where(margins[k] > 0, 1.0, 0.0))
        factors[k] = np.clip(factors[k] * step, 0, 1e12)
        return float(np.max(np.abs(step[(margins[k] > 0) & (factors[k] < 1e12)] - 1), initial=0.0))

    for _ in range(ROUNDS):
        if max(scale(1), scale(2), scale(0)) < REST:
            break
    for _ in range(ROUNDS):  # caps bend a single step
        if scale(0) < REST:
            break
    return factors


def _sums_here(codes: np.ndarray, tokens: np.ndarray, cap: np.ndarray) -> Callable:
    def sums(factors: list[np.ndarray], k: int) -> np.ndarray:
        w = np.minimum(cap[codes[:, 0]], factors[0][codes[:, 0]] * factors[1][codes[:, 1]] * factors[2][codes[:, 2]])
        return np.bincount(codes[:, k], w * tokens, len(factors[k]))

    return sums


def _sums_there(cells: DataFrame, cap: np.ndarray) -> Callable:
    """The same over a table of cells (c0, c1, c2, tokens)."""

    def sums(factors: list[np.ndarray], k: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(factors[k]))
            for b in batches:
                codes = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
                total += _sums_here(codes, b.column(3).to_numpy().astype(float), cap)(factors, k)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "total"])

        out = np.zeros(len(factors[k]))
        for r in cells.select("c0", "c1", "c2", "tokens").mapInArrow(run, "at bigint, total double").groupBy("at").agg(F.sum("total").alias("total")).collect():
            out[r["at"]] = r.total
        return out

    return sums


def rake(cells: DataFrame, targets: dict[str, tuple[float, int | None]], total: float | None = None) -> tuple[list[DataFrame], float]:
    """cells(source, lang, topic, tokens) -> tables (source, f0, cap), (lang, f1), (topic, f2) of the factors whose product, at most
    the cap, is a cell's weight; and the total aimed at."""
    spark = cells.sparkSession
    kinds = ["source", "lang", "topic"]
    held = [sorted(((r[0], r[1] or 0) for r in cells.groupBy(k).agg(F.sum("tokens")).collect()), key=lambda x: (x[0] is not None, x[0] or "")) for k in kinds]
    have = [np.array([n for _, n in h], float) for h in held]
    pool = have[0].sum()
    share = np.array([targets[s][0] if n > 0 else 0.0 for s, n in held[0]])
    share = share / max(share.sum(), 1e-300)
    cap = np.array([np.inf if targets[s][1] is None else float(targets[s][1]) for s, _ in held[0]])
    most = np.min(np.where(share > 0, cap * have[0] / np.maximum(share, 1e-300), np.inf), initial=np.inf)
    goal = float(total if total is not None else most if np.isfinite(most) else pool)
    margins = [share * goal, *[h / max(pool, 1e-300) * goal for h in have[1:]]]
    table = [spark.createDataFrame([(v, i) for i, (v, _) in enumerate(h)], f"{k} string, c{j} bigint") for j, (k, h) in enumerate(zip(kinds, held))]
    coded = cells
    for k, codes in zip(kinds, table):
        coded = coded.join(codes, coded[k].eqNullSafe(codes[k])).drop(codes[k])
    few = coded.select("c0", "c1", "c2", "tokens").limit(CELLS + 1).toArrow()
    if few.num_rows <= CELLS:
        sums = _sums_here(np.stack([few.column(i).to_numpy() for i in range(3)], 1), few.column(3).to_numpy().astype(float), cap)
    else:
        sums = _sums_there(coded, cap)
    factors = _fit(sums, margins)
    out = [spark.createDataFrame([(v, float(f), None if j or not np.isfinite(c) else float(c)) for (v, _), f, c in zip(held[j], factors[j], cap if j == 0 else factors[j])], f"{k} string, f{j} double, cap double") for j, k in enumerate(kinds)]
    return [out[0], *[o.drop("cap") for o in out[1:]]], goal


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """docs(id, source, lang, topic, n_tokens), targets(source, target_share, max_repeats) -> (id, source, lang, topic, n_tokens,
    weight, copies) of every document that is taken at least once."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixed")
    goals = {r.source: (float(r.target_share), r.max_repeats) for r in targets.where("source is not null and target_share > 0").select("source", "target_share", "max_repeats").collect()}
    pool = docs.where("id is not null").join(targets.where("target_share > 0").select("source").distinct(), "source", "left_semi").select("id", "source", "lang", "topic", "n_tokens")
    cells = scratch.cut(pool.groupBy("source", "lang", "topic").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")), "cells")
    weighed = pool
    for k, factors in zip(("source", "lang", "topic"), rake(cells, goals, total)[0]):
        weighed = weighed.join(factors, weighed[k].eqNullSafe(factors[k])).drop(factors[k])
    weight = F.least(F.coalesce("cap", F.lit(float("inf"))), F.col("f0") * F.col("f1") * F.col("f2"))
    line = ["source", "lang", "topic", "n_tokens", "_turn", "id"]
    laid = weighed.select("id", "source", "lang", "topic", "n_tokens", weight.alias("weight"), F.xxhash64("id", F.lit(seed)).alias("_turn")).repartitionByRange(*line).withColumn("_part", F.spark_partition_id())
    laid = scratch.cut(laid, "line")
    parts = laid.groupBy("_part").agg(F.sum("weight").alias("_sum"))
    before = parts.select("_part", (F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"))  # one row for each range
    start = float(np.random.default_rng(seed).random())
    upto = F.sum("weight").over(Window.partitionBy("_part").orderBy(*line).rowsBetween(Window.unboundedPreceding, 0))
    placed = laid.withColumn("_upto", upto).join(F.broadcast(before), "_part").withColumn("_upto", F.col("_upto") + F.col("_before") + start)
    copies = (F.floor("_upto") - F.floor(F.col("_upto") - F.col("weight"))).cast("int")
    return placed.select("id", "source", "lang", "topic", "n_tokens", "weight", copies.alias("copies")).where("copies > 0")


def margins(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """kind (lang or topic), category, goal_share, actual_share of tokens: the pool's marginals and the mix's."""
    out = None
    for k in ("lang", "topic"):
        goal = docs.groupBy(F.col(k).alias("category")).agg(F.sum("n_tokens").alias("g"))
        got = mixed.groupBy(F.col(k).alias("got")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"))
        both = goal.join(got, F.col("category").eqNullSafe(F.col("got")), "left").select(F.lit(k).alias("kind"), "category", "g", F.coalesce("t", F.lit(0)).alias("t"))
        whole = both.agg(F.sum("g").alias("gs"), F.sum("t").alias("ts"))
        both = both.join(F.broadcast(whole), F.lit(True)).select("kind", "category", (F.col("g") / F.col("gs")).alias("goal_share"), (F.col("t") / F.col("ts")).alias("actual_share"))
        out = both if out is None else out.unionByName(both)
    return out


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What came of it: source, target_share, actual_share, tokens, documents, most_copies; sources without documents have 0."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    return targets.select("source", "target_share").join(got, "source", "left").join(F.broadcast(whole), F.lit(True), "left").select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies")
    )
