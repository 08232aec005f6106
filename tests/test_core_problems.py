"""The general problems against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import datetime as dt
import random

import pytest

from graftline.operators import hierarchy, incremental, orphans, snapshot_diff
from graftline.tables import current_rows


def T(x):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=x)


def brute_forest(links):
    parent = {}
    nodes = set()
    for c, p in links:
        if c is not None:
            nodes.add(c)
        if p is not None:
            nodes.add(p)
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for n in nodes:
        seen, at = [n], n
        while at in parent and parent[at] not in seen:
            at = parent[at]
            seen.append(at)
        out[n] = ("cycle", -1, None) if at in parent else (at, len(seen) - 1, "/".join(reversed(seen)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_random(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{i}", f"n{rng.randrange(max(1, i))}" if rng.random() < 0.9 else None) for i in range(1, 60)]
    links += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c4", "c1"), ("s", "s"), (None, "n0"), (None, None), links[5]]
    links += [(f"l{i}", f"l{i - 1}") for i in range(1, 20)]
    df = spark.createDataFrame([(c, p, "x") for c, p in links], "child string, parent string, node string")
    placed = hierarchy.decompose(df)
    want = brute_forest(links)
    got = {r.node: (r.root_id, r.tree_depth) for r in placed.collect()}
    assert got == {n: v[:2] for n, v in want.items()}
    assert {r.node: r.path for r in hierarchy.paths(placed).collect()} == {n: v[2] for n, v in want.items() if v[2]}
    below = {(a, n) for n, v in want.items() if v[2] for a in v[2].split("/") if a != n}
    assert {tuple(r) for r in hierarchy.descendants(placed).collect()} == below
    sizes = {r.node: r.subtree_size for r in placed.where("tree_depth >= 0").collect()}
    assert all(sizes[n] == 1 + sum(a == n for a, _ in below) for n in sizes)
    assert {tuple(r) for r in hierarchy.cycles(placed).collect()} == {("c1", "c1"), ("c1", "c2"), ("c1", "c3"), ("s", "s")}


def test_hierarchy_empty(spark):
    df = spark.createDataFrame([], "child string, parent string")
    assert hierarchy.decompose(df).count() == 0


VALUES, LISTS = ["name", "size"], ["tags"]
RECORD = "feed_id string, snapshot_digest string, row_no int, catalog_id string, name string, size double, tags array<string>, value_hash string"
REPORT = "feed_id string, snapshot_digest string, sync_mode string, complete boolean, started_at timestamp"


def test_snapshot_changes(spark):
    reports = [("f", "A", "full", True, T(0)), ("f", "B", "full", True, T(2)), ("f", "X", "full", False, T(1)), ("f", "A", "full", True, T(3)), ("f", "C", "full", True, T(4)), ("g", "G", "full", True, T(0)), ("f", None, "full", True, T(9)), ("f", "E", "incremental", True, T(5))]
    rows = [
        ("f", "A", 1, "k1", "a", 1.0, ["x", "y"], None), ("f", "A", 2, "k2", "b", None, None, None), ("f", "A", 3, "k2", "zz", None, None, None), ("f", "A", 4, "k3", "c", 2.0, [], None), ("f", "A", 5, None, "c", 2.0, [], None),
        ("f", "X", 1, "k9", "a", 1.0, None, None),
        ("f", "B", 1, "k1", " a ", 1.0, ["y", " x"], None), ("f", "B", 2, "k2", "b", None, [" "], None), ("f", "B", 2, "k2", "b", None, [" "], None), ("f", "B", 3, "k3", None, 2.0, [], None), ("f", "B", 9, "k4", "", 1.0, None, None),
        ("f", "C", 1, "k4", None, 1.0, [], None), ("f", "C", None, "k5", "n", 1.0, [], None), ("g", "G", 1, "k1", "a", 1.0, None, None),
    ]
    r, p = spark.createDataFrame(rows, RECORD), spark.createDataFrame(reports, REPORT)
    got = {(x.snapshot_digest, x.catalog_id, x.change_kind) for x in snapshot_diff.changes(r, p, VALUES, LISTS).collect()}
    assert got == {("B", "k3", "changed"), ("B", "k4", "added"), ("C", "k1", "removed"), ("C", "k2", "removed"), ("C", "k3", "removed"), ("C", "k5", "added")}
    assert snapshot_diff.changes(r.limit(0), p, VALUES, LISTS).count() == 0
    assert snapshot_diff.changes(r, p.limit(0), VALUES, LISTS).count() == 0


def test_orphans(spark):
    from pyspark.sql import functions as F

    refs = spark.createDataFrame([("r1", " A ", T(5)), ("r2", "b", T(5)), ("r3", "C", T(1)), ("r4", "zz", None), ("r5", None, T(1)), ("r6", " ", T(1)), ("r7", "c", T(50)), ("r4", "zz", None)], "record string, key string, at timestamp")
    known = orphans.parents(spark.createDataFrame([("a", T(0), None), ("B", T(0), T(9)), ("c", T(3), None), (None, T(0), None)], "id string, recorded timestamp, withdrawn timestamp"), "id", "recorded", "withdrawn")
    found = orphans.orphans(orphans.references(refs, "t", F.col("record"), F.col("key"), F.col("at")), known)
    assert {tuple(r) for r in found.collect()} == {("t", "r2", "deleted", "2024-01", 1), ("t", "r3", "late", "2024-01", 1), ("t", "r4", "missing", None, 2)}
    assert orphans.report(found).agg(F.sum("n_references")).first()[0] == 4
    assert orphans.orphans(orphans.references(refs.limit(0), "t", F.col("record"), F.col("key"), F.col("at")), known).count() == 0


OBS = "obs_id bigint, run_id string, feed_id string, catalog_id string, version_id string, modified_at timestamp, observed_at timestamp, part int"
RUN = "run_id string, feed_id string, sync_mode string, started_at timestamp, complete boolean"


def brute_batches(obs, runs):
    when = {}
    for o in obs:
        if o[4] is not None:
            when.setdefault(o[4], [None, None])
            m, w = when[o[4]]
            when[o[4]] = [max(x for x in (m, o[5]) if x) if (m or o[5]) else None, min(x for x in (w, o[6]) if x) if (w or o[6]) else None]
    done, found = {}, set()
    waiting = []
    for run in sorted((r for r in runs if r[2] == "incremental"), key=lambda r: (r[1], r[3])):
        if waiting and waiting[0][0] != run[1]:
            waiting = []
        waiting.append((run[1], run[0]))
        if not run[4]:
            continue
        ids = {w[1] for w in waiting}
        waiting = []
        for key in {o[3] for o in obs if o[1] in ids and o[3] is not None}:
            versions = {o[4] for o in obs if o[1] in ids and o[3] == key and o[4] is not None}
            old = done.setdefault((run[1], key), {})
            new = [(when[v][0] or when[v][1], v) for v in versions if v not in old and (when[v][0] or when[v][1])]
            if new and all(max(new)[0] > t for t in old.values()):
                t, v = max(new)
                old[v] = t
                found.add((run[0], v))
    return found


def test_incremental(spark, tmp_path):
    rng = random.Random(4)
    runs = [(f"r{i:02d}", f"f{i % 2}", "incremental" if i % 7 else "full", T(i), rng.random() < 0.6) for i in range(30)]
    obs = [(n, f"r{(i := rng.randrange(30)):02d}", f"f{i % 2}", f"k{i % 2}{rng.randrange(6)}", None, None, T(n)) for n in range(300)]
    obs = [(*o[:4], f"{o[3]}@{(v := rng.randrange(12))}", None if v % 5 == 0 else T(100 + v * 3), o[6], 1) for o in obs]
    obs += obs[:20] + [(999, None, "f0", "k01", "v", T(1), T(1), 1), (998, "r01", "f1", None, "v", T(1), T(1), 1), (997, "nope", "f1", "k11", "v", T(1), T(1), 1)]
    o, p = spark.createDataFrame(obs, OBS), spark.createDataFrame(runs, RUN)
    state = str(tmp_path / "state")
    first = incremental.refresh(o, p, state, 4)
    assert first
    assert {tuple(r) for r in incremental.processed(spark, state).collect()} == brute_batches([x for x in obs if x[1] != "nope"], runs)
    assert incremental.refresh(o, p, state, 4) == []
    late = (1000, "r29" if runs[29][4] else "r28", "f1" if runs[29][4] else "f0", "new", "new@1", T(500), T(500), 1)
    obs.append(late)
    changed = incremental.refresh(spark.createDataFrame(obs, OBS), p, state, 4)
    assert len(changed) <= 1
    assert {tuple(r) for r in incremental.processed(spark, state).collect()} == brute_batches([x for x in obs if x[1] != "nope"], runs)


def test_incremental_empty(spark, tmp_path):
    o, p = spark.createDataFrame([], OBS), spark.createDataFrame([], RUN)
    assert incremental.refresh(o, p, str(tmp_path / "s"), 2) == []


def test_current_rows(spark):
    df = spark.createDataFrame([("a", T(1), 1), ("a", T(3), 3), ("a", None, 9), (None, T(9), 5), ("b", None, 2), ("a", T(3), 3)], "id string, at timestamp, v int")
    assert {tuple(r) for r in current_rows(df, "id", "at").select("id", "v").collect()} == {("a", 3), ("b", 2)}
