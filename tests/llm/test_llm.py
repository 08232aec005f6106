"""The llm problems against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from graftline.llm import canonical_list, entity_match, leakage, mixing, names, similar_sets, visual_text


def plain_form(t):
    """The consistent form by Python's own Unicode tables, code point by code point."""
    t = re.sub("[\xad​-‏⁠-⁤﻿]", "", t)
    out = "".join(visual_text._fold(c) for c in unicodedata.normalize("NFD", t))
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", out))


TEXTS = [
    "naïve café", "naïve café", "nаïve cаfé", "ｎａïｖｅ　café", "naïve  \tcafé", "na​ïve caf­é", "naive cafe", "Naïve café", "x² x2", "x2 x2", "ﬁne‑tune", "fine-tune", "q̣̇", "q̣̇", "Ёлка й", "Ёлкa й", "", " ", None, "계산 그래프 计算图", "é" * 3000, "é" * 3000,
    "naïve café", "한국어 모델", unicodedata.normalize("NFD", "한국어 모델"), "한국어 모델", "한\u302e글\u0301", unicodedata.normalize("NFD", "한") + "\u302e글\u0301", "\u1112", "\u11ab\u0301", "각ᆨ", unicodedata.normalize("NFD", "각") + "ᆨ",
]


def test_visual_forms(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "naïve café", "x")], "doc_id int, text string, form string")
    got = {r.doc_id: r.f for r in visual_text.consistent(docs.where("doc_id is not null").select("doc_id", "text"), "text", "f").collect()}
    assert got == {i: None if t is None else plain_form(t) for i, t in enumerate(TEXTS)}
    pairs = {tuple(r) for r in visual_text.look_alikes(docs).collect()}
    want = {(i, j) for j in range(len(TEXTS)) for i in range(j) if None not in (TEXTS[i], TEXTS[j]) and TEXTS[i] != TEXTS[j] and plain_form(TEXTS[i]) == plain_form(TEXTS[j])}
    assert pairs == want and want
    assert visual_text.look_alikes(docs.limit(0)).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("the Porridtoth_v3 - 800 million (Far University)",), ("vud/MAGITTIN/II/0.3B/coder",), ("Fоо2-13000m-chat tuned",), ("-",), (None,)], "n string")
    got = [tuple(r.p[c] for c in ("family", "generation", "size_m", "tuning")) for r in df.select(names.parse(F.col("n")).alias("p")).collect()]
    assert got == [("porridtoth", 3, 800, "base"), ("magittin", 2, 300, "code"), ("foo", 2, 13000, "chat"), (None, 1, None, "base"), (None, 1, None, "base")]


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, before = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(before[j] + 1, d[-1] + 1, before[j - 1] + (x != y)))
    return d[-1]


def test_canonical_list(spark):
    rng = random.Random(5)
    families = ["".join(rng.choice("bdgklmnrst") + rng.choice("aeiou") for _ in range(4)) + "x" for _ in range(25)]
    free = []
    for f in families:
        for k in range(5):
            w = list(f)
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice("abcdefgh")
            free.append("".join(w) + " 7B Chat")
    free += ["nothing like it 7B Chat", families[0] + " 3B Chat", families[0][1] + families[0][0] + families[0][3] + families[0][2] + families[0][4:] + " 7b dialogue", None, "", "  ", "n/a", "x" * 5000, free[0]]
    reference = spark.createDataFrame([(f"id-{f}", [f"{f} 7B Chat", None]) for f in families] + [("empty", []), (None, ["zz 7B"])], "ref_id string, names array<string>")
    table = spark.createDataFrame([(n, 1) for n in free], "name string, ref_id int")
    matched = canonical_list.match(table, reference)
    got = {r.name: (r.ref_id, r.distance) for r in matched.collect()}
    want = {}
    for n in free:
        m = re.fullmatch(r"(\w+) 7b (chat|dialogue)", (n or "").lower())
        if m:
            near = sorted((edit(m[1], f), f) for f in families if edit(m[1], f) <= 3 or (edit(m[1], f) == 4 and sorted(m[1]) == sorted(f)))
            if near and (len(near) == 1 or near[0][0] < near[1][0]):
                want[n] = (f"id-{near[0][1]}", near[0][0])
    assert got == want and len(want) > 50
    left = canonical_list.unmatched(table, matched)
    assert {r.name for r in left.collect()} == {n for n in free if n not in want}
    assert canonical_list.match(table.limit(0), reference).count() == 0 and canonical_list.match(table, reference.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [512, 4])
def test_similar_sets(spark, monkeypatch, crowd):
    monkeypatch.setattr(similar_sets, "CROWD", crowd)
    rng = random.Random(7)
    sets = {}
    for i in range(60):
        base = {"hot"} | {f"e{rng.randrange(400)}" for _ in range(rng.randrange(3, 14))}
        sets[f"m{i}"] = base
        for k in range(rng.randrange(3)):
            near = set(base)
            for _ in range(rng.randrange(3)):
                near ^= {f"e{rng.randrange(400)}"}
            sets[f"m{i}-{k}"] = near
    rows = [(m, e, "x") for m, s in sets.items() for e in s]
    rows += rows[:50] + [(None, "hot", "x"), ("null", None, "x")]
    df = spark.createDataFrame(rows, "model string, element string, e string")
    got = {(r.left_id, r.right_id): round(r.similarity, 9) for r in similar_sets.similar_pairs(df, "model", F.col("element")).collect()}
    want = {}
    for a in sets:
        for b in sets:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if a < b and j >= 0.7:
                want[(a, b)] = round(j, 9)
    assert got == want and want
    member, pairs = similar_sets.similar_classes(df, "model", F.col("element"))
    of = {r.set_id: r.cls for r in member.collect()}
    linked = {frozenset((r.a, r.b)) for r in pairs.collect()}
    assert set(of) == set(sets) and {frozenset((of[a], of[b])) for a, b in want if of[a] != of[b]} == linked and all((of[a] == of[b]) == (sets[a] == sets[b]) for a, b in want)
    assert similar_sets.similar_pairs(df.limit(0), "model", F.col("element")).count() == 0


def test_crowds_of_variants(spark):
    """Thousands of variants of one set: most pairs are crowded in every tree, and each is exactly at the threshold."""
    base = [f"b{i}" for i in range(14)]
    n = 1300
    rows = [(f"v{v:05d}", e) for v in range(n) for e in base + [f"u{v}-{k}" for k in range(3)]]
    rows += [(f"w{v:05d}", e) for v in range(600) for e in base + [f"x{v}-{k}" for k in range(4)]]
    df = spark.createDataFrame(rows, "model string, element string")
    got = similar_sets.similar_pairs(df, "model", F.col("element")).groupBy(F.substring("left_id", 1, 1).alias("l"), F.substring("right_id", 1, 1).alias("r"), F.round("similarity", 9).alias("s")).count().collect()
    assert {tuple(x) for x in got} == {("v", "v", 0.7, n * (n - 1) // 2)}


def test_leaks(spark):
    items = [("i1", "A keeper named Vetrad pays 934 tokens per ledger whenever the Pigid relay drops below level 654 in spring."), ("i2", "Suppose ancestor Dikok lost 12 characters on branch Subris while cousin Lobal gained 743 on the way."), ("i3", "too short"), (None, "x " * 20), ("i4", None)]
    full = items[0][1]
    docs = [
        (1, "He said: **a KEEPER** named <b>Vetrad</b> pays\n934 tokens  per ledger whenever the Pigid relay ends."), (2, full), (3, full.replace("Vetrad", "Other").replace("Pigid", "Else").replace("934", "11")), (4, "keeper named Vetrad pays 934 tokens per ledger whenever the Pigid"),
        (5, "а keeper nаmed Ｖｅｔｒａｄ pа​ys 934 tokens per ledger whenever the Pigid"), (6, None), (7, ""), (8, "suppose ancestor dikok lost 12 characters on branch subris while cousin lobal or not gained 743"), (9, (full + " ") * 300), (2, full),
    ]
    d, i = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, id int")
    table = leakage._table()
    grams = lambda t: {tuple(w[k : k + 12]) for w in [leakage.words(t or "", table)] for k in range(len(w) - 11)}
    want = {(a, b) for a, t in docs for b, u in items if b and grams(t) & grams(u)}
    assert {(r.id, r.item_id) for r in leakage.leaks(d, i).collect()} == want == {(1, "i1"), (2, "i1"), (5, "i1"), (9, "i1"), (8, "i2")}
    other = {r.id for r in leakage.reparameterised(d, i, 14).collect()}
    assert 3 in other and 2 not in other and 7 not in other
    assert leakage.leaks(d.limit(0), i).count() == 0


def naive_windows(text, width, kinds):
    """(types, values, repeats) of every window, by hand."""
    ws = leakage.words(text or "", leakage._table())
    for k in range(len(ws) - width + 1):
        w = ws[k : k + width]
        kind = ["#" if any(c.isdigit() for c in x) else kinds.get(x, "name") for x in w]
        yield tuple(x if k == "word" else k for x, k in zip(w, kind)), tuple(w), tuple(w.index(x) for x in w)


def test_reparameterised_questions(spark):
    """Questions asked again with other names, numbers and units are all found, those with confused slots aren't."""
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bdgklmnrst") + rng.choice("aeiou") for _ in range(3)).title()
    forms = [
        "A keeper called {a} pays {n} credits for every ledger that {b} sends, while {c} asks for {m} credits, and so {a} wonders how many ledgers {b} must send before the sum is even.",
        "Suppose that the river {a} carries {n} barrels to the town of {b} in spring, but {m} barrels in autumn; how many barrels reach {b} when the river {a} and the river {c} run together?",
    ]
    fill = lambda f: f.format(a=name(), b=name(), c=name(), n=rng.randrange(100, 999), m=rng.randrange(100, 999))
    items = [(f"i{k}", fill(forms[k % 2])) for k in range(12)]
    confused = [f.replace("{a}", "{a1}", 1).format(a=name(), a1=name(), b=name(), c=name(), n=5, m=6) for f in forms]
    docs = [(k, "Some text before. <span style=" + "x" * 250 + ">" + fill(forms[k % 2]) + "</span> And after.") for k in range(40)] + [(100, items[0][1]), (101, confused[0]), (102, None), (103, "")]
    d, i = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {r.id for r in leakage.reparameterised(d, i).collect()}
    assert set(range(40)) <= got and 100 not in got
    table = leakage._table()
    capital = {w.lower() for _, t in items for w in re.findall(r"(?<=[a-z,;] )([A-Z]\w+)", t)}
    behind = [(b, _is) for _, t in items for a, b in zip(leakage.words(t, table), leakage.words(t, table)[1:]) for _is in [a.isdigit()]]
    unit = {w for w in {b for b, _ in behind} if sum(x for b, x in behind if b == w) > sum(not x for b, x in behind if b == w)} | leakage.UNITS
    kinds = {w: "unit" if w in unit else "word" for _, t in items for w in leakage.words(t, table) if w not in capital}
    own = [w for _, t in items for w in naive_windows(t, 24, kinds)]
    pairs, values = {(t, p) for t, _, p in own}, {v for _, v, _ in own}
    assert got == {k for k, t in docs if any((a, p) in pairs and v not in values for a, v, p in naive_windows(t, 24, kinds))}
    assert {(r.id, r.item_id) for r in leakage.leaks(d, i).where("id = 100").collect()} == {(100, "i0")}


def test_reparameterised_pairs(spark):
    """A question asked again is paired with every item of its form, also if a new name shares the last 24 bits of its hash with a
    word of the items ("rumenamu" and "before")."""
    forms = [
        "A keeper called {a} pays {n} credits for every ledger that {b} sends, while {a} asks for {m} credits, and so wonders how many ledgers {b} must send before the sum is even.",
        "Suppose that the river {a} carries {n} barrels to the town of {b} in spring, but {m} barrels in autumn; how many barrels reach {b} when the river {a} and the town run together?",
    ]
    fill = lambda k, a, b, n, m: forms[k % 2].format(a=a, b=b, n=n, m=m)
    items = [(f"i{k}", fill(k, f"Bado{c}", f"Kilu{c}", 10 + k, 50 + k)) for k, c in enumerate("klmnrst")]
    docs = [(1, fill(0, "Tesak", "Gubin", 3, 4)), (2, fill(1, "Tesak", "Gubin", 3, 4)), (3, fill(0, "Rumenamu", "Gubin", 3, 4)), (4, fill(0, "Tesak", "Gubin", 3, 4) + " " + fill(1, "Rumenamu", "Gubin", 3, 4)), (5, items[0][1])]
    d, i = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = leakage.reparameterised(d, i).collect()
    even, odd = ({f"i{k}" for k in range(first, 7, 2)} for first in (0, 1))
    assert {(r.id, r.item_id) for r in got} == {(n, x) for n, held in ((1, even), (2, odd), (3, even), (4, even | odd)) for x in held} and len(got) == len({(r.id, r.item_id) for r in got})
    words = [len(leakage.words(items[k][1], leakage._table())) for k in (0, 1)]
    assert all(r.n_windows == words[r.item_id in odd] - 23 for r in got)


def test_mixing(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(n, s, rng.choice(["en", "fr", None]), rng.choice(["a", "b"]), rng.randrange(50, 400)) for n, s in enumerate(["big"] * 900 + ["mid"] * 300 + ["small"] * 60 + ["none"] * 40)] + [(5000, None, "en", "a", 9), (None, "big", "en", "a", 9)]
    d = spark.createDataFrame(docs, "id int, source string, lang string, topic string, n_tokens int")
    t = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, None), ("small", 0.2, 3), ("ghost", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(d, t)
    rows = mixed.collect()
    assert {r.source for r in rows} == {"big", "mid", "small"}
    assert max(r.copies for r in rows if r.source == "big") == 1 and max(r.copies for r in rows if r.source == "small") <= 3
    shares = {r.source: r.actual_share for r in mixing.shares(mixed, t).collect()}
    assert shares["ghost"] == 0 and all(abs(shares[s] - x / 0.9) < 0.01 for s, x in (("big", 0.4), ("mid", 0.3), ("small", 0.2)))
    assert {tuple(r) for r in mixing.mix(d.repartition(7), t).select("id", "copies").collect()} == {(r.id, r.copies) for r in rows}
    margins = mixing.margins(d.where("id is not null and source <> 'none'"), mixed).collect()
    assert {(r.kind, r.category) for r in margins} == {("lang", "en"), ("lang", "fr"), ("lang", None), ("topic", "a"), ("topic", "b")} and all(abs(r.goal_share - r.actual_share) < 0.02 for r in margins)
    monkeypatch.setattr(mixing, "CELLS", 3)
    assert {(r.id, r.copies) for r in mixing.mix(d, t).collect()} == {(r.id, r.copies) for r in rows}  # raked by the executors
    assert mixing.mix(d.limit(0), t).count() == 0


def test_tokens(spark):
    import os

    if not os.path.exists(mixing.TOKENIZER):
        pytest.skip("no tokenizer here")
    d = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "word " * 20000)], "id int, text string")
    assert {r.id: r.n_tokens for r in mixing.token_counts(d, "text").collect()} == {1: 2, 2: 0, 3: 0, 4: 20001}


def test_entity_match(spark):
    rng = random.Random(9)
    families = ["".join(rng.choice("bdgklmnrstvz") + rng.choice("aeiou") for _ in range(4)) + "k" for _ in range(40)]
    entries, records, truth = [], [], set()
    for n, f in enumerate(families):
        for g, size, tuning in (("2 ", "7B", " Chat"), ("", "13B", "")):
            e = f"registry:model:{f}-{n}{size}"
            entries.append((e, f"{f.title()} {g}{size}{tuning}", [f"{f}-other"] if n == 0 else None, [("paper", f"pp-20-{n:07d}")] if n % 2 else None, [("maker", f"Maker{chr(97 + n % 26)}x Labs")]))
            w = list(f)
            if n % 3 == 0:
                w[3] = "q"
            r = f"index:{n}{size}"
            records.append((r, f"{''.join(w)}_{g.strip()}_{size.lower()}n{tuning}", "The Maker" + chr(97 + n % 26) + "x", "index", [("ref", f"PP:20/{n:07d}v2")], None, None, None))
            truth.add((r, e))
        records.append((f"forge:{n}", f"{f.title()} 70B", "Maker", "forge", None, None, None, None))
    records += records[:5] + [("index:null", None, None, None, None, None, None, None), (None, "x", None, None, None, None, None, None), ("index:long", "y" * 4000, None, None, None, 7e9, None, None)]
    e = spark.createDataFrame(entries + [("registry:model:none", None, None, None, None), (None, "a", None, None, None)], "id string, canonical_name string, aliases array<string>, identifiers array<struct<namespace:string,value:string>>, members array<struct<member_kind:string,name:string>>")
    r = spark.createDataFrame(records, "catalog_id string, name string, organization string, provider string, identifiers array<struct<namespace:string,value:string>>, parameters double, modified_at timestamp, observed_at timestamp")
    rows = entity_match.match(e, r).collect()
    got = {(x.catalog_id, x.entry_id) for x in rows}
    assert len(got & truth) >= 0.97 * len(truth) and not got - truth
    assert all(0 <= x.confidence <= 1 for x in rows) and len({x.catalog_id for x in rows}) == len(rows)
    assert entity_match.match(e.limit(0), r).count() == 0


def test_blocks_hold_recall_at_any_size():
    """A pair at the cosine that the blocks are laid out for is found no less often among millions of entries than among a few."""
    found = lambda bits, tables: 1 - (1 - (2 / 3) ** bits) ** tables
    least = found(6, 32)
    assert entity_match.forest(0) == entity_match.forest(10_000) == (6, 32)
    for size in (100_000, 1_000_000, 10_000_000):
        assert found(*entity_match.forest(size)) >= least - 0.01


def test_blocks_leave_in_stripes(monkeypatch):
    """However many pairs of a block meet, no more than a stripe of them is held, and all of them come once."""
    import numpy as np

    rng = np.random.default_rng(1)
    u = [rng.standard_normal((n, entity_match.DIM)).astype(np.float32) for n in (300, 400)]
    none, size = [np.zeros(len(x), np.int64) for x in u], [np.where(rng.random(len(x)) < 0.5, np.nan, 0.0) for x in u]
    pairs = lambda: [set(zip(*p.tolist())) for p in entity_match._meetings(u, none, size, 3, 6)]
    whole = pairs()
    stripe, held = entity_match._stripe, []
    monkeypatch.setattr(entity_match, "_stripe", lambda *a: held.append(stripe(*a)[0]) or stripe(*a))
    monkeypatch.setattr(entity_match, "AT_ONCE", 1 << 11)
    parts = pairs()
    sizes = [len(x) for x in held if x is not None]
    assert len(set.union(*whole)) > 50_000 and len(sizes) > 10 and max(sizes) < 2 * (1 << 11)
    assert sum(map(len, parts)) == sum(sizes) == len(set.union(*whole)) and set.union(*parts) == set.union(*whole)


def test_vectors_of_a_block_in_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    lists = pa.array([[rng.integers(0, entity_match.VOCABULARY, rng.integers(0, 5)).tolist() for _ in range(3)] for _ in range(200)], pa.list_(pa.list_(pa.int16())))
    model, common = entity_match._start(), rng.random(entity_match.VOCABULARY).astype(np.float32)
    whole = entity_match._vectors(lists, model, common)
    monkeypatch.setattr(entity_match, "TOKENS", 7)
    assert (entity_match._vectors(lists, model, common) == whole).all() and (entity_match._vectors(lists.slice(0, 0), model, common).shape == (0, 3, entity_match.DIM))


@pytest.mark.parametrize("tile", [1 << 18, 9])
def test_blocks_in_place(spark, monkeypatch, tile):
    """Candidates are exactly the pairs that have the signs of a table in common, however the classes are cut into tiles, and what
    moves doesn't grow with the tables."""
    import numpy as np

    monkeypatch.setattr(entity_match, "TILE", tile)
    monkeypatch.setattr(entity_match, "AT_ONCE", 1 << (21 if tile > 9 else 6))
    rng = random.Random(3)
    base = ["".join(rng.choice("bdgk") + rng.choice("aeiou") for _ in range(4)) for _ in range(12)]
    slip = lambda w: "".join(rng.choice("xyz") if rng.random() < 0.25 else c for c in w)
    rows = [(k % 2, f"n{k}", sorted({slip(rng.choice(base)) for _ in range(rng.randrange(1, 4))}), rng.choice(["va", "vb", None]), [f"pp-{rng.randrange(9)}"][: rng.randrange(2)], 1 + (k % 12 == 0), rng.choice([None, 100.0, 105.0, 111.0, 119.0]), "base") for k in range(160)] + [(0, "long", ["q" * 4000], None, [], 1, None, "base")]
    sides = spark.createDataFrame(rows, entity_match.SIDE)
    model, common = entity_match._start(), np.ones(entity_match.VOCABULARY, np.float32)
    bits, tables = 9, 12
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)
    centred = unit(model) - unit(model).mean(0)
    planes = np.random.default_rng(5).standard_normal((entity_match.DIM, tables * bits)).astype(np.float32)
    held = {}
    for r in entity_match.by_family(sides).collect():
        parts = np.array([unit(centred[a].mean(0)) if a else np.zeros(entity_match.DIM) for a in r.attributes])
        signs = ((parts * np.array([3, 1, 1])[:, None]).sum(0) @ planes > 0).reshape(tables, bits)
        held.setdefault((r.side, r.id), []).append((r.families[0], parts * entity_match.WEIGHTS[:, None], signs))
    of = {(r[0], r[1]): r for r in rows}
    same = lambda a, b: a[5] == b[5] and a[7] == b[7] and ((a[6] is None) == (b[6] is None)) and (a[6] is None or max(a[6], b[6]) / min(a[6], b[6]) <= entity_match.SIZE_SLACK)
    want = {}
    for r in (k for k in held if k[0] == 1):
        for e in (k for k in held if k[0] == 0):
            if same(of[r], of[e]) and any((x[2] == y[2]).all(1).any() and edit(x[0], y[0]) <= entity_match.EDITS for x in held[r] for y in held[e]):
                want[r[1], e[1]] = max((x[1] * y[1]).sum() for x in held[r] for y in held[e])
    ids = sides.select("id", F.xxhash64("id").alias("no"))
    name = {x.no: x.id for x in ids.collect()}
    written = lambda: sum(x.totalShuffleWrite() for x in (lambda s: [s.apply(i) for i in range(s.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    moved = []
    for n in (tables, 16 * tables):
        before = written()
        got = {(name[x.r], name[x.e]): x.nearest for x in entity_match.candidates(sides, model, common, bits, n).collect()}
        moved.append(written() - before)
        if n == tables:
            assert got.keys() == want.keys() and len(want) > 50 and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    assert 0 < moved[1] < 2 * moved[0]
    assert entity_match.candidates(sides.where("side = 0"), model, common, bits, tables).count() == 0
