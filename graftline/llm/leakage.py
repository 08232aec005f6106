"""Evaluation texts leaking into training text, by template canonicalisation.

Words of both sides are replaced by template symbols: numbers, units and names become typed slots, every other word of the
held-out items stays itself. Windows of ``WINDOW`` symbols are hashed and joined by their template; the slots decide what a
match means. Both ask that the slots' values map one to one (which words of the window repeat which is part of the key):

* ``leaks``: each slot holds the item's own value, so the document holds those words of the item (the pairs of p8_found);
* ``reparameterised``: over ``LONG_TEMPLATE`` words the slots hold other values than any item has there, as in a question
  asked again with other names and numbers. A document is paired with every item of the template.

A word with a digit is a number. Units are the listed ones and words that the items write mostly behind numbers. Names are
words that the items write with a capital wherever they stand inside a sentence, and all words that no item holds. What a word
is depends on the word alone, so equal words are equal symbols on both sides whatever the typing makes of them.

Items are read, counted and joined as tables; what comes of them to the driver and goes to all executors are 64-bit hashes of
their template words and units (no names, no numbers: 8 bytes for each word of their language) and a map of ``TEMPLATE_BITS``
bits of the templates of their windows, by which windows that no item has are left out before the shuffle. A bit set by another
template lets a window through to the join that finds no partner; it loses nothing. Texts are read whole, in Arrow batches.

Letter case, punctuation, markup, spacing, line breaks, invisible characters, wide and look-alike letters, ligatures and the
composition of letters are set aside.

Nulls: null and empty texts, and items shorter than the window, hold no passage. Repeated rows count once. Further columns
are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.llm import visual_text
from graftline.session import Scratch
from graftline.skew import hot_join

WINDOW, LONG_TEMPLATE = 12, 24
TEMPLATE_BITS, SLICE = 1 << 25, 1 << 15
# Units of measure, beside those that the items' use shows.
UNITS = {
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "mile", "miles", "foot", "feet", "inch", "inches", "gram", "grams", "kilogram", "kilograms",
    "ton", "tons", "liter", "liters", "litre", "litres", "degree", "degrees", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "byte", "bytes", "unit", "units", "token", "tokens", "point", "points", "step", "steps", "km", "cm", "mm", "kg", "mg", "ml", "gb", "mb", "kb", "ms", "hz",
}
_MARKUP = re.compile(r"</?[a-zA-Z!?][^<>]*>|&(?:[a-zA-Z]{2,8}|#\d{1,6});")
_WORD = re.compile(r"[^\W_]+")
_EXOTIC = re.compile(r"[^\x00-\x7f]+")
_INVISIBLE = re.compile("[\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]+")
_INSIDE = re.compile(r"(?<=[a-z,;] )([^\W_]+)")
NUMBER, UNIT, NAME = 1, 2, 3


def _table() -> dict[int, str]:
    return {ord(c): k for c, _, k in visual_text._tables()[0]}


def words(text: str, table: dict[int, str]) -> list[str]:
    """Lower-case words of a text in its consistent form, markup set aside."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFC", _EXOTIC.sub(lambda m: unicodedata.normalize("NFC", m[0]).translate(table), text))
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text.lower())


def _is_number(word: str) -> bool:
    return any(c.isdigit() for c in word)


def word_uses(items: DataFrame) -> DataFrame:
    """(word, n, inside, capital, behind): how often the items hold a word, inside a sentence, there with a capital, and behind a
    number. Numbers are left out, as they are known by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        for b in batches:
            use: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
            for text in b.column(0).to_pylist():
                before = ""
                for w in words(text, table):
                    use[w][0] += 1
                    use[w][3] += _is_number(before)
                    before = w
                for m in _INSIDE.finditer(text):
                    for w in words(m[1], table):
                        use[w][1] += 1
                        use[w][2] += m[1][0].isupper()
            use = {w: u for w, u in use.items() if not _is_number(w)}
            yield pa.RecordBatch.from_arrays([pa.array(list(use), pa.string()), *[pa.array([u[k] for u in use.values()], pa.int64()) for k in range(4)]], ["word", "n", "inside", "capital", "behind"])

    rows = items.select("text").mapInArrow(run, "word string, n bigint, inside bigint, capital bigint, behind bigint")
    return rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "inside", "capital", "behind")])


def bit_map(hashes: DataFrame, bits: int) -> np.ndarray:
    """A map of ``bits`` bits, packed, with those of ``hashes`` (one bigint column) set; bits / SLICE rows come to the driver."""

    def pack(t: pa.Table) -> pa.Table:
        held = np.zeros(SLICE, np.uint8)
        held[t.column("at").to_numpy() % SLICE] = 1
        return pa.table({"slice": t.column("slice")[:1], "held": pa.array([np.packbits(held).tobytes()], pa.binary())})

    at = hashes.select(F.pmod(F.col(hashes.columns[0]), F.lit(bits)).alias("at")).distinct().withColumn("slice", F.floor(F.col("at") / SLICE))
    out = np.zeros((bits // SLICE, SLICE // 8), np.uint8)
    for r in at.groupBy("slice").applyInArrow(pack, "slice bigint, held binary").collect():
        out[r.slice] = np.frombuffer(r.held, np.uint8)
    return out.ravel()


def _held(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` (uint64) have their bit set; the number of bits is a power of two, so pmod of the signed number is this."""
    at = hashes & np.uint64(len(packed) * 8 - 1)
    return (packed[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1


def _among(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` are in ``known`` (both uint64, ``known`` sorted)."""
    return np.searchsorted(known, hashes, "right") > np.searchsorted(known, hashes)


def typed_words(items: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the items' template words and of their units."""
    uses = scratch.cut(word_uses(items), "uses")
    hashed = uses.select("word", "n", "inside", "capital", "behind", F.xxhash64("word").alias("h"))
    unit = (F.col("behind") >= 2) & (2 * F.col("behind") > F.col("n"))
    name = (F.col("inside") > 0) & (F.col("capital") == F.col("inside"))
    listed = lambda which: np.sort(hashed.where(which).select("h").toArrow().column("h").to_numpy().view(np.uint64))
    return listed(~unit & ~name), listed(unit & ~name)


_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _rolled(codes: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(max(0, len(codes) - width + 1), np.uint64)
    for k in range(width):
        out = out * _MUL + codes[k : k + len(out)]
    return _mix(out)


class Symbols:
    """Words -> (symbol, value): the symbol of a slot is its type, that of a template word its value."""

    def __init__(self, template_words: np.ndarray, units: np.ndarray):
        import xxhash

        self.words, self.units, self.seen, self.hash = template_words, units, {}, xxhash.xxh64_intdigest
        self.table = _table()

    def codes(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        seen = self.seen
        if len(seen) > 2_000_000:
            seen.clear()
        new = [w for w in dict.fromkeys(ws) if w not in seen]
        if new:
            value = np.array([self.hash(w.encode(), 42) for w in new], np.uint64)  # Spark's xxhash64 of a string
            kind = np.where(_among(self.words, value), value, NAME)
            kind = np.where(_among(self.units, value) | np.array([w in UNITS for w in new]), UNIT, kind)
            kind = np.where([_is_number(w) for w in new], NUMBER, kind)
            seen.update(zip(new, zip(kind.tolist(), value.tolist())))
        both = np.array([seen[w] for w in ws], np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _windows(texts: pa.Array, wanted: np.ndarray | None, symbols: Symbols, width: int):
    """Windows of a batch: (row number, template, slots and pattern hash), only those whose template may be wanted.

    ``slots`` covers the values of the slots in order; ``pattern`` tells which words of the window repeat which: two windows of
    one template have equal patterns if and only if their slot values map one to one."""
    all_words: list[str] = []
    counts = []
    for t in texts.to_pylist():
        ws = words(t, symbols.table) if t else []
        counts.append(len(ws))
        all_words += ws
    sym, val = symbols.codes(all_words)
    row = np.repeat(np.arange(len(counts)), np.array(counts, np.int64))
    template = _rolled(_mix(sym), width)
    ok = row[: len(template)] == row[width - 1 :] if len(template) else np.zeros(0, bool)
    if wanted is not None and len(template):
        ok &= _held(wanted, template)
    keep = np.flatnonzero(ok)
    span = keep[:, None] + np.arange(width)
    values, slot = val[span], sym[span] <= NAME
    slots, pattern = np.zeros(len(keep), np.uint64), np.zeros(len(keep), np.uint64)
    for k in range(width):
        slots = slots * _MUL + np.where(slot[:, k], values[:, k], np.uint64(1))
        pattern = pattern * _MUL + (values[:, : k + 1] == values[:, k : k + 1]).argmax(1).astype(np.uint64)
    return row[keep], template[keep], _mix(slots), _mix(pattern)


def text_windows(texts: DataFrame, maps: tuple, wanted: np.ndarray | None, width: int) -> DataFrame:
    """texts(id, text) -> (id, template, slots, pattern) of every window whose template may be wanted."""
    shared = texts.sparkSession.sparkContext.broadcast((maps, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps_, wanted_ = shared.value
        symbols = Symbols(*maps_)
        for b in batches:
            row, *hashes = _windows(b.column(1), wanted_, symbols, width)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *[pa.array(h.view(np.int64)) for h in hashes]], ["id", "template", "slots", "pattern"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, template bigint, slots bigint, pattern bigint")


def _template_windows(docs: DataFrame, items: DataFrame, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, template, slots, pattern, n) of the documents, only where an item may have the template, and (item_id, template, slots,
    pattern) of the items."""
    held = items.where("item_id is not null and text is not null").select(F.col("item_id").alias("id"), "text").distinct()
    maps = typed_words(held, scratch)
    ours = scratch.cut(text_windows(held, maps, None, width).distinct(), "items").withColumnRenamed("id", "item_id")
    theirs = text_windows(docs.where("id is not null and text is not null"), maps, bit_map(ours.select("template"), TEMPLATE_BITS), width)
    return scratch.cut(theirs.groupBy("id", "template", "slots", "pattern").agg(F.count(F.lit(1)).alias("n")), "windows"), ours  # read once to count hot ones, once to join


def leaks(docs: DataFrame, items: DataFrame, width: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """docs(id, text), items(item_id, text) -> (id, item_id, n_windows): documents that hold ``width`` words of the item: windows of
    one template whose slots map one to one and to the item's own values."""
    theirs, ours = _template_windows(docs, items, width, scratch or Scratch(docs.sparkSession, "leaks"))
    return hot_join(theirs, ours, ["template", "pattern", "slots"]).groupBy("id", "item_id").agg(F.sum("n").alias("n_windows"))


def reparameterised(docs: DataFrame, items: DataFrame, width: int = LONG_TEMPLATE, scratch: Scratch | None = None) -> DataFrame:
    """(id, item_id, n_windows): documents and every item of whose template they have windows with slots that map one to one to
    the item's but hold other values than any item has there."""
    theirs, ours = _template_windows(docs, items, width, scratch or Scratch(docs.sparkSession, "leaks"))
    copied = ours.select("template", "slots").distinct()
    other = theirs.join(copied, ["template", "slots"], "left_anti").groupBy("id", "template", "pattern").agg(F.sum("n").alias("n"))
    return hot_join(other, ours.select("item_id", "template", "pattern").distinct(), ["template", "pattern"]).groupBy("id", "item_id").agg(F.sum("n").alias("n_windows"))
