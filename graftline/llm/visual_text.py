"""One consistent form for texts that look the same but are written with different characters.

Texts are taken apart into positioned pieces: a code point together with the combining marks behind it, or a run of code
points that no mapping touches (plain ASCII), which stays one piece. Pieces of one code point are joined to a broadcast
table of their consistent form; pieces with marks are exploded to positioned code points, joined to the broadcast
decomposition and look-alike tables, their marks ordered by combining class, recomposed and joined back as a broadcast table
if their count is within ``MARKED_BOUND`` (else by shuffle). Pieces are then put together again in order.

Hangul written in single letters is put together to syllables by a broadcast table of all 11,172, made by rule.

What is made equal: invisible characters (dropped), spacing (a run becomes one space), wide and narrow forms, ligatures,
composed and decomposed letters, look-alike letters of other scripts, look-alike hyphens. Letter case, digits, accents,
superscripts and everything else stays.

Nulls: a null text keeps a null form and pairs with nothing; an empty text stays empty. Every row gets its own form, repeated
rows included. Documents without an id are in no pair. Empty tables give empty results.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.session import Scratch
from graftline.skew import hot_join

# Code points that show nothing (soft hyphen, joiners, direction marks, variation selectors, fillers, tags).
INVISIBLE = r"[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E0FFF}]"
# Spacing of any kind, line ends included.
SPACING = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
# Letters of other scripts and hyphens, and what they look like.
LOOK_ALIKE_FROM = "аеорсухіѕјһԁԛԝѵӏАВЕКМНОРСТУХІЅЈԌѴӀΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳϹͿ‐‑‒–⁃−˗﹘"
LOOK_ALIKE_TO = "aeopcyxisjhdqwvlABEKMHOPCTYXISJGVlABEZHIKMNOPTYXocjCJ--------"
#: Distinct pieces with combining marks that may be broadcast: at 100 bytes each, 10 MB.
MARKED_BOUND = 100_000


def _fold(cp: str) -> str:
    """The consistent form of one code point: canonical decomposition, wide forms and ligatures undone, look-alikes mapped,
    recomposed."""
    out = []
    for ch in unicodedata.normalize("NFD", cp):
        tag, _, parts = unicodedata.decomposition(ch).rpartition("> ")
        ligature = tag.startswith("<compat") and unicodedata.category(ch)[0] == "L" and len(parts.split()) > 1
        if tag.startswith(("<wide", "<narrow")) or ligature:
            out.extend(unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in parts.split())))
        else:
            out.append(ch)
    return "".join(_alike().get(ch, ch) for ch in out)


@lru_cache(1)
def _alike() -> dict[str, str]:
    return dict(zip(LOOK_ALIKE_FROM, LOOK_ALIKE_TO))


@lru_cache(1)
def _tables() -> tuple[list, list, list]:
    """(cp, decomposed, consistent) for code points that change, (mark, class), (pair, composed): all from Unicode's rules."""
    changes, classes, pairs = [], [], []
    for n in range(0x80, 0x30000):
        if 0xD800 <= n < 0xE000 or 0xAC00 <= n < 0xD7A4:
            continue
        ch = chr(n)
        if unicodedata.category(ch) in ("Cn", "Co"):
            continue
        folded = _fold(ch)
        composed = unicodedata.normalize("NFC", folded)
        if folded != ch or composed != ch:
            changes.append((ch, folded, composed))
        if unicodedata.combining(ch):
            classes.append((ch, unicodedata.combining(ch)))
        d = unicodedata.normalize("NFD", ch)
        if len(d) > 1 and unicodedata.normalize("NFC", d) == ch:
            short = unicodedata.normalize("NFC", d[:-1])
            if len(short) == 1 and unicodedata.normalize("NFC", short + d[-1]) == ch:
                pairs.append((short + d[-1], ch))
    return changes, classes, pairs


@lru_cache(1)
def _syllables() -> list[tuple[str, str]]:
    """(sequence, syllable): Hangul syllables taken apart to letters, or to a syllable and its last letter."""
    found = []
    for n in range(0xAC00, 0xD7A4):
        parts = unicodedata.normalize("NFD", chr(n))
        found.append((parts, chr(n)))
        if len(parts) == 3:
            found.append((unicodedata.normalize("NFC", parts[:2]) + parts[2], chr(n)))
    return found


#: A Hangul syllable in letters, or a syllable and a last letter.
HANGUL = r"(?:[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?|[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}])"


def _recompose(parts: Column) -> Column:
    """Canonical composition of an ordered array of (class, code point), the first of which is the base."""
    _, _, pairs = _tables()
    known = F.map_from_arrays(F.lit([p for p, _ in pairs]), F.lit([c for _, c in pairs]))
    start = F.struct(parts[0]["cp"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(acc, x):
        joined = F.try_element_at(known, F.concat(acc["base"], x["cp"]))
        fits = joined.isNotNull() & ((acc["rest"] == "") | (acc["last"] < x["ccc"]))
        return F.struct(F.when(fits, joined).otherwise(acc["base"]).alias("base"), F.when(fits, acc["rest"]).otherwise(F.concat(acc["rest"], x["cp"])).alias("rest"), F.when(fits, acc["last"]).otherwise(x["ccc"]).cast("int").alias("last"))

    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda acc: F.concat(acc["base"], acc["rest"]))


def _marked_forms(spark: SparkSession, marked: DataFrame) -> DataFrame:
    """Distinct pieces with combining marks -> (piece, form): exploded to positioned code points, joined to the tables, marks
    ordered by class (stable by position), recomposed. A piece is one base with its marks; its group is that one piece."""
    changes, classes, _ = _tables()
    folds = F.broadcast(spark.createDataFrame([(c, d) for c, d, _ in changes], "cp string, folded string"))
    ccc = F.broadcast(spark.createDataFrame(classes, "cp string, ccc int"))
    syllables = F.broadcast(spark.createDataFrame(_syllables(), "base string, syllable string"))
    base = marked.select("piece", F.regexp_extract("piece", r"^\P{M}+", 0).alias("base")).join(syllables, "base", "left")
    whole = base.select("piece", F.concat(F.coalesce("syllable", "base"), F.expr("substring(piece, length(base) + 1)")).alias("joined"))
    single = whole.select("piece", F.posexplode(F.split("joined", "")).alias("at", "cp")).where("cp <> ''")
    small = single.join(folds, "cp", "left").select("piece", "at", F.posexplode(F.split(F.coalesce("folded", "cp"), "")).alias("sub", "cp")).where("cp <> ''")
    placed = small.join(ccc, "cp", "left").select("piece", "at", "sub", "cp", F.coalesce("ccc", F.lit(0)).alias("ccc"))
    whole = placed.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("ccc", "at", "sub", "cp"))).alias("parts"))
    return whole.select("piece", _recompose(F.col("parts")).alias("form"))


#: An untouched run (ASCII not followed by a mark), or one code point or Hangul syllable with its marks.
PIECE = rf"[\x00-\x7F]+(?!\p{{M}})|(?:{HANGUL}|[\s\S])\p{{M}}*"


def consistent(rows: DataFrame, text_col: str, out: str = "form", scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with the consistent form of ``text_col`` in ``out``; texts of plain ASCII only have their spacing evened.

    Further columns are carried through the regrouping of a row's pieces, so pass few and short ones.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "visual")
    changes, _, _ = _tables()
    others = [c for c in rows.columns if c not in (text_col, out)]
    base = rows.select(*others, F.col(text_col).alias("_text"))
    exotic = F.coalesce(F.col("_text").rlike(r"[^\x00-\x7F]"), F.lit(False))
    seen = F.regexp_replace("_text", INVISIBLE, "")
    marked = base.where(F.col("_text").rlike(r"\p{M}")).select(F.explode(F.regexp_extract_all(seen, F.lit(rf"(?:{HANGUL}|\P{{M}})\p{{M}}+"), F.lit(0))).alias("piece")).distinct()
    forms = scratch.cut(_marked_forms(spark, marked), "marked").withColumnRenamed("piece", "marked_piece")
    bounded = forms.limit(MARKED_BOUND + 1).count() <= MARKED_BOUND
    single = F.broadcast(spark.createDataFrame([(c, k) for c, _, k in changes if c != k] + _syllables(), "single_piece string, one string"))
    numbered = base.where(exotic).withColumn("_row", F.monotonically_increasing_id())  # one number a text, before it is taken apart
    pieces = numbered.select(*others, "_row", F.posexplode_outer(F.regexp_extract_all(seen, F.lit(PIECE), F.lit(0))).alias("_pos", "_piece"))
    marks = (F.length("_piece") > 1) & F.substring("_piece", -1, 1).rlike(r"\p{M}")
    pieces = pieces.withColumn("single_piece", F.when((F.length("_piece") <= 3) & ~marks, F.col("_piece"))).withColumn("marked_piece", F.when(marks, F.col("_piece")))
    known = pieces.join(single, "single_piece", "left").join(F.broadcast(forms) if bounded else forms, "marked_piece", "left")
    whole = known.groupBy("_row").agg(*[F.first(c).alias(c) for c in others], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("form", "one", "_piece").alias("s")))), lambda x: x["s"]), "").alias("_whole"))
    even = lambda c: F.regexp_replace(c, SPACING, " ")
    return base.where(~exotic).select(*others, even("_text").alias(out)).unionByName(whole.select(*others, even(F.coalesce("_whole", F.lit(""))).alias(out)))


def look_alikes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(left_id, right_id): documents whose texts look the same but aren't the same characters, smaller id first.

    Rows carry only ids and digests. Texts are grouped to classes of equal characters; classes of one form are paired, and
    only then their members, so copies of one text never meet each other, however many there are.
    """
    scratch = scratch or Scratch(docs.sparkSession, "alike")
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.unhex(F.md5(text_col)).alias("raw"), F.col(text_col).alias("text"))
    digests = scratch.cut(consistent(rows, "text", "form", scratch).select("id", "raw", F.unhex(F.md5("form")).alias("form")), "digests")
    classes = digests.groupBy("form", "raw").agg(F.lit(1).alias("one")).select("form", "raw")
    several = classes.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form")
    several = classes.join(several, "form", "left_semi")
    pairs = several.select("form", F.col("raw").alias("raw_a")).join(several.select("form", F.col("raw").alias("raw_b")), "form").where("raw_a < raw_b").select("raw_a", "raw_b")
    members = digests.select("id", "raw")
    left = hot_join(members.select(F.col("raw").alias("raw_a"), F.col("id").alias("a")), pairs, ["raw_a"])
    both = hot_join(left, members.select(F.col("raw").alias("raw_b"), F.col("id").alias("b")), ["raw_b"]).where("a <> b")
    return both.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).distinct()
