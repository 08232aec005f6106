"""Model names in any writing taken apart to family, generation, size and tuning, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graftline.llm import visual_text

# Words for tunings and what they stand for; no tuning and "base" are the same.
TUNINGS = {
    "instruct": "instruct", "instruction": "instruct", "inst": "instruct", "it": "instruct", "chat": "chat", "dialogue": "chat", "dialog": "chat", "code": "code", "coder": "code", "vision": "vision", "visual": "vision", "vl": "vision",
    "embed": "embed", "embedding": "embed", "emb": "embed", "base": "base", "pretrained": "base",
}
# Generations in words or Roman numerals.
GENERATIONS = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "one": "1", "two": "2", "three": "3"}
# Words that say nothing about the model.
FILLERS = ["the", "a", "model", "tuned", "v", "version"]
SIZE = r"(?<![a-z0-9.])(\d+(?:\.\d+)?)[\s_-]*(billion|million|bn|b|m)(?![a-z0-9])"


def plain(c: Column) -> Column:
    """Lower case, invisible characters dropped, wide and look-alike letters mapped, spacing evened, trimmed."""
    changes = [(a, k) for a, _, k in visual_text._tables()[0] if len(k) == 1 and k.isascii()]
    mapped = F.translate(F.regexp_replace(c, visual_text.INVISIBLE, ""), "".join(a for a, _ in changes), "".join(k for _, k in changes))
    return F.lower(F.trim(F.regexp_replace(mapped, visual_text.SPACING, " ")))


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def parse(c: Column) -> Column:
    """struct(family, maker, generation, size_m, tuning, has_tuning): size in millions, null if not named.

    The family is the last word that is no generation, size, tuning or filler; a word before it is taken for a maker.
    """
    text = F.regexp_replace(plain(c), r"\([^)]*\)", " ")
    amount = F.nullif(F.regexp_extract(text, SIZE, 1), F.lit("")).try_cast("double")
    unit = F.regexp_extract(text, SIZE, 2)
    size = F.round(F.when(unit.startswith("m"), amount).otherwise(amount * 1000)).cast("bigint")
    words = F.split(F.regexp_replace(F.regexp_replace(text, SIZE, " "), r"([a-z])(\d)", "$1 $2"), r"[^\p{L}\p{N}.]+")
    words = F.filter(words, lambda w: (w != "") & ~w.isin(FILLERS))
    generations = F.filter(F.transform(words, lambda w: F.coalesce(F.try_element_at(_lookup(GENERATIONS), w), w)), lambda w: w.rlike(r"^\d{1,3}$"))
    tunings = F.filter(F.transform(words, lambda w: F.try_element_at(_lookup(TUNINGS), w)), lambda w: w.isNotNull())
    rest = F.filter(words, lambda w: ~w.isin(list(TUNINGS)) & ~w.isin(list(GENERATIONS)) & ~w.rlike(r"^[\d.]+$"))
    return F.struct(
        F.try_element_at(rest, F.lit(-1)).alias("family"),
        F.when(F.size(rest) > 1, F.element_at(rest, 1)).alias("maker"),
        F.coalesce(F.try_element_at(generations, F.lit(1)).cast("int"), F.lit(1)).alias("generation"),
        size.alias("size_m"),
        F.coalesce(F.try_element_at(tunings, F.lit(1)), F.lit("base")).alias("tuning"),
        (F.size(tunings) > 0).alias("has_tuning"),
    )
