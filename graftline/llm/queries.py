"""Queries of the problems tagged llm over the test tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.llm import canonical_list, entity_match, leakage, mixing, names, similar_sets, visual_text
from graftline.session import Scratch
from graftline.tables import current_rows, load


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    found = visual_text.look_alikes(load(spark, sf, "documents").select("doc_id", "text"))
    return found.select(F.col("left_id").alias("left_doc_id"), F.col("right_id").alias("right_doc_id"))


def p10_forms(spark: SparkSession, sf: str) -> DataFrame:
    return visual_text.consistent(load(spark, sf, "documents").select("doc_id", "text"), "text", "form")


def p1_matches(spark: SparkSession, sf: str) -> DataFrame:
    entries = current_rows(load(spark, sf, "entries").select("id", "modified_at", "canonical_name", "aliases", "identifiers", "members"), "id", "modified_at")
    return entity_match.match(entries, load(spark, sf, "catalog_records"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_matches(spark, sf).select("catalog_id", "entry_id")


def _name_only(spark: SparkSession, sf: str) -> DataFrame:
    """source_record_id, name: relations of current rows without an entry id."""
    entries = current_rows(load(spark, sf, "entries").select("id", "modified_at", "model_relations"), "id", "modified_at")
    rel = entries.select(F.explode("model_relations").alias("r"))
    return rel.where("r.target.entry_id is null or trim(r.target.entry_id) = ''").select("r.source_record_id", F.col("r.target.name").alias("name"))


def _curated(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "curated_entries").select(F.col("id").alias("ref_id"), F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    free = _name_only(spark, sf)
    return free.join(canonical_list.match(free, _curated(spark, sf)), "name").select("source_record_id", F.col("ref_id").alias("curated_id")).distinct()


def p2_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    free = _name_only(spark, sf)
    return canonical_list.unmatched(free, canonical_list.match(free, _curated(spark, sf))).select("source_record_id", "name").distinct()


def _character(df: DataFrame):
    """A character's id in one form: computed from generator, radius and signature where these are there, else as given."""
    tidy = lambda c: F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"^([a-z0-9-]+:|0x)", ""), F.lit(""))
    parameters = F.when(F.col("radius").isNull(), F.lit("{}")).otherwise(F.concat(F.lit('{"radius":'), F.col("radius").cast("string"), F.lit("}")))
    text = F.concat(F.lit('{"generator":"'), F.col("generator"), F.lit('","parameters":'), parameters, F.lit(',"structural_signature":"'), tidy("structural_signature"), F.lit('"}'))
    return F.coalesce(F.sha2(text, 256), tidy("character_id"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    profiles = load(spark, sf, "profile_characters")
    return similar_sets.similar_pairs(profiles, "model_id", _character(profiles)).select("left_id", "right_id")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(_documents(spark, sf), load(spark, sf, "eval_items")).select(F.col("id").alias("doc_id"), "item_id")


def p8_reparameterised(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.reparameterised(_documents(spark, sf), load(spark, sf, "eval_items")).withColumnRenamed("id", "doc_id")


def _counted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents of the mix's sources with their tokens and topic, the tuning of the curated model that a document is about; and
    the targets. The tokenizer's vocabulary file may be named in ``spark.graftline.tokenizer``."""
    curated = load(spark, sf, "curated_entries").select(F.col("id").alias("subject_id"), F.coalesce(F.try_element_at("tags", F.lit(2)), F.lit("base")).alias("topic"))
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "lang", "subject_id", "text")
    targets = load(spark, sf, "mix_targets")
    wanted = docs.join(targets.select("source"), "source", "left_semi")
    counted = Scratch(spark, "mix").cut(mixing.token_counts(wanted, "text", spark.conf.get("spark.graftline.tokenizer", mixing.TOKENIZER)), "counted")
    return counted.join(curated, "subject_id", "left").drop("subject_id"), targets


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(*_counted(spark, sf)).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, sf), load(spark, sf, "mix_targets"))


def p9_margins(spark: SparkSession, sf: str) -> DataFrame:
    docs, targets = _counted(spark, sf)
    return mixing.margins(docs, mixing.mix(docs, targets))


def queries():
    return {f.__name__: f for f in (p1_found, p1_matches, p2_found, p2_unmatched, p4_found, p8_found, p8_reparameterised, p9_mix, p9_shares, p9_margins, p10_found, p10_forms)}


# Letters of other scripts by their Unicode names, and what they look like.
_LOOKS = {
    "CYRILLIC": {"SMALL": {"A": "a", "IE": "e", "O": "o", "ER": "p", "ES": "c", "U": "y", "HA": "x", "DZE": "s", "BYELORUSSIAN-UKRAINIAN I": "i", "JE": "j", "SHHA": "h", "KOMI DE": "d", "QA": "q", "WE": "w", "IZHITSA": "v"},
                 "CAPITAL": {"A": "A", "VE": "B", "IE": "E", "KA": "K", "EM": "M", "EN": "H", "O": "O", "ER": "P", "ES": "C", "TE": "T", "U": "Y", "HA": "X", "BYELORUSSIAN-UKRAINIAN I": "I", "DZE": "S", "JE": "J", "KOMI SJE": "G", "IZHITSA": "V"}},
    "GREEK": {"SMALL": {"OMICRON": "o"},
              "CAPITAL": {"ALPHA": "A", "BETA": "B", "EPSILON": "E", "ZETA": "Z", "ETA": "H", "IOTA": "I", "KAPPA": "K", "MU": "M", "NU": "N", "OMICRON": "O", "RHO": "P", "TAU": "T", "UPSILON": "Y", "CHI": "X"}},
}


def _looks() -> list[tuple[str, str]]:
    """Letters and signs that DuckDB maps one to one: those of ``_LOOKS``, hyphens, and wide and narrow forms."""
    found = [(unicodedata.lookup(f"{script} {case} LETTER {name}"), to) for script, cases in _LOOKS.items() for case, names in cases.items() for name, to in names.items()]
    found += [(chr(n), "-") for n in (0x2010, 0x2011, 0x2012, 0x2013, 0x2043, 0x2212, 0x2D7, 0xFE58)] + [("\u04cf", "l"), ("\u04c0", "l"), ("\u03f2", "c"), ("\u03f3", "j"), ("\u03f9", "C"), ("\u037f", "J")]
    base = dict(found)
    for n in range(0x370, 0x530):  # letters with marks on a mapped letter
        first, *marks = unicodedata.normalize("NFD", chr(n))
        if marks and first in base and len(k := unicodedata.normalize("NFC", base[first] + "".join(marks))) == 1:
            found.append((chr(n), k))
    forms = [(chr(n), unicodedata.normalize("NFKC", chr(n))) for n in range(0xFF01, 0xFFEF) if unicodedata.decomposition(chr(n)).startswith(("<wide>", "<narrow>"))]
    return found + [(c, k) for c, k in forms if len(k) == 1 and k != "'" and unicodedata.category(c)[0] != "M"]


def _form_sql(column: str) -> str:
    """The same form in DuckDB, from Unicode's names and normal forms: composed, mapped letter by letter, ligatures replaced, composed
    again."""
    one = _looks()
    bare = f"nfc_normalize(regexp_replace({column}, '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'))"
    text = f"replace(translate({bare}, $m$" + "".join(c for c, _ in one) + "$m$, $m$" + "".join(k for _, k in one) + "$m$), chr(65287), chr(39))"
    for n in range(0xFB00, 0xFB07):
        text = f"replace({text}, '{chr(n)}', '{unicodedata.normalize('NFKC', chr(n))}')"
    return f"regexp_replace(nfc_normalize({text}), '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')"


def _words_sql(column: str) -> str:
    bare = f"regexp_replace({_form_sql(column)}, '</?[a-zA-Z!?][^<>]*>|&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g')"
    return f"regexp_extract_all(lower({bare}), '[\\p{{L}}\\p{{N}}]+')"


def _parsed_sql(table: str, carried: str, name: str) -> str:
    """CTEs that take names apart: {table}_p(carried, family, generation, size_m, tuning)."""
    words = lambda t: ", ".join(f"'{x}'" for x in t)
    tuning = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.TUNINGS.items()) + " END"
    generation = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.GENERATIONS.items()) + " ELSE x END"
    size = "(^|[^a-z0-9.])([0-9]+(\\.[0-9]+)?)[\\s_-]*(billion|million|bn|b|m)($|[^a-z0-9])".replace("\\\\", "\\")
    return f"""{table}_a AS (SELECT {carried}, regexp_replace(lower(trim({_form_sql(name)})), '\\([^)]*\\)', ' ', 'g') AS t FROM {table}),
{table}_b AS (SELECT {carried}, TRY_CAST(nullif(regexp_extract(t, '{size}', 2), '') AS DOUBLE) AS amount, regexp_extract(t, '{size}', 4) AS unit,
  list_filter(string_split_regex(regexp_replace(regexp_replace(t, '{size}', '\\1 \\5', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{N}}.]+'), lambda x: x <> '' AND x NOT IN ({words(names.FILLERS)})) AS w FROM {table}_a),
{table}_p AS (SELECT {carried}, list_filter(w, lambda x: x NOT IN ({words(names.TUNINGS)}, {words(names.GENERATIONS)}) AND NOT regexp_full_match(x, '[0-9.]+'))[-1] AS family,
  coalesce(CAST(list_filter(list_transform(w, lambda x: {generation}), lambda x: regexp_full_match(x, '[0-9]{{1,3}}'))[1] AS INTEGER), 1) AS generation,
  coalesce(CAST(round(CASE WHEN starts_with(unit, 'm') THEN amount ELSE amount * 1000 END) AS BIGINT), -1) AS size_m,
  coalesce(list_filter(list_transform(w, lambda x: {tuning}), lambda x: x IS NOT NULL)[1], 'base') AS tuning FROM {table}_b)"""


def _canonical_sql() -> str:
    """CTEs up to best(name, ref_id): the nearest listed name within the edits, by levenshtein over all pairs of one key."""
    edits = lambda c: f"CASE WHEN length({c}) >= 7 THEN 3 WHEN length({c}) = 6 THEN 2 ELSE 0 END"
    letters = lambda c: f"list_sort(string_split({c}, ''))"
    return f"""cur AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_at DESC NULLS LAST) = 1), rel AS (SELECT unnest(model_relations) AS r FROM cur WHERE id IS NOT NULL),
free AS (SELECT r.source_record_id AS record, r.target.name AS name FROM rel WHERE r.target.entry_id IS NULL OR trim(r.target.entry_id) = ''), q AS (SELECT DISTINCT name FROM free WHERE name IS NOT NULL),
ref AS (SELECT id, unnest(list_append(coalesce(aliases, []), canonical_name)) AS name FROM curated_entries WHERE id IS NOT NULL), {_parsed_sql("q", "name", "name")}, {_parsed_sql("ref", "id", "name")},
near AS (SELECT q.name, r.id, min(levenshtein(q.family, r.family)) AS d FROM q_p q JOIN ref_p r USING (generation, size_m, tuning) WHERE levenshtein(q.family, r.family) <= least({edits("q.family")}, {edits("r.family")})
  OR (levenshtein(q.family, r.family) = 4 AND least(length(q.family), length(r.family)) >= 7 AND {letters("q.family")} = {letters("r.family")}) GROUP BY ALL),
best AS (SELECT name, min(id) AS ref_id FROM near n WHERE d = (SELECT min(d) FROM near m WHERE m.name = n.name) GROUP BY name HAVING count(*) = 1)"""


def oracle_sql() -> dict[str, str]:
    window = "unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' ')))"
    tidy = lambda c: f"nullif(regexp_replace(lower(trim({c})), '^([a-z0-9-]+:|0x)', ''), '')"
    return {
        "p2_found": f"WITH {_canonical_sql()} SELECT DISTINCT record AS source_record_id, ref_id AS curated_id FROM free JOIN best USING (name)",
        "p2_unmatched": f"WITH {_canonical_sql()} SELECT DISTINCT record AS source_record_id, name FROM free WHERE name IS NULL OR name NOT IN (SELECT name FROM best)",
        "p4_found": f"""WITH c AS (SELECT DISTINCT model_id AS m, coalesce(sha256('{{"generator":"' || generator || '","parameters":' || CASE WHEN radius IS NULL THEN '{{}}' ELSE '{{"radius":' || radius || '}}' END || ',"structural_signature":"' || {tidy('structural_signature')} || '"}}'), {tidy('character_id')}) AS e FROM profile_characters WHERE model_id IS NOT NULL),
n AS (SELECT m, count(*) AS n FROM c WHERE e IS NOT NULL GROUP BY m), common AS (SELECT a.m AS l, b.m AS r, count(*) AS k FROM c a JOIN c b ON a.e = b.e AND a.m < b.m GROUP BY ALL)
SELECT l AS left_id, r AS right_id FROM common JOIN n x ON l = x.m JOIN n y ON r = y.m WHERE 10 * k >= 7 * (x.n + y.n - k)""",
        "p8_found": f"""WITH i AS (SELECT item_id, {_words_sql('text')} AS w FROM eval_items), d AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
iw AS (SELECT DISTINCT item_id, {window} AS t FROM i WHERE len(w) >= 12), dw AS (SELECT DISTINCT doc_id, {window} AS t FROM d WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM iw JOIN dw USING (t)""",
        "p10_found": f"WITH f AS (SELECT doc_id, text, {_form_sql('text')} AS form FROM documents) SELECT a.doc_id AS left_doc_id, b.doc_id AS right_doc_id FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
        "p10_forms": f"SELECT doc_id, {_form_sql('text')} AS form FROM documents",
    }
