"""Queries of the scalar functions, over whole tables."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import functions as F

from weft.functions import similarity as sim
from weft.functions import text
from weft.plans.runtime import table

R = "records_normalised"
SP = r"[\s\p{Z}]"


# DuckDB forms of the text functions


def STRIP(x):
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def WORDS(x):
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{SP}+'), lambda x: x <> '')"


def TOKENS(x):
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"


def LIST(x, separator):
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), '{separator}'), lambda x: {STRIP('x')}), lambda x: x <> '')"


def STRIP_ID(x):
    return STRIP(rf"regexp_replace({x}, '{SP}*\([0-9]{{6,20}}\)', '', 'g')")


def SAFE(x):
    return f"CASE WHEN {x} IS NULL OR lower({STRIP(x)}) IN ('nan', 'none') THEN '' ELSE {x} END"


#: Full-width forms and mathematical letters with the single letters they stand for, and ligatures.
_ODD = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in (*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0xFB00, 0xFB07))]
_WIDE, _NARROW = ("".join(x[i] for x in _ODD if len(x[1]) == 1 and x[0] != x[1]).replace("'", "''") for i in (0, 1))
_LIGATURES = [x for x in _ODD if len(x[1]) > 1]


def NORMALISED(x, collapse=True):
    """Compatibility form (of full-width forms and spaces, all that the tables have), lower case, single
    spaces, with ``collapse`` single ASCII punctuation marks."""
    out = f"translate(coalesce({x}, ''), '{_WIDE}', '{_NARROW}')"
    for ligature, letters in _LIGATURES:
        out = f"replace({out}, '{ligature}', '{letters}')"
    out = STRIP(f"regexp_replace(lower(nfc_normalize({out})), '{SP}+', ' ', 'g')")
    for mark in string.punctuation.replace("_", "") if collapse else "":
        quoted = "''" if mark == "'" else mark
        out = f"regexp_replace({out}, '[{chr(92) if mark in '^]' + chr(92) else ''}{quoted}]{{2,}}', '{chr(92) * 2 if mark == chr(92) else quoted}', 'g')"
    return out


def distinct_list(x):
    """In first-seen order."""
    return f"list_transform(list_filter(list_transform({x}, lambda x, i: {{'x': x, 'i': i}}), lambda s: list_position({x}, s.x) = s.i), lambda s: s.x)"


def JACCARD(a, b):
    both = f"len(list_distinct(list_concat(coalesce({a}, []), coalesce({b}, []))))"
    return f"CASE WHEN {both} > 0 THEN len(list_intersect(coalesce({a}, []), coalesce({b}, []))) / {both} ELSE 0.0 END"


KEY = ["source_file", "row_id_in_file"]


def _records(*columns):
    def run(spark, sf_dir):
        return table(spark, sf_dir, R).select(*KEY, *(c() if callable(c) else c for c in columns))

    return run


def _records_sql(*columns: str) -> str:
    return f"SELECT source_file, row_id_in_file, {', '.join(columns)} FROM {R}"


def _joined(array, name):
    return F.array_join(array, "|").alias(name)


_ACRONYM_SQL = (
    "list_filter(list_transform(list_concat(flatten(list_transform(regexp_extract_all(coalesce(\"Affiliations\", ''), '[(\\[](.*?)[)\\]]', 1), "
    "lambda x: regexp_split_to_array(x, '[\\s\\p{Z},;./\\\\|]+'))), "
    "regexp_split_to_array(coalesce(\"Affiliations\", ''), '[\\s\\p{Z},;.()\\[\\]{}/\\\\|]+')), "
    "lambda t: regexp_replace(t, '^[-–—]+|[-–—]+$', '', 'g')), "
    "lambda t: regexp_matches(t, '^[A-Z0-9]{3,10}$') AND regexp_matches(t, '[A-Z]') AND NOT regexp_matches(t, '^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$', 'i'))"
)

SIDES = """
WITH one AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY author_instance_id ORDER BY query_frame NULLS FIRST, year_int NULLS FIRST, author_norm NULLS FIRST,
    author_id NULLS FIRST, name_key NULLS FIRST, record_affil_prefix NULLS FIRST, record_id NULLS FIRST, author_pos NULLS FIRST) AS k FROM author_instances) WHERE k = 1),
p AS (SELECT DISTINCT anchor_id, candidate_id FROM candidates_and),
s AS (
  SELECT p.*, a.author_norm AS a_author_norm, c.author_norm AS c_author_norm, a.coauthor_keys AS a_coauthor_keys, c.coauthor_keys AS c_coauthor_keys,
         a.record_affil_prefix AS a_record_affil_prefix, c.record_affil_prefix AS c_record_affil_prefix, a.year_int AS a_year_int, c.year_int AS c_year_int
  FROM p JOIN one a ON a.author_instance_id = p.anchor_id JOIN one c ON c.author_instance_id = p.candidate_id)
"""

def pair_sides(spark, sf_dir):
    from weft.operators.blocking import with_sides
    from weft.operators.mentions import unique_instances

    one = unique_instances(table(spark, sf_dir, "author_instances"))
    pairs = table(spark, sf_dir, "candidates_and").select("anchor_id", "candidate_id").distinct()
    return with_sides(pairs, one, "author_instance_id", ["author_norm", "coauthor_keys", "record_affil_prefix", "year_int"])


def _pairs(**columns):
    def run(spark, sf_dir):
        return pair_sides(spark, sf_dir).select("anchor_id", "candidate_id", *(c().alias(k) for k, c in columns.items()))

    return run


def _pairs_sql(**columns: str) -> str:
    return SIDES + "SELECT anchor_id, candidate_id, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + " FROM s"


def _affil_pairs(spark, sf_dir):
    """Spelling pairs that share their first word, for the organisation measures."""
    s = table(spark, sf_dir, "affil_spellings").select("spelling_id", F.lower("affil_text").alias("t"))
    a, b = s.toDF("a", "ta"), s.toDF("b", "tb")
    return a.join(b, F.split("ta", " ")[0] == F.split("tb", " ")[0]).filter("a < b")


_AFFIL_PAIRS_SQL = """WITH q AS (SELECT spelling_id, lower(affil_text) AS t FROM affil_spellings),
s AS (SELECT x.spelling_id AS a, y.spelling_id AS b, x.t AS ta, y.t AS tb FROM q x JOIN q y ON split_part(x.t, ' ', 1) = split_part(y.t, ' ', 1) AND x.spelling_id < y.spelling_id)
"""


def _embedding_pairs(spark, sf_dir):
    """Neighbouring ids as pairs."""
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", F.round(sim.cosine(F.col("x"), F.col("y")), 6).alias("score"))


_PIPE = 'array_to_string(author_ids_list, \' | \')'

QUERIES = {
    "str01_normalise": (_records(lambda: text.normalise_text(F.col("Title")).alias("title"), lambda: text.normalise_text(F.col("Affiliations")).alias("affiliations")), None),
    "str02_acronyms": (_records(lambda: _joined(text.acronyms(F.col("Affiliations")), "acronyms")), _records_sql(f"array_to_string({distinct_list(_ACRONYM_SQL)}, '|') AS acronyms")),
    "str03_lists": (
        _records(lambda: _joined(text.split_list(F.col("Authors")), "authors"), lambda: F.size(text.split_list(F.col("Affiliations"))).alias("n_affiliations")),
        _records_sql(f"array_to_string({LIST('\"Authors\"', ';')}, '|') AS authors", f"CAST(len({LIST('\"Affiliations\"', ';')}) AS INTEGER) AS n_affiliations"),
    ),
    "str04_strip_ids": (
        _records(
            lambda: text.strip_numeric_id(F.col("Author full names")).alias("numeric"), lambda: text.strip_any_id(F.col("Author full names")).alias("any_length"),
            lambda: text.strip_trailing_id(F.col("Author full names")).alias("trailing"),
        ),
        _records_sql(
            STRIP_ID('"Author full names"') + " AS numeric", STRIP("regexp_replace(\"Author full names\", '\\([0-9]+\\)', '', 'g')") + " AS any_length",
            rf"""regexp_replace("Author full names", '{SP}*\([0-9]+\){SP}*$', '') AS trailing""",
        ),
    ),
    "str07_keys": (
        lambda spark, d: table(spark, d, "author_instances").select(
            "author_instance_id", text.name_key(F.col("author_norm")).alias("name_key"), text.first_words(F.col("author_norm"), 3).alias("first_words"), text.first_letters(F.col("author_norm"), 12).alias("letters")
        ),
        f"""SELECT author_instance_id, CASE WHEN len({WORDS('author_norm')}) > 0 THEN {WORDS('author_norm')}[-1] || '|' || left({WORDS('author_norm')}[1], 1) ELSE '' END AS name_key,
        array_to_string({WORDS('author_norm')}[1:3], ' ') AS first_words, left(coalesce(author_norm, ''), 12) AS letters FROM author_instances""",
    ),
    "str10_tokens": (
        _records(lambda: _joined(text.tokens(F.col("affiliations_norm")), "tokens"), lambda: _joined(text.token_set(F.col("affiliations_norm")), "token_set")),
        _records_sql(
            f"array_to_string({TOKENS('affiliations_norm')}, '|') AS tokens",
            f"array_to_string({distinct_list('list_filter(' + TOKENS('lower(affiliations_norm)') + ', lambda x: length(x) >= 2)')}, '|') AS token_set",
        ),
    ),
    "str12_label_text": (
        _records(lambda: text.normalise_label_text(F.col("affiliations_norm")).alias("affiliations")),
        _records_sql("CASE WHEN " + NORMALISED("affiliations_norm", False) + " IN ('nan', 'none') THEN '' ELSE " + NORMALISED("affiliations_norm", False) + " END AS affiliations"),
    ),
    "str13_safe": (
        _records(lambda: text.safe_text(F.col("Source title")).alias("safe"), lambda: text.compare_name(F.col("Author full names")).alias("compare")),
        _records_sql(SAFE('"Source title"') + " AS safe", f"regexp_replace(lower({STRIP_ID('(' + SAFE('\"Author full names\"') + ')')}), '{SP}+', ' ', 'g') AS compare"),
    ),
    "str15_pipe_sets": (
        _records(lambda: _joined(text.pipe_set(F.array_join("author_ids_list", " | ")), "people"), lambda: _joined(text.pipe_acronyms(F.array_join("affiliations_acronyms", " | ")), "acronyms")),
        _records_sql(
            f"array_to_string({distinct_list('list_filter(list_transform(string_split(' + SAFE(_PIPE) + ', ' + repr('|') + '), lambda x: ' + STRIP_ID('x') + '), lambda x: x <> ' + repr('') + ')')}, '|') AS people",
            f"array_to_string({distinct_list('list_filter(list_transform(affiliations_acronyms, lambda x: upper(x)), lambda x: x <> ' + repr('') + ')')}, '|') AS acronyms",
        ),
    ),
    "str17_surname": (
        lambda spark, d: table(spark, d, "author_instances").select("author_instance_id", text.surname_initial(F.col("author_norm")).alias("s")).select("author_instance_id", "s.surname", "s.initial"),
        f"""WITH t AS (SELECT author_instance_id, {WORDS("lower(" + STRIP_ID("(" + SAFE("author_norm") + ")") + ")")} AS w FROM author_instances)
        SELECT author_instance_id, CASE WHEN len(w) >= 2 THEN w[-1] ELSE '' END AS surname, CASE WHEN len(w) >= 2 THEN left(w[1], 1) ELSE '' END AS initial FROM t""",
    ),
    "str18_truncate": (
        _records(
            lambda: text.truncate(F.col("Title"), 40).alias("cut"), lambda: text.truncate_dots(F.col("Title"), 40).alias("dots"),
            lambda: text.pipe_join(F.col("author_ids_list"), 2).alias("joined"), lambda: text.truncate_pipe_list(F.array_join("author_ids_list", " | "), 2).alias("more"),
            lambda: text.fallback_flag(F.when(F.col("Year").isNull(), "true").otherwise("false"), F.when(F.col("DOI").isNull(), "True")).alias("flag"),
        ),
        _records_sql(
            "CASE WHEN length(\"Title\") > 40 THEN left(\"Title\", 39) || '…' ELSE \"Title\" END AS cut", "CASE WHEN length(\"Title\") > 40 THEN left(\"Title\", 40) || '...' ELSE \"Title\" END AS dots",
            "CASE WHEN len(author_ids_list) > 2 THEN array_to_string(author_ids_list[1:2], ' | ') || ' | …' ELSE array_to_string(author_ids_list, ' | ') END AS joined",
            "CASE WHEN len(author_ids_list) > 2 THEN array_to_string(author_ids_list[1:2], ' | ') || ' ... (+' || (len(author_ids_list) - 2) || ' more)' ELSE array_to_string(author_ids_list, ' | ') END AS more",
            "CASE WHEN \"Year\" IS NULL AND \"DOI\" IS NULL THEN 'true (anchor+candidate)' WHEN \"Year\" IS NULL THEN 'true (anchor)' WHEN \"DOI\" IS NULL THEN 'true (candidate)' ELSE 'false' END AS flag",
        ),
    ),
    "str23_labels": (
        lambda spark, d: table(spark, d, "routing_log_and").select(
            "run_id", "anchor_id", "candidate_id", "timestamp", text.label_class(F.col("label_final")).alias("label"), text.split_class(F.when(F.col("retry_count") == 0, " Dev").when(F.col("retry_count") == 1, "TEST ").otherwise(F.col("reason_code"))).alias("split"),
            text.label_code(F.col("retry_count").cast("string")).alias("code"), text.pretty(F.col("reason_code")).alias("pretty"), text.tex_escape(F.col("reason_code")).alias("tex"),
        ),
        f"""SELECT run_id, anchor_id, candidate_id, timestamp,
        CASE WHEN k IN ('match', 'same', 'positive', 'yes', '1') THEN 'match' WHEN k IN ('non-match', 'nonmatch', 'different', 'negative', 'no', '0') THEN 'non-match'
             WHEN k IN ('uncertain', 'unsure', 'skip', 'abstain') THEN 'uncertain' ELSE '' END AS label,
        CASE retry_count WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE '' END AS split, CASE WHEN retry_count IN (0, 1, 2) THEN CAST(retry_count AS VARCHAR) END AS code,
        array_to_string(list_transform(string_split(replace(reason_code, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS pretty, replace(reason_code, '_', '\\_') AS tex
        FROM (SELECT *, lower({STRIP("coalesce(label_final, '')")}) AS k FROM routing_log_and)""",
    ),
    "str26_redact": (
        _records(lambda: text.redact_key(F.concat(F.lit("key sk-ant-"), F.coalesce("record_id", F.lit("")), F.lit(" end"))).alias("redacted")),
        _records_sql("regexp_replace('key sk-ant-' || coalesce(record_id, '') || ' end', 'sk-ant-[A-Za-z0-9\\-_]{10,}', '[REDACTED]', 'g') AS redacted"),
    ),
    "str27_int": (
        _records(lambda: text.safe_int(F.col("Year")).alias("year"), lambda: text.safe_int(F.col("Cited by")).alias("cited")),
        _records_sql(*(
            f"CASE WHEN TRY_CAST({STRIP(c)} AS DOUBLE) = floor(TRY_CAST({STRIP(c)} AS DOUBLE)) AND abs(TRY_CAST({STRIP(c)} AS DOUBLE)) < 2147483648 "
            f"THEN CAST(TRY_CAST({STRIP(c)} AS DOUBLE) AS INTEGER) END AS {n}" for c, n in (('"Year"', "year"), ('"Cited by"', "cited"))
        )),
    ),
    "str28_sha": (_records(lambda: text.sha(F.col("EID")).alias("record_hash")), _records_sql("sha256(coalesce(\"EID\", '')) AS record_hash")),
    "sim01_jaccard": (
        _pairs(coauthors=lambda: F.round(sim.jaccard(F.col("a_coauthor_keys"), F.col("c_coauthor_keys")), 6), tokens=lambda: F.round(sim.jaccard(text.tokens(F.col("a_author_norm")), text.tokens(F.col("c_author_norm"))), 6)),
        _pairs_sql(coauthors=f"round({JACCARD('a_coauthor_keys', 'c_coauthor_keys')}, 6)", tokens=f"round({JACCARD(TOKENS('a_author_norm'), TOKENS('c_author_norm'))}, 6)"),
    ),
    "sim02_ratios": (
        _pairs(
            ratio=lambda: F.round(sim.ratio(F.col("a_author_norm"), F.col("c_author_norm")), 6), token_sort=lambda: F.round(sim.token_sort_ratio(F.col("a_author_norm"), F.col("c_author_norm")), 6),
            token_set=lambda: F.round(sim.token_set_ratio(F.col("a_author_norm"), F.col("c_author_norm")), 6),
        ),
        None,
    ),
    "sim05_and_context": (
        _pairs(score=lambda: F.round(sim.and_context_score("a_", "c_"), 6)),
        _pairs_sql(score=f"round(0.35 * ({JACCARD('a_coauthor_keys', 'c_coauthor_keys')}) + 0.10 * CASE WHEN a_record_affil_prefix <> '' AND a_record_affil_prefix = c_record_affil_prefix THEN 1.0 ELSE 0.0 END, 6)"),
    ),
    "sim05_and_score": (_pairs(score=lambda: F.round(sim.and_score("a_", "c_"), 6)), None),
    "sim06_ain_score": (
        lambda spark, d: _affil_pairs(spark, d).select("a", "b", F.col("ta").alias("a_affil_norm"), F.col("tb").alias("c_affil_norm"), F.array(F.split("ta", " ")[0]).alias("a_affil_acronyms"), F.array(F.split("tb", " ")[1]).alias("c_affil_acronyms"))
        .select("a", "b", F.round(sim.ain_score("a_", "c_"), 6).alias("score")),
        None,
    ),
    "sim06_ain_tokens": (
        lambda spark, d: _affil_pairs(spark, d).select("a", "b", F.round(sim.jaccard(text.tokens(F.col("ta")), text.tokens(F.col("tb"))), 6).alias("score")),
        _AFFIL_PAIRS_SQL + f"SELECT a, b, round({JACCARD(TOKENS('ta'), TOKENS('tb'))}, 6) AS score FROM s",
    ),
    "sim07_deterministic": (
        _pairs(score=lambda: sim.deterministic_and(F.col("a_author_norm"), F.col("c_author_norm"), F.col("a_record_affil_prefix"), F.col("c_record_affil_prefix"))),
        _pairs_sql(score="CASE WHEN a_author_norm <> '' AND a_author_norm = c_author_norm THEN CASE WHEN a_record_affil_prefix <> '' AND a_record_affil_prefix = c_record_affil_prefix THEN 1.0 ELSE 0.5 END ELSE 0.0 END::DOUBLE"),
    ),
    "sim08_deterministic_ain": (
        lambda spark, d: _affil_pairs(spark, d).select("a", "b", sim.equal_filled(F.col("ta"), F.col("tb")).alias("score")),
        _AFFIL_PAIRS_SQL + "SELECT a, b, CASE WHEN ta = tb AND ta <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM s",
    ),
    "sim09_fuzzy_and": (
        _pairs(score=lambda: F.round(sim.fuzzy_and(F.col("a_author_norm"), F.col("c_author_norm"), F.col("a_record_affil_prefix"), F.col("c_record_affil_prefix"), F.col("a_year_int"), F.col("c_year_int")), 6)),
        None,
    ),
    "sim09_year_closeness": (
        _pairs(score=lambda: F.round(sim.year_closeness(F.col("a_year_int"), F.col("c_year_int")), 6)),
        _pairs_sql(score="round(coalesce(greatest(0.0, 1.0 - abs(a_year_int - c_year_int) / 10.0), 0.0), 6)"),
    ),
    "sim10_fuzzy_ain": (
        lambda spark, d: _affil_pairs(spark, d).select("a", "b", F.round(sim.fuzzy_ain(F.col("ta"), F.col("tb"), F.split("ta", " "), F.split("tb", " ")), 6).alias("score")),
        None,
    ),
    "sim12_embedding_cosine": (
        _embedding_pairs,
        """SELECT x.vec_id AS a, round((list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / (sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) * sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])) + 1e-9) + 1) / 2, 6) AS score
        FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1""",
    ),
}
