"""Queries of the llm problems and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text
from weft.llm.components import components
from weft.llm import langid, lookalikes, names, packing, tokenizer
from weft.llm.terms import gram_counts, marked
from weft.llm.topn import top_n
from weft.plans.runtime import table

TOP_N = 3


def p2_found(spark, sf_dir):
    c = table(spark, sf_dir, "candidates_and")
    best = top_n(c, "anchor_id", "candidate_id", "pass_priority", "similarity_score", TOP_N)
    return best.select(F.col("group").alias("anchor_id"), "pos", F.col("item").alias("candidate_id"))


P2_SQL = """
WITH best AS (
  SELECT anchor_id, candidate_id, pass_priority, similarity_score,
         row_number() OVER (PARTITION BY anchor_id, candidate_id
                            ORDER BY pass_priority NULLS LAST, similarity_score DESC) AS k
  FROM candidates_and
  WHERE anchor_id IS NOT NULL AND candidate_id IS NOT NULL
    AND similarity_score IS NOT NULL AND NOT isnan(similarity_score)),
placed AS (
  SELECT anchor_id, candidate_id,
         CAST(row_number() OVER (PARTITION BY anchor_id
              ORDER BY pass_priority NULLS LAST, similarity_score DESC, candidate_id) AS INTEGER) AS pos
  FROM best WHERE k = 1)
SELECT anchor_id, pos, candidate_id FROM placed WHERE pos <= 3"""


MIN_RECORDS = 3
MAX_SHARE = 0.05
GRAM_LENGTH = 3


def _field_terms(r):
    """(record_id, field, terms): the acronyms, and the pieces of affiliations_norm between ; and ,
    stripped of U+0020."""
    pieces = F.filter(F.transform(F.split("affiliations_norm", "[;,]", -1), lambda x: F.trim(x)), lambda x: x != "")
    fields = F.array(
        F.struct(F.lit("affiliations_acronyms").alias("field"), F.col("affiliations_acronyms").alias("terms")),
        F.struct(F.lit("affiliations_norm").alias("field"), pieces.alias("terms")),
    )
    return r.select("record_id", F.explode(fields).alias("x")).select("record_id", "x.field", "x.terms")


def _counted(r, max_n):
    """Term counts of both fields in one pass: each term is qualified by its field."""
    terms = _field_terms(r).select("record_id", F.transform("terms", lambda t: F.concat("field", F.lit("\x1f"), t)).alias("terms"))
    counts = marked(gram_counts(terms, "terms", "record_id", max_n), r.agg(F.countDistinct("record_id").alias("n")).scalar(), MIN_RECORDS, MAX_SHARE)
    words = F.transform("gram", lambda t: F.substr(t, F.instr(t, "\x1f") + 1))
    return counts.select(F.substring_index(F.col("gram")[0], "\x1f", 1).alias("field"), words.alias("gram"), "occurrences", "records", "mark")


def _terms(spark, sf_dir):
    return _counted(table(spark, sf_dir, "records_normalised"), 1).withColumn("term", F.col("gram")[0])


def p4_found(spark, sf_dir):
    return _terms(spark, sf_dir).filter("mark is not null").select("field", "term", "mark")


def p4_terms(spark, sf_dir):
    return _terms(spark, sf_dir).select("field", "term", "occurrences", "records", "mark")


def p4_grams(spark, sf_dir):
    counts = _counted(table(spark, sf_dir, "records_normalised"), GRAM_LENGTH)
    return counts.select("field", F.array_join("gram", " | ").alias("gram"), F.size("gram").alias("n"), "occurrences", "records", "mark")


_P4_GRAMS = """
WITH seqs AS (
  SELECT record_id, 'affiliations_acronyms' AS field, list_filter(affiliations_acronyms, lambda x: x IS NOT NULL) AS terms
  FROM records_normalised
  UNION ALL
  SELECT record_id, 'affiliations_norm',
         list_filter(list_transform(regexp_split_to_array(affiliations_norm, '[;,]'), lambda x: trim(x, ' ')), lambda x: x <> '')
  FROM records_normalised),
grams AS (
  SELECT record_id, field, array_to_string(terms[i:i + n - 1], ' | ') AS gram, n
  FROM seqs, range(1, CAST(coalesce(len(terms), 0) + 1 AS BIGINT)) AS t(i), range(1, {n} + 1) AS u(n)
  WHERE i + n - 1 <= len(terms)),
counted AS (
  SELECT field, gram, CAST(n AS INTEGER) AS n, count(*) AS occurrences, count(DISTINCT record_id) AS records
  FROM grams GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN records < 3 THEN 'rare'
                 WHEN records > 0.05 * (SELECT count(DISTINCT record_id) FROM records_normalised) THEN 'common' END AS mark
  FROM counted)
"""

P4_FOUND_SQL = _P4_GRAMS.format(n=1) + "SELECT field, gram AS term, mark FROM marked WHERE mark IS NOT NULL"
P4_TERMS_SQL = _P4_GRAMS.format(n=1) + "SELECT field, gram AS term, occurrences, records, mark FROM marked"
P4_GRAMS_SQL = _P4_GRAMS.format(n=GRAM_LENGTH) + "SELECT field, gram, n, occurrences, records, mark FROM marked"


_OUTER = " \t\r\n\u00a0"


def p5_found(spark, sf_dir):
    log = table(spark, sf_dir, "routing_log_and")
    return components(log, "anchor_id", "candidate_id", F.lower(F.btrim("label_final", F.lit(_OUTER))) == "match")


P5_SQL = f"""
WITH RECURSIVE links AS (
  SELECT DISTINCT anchor_id AS a, candidate_id AS b FROM routing_log_and
  WHERE lower(trim(label_final, '{_OUTER}')) = 'match' AND anchor_id IS NOT NULL AND candidate_id IS NOT NULL),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
nodes AS (SELECT anchor_id AS n FROM routing_log_and WHERE anchor_id IS NOT NULL
          UNION SELECT candidate_id FROM routing_log_and WHERE candidate_id IS NOT NULL),
reach(a, b) AS (SELECT n, n FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT min(b) AS group_id, a AS node_id FROM reach GROUP BY a"""


def p7_ids(spark, sf_dir):
    return tokenizer.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_roundtrip(spark, sf_dir):
    """Documents whose ids don't decode to their text; none are expected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("original"))
    decoded = tokenizer.decode(tokenizer.encode(docs, "doc_id", "original"), "doc_id", "ids")
    return docs.join(decoded, "doc_id", "full").filter(~F.col("original").eqNullSafe(F.col("text"))).select("doc_id")


CAPACITY = 2048


def p8_pack(spark, sf_dir):
    sizes = tokenizer.sizes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p8_violations(spark, sf_dir):
    """Containers of ``p8_pack`` with a gap, an overlap or too many tokens, documents that fit but are split or
    have lost tokens: none is expected."""
    docs = table(spark, sf_dir, "documents")
    placed = p8_pack(spark, sf_dir)
    inside = placed.filter("container is not null").groupBy("container").agg(F.sum("length").alias("used"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("first"), F.countDistinct("offset").alias("starts"), F.count(F.lit(1)).alias("n"))
    bad = inside.filter((F.col("used") != F.col("end")) | (F.col("end") > CAPACITY) | (F.col("first") != 0) | (F.col("starts") != F.col("n"))).select(F.col("container").alias("what"))
    sizes = tokenizer.sizes(docs, "doc_id", "text")
    whole = placed.groupBy("doc_id").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("parts"), F.max(F.col("start") + F.col("length")).alias("end"))
    split = sizes.join(whole, "doc_id", "full").filter(
        ~F.col("n_tokens").eqNullSafe(F.col("length")) | ~F.col("n_tokens").eqNullSafe(F.col("end")) | (F.col("parts") > F.greatest(F.ceil(F.col("n_tokens") / CAPACITY), F.lit(1)))
    )
    return bad.unionByName(split.select(F.col("doc_id").cast("string").alias("what")))


def p8_fill(spark, sf_dir):
    """One row: containers, tokens and the share of unused space."""
    p = p8_pack(spark, sf_dir).filter("container is not null")
    each = p.groupBy("container").agg(F.sum("length").alias("used"), F.max(F.col("offset") + F.col("length")).alias("end"))
    return each.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"),
        F.round(1 - F.sum("used") / (F.count(F.lit(1)) * CAPACITY), 6).alias("unused_share"), F.max("end").alias("fullest"),
    )



TEXT_FIELDS = ["authors_norm", "author_full_names_norm", "affiliations_norm"]


def _unified(spark, sf_dir, only_changed):
    return lookalikes.unified(table(spark, sf_dir, "records_normalised"), ["source_file", "row_id_in_file"], TEXT_FIELDS, only_changed)


def p3_cells(spark, sf_dir):
    return _unified(spark, sf_dir, False)


def p3_found(spark, sf_dir):
    return _unified(spark, sf_dir, True).filter("changed").select("source_file", "row_id_in_file", "field")


def p9_segments(spark, sf_dir):
    by_line = langid.languages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return by_line.select("doc_id", "seg_no", "n_words", F.col("language").alias("lang"), F.round("confidence", 6).alias("confidence"))


def p9_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.document_languages(langid.languages(docs, "doc_id", "text", "lang"), "doc_id")
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", F.col("language").alias("lang"), F.round("confidence", 6).alias("confidence")
    )


def p9_found(spark, sf_dir):
    by_line = langid.languages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    wrong = ~F.col("label").eqNullSafe(F.col("language"))
    return by_line.filter(wrong & (F.col("n_words") >= langid.MIN_WORDS)).select("doc_id", "seg_no", F.col("language").alias("lang"))



def _people(spark, sf_dir):
    return names.link_people(
        table(spark, sf_dir, "author_instances"), "author_instance_id", "author_raw", "author_id", table(spark, sf_dir, "given_name_aliases"), "alias", "given_name"
    )


def _organisations(spark, sf_dir):
    return names.link_organisations(table(spark, sf_dir, "affil_spellings"), "spelling_id", "affil_text")


def p1_found(spark, sf_dir):
    people = names.pairs_within(_people(spark, sf_dir), "author_instance_id")
    organisations = names.pairs_within(_organisations(spark, sf_dir), "spelling_id")
    return people.select(F.lit("author").alias("kind"), "key_a", "key_b").unionByName(organisations.select(F.lit("affil").alias("kind"), "key_a", "key_b"))


def p1_clusters(spark, sf_dir):
    """Every mention and spelling with its cluster."""
    people = _people(spark, sf_dir).select(F.lit("author").alias("kind"), F.col("author_instance_id").alias("key"), F.sha2("cluster", 256).alias("cluster"))
    orgs = _organisations(spark, sf_dir).select(F.lit("affil").alias("kind"), F.col("spelling_id").alias("key"), F.sha2("cluster", 256).alias("cluster"))
    return people.unionByName(orgs)


def p1_record_names(spark, sf_dir):
    """Every name of ``Authors`` and ``Author full names`` and every organisation of ``Affiliations`` in the
    records, with its cluster; an organisation is a piece of an element that the list of spellings has."""
    r = table(spark, sf_dir, "records_normalised")
    at = ["source_file", "row_id_in_file"]
    fields = {"Authors": ";", "Author full names": ";"}
    cells = F.array(*(F.struct(F.lit(f).alias("field"), text.split_list(F.col(f"`{f}`"), sep).alias("items")) for f, sep in fields.items()))
    listed = r.select(*at, F.explode(cells).alias("x")).select(*at, "x.field", F.posexplode("x.items").alias("pos", "raw"))
    spelled = listed.select("raw").distinct().select(F.col("raw").alias("key"), "raw", F.lit("").alias("id"))
    people = names.link_people(spelled, "key", "raw", "id", table(spark, sf_dir, "given_name_aliases"), "alias", "given_name").withColumnRenamed("key", "raw")
    elements = r.select(*at, F.posexplode(text.split_list(F.col("Affiliations"))).alias("pos", "element"))
    pieces = elements.select(*at, "pos", F.explode(text.split_list(F.col("element"), ",")).alias("affil_text"))
    spellings = table(spark, sf_dir, "affil_spellings").select("spelling_id", "affil_text").join(_organisations(spark, sf_dir), "spelling_id")
    orgs = pieces.join(spellings, "affil_text").select(*at, F.lit("Affiliations").alias("field"), "pos", F.col("affil_text").alias("raw"), "cluster")
    found = listed.join(people, "raw").select(*at, "field", "pos", "raw", "cluster").unionByName(orgs)
    return found.withColumn("cluster", F.sha2("cluster", 256))


QUERIES = {
    "p1_found": (p1_found, None),
    "p1_clusters": (p1_clusters, None),
    "p1_record_names": (p1_record_names, None),
    "p3_found": (p3_found, None),
    "p3_cells": (p3_cells, None),
    "p9_found": (p9_found, None),
    "p9_segments": (p9_segments, None),
    "p9_documents": (p9_documents, None),
    "p7_ids": (p7_ids, None),
    "p7_roundtrip": (p7_roundtrip, "SELECT doc_id FROM documents WHERE false"),
    "p8_pack": (p8_pack, None),
    "p8_fill": (p8_fill, None),
    "p8_violations": (p8_violations, "SELECT CAST(doc_id AS VARCHAR) AS what FROM documents WHERE false"),
    "p2_found": (p2_found, P2_SQL),
    "p4_found": (p4_found, P4_FOUND_SQL),
    "p4_terms": (p4_terms, P4_TERMS_SQL),
    "p4_grams": (p4_grams, P4_GRAMS_SQL),
    "p5_found": (p5_found, P5_SQL),
}
