"""Queries of mentions, blocking, joins, decisions, guards and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import similarity as sim
from weft.operators import best_pairs, blocking, decisions, graph, guards, mentions, metrics
from weft.plans.runtime import table
from weft.plans.text_queries import JACCARD, LIST, NORMALISED, SIDES, SP, TOKENS, WORDS, _ACRONYM_SQL, distinct_list

# ---------------------------------------------------------------- mentions

_AUTHORS_CTE = f"""
b AS (SELECT record_id, coalesce("EID", '') AS eid, query_frame, year_int, {LIST('author_full_names_norm', ';')} AS f, {LIST('authors_norm', ';')} AS s,
      {LIST('"Author full names"', ';')} AS rf, {LIST('"Authors"', ';')} AS rs, author_ids_list AS ids, array_to_string({WORDS('affiliations_norm')}[1:3], ' ') AS prefix FROM records_normalised),
n AS (SELECT *, CASE WHEN len(f) > 0 THEN f ELSE s END AS names, CASE WHEN len(f) > 0 THEN rf ELSE rs END AS raws FROM b),
k AS (SELECT *, list_transform(names, lambda x: CASE WHEN len({WORDS('x')}) > 0 THEN {WORDS('x')}[-1] || '|' || left({WORDS('x')}[1], 1) ELSE '' END) AS keys FROM n),
e AS (SELECT *, unnest(range(len(names))) AS pos FROM k)"""

AUTHOR_MENTIONS_SQL = f"""WITH {_AUTHORS_CTE}
SELECT sha256(eid || '|' || pos || '|' || coalesce(raws[pos + 1], names[pos + 1])) AS author_instance_id, record_id, eid AS "EID", query_frame, year_int, CAST(pos AS INTEGER) AS author_pos,
  coalesce(raws[pos + 1], names[pos + 1]) AS author_raw, names[pos + 1] AS author_norm, coalesce(ids[pos + 1], '') AS author_id, keys[pos + 1] AS name_key,
  array_to_string(list_sort(list_distinct(list_filter(keys, lambda x, i: i <> pos + 1 AND x <> ''))), ';') AS coauthor_keys, prefix AS record_affil_prefix, len(names) >= 100 AS truncation_flag FROM e"""


def author_mentions(spark, sf_dir):
    m = mentions.author_mentions(table(spark, sf_dir, "records_normalised"))
    return m.withColumn("coauthor_keys", F.array_join("coauthor_keys", ";"))


_AFFIL_CTE = f"""
ab AS (SELECT record_id, coalesce("EID", '') AS eid, query_frame, year_int, {LIST('"Affiliations"', ';')} AS raws FROM records_normalised),
ae AS (SELECT *, unnest(range(len(raws))) AS pos FROM ab),
am AS (SELECT sha256(eid || '|' || pos || '|' || raws[pos + 1]) AS id, record_id, eid, query_frame, year_int, CAST(pos AS INTEGER) AS affil_pos, raws[pos + 1] AS affil_raw,
       {NORMALISED('raws[pos + 1]')} AS affil_norm FROM ae),
ai AS (SELECT *, {distinct_list(_ACRONYM_SQL.replace('"Affiliations"', 'affil_raw'))} AS acronyms, array_to_string({WORDS('affil_norm')}[1:3], ' ') AS tok3, left(affil_norm, 12) AS pre12 FROM am)"""

AFFIL_MENTIONS_SQL = f"""WITH {_AFFIL_CTE}
SELECT id AS affil_instance_id, record_id, eid AS "EID", query_frame, year_int, affil_pos, affil_raw, affil_norm, array_to_string(acronyms, ';') AS affil_acronyms, tok3 AS token_prefix_key, pre12 AS prefix_key FROM ai"""


def affiliation_mentions(spark, sf_dir):
    m = mentions.affiliation_mentions(table(spark, sf_dir, "records_normalised"))
    return m.withColumn("affil_acronyms", F.array_join("affil_acronyms", ";"))


def coauthors(spark, sf_dir):
    c = mentions.coauthor_names(table(spark, sf_dir, "author_instances"))
    return c.select("record_id", "author_pos", F.array_join("coauthors", ";").alias("coauthors"))


COAUTHORS_SQL = rf"""
WITH n AS (SELECT DISTINCT record_id, author_pos, regexp_replace(regexp_replace(CASE WHEN author_norm IS NULL OR lower(trim(author_norm)) IN ('nan', 'none') THEN '' ELSE author_norm END, '{SP}*\([0-9]{{6,20}}\)', '', 'g'), '^{SP}+|{SP}+$', '', 'g') AS name FROM author_instances),
r AS (SELECT record_id, list({{'p': author_pos, 'n': name}} ORDER BY author_pos, name) AS l FROM n GROUP BY record_id)
SELECT d.record_id, d.author_pos, array_to_string(list_transform(list_filter(l, lambda x: x.p <> d.author_pos), lambda x: x.n), ';') AS coauthors
FROM (SELECT DISTINCT record_id, author_pos FROM n) d JOIN r ON r.record_id = d.record_id"""

# ---------------------------------------------------------------- blocking

_AND_PAIRS_CTE = """
e AS (SELECT author_instance_id AS id, author_id, name_key, year_int, CASE WHEN name_key <> '' AND record_affil_prefix <> '' THEN name_key || '|' || record_affil_prefix END AS na
      FROM author_instances WHERE NOT truncation_flag),
u AS (SELECT a.id AS anchor_id, c.id AS candidate_id, 1 AS pr, 'pass1_author_id' AS ps, 'author_id:' || a.author_id AS bk FROM e a JOIN e c ON a.author_id = c.author_id WHERE a.author_id <> '' AND a.id <> c.id
      UNION SELECT a.id, c.id, 2, 'pass2_name_key', 'name_key:' || a.name_key FROM e a JOIN e c ON a.name_key = c.name_key
            WHERE a.name_key <> '' AND a.id <> c.id AND (a.year_int IS NULL OR c.year_int IS NULL OR abs(a.year_int - c.year_int) <= 5)
      UNION SELECT a.id, c.id, 3, 'pass3_name_key_affil', 'name_key_affil:' || a.na FROM e a JOIN e c ON a.na = c.na WHERE a.id <> c.id),
pairs AS (SELECT anchor_id, candidate_id, ps AS best_pass_id, bk AS best_block_key, CAST(pr AS INTEGER) AS pass_priority FROM
          (SELECT *, row_number() OVER (PARTITION BY anchor_id, candidate_id ORDER BY pr, bk) AS k FROM u) WHERE k = 1)"""


def author_pairs(spark, sf_dir):
    return blocking.author_pairs(table(spark, sf_dir, "author_instances"))


def blocking_topk(spark, sf_dir):
    """Candidate pairs with their native score, the best 50 per anchor."""
    i = table(spark, sf_dir, "author_instances")
    ranked = best_pairs.best_pairs(i, blocking.TOP_K, blocking.YEAR_WINDOW, with_names=False)
    return ranked.select("anchor_id", "candidate_id", "best_pass_id", "best_block_key", "pass_priority", F.round("score", 6).alias("similarity_score"), "rank")


_ONE = SIDES.split("WITH ")[1].split("p AS (")[0].strip().rstrip(",")
BLOCKING_TOPK_SQL = f"""WITH {_AND_PAIRS_CTE}, {_ONE},
s AS (SELECT pairs.*, 0.35::DOUBLE * ({JACCARD('a.coauthor_keys', 'c.coauthor_keys')})
      + 0.10::DOUBLE * CASE WHEN a.record_affil_prefix <> '' AND a.record_affil_prefix = c.record_affil_prefix THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
      FROM pairs JOIN one a ON a.author_instance_id = anchor_id JOIN one c ON c.author_instance_id = candidate_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY pass_priority, score DESC, candidate_id) AS INTEGER) AS rank FROM s)
SELECT anchor_id, candidate_id, best_pass_id, best_block_key, pass_priority, round(score, 6) AS similarity_score, rank FROM r WHERE rank <= 50"""


def author_candidates(spark, sf_dir):
    """The full candidate table: names compared by subsequence ratio."""
    i = table(spark, sf_dir, "author_instances")
    ranked = best_pairs.best_pairs(i, blocking.TOP_K, blocking.YEAR_WINDOW, with_names=True)
    return ranked.select(
        F.lit("AND").alias("task"), "anchor_id", "candidate_id", "best_pass_id", "best_block_key", "pass_priority", F.round("score", 6).alias("similarity_score"), "rank",
        F.abs(F.col("a_year_int") - F.col("c_year_int")).alias("year_diff"), F.col("a_query_frame").alias("query_frame_anchor"), F.col("c_query_frame").alias("query_frame_candidate"),
    )


def affiliation_pairs(spark, sf_dir):
    return blocking.affiliation_pairs(mentions.affiliation_mentions(table(spark, sf_dir, "records_normalised")))


def _capped(key, source):
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY record_id, affil_pos, id) AS n FROM {source}) WHERE n <= 50)"


AFFIL_PAIRS_SQL = f"""WITH {_AFFIL_CTE},
x AS (SELECT id, record_id, affil_pos, unnest(acronyms) AS acronym, unnest(range(len(acronyms))) AS kp FROM ai),
u AS (SELECT a.id AS anchor_id, c.id AS candidate_id, 1 AS pr, a.kp AS kp, 'ain_acro' AS ps, 'acro:' || a.acronym AS bk FROM x a JOIN {_capped('acronym', 'x')} c ON a.acronym = c.acronym WHERE a.id <> c.id
      UNION ALL SELECT a.id, c.id, 2, 0, 'ain_tok3', 'tok3:' || a.tok3 FROM ai a JOIN {_capped('tok3', 'ai')} c ON a.tok3 = c.tok3 WHERE a.tok3 <> '' AND a.id <> c.id
      UNION ALL SELECT a.id, c.id, 3, 0, 'ain_pre12', 'pre12:' || a.pre12 FROM ai a JOIN {_capped('pre12', 'ai')} c ON a.pre12 = c.pre12 WHERE a.pre12 <> '' AND a.id <> c.id)
SELECT anchor_id, candidate_id, ps AS best_pass_id, bk AS best_block_key, CAST(pr AS INTEGER) AS pass_priority
FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, candidate_id ORDER BY pr, kp, bk) AS k FROM u) WHERE k = 1"""


def affiliation_candidates(spark, sf_dir):
    """The full candidate table of affiliations: the best 50 per anchor by the whole score."""
    m = mentions.affiliation_mentions(table(spark, sf_dir, "records_normalised"))
    return blocking.affiliation_candidates(m, sim.ain_score("a_", "c_")).withColumn("similarity_score", F.round("similarity_score", 6))


def affiliation_topk(spark, sf_dir):
    """The best 50 per anchor by the native part of the score."""
    m = mentions.affiliation_mentions(table(spark, sf_dir, "records_normalised"))
    ranked = blocking.affiliation_candidates(m, sim.ain_context_score("a_", "c_"))
    return ranked.select("anchor_id", "candidate_id", "best_pass_id", "best_block_key", "pass_priority", F.round("similarity_score", 6).alias("similarity_score"), "rank", "query_frame_anchor", "query_frame_candidate")


AFFIL_TOPK_SQL = f"""{AFFIL_PAIRS_SQL.replace("SELECT anchor_id, candidate_id, ps AS", ", pairs AS (SELECT anchor_id, candidate_id, ps AS", 1)}),
one AS (SELECT id, affil_norm, acronyms, query_frame FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query_frame NULLS FIRST, year_int NULLS FIRST, record_id NULLS FIRST) AS k FROM ai) WHERE k = 1),
s AS (SELECT pairs.*, 0.35::DOUBLE * ({JACCARD(TOKENS('a.affil_norm'), TOKENS('c.affil_norm'))}) + 0.15::DOUBLE * CASE WHEN len(list_intersect(a.acronyms, c.acronyms)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
      coalesce(a.query_frame, '') AS query_frame_anchor, coalesce(c.query_frame, '') AS query_frame_candidate
      FROM pairs JOIN one a ON a.id = anchor_id JOIN one c ON c.id = candidate_id)
SELECT anchor_id, candidate_id, best_pass_id, best_block_key, pass_priority, round(score, 6) AS similarity_score, CAST(rank AS INTEGER) AS rank, query_frame_anchor, query_frame_candidate
FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY pass_priority, score DESC, candidate_id) AS rank FROM s) WHERE rank <= 50"""


def block_sizes(spark, sf_dir):
    c = table(spark, sf_dir, "candidates_and").select(F.col("best_pass_id").alias("pass_id"), F.col("best_block_key").alias("block_key"))
    return blocking.block_sizes(c)


BLOCK_SIZES_SQL = """
WITH s AS (SELECT best_pass_id AS pass_id, best_block_key AS block_key, count(*) AS size FROM candidates_and WHERE best_block_key IS NOT NULL GROUP BY ALL)
SELECT pass_id, block_key, size, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY size DESC, block_key) AS place FROM s) WHERE place <= 20"""


def ranked_candidates(spark, sf_dir):
    """Ranks of the candidate table anew: rows with a score, best 50 per anchor."""
    c = table(spark, sf_dir, "candidates_and").filter("similarity_score is not null and not isnan(similarity_score)")
    best = c.groupBy("anchor_id", "candidate_id").agg(F.min(F.struct("pass_priority", (-F.col("similarity_score")).alias("n"))).alias("b"))
    scored = best.select("anchor_id", "candidate_id", F.col("b.pass_priority").alias("pass_priority"), (-F.col("b.n")).alias("score"))
    return blocking.top_k(scored).select("anchor_id", "candidate_id", "rank")


RANKED_SQL = """
WITH b AS (SELECT anchor_id, candidate_id, pass_priority, similarity_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, candidate_id ORDER BY pass_priority, similarity_score DESC) AS k
  FROM candidates_and WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score)) WHERE k = 1)
SELECT anchor_id, candidate_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY pass_priority, similarity_score DESC, candidate_id) AS rank FROM b) WHERE rank <= 50"""

# ---------------------------------------------------------------- decisions and guards

_LOG = "routing_log_and"
_ORDER = ["timestamp", "confidence", "label", "reason_code", "run_id"]
_DEC = ["label", "confidence", "reason_code", "retry_count", "timestamp"]


def last_decision(spark, sf_dir):
    return decisions.last_decision(table(spark, sf_dir, _LOG), [*_ORDER, "retry_count"], _DEC)


_RANK = "label <> 'error' DESC, timestamp DESC NULLS LAST, confidence DESC NULLS LAST, label DESC NULLS LAST, reason_code DESC NULLS LAST, run_id DESC NULLS LAST, retry_count DESC NULLS LAST"
LAST_SQL = f"""SELECT anchor_id, candidate_id, label, confidence, reason_code, retry_count, timestamp
FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, candidate_id ORDER BY {_RANK}) AS k FROM {_LOG}) WHERE k = 1"""


def last_by_column(spark, sf_dir):
    return decisions.last_decision(table(spark, sf_dir, _LOG), [*_ORDER, "retry_count"], _DEC, compat=True)


def _last_of(c):
    return f"(list({c} ORDER BY {_RANK}) FILTER ({c} IS NOT NULL))[1] AS {c}"


LAST_BY_COLUMN_SQL = f"SELECT anchor_id, candidate_id, {', '.join(_last_of(c) for c in _DEC)} FROM {_LOG} GROUP BY anchor_id, candidate_id"


def routed(spark, sf_dir):
    log = table(spark, sf_dir, _LOG).select("run_id", "anchor_id", "candidate_id", "timestamp", "label", "confidence", "evidence_used", "retry_count")
    return guards.route(log, "AND").drop("evidence_used")


def _fired(expr="coalesce(evidence_used, [])", task="AND"):
    cases = []
    for category, keywords in sorted(guards.SIGNALS[task].items()):
        cases.append(f"CASE WHEN len(list_filter({expr}, lambda x: regexp_matches(lower(x), '{'|'.join(sorted(keywords))}'))) > 0 THEN '{category}' END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def routed_ain(spark, sf_dir):
    """Routing under the affiliation task's evidence kinds; a doubled item of evidence shows them."""
    log = table(spark, sf_dir, _LOG).select("run_id", "anchor_id", "candidate_id", "timestamp", "label", "confidence", _ain_evidence().alias("evidence_used"), "retry_count")
    return guards.route(log, "AIN").drop("evidence_used")


#: The log is of authors: its evidence is renamed to that of affiliations, kind by kind.
_RENAMED = {"name": "affil_string", "coauthor": "linked_authors", "affil": "Acronym"}


def _ain_evidence():
    return F.transform("evidence_used", lambda x: F.when(F.lower(x).contains("name"), _RENAMED["name"]).when(F.lower(x).contains("coauthor"), _RENAMED["coauthor"]).when(F.lower(x).contains("affil"), _RENAMED["affil"]).otherwise(x))


_AIN_EVIDENCE_SQL = "list_transform(coalesce(evidence_used, []), lambda y: CASE WHEN contains(lower(y), 'name') THEN 'affil_string' WHEN contains(lower(y), 'coauthor') THEN 'linked_authors' WHEN contains(lower(y), 'affil') THEN 'Acronym' ELSE y END)"

ROUTED_SQL = f"""WITH f AS (SELECT run_id, anchor_id, candidate_id, timestamp, label, confidence, retry_count, {_fired()} AS fired FROM {_LOG}),
g AS (SELECT *, len(fired) AS n, label = 'non-match' AND confidence >= 0.85 AS no, label = 'match' AND confidence >= 0.85 AS yes FROM f),
h AS (SELECT *, CASE WHEN label = 'error' THEN 'uncertain' WHEN no THEN 'non-match' WHEN yes AND n >= 2 THEN 'match' ELSE 'uncertain' END AS label_final FROM g)
SELECT run_id, anchor_id, candidate_id, timestamp, label, confidence, retry_count, label_final,
  CASE WHEN label = 'error' THEN 'error_row' WHEN NOT no AND yes AND n < 2 THEN 'match_guard_insufficient_signals:' || n || '<2' ELSE '' END AS override_reason,
  CAST(CASE WHEN label = 'error' THEN 0 ELSE n END AS INTEGER) AS signals_count, CASE WHEN label = 'error' THEN '' ELSE array_to_string(fired, '|') END AS fired_categories,
  label_final = 'uncertain' AS routed_to_human FROM h"""

ROUTED_AIN_SQL = ROUTED_SQL.replace(_fired(), _fired(_AIN_EVIDENCE_SQL, "AIN"))

_C6 = [round(0.99 - i * 0.01, 10) for i in range(50)]


def _gold_log(spark, sf_dir):
    """The log with its final label as stand-in gold."""
    return table(spark, sf_dir, _LOG).withColumn("gold_label", guards.three_class(F.lower(F.trim("label_final"))))


def match_curve(spark, sf_dir):
    curve = guards.match_threshold_curve(_gold_log(spark, sf_dir), "gold_label", "AND", _C6)
    return curve.select("t", "n_auto_match", "tp", "n_gold_match", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


_CURVE_CTE = f"""f AS (SELECT *, lower(trim(label_final)) = 'match' AS gm, len({_fired()}) AS n FROM {_LOG}),
t AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in _C6)}]) AS t),
c AS (SELECT t, count(*) FILTER (label = 'match' AND n >= 2 AND confidence >= t) AS n_auto_match, count(*) FILTER (label = 'match' AND n >= 2 AND confidence >= t AND gm) AS tp,
      count(*) FILTER (gm) AS n_gold_match FROM t, f GROUP BY t)"""
MATCH_CURVE_SQL = f"""WITH {_CURVE_CTE} SELECT t, n_auto_match, tp, n_gold_match, CASE WHEN n_auto_match > 0 THEN round(tp / n_auto_match, 9) END AS precision,
CASE WHEN n_auto_match = 0 OR n_gold_match = 0 THEN 0.0 ELSE round(tp / n_gold_match, 9) END AS recall FROM c"""


def tuned_threshold(spark, sf_dir):
    return guards.tuned_match_threshold(guards.match_threshold_curve(_gold_log(spark, sf_dir), "gold_label", "AND", _C6), 0.5, 0.85)


TUNED_SQL = f"""WITH {_CURVE_CTE} SELECT coalesce(min(t) FILTER (n_auto_match > 0 AND tp / n_auto_match >= 0.5), 0.85) AS tuned_t_match, min(t) FILTER (n_auto_match > 0 AND tp / n_auto_match >= 0.5) IS NULL AS fallback_to_initial FROM c"""


def still_open(spark, sf_dir):
    pairs = table(spark, sf_dir, "candidates_and").select("anchor_id", "candidate_id").distinct()
    return decisions.still_open(pairs, table(spark, sf_dir, _LOG))


OPEN_SQL = f"SELECT DISTINCT anchor_id, candidate_id FROM candidates_and c WHERE NOT EXISTS (SELECT 1 FROM {_LOG} r WHERE r.anchor_id = c.anchor_id AND r.candidate_id = c.candidate_id AND r.label <> 'error')"


def resume_plan(spark, sf_dir):
    log = table(spark, sf_dir, _LOG)
    return decisions.resume_plan(log.select("anchor_id", "candidate_id").unionByName(table(spark, sf_dir, "candidates_and").select("anchor_id", "candidate_id")), log)


RESUME_SQL = f"""WITH p AS (SELECT anchor_id, candidate_id FROM {_LOG} UNION SELECT anchor_id, candidate_id FROM candidates_and),
s AS (SELECT anchor_id, candidate_id, bool_or(label <> 'error') AS ok, bool_or(label = 'error' AND (lower(error) LIKE '%empty_response_content%' OR lower(error) LIKE '%list index out of range%')) AS bad FROM {_LOG} GROUP BY ALL)
SELECT p.anchor_id, p.candidate_id, CASE WHEN ok THEN 'skip' WHEN coalesce(bad, false) THEN 'force_uncertain' WHEN ok IS NOT NULL THEN 'retry' ELSE 'run' END AS action
FROM p LEFT JOIN s ON s.anchor_id = p.anchor_id AND s.candidate_id = p.candidate_id"""


_STATUSES = "[NULL, 400, 401, 402, 403, 404, 429, 500]"


def error_classes(spark, sf_dir):
    """Classes of the log's error texts, each alone and under several HTTP statuses, and of a billing text."""
    log = table(spark, sf_dir, _LOG).filter("label = 'error'").groupBy("error").agg(F.count(F.lit(1)).alias("n"))
    texts = log.unionByName(log.agg(F.lit("usage limit, add credit").alias("error"), F.lit(0).cast("bigint").alias("n")))
    statuses = F.array(*(F.lit(x).cast("int") for x in (None, 400, 401, 402, 403, 404, 429, 500)))
    rows = texts.select("error", "n", F.explode(statuses).alias("status"))
    return rows.groupBy("status", decisions.error_classes(F.col("error"), F.col("status")).alias("class")).agg(F.sum("n").alias("n"))


ERRORS_SQL = f"""WITH e AS (SELECT error, count(*) AS n FROM {_LOG} WHERE label = 'error' GROUP BY error UNION ALL SELECT 'usage limit, add credit', 0),
x AS (SELECT lower(coalesce(error, '')) AS m, n, unnest({_STATUSES}) AS status FROM e),
c AS (SELECT n, CAST(status AS INTEGER) AS status, CASE
 WHEN status = 401 THEN 'AUTH' WHEN status = 403 THEN 'PERMISSION' WHEN status = 429 THEN 'RATE_LIMIT' WHEN status = 404 THEN 'MODEL_NOT_FOUND' WHEN status = 402 THEN 'BILLING'
 WHEN status = 400 THEN CASE WHEN m LIKE '%usage%' AND m LIKE '%limit%' THEN 'BILLING' ELSE 'INVALID_REQUEST' END
 WHEN status IS NOT NULL THEN CASE WHEN m LIKE '%billing%' OR m LIKE '%credit%' THEN 'BILLING' ELSE 'UNKNOWN' END
 WHEN m LIKE '%empty_response_content%' OR m LIKE '%list index out of range%' THEN 'INVALID_RESPONSE' WHEN m LIKE '%auth%' OR m LIKE '%api key%' THEN 'AUTH'
 WHEN m LIKE '%billing%' OR m LIKE '%credit%' OR (m LIKE '%usage%' AND m LIKE '%limit%') THEN 'BILLING' WHEN m LIKE '%rate%' OR m LIKE '%429%' THEN 'RATE_LIMIT'
 WHEN m LIKE '%connect%' OR m LIKE '%timeout%' OR m LIKE '%network%' THEN 'NETWORK' ELSE 'UNKNOWN' END AS class FROM x)
SELECT status, class, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY status, class"""


def stub(spark, sf_dir):
    pairs = table(spark, sf_dir, "candidates_and").select("anchor_id", "candidate_id").distinct()
    return decisions.stub_decisions(pairs).drop("evidence_used")


STUB_SQL = """SELECT DISTINCT anchor_id, candidate_id, 'uncertain' AS label, 0.0::DOUBLE AS confidence, 'insufficient_evidence' AS reason_code, 'requests_only_stub' AS abstention_reason, 'requests_only' AS backend FROM candidates_and"""

# ---------------------------------------------------------------- joins

_BENCH = f"bench AS (SELECT anchor_id, candidate_id, label AS gold_label, CASE WHEN md5(anchor_id || candidate_id) < '8' THEN 'dev' ELSE 'test' END AS split FROM ({LAST_SQL}))"


def benchmark(spark, sf_dir):
    """Stand-in benchmark: each pair of the log once, with its last label and a split by hash."""
    last = last_decision(spark, sf_dir)
    return last.select("anchor_id", "candidate_id", F.col("label").alias("gold_label"), F.when(F.md5(F.concat("anchor_id", "candidate_id")) < "8", "dev").otherwise("test").alias("split"))


def decisions_gold(spark, sf_dir):
    """Decisions joined to the dev benchmark, with the 3-class prediction."""
    b = benchmark(spark, sf_dir).filter("split = 'dev' and gold_label in ('match', 'non-match')")
    log = table(spark, sf_dir, _LOG).select("anchor_id", "candidate_id", "run_id", "timestamp", guards.three_class(F.col("label_final")).alias("predicted"))
    return log.join(b, ["anchor_id", "candidate_id"])


GOLD_SQL = f"""WITH {_BENCH} SELECT r.anchor_id, r.candidate_id, run_id, timestamp, CASE WHEN label_final IN ('match', 'non-match') THEN label_final ELSE 'uncertain' END AS predicted, gold_label, split
FROM {_LOG} r JOIN bench b ON b.anchor_id = r.anchor_id AND b.candidate_id = r.candidate_id WHERE split = 'dev' AND gold_label IN ('match', 'non-match')"""


def id_comparator(spark, sf_dir):
    """Benchmark pairs with whether the first pass (same platform id) found them."""
    c = table(spark, sf_dir, "candidates_and").groupBy("anchor_id", "candidate_id").agg(F.min(F.struct("pass_priority", "best_pass_id")).alias("b"))
    joined = benchmark(spark, sf_dir).join(c, ["anchor_id", "candidate_id"], "left")
    return joined.select("anchor_id", "candidate_id", "gold_label", "split", F.coalesce(F.col("b.best_pass_id") == "pass1_author_id", F.lit(False)).alias("same_id"))


COMPARATOR_SQL = f"""WITH {_BENCH}, c AS (SELECT anchor_id, candidate_id, best_pass_id FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, candidate_id ORDER BY pass_priority, best_pass_id) AS k FROM candidates_and) WHERE k = 1)
SELECT b.anchor_id, b.candidate_id, gold_label, split, coalesce(best_pass_id = 'pass1_author_id', false) AS same_id FROM bench b LEFT JOIN c ON c.anchor_id = b.anchor_id AND c.candidate_id = b.candidate_id"""


K_VALUES = (1, 5, 10, 20, 50)


def _at_k(spark, sf_dir):
    """Benchmark pairs at each K with whether they are among the K best of their anchor, and the final label,
    which is uncertain beyond K."""
    r = ranked_candidates(spark, sf_dir)
    final = decisions.last_decision(table(spark, sf_dir, _LOG), [*_ORDER, "retry_count", "label_final"], ["label_final"])
    j = benchmark(spark, sf_dir).join(r, ["anchor_id", "candidate_id"], "left").join(final, ["anchor_id", "candidate_id"], "left").withColumn("rank", F.coalesce("rank", F.lit(2**31 - 1)))
    label = guards.three_class(F.lower(F.trim("label_final")))
    cells = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("rank") <= k).alias("hit"), F.when(F.col("rank") <= k, label).otherwise("uncertain").alias("predicted")) for k in K_VALUES))
    gold = F.when(F.col("gold_label").isin("match", "non-match"), F.col("gold_label")).otherwise("uncertain")
    return j.select("anchor_id", "candidate_id", "gold_label", gold.alias("gold"), F.explode(cells).alias("c")).select("anchor_id", "candidate_id", "gold_label", "gold", "c.*")


def k_sensitivity(spark, sf_dir):
    """Blocking recall at K of all benchmark pairs and of match pairs, and the metrics at K."""
    x = _at_k(spark, sf_dir)
    hits = x.groupBy("k").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if("hit").alias("n_hit"), F.count_if(F.col("gold_label") == "match").alias("n_match"), F.count_if(F.col("hit") & (F.col("gold_label") == "match")).alias("n_match_hit")
    )
    suite = metrics.metric_suite(x, "gold", "predicted", ["k"]).select("k", "tp", "fp", *(F.round(c, 9).alias(c) for c in ("precision_match", "recall_match", "f1_match", "coverage")))
    return hits.join(suite, "k").withColumns({"recall_all": F.round(F.try_divide("n_hit", "n_pairs"), 9), "recall_of_match": F.round(F.try_divide("n_match_hit", "n_match"), 9)})


def k_intervals(spark, sf_dir):
    """Bootstrap intervals of the metrics at each K."""
    x = _at_k(spark, sf_dir)
    out = None
    for k in K_VALUES:
        one = metrics.bootstrap(x.filter(F.col("k") == k), "gold", "predicted", ["anchor_id", "candidate_id"]).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


K_SQL = f"""WITH {_BENCH}, r AS ({RANKED_SQL.strip()}), k AS (SELECT unnest([1, 5, 10, 20, 50]) AS k),
fl AS (SELECT anchor_id, candidate_id, lower(trim(label_final)) AS f FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, candidate_id ORDER BY {_RANK}, label_final DESC NULLS LAST) AS k FROM {_LOG}) WHERE k = 1),
x AS (SELECT k, gold_label AS g, rank <= k AS hit, CASE WHEN rank <= k AND f IN ('match', 'non-match') THEN f ELSE 'uncertain' END AS p
      FROM k, bench b LEFT JOIN r ON r.anchor_id = b.anchor_id AND r.candidate_id = b.candidate_id LEFT JOIN fl ON fl.anchor_id = b.anchor_id AND fl.candidate_id = b.candidate_id),
c AS (SELECT k, count(*) AS n_pairs, count(*) FILTER (hit) AS n_hit, count(*) FILTER (g = 'match') AS n_match, count(*) FILTER (hit AND g = 'match') AS n_match_hit,
      count(*) FILTER (p = 'match' AND g = 'match') AS tp, count(*) FILTER (p = 'match' AND g = 'non-match') AS fp,
      count(*) FILTER (g IN ('match', 'non-match')) AS n_bin, count(*) FILTER (p IN ('match', 'non-match')) AS n_auto FROM x GROUP BY k),
q AS (SELECT *, CASE WHEN n_bin = 0 THEN NULL WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS pm, CASE WHEN n_bin = 0 THEN NULL WHEN n_match > 0 THEN tp / n_match ELSE 0.0 END AS rm FROM c)
SELECT CAST(k AS INTEGER) AS k, n_pairs, n_hit, n_match, n_match_hit, tp, fp, round(pm, 9) AS precision_match, round(rm, 9) AS recall_match,
  round(CASE WHEN pm + rm > 0 THEN 2 * pm * rm / (pm + rm) WHEN pm IS NOT NULL THEN 0.0 END, 9) AS f1_match, round(n_auto / n_pairs, 9) AS coverage, round(n_hit / n_pairs, 9) AS recall_all, round(n_match_hit / n_match, 9) AS recall_of_match FROM q"""


def anchor_frames(spark, sf_dir):
    frames = table(spark, sf_dir, "author_instances").groupBy("author_instance_id").agg(F.min("query_frame").alias("query_frame"))
    return benchmark(spark, sf_dir).join(frames.withColumnRenamed("author_instance_id", "anchor_id"), "anchor_id", "left").select("anchor_id", "candidate_id", "query_frame")


FRAMES_SQL = f"""WITH {_BENCH} SELECT anchor_id, candidate_id, query_frame FROM bench b LEFT JOIN (SELECT author_instance_id, min(query_frame) AS query_frame FROM author_instances GROUP BY ALL) i ON i.author_instance_id = b.anchor_id"""


def unknown_ids(spark, sf_dir):
    from weft.operators.evidence import unknown_ids as run

    pairs = table(spark, sf_dir, _LOG).select("anchor_id", "candidate_id").distinct()
    dated = table(spark, sf_dir, "author_instances").filter("year_int > 2015")  # else no id is unknown in these tables
    return run(pairs, dated, "author_instance_id")


UNKNOWN_SQL = f"""WITH k AS (SELECT DISTINCT author_instance_id AS id FROM author_instances WHERE year_int > 2015)
SELECT * FROM (SELECT anchor_id, candidate_id, anchor_id IN (SELECT id FROM k) AS anchor_known, candidate_id IN (SELECT id FROM k) AS candidate_known FROM (SELECT DISTINCT anchor_id, candidate_id FROM {_LOG})) WHERE NOT (anchor_known AND candidate_known)"""

# ---------------------------------------------------------------- entities


def _match(name="label_final"):
    return F.lower(F.trim(name)) == "match"


def entities(spark, sf_dir):
    return graph.entities(table(spark, sf_dir, _LOG), "anchor_id", "candidate_id", _match())


_REACH = f"""WITH RECURSIVE links AS (SELECT DISTINCT anchor_id AS a, candidate_id AS b FROM {_LOG} WHERE lower(trim(label_final)) = 'match'),
w AS (SELECT a, b FROM links UNION SELECT b, a FROM links), nodes AS (SELECT anchor_id AS n FROM {_LOG} UNION SELECT candidate_id FROM {_LOG}),
reach(a, b) AS (SELECT n, n FROM nodes UNION SELECT r.a, w.b FROM reach r JOIN w ON r.b = w.a),
root AS (SELECT a AS node_id, min(b) AS root FROM reach GROUP BY a),
ent AS (SELECT root, sha256(string_agg(node_id, chr(10) ORDER BY node_id)) AS entity_id FROM root GROUP BY root),
mem AS (SELECT entity_id, node_id FROM root JOIN ent ON ent.root = root.root)"""
_CONF = f"""conf AS (SELECT m.entity_id, anchor_id AS node_a, candidate_id AS node_b FROM (SELECT DISTINCT anchor_id, candidate_id FROM {_LOG} WHERE lower(trim(label_final)) = 'non-match') x
  JOIN mem m ON m.node_id = anchor_id JOIN mem c ON c.node_id = candidate_id WHERE m.entity_id = c.entity_id)"""


def _conflicts(spark, sf_dir):
    members = entities(spark, sf_dir)
    return graph.conflicts(table(spark, sf_dir, _LOG), members, "anchor_id", "candidate_id", F.lower(F.trim("label_final")) == "non-match"), members


QUERIES = {
    "arr01_author_mentions": (author_mentions, AUTHOR_MENTIONS_SQL),
    "arr02_affiliation_mentions": (affiliation_mentions, AFFIL_MENTIONS_SQL),
    "jn20_coauthors": (coauthors, COAUTHORS_SQL),
    "jn01_author_pairs": (author_pairs, f"WITH {_AND_PAIRS_CTE} SELECT * FROM pairs"),
    "blocking_topk": (blocking_topk, BLOCKING_TOPK_SQL),
    "and_candidates": (author_candidates, None),
    "jn04_affiliation_pairs": (affiliation_pairs, AFFIL_PAIRS_SQL),
    "ain_topk": (affiliation_topk, AFFIL_TOPK_SQL),
    "ain_candidates": (affiliation_candidates, None),
    "agg06_block_sizes": (block_sizes, BLOCK_SIZES_SQL),
    "win01_ranks": (ranked_candidates, RANKED_SQL),
    "win03_keep_first": (
        lambda spark, d: mentions.unique_instances(table(spark, d, "author_instances")).select("author_instance_id", "query_frame", "year_int", "author_norm", "author_id"),
        f"WITH {_ONE} SELECT author_instance_id, query_frame, year_int, author_norm, author_id FROM one",
    ),
    "agg07_last_decision": (last_decision, LAST_SQL),
    "agg07_last_by_column": (last_by_column, LAST_BY_COLUMN_SQL),
    "rul01_routing": (routed, ROUTED_SQL),
    "rul01_routing_ain": (routed_ain, ROUTED_AIN_SQL),
    "sel04_match_curve": (match_curve, MATCH_CURVE_SQL),
    "sel04_tuned_threshold": (tuned_threshold, TUNED_SQL),
    "flt10_still_open": (still_open, OPEN_SQL),
    "rul13_resume_plan": (resume_plan, RESUME_SQL),
    "rul14_error_classes": (error_classes, ERRORS_SQL),
    "jsn06_stub": (stub, STUB_SQL),
    "jn10_decisions_gold": (decisions_gold, GOLD_SQL),
    "jn14_id_comparator": (id_comparator, COMPARATOR_SQL),
    "agg16_k_sensitivity": (k_sensitivity, K_SQL),
    "agg16_k_intervals": (k_intervals, None),
    "jn18_anchor_frames": (anchor_frames, FRAMES_SQL),
    "flt07_unknown_ids": (unknown_ids, UNKNOWN_SQL),
    "grf02_entities": (entities, _REACH + " SELECT entity_id, node_id FROM mem"),
    "grf03_conflicts": (lambda spark, d: _conflicts(spark, d)[0], _REACH + ", " + _CONF + " SELECT * FROM conf"),
    "agg10_conflict_summary": (
        lambda spark, d: graph.conflict_summary(*_conflicts(spark, d)),
        _REACH + ", " + _CONF + """, f AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY node_a, node_b) AS k FROM conf),
        s AS (SELECT entity_id, '[' || string_agg('["' || node_a || '","' || node_b || '"]', ',' ORDER BY k) || ']' AS sample_edges FROM f WHERE k <= 5 GROUP BY entity_id)
        SELECT conf.entity_id, any_value(num_members) AS num_members, count(*) AS num_conflicts, any_value(sample_edges) AS sample_edges
        FROM conf JOIN (SELECT entity_id, count(*) AS num_members FROM mem GROUP BY entity_id) z ON z.entity_id = conf.entity_id JOIN s ON s.entity_id = conf.entity_id GROUP BY conf.entity_id""",
    ),
    "agg09_size_distribution": (
        lambda spark, d: graph.size_distribution(entities(spark, d)),
        _REACH + " SELECT size, count(*) AS clusters FROM (SELECT entity_id, count(*) AS size FROM mem GROUP BY entity_id) GROUP BY size",
    ),
    "agg09_largest": (
        lambda spark, d: graph.largest_clusters(entities(spark, d)),
        _REACH + " SELECT entity_id, count(*) AS size FROM mem GROUP BY entity_id ORDER BY size DESC, entity_id LIMIT 20",
    ),
    "agg09_cluster_sizes": (
        lambda spark, d: graph.cluster_sizes(entities(spark, d)),
        _REACH + " SELECT count(*) AS num_clusters, count(*) FILTER (n = 1) AS num_singletons, max(n) AS largest, CAST(sum(n) AS BIGINT) AS members FROM (SELECT entity_id, count(*) AS n FROM mem GROUP BY entity_id)",
    ),
}
