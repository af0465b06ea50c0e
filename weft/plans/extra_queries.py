"""Queries of joins, filters, variants and logs that the other modules don't show by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import baselines, decisions, evidence, graph, guards, joins, labelling, metrics, quality, reports
from weft.operators.blocking import affiliation_pairs, with_sides
from weft.operators.mentions import affiliation_mentions, unique_instances
from weft.plans import eval_queries as ev
from weft.plans import match_queries as mq
from weft.plans.runtime import table
from weft.plans.text_queries import JACCARD, LIST, STRIP, STRIP_ID
from weft.sources import tables

_LOG = mq._LOG
_ROUTE = f"rt AS (SELECT anchor_id, candidate_id, label, confidence, CASE WHEN lower(trim(label_final)) IN ('match', 'non-match') THEN lower(trim(label_final)) ELSE 'uncertain' END AS label_final FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, candidate_id ORDER BY {mq._RANK}, label_final DESC NULLS LAST) AS k FROM {_LOG}) WHERE k = 1)"


def _routing(spark, sf_dir):
    """One routing row per pair."""
    cols = ["label", "confidence", "label_final"]
    one = decisions.last_decision(table(spark, sf_dir, _LOG), [*mq._ORDER, "retry_count", "label_final"], cols)
    return one.withColumn("label_final", guards.three_class(F.lower(F.trim("label_final"))))


def benchmark_routing(spark, sf_dir):
    return joins.complete_join(mq.benchmark(spark, sf_dir), _routing(spark, sf_dir))


_JOINED = f"WITH {mq._BENCH}, {_ROUTE} SELECT b.*, label, confidence, label_final FROM bench b JOIN rt ON rt.anchor_id = b.anchor_id AND rt.candidate_id = b.candidate_id"


def gold_mismatches(spark, sf_dir):
    """The last label of a pair against its final label."""
    a = mq.benchmark(spark, sf_dir)
    return joins.gold_mismatches(a, _routing(spark, sf_dir).withColumnRenamed("label_final", "gold_label"))


def with_ranks(spark, sf_dir):
    return joins.with_ranks(mq.benchmark(spark, sf_dir), _routing(spark, sf_dir), mq.ranked_candidates(spark, sf_dir))


def diagnostics(spark, sf_dir):
    return joins.diagnostics(mq.benchmark(spark, sf_dir), mq.last_decision(spark, sf_dir).filter("label <> 'error'"), _routing(spark, sf_dir))


_DIAG = f"""WITH {mq._BENCH}, {_ROUTE}, dd AS (SELECT * FROM ({mq.LAST_SQL}) WHERE label <> 'error')
SELECT b.*, d.label AS decided, d.confidence, r.label_final AS routed FROM bench b LEFT JOIN dd d ON d.anchor_id = b.anchor_id AND d.candidate_id = b.candidate_id LEFT JOIN rt r ON r.anchor_id = b.anchor_id AND r.candidate_id = b.candidate_id"""


def label_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, _LOG).select("anchor_id", "candidate_id", "timestamp", "run_id")
    return joins.labels_for(rows, mq.benchmark(spark, sf_dir), "gold_label")


def shared_splits(spark, sf_dir):
    """Pairs in both splits if rows of the log, not pairs, are split: those decided twice."""
    half = F.when(F.md5(F.coalesce("timestamp", F.lit(""))) < "8", "dev").otherwise("test")
    log = table(spark, sf_dir, _LOG).select("anchor_id", "candidate_id", half.alias("split"))
    return joins.shared_pairs(joins.split_part(log, "dev"), joins.split_part(log, "test"))


def nodes(spark, sf_dir):
    log = table(spark, sf_dir, _LOG)
    return log.select(F.col("anchor_id").alias("node")).union(log.select("candidate_id")).distinct()


def variants(spark, sf_dir):
    """Metrics of the raw label, the confidence-gated label and the guarded label, as a long table."""
    b = mq.benchmark(spark, sf_dir).select("anchor_id", "candidate_id", F.when(F.col("gold_label").isin("match", "non-match"), F.col("gold_label")).otherwise("uncertain").alias("gold"))
    log = table(spark, sf_dir, _LOG).select("anchor_id", "candidate_id", "label", "confidence", "signals_count")
    gated = F.when(F.col("confidence") >= 0.85, guards.three_class(F.col("label"))).otherwise("uncertain")
    guarded = guards.reapplied(F.col("label"), F.col("confidence"), F.col("signals_count"), F.lit(0.85), F.lit(2))
    cells = F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("predicted")) for k, v in (("raw", guards.three_class(F.col("label"))), ("gated", gated), ("guarded", guarded))))
    long = log.join(b, ["anchor_id", "candidate_id"]).select("gold", F.explode(cells).alias("c")).select("gold", "c.*")
    return ev._shown(metrics.metric_suite(long, "gold", "predicted", ["variant"]), ["variant"])


VARIANTS_SQL = f"""WITH {mq._BENCH}, j AS (SELECT r.label, r.confidence, r.signals_count, CASE WHEN gold_label IN ('match', 'non-match') THEN gold_label ELSE 'uncertain' END AS gold FROM {_LOG} r JOIN bench b ON b.anchor_id = r.anchor_id AND b.candidate_id = r.candidate_id),
y AS (SELECT *, CASE WHEN label IN ('match', 'non-match') THEN label ELSE 'uncertain' END AS raw FROM j),
x AS (SELECT 'raw' AS variant, gold, raw AS predicted FROM y UNION ALL SELECT 'gated', gold, CASE WHEN confidence >= 0.85 THEN raw ELSE 'uncertain' END FROM y
 UNION ALL SELECT 'guarded', gold, CASE WHEN label = 'non-match' AND confidence >= 0.85 THEN 'non-match' WHEN label = 'match' AND confidence >= 0.85 AND signals_count >= 2 THEN 'match' ELSE 'uncertain' END FROM y),
{ev._rates(['variant'])}"""


def all_methods(spark, sf_dir):
    """Every tuned operating point of every system applied to its scores: a join with the small table of
    thresholds, then the metric suite per system and method."""
    scored = ev._labelled(spark, sf_dir).filter("label <> 'error'")
    points = metrics.operating_points(ev._curve(spark, sf_dir), 0.55, 0.55, ["system"])
    joined = scored.select("system", "gold", "confidence").join(points, "system")
    s = F.col("confidence")
    cells = F.array(
        F.struct(F.lit("f1_optimal").alias("method"), metrics.apply_threshold(s, F.col("t_f1")).alias("predicted")),
        F.struct(F.lit("precision_floor").alias("method"), metrics.apply_threshold(s, F.col("t_floor")).alias("predicted")),
        F.struct(F.lit("two_threshold").alias("method"), metrics.apply_band(s, F.col("t_low"), F.col("t_high")).alias("predicted")),
    )
    long = joined.select("system", "gold", F.explode(cells).alias("c")).select("system", "gold", "c.*")
    return ev._shown(metrics.metric_suite(long, "gold", "predicted", ["system", "method"]), ["system", "method"])


ALL_METHODS_SQL = f"""WITH {ev._CURVE},
o AS (SELECT system, (list(t ORDER BY fm DESC, i))[1] AS t_f1, min(t) FILTER (tp + fp > 0 AND pm >= 0.55) AS t_floor, max(t) FILTER (n_total - tp - fp > 0 AND pn >= 0.55) AS tl FROM q GROUP BY system),
p AS (SELECT system, t_f1, t_floor, coalesce(t_floor, 1.0) AS hi, least(coalesce(tl, 0.0), coalesce(t_floor, 1.0)) AS lo FROM o),
j AS (SELECT l.system, gold, confidence AS s, t_f1, t_floor, hi, lo FROM l JOIN p ON p.system = l.system WHERE label <> 'error'),
x AS (SELECT system, 'f1_optimal' AS method, gold, CASE WHEN s >= t_f1 THEN 'match' ELSE 'non-match' END AS predicted FROM j
 UNION ALL SELECT system, 'precision_floor', gold, CASE WHEN t_floor IS NULL THEN 'uncertain' WHEN s >= t_floor THEN 'match' ELSE 'non-match' END FROM j
 UNION ALL SELECT system, 'two_threshold', gold, CASE WHEN s >= hi THEN 'match' WHEN s < lo THEN 'non-match' ELSE 'uncertain' END FROM j),
{ev._rates(['system', 'method']).replace('c AS (SELECT', 'c2 AS (SELECT', 1).replace('AS rn FROM c)', 'AS rn FROM c2)')}"""


def cluster_diagnostics(spark, sf_dir):
    """Clusters, their sizes, and conflict edges per member."""
    found, members = mq._conflicts(spark, sf_dir)
    edges = found.agg(F.count(F.lit(1)).alias("conflict_count"))
    out = graph.cluster_sizes(members).withColumn("conflict_count", edges.scalar())
    return out.select("num_clusters", "num_singletons", (F.col("num_clusters") - F.col("num_singletons")).alias("num_multi"), "largest", "members", "conflict_count", F.round(F.try_divide("conflict_count", "members"), 9).alias("conflict_rate"))


def normalisation_log(spark, sf_dir):
    """All normalisation statistics as one long table, ready for a JSON-lines sink."""
    r = table(spark, sf_dir, "records_normalised")
    parts = [
        reports.missingness(r, ev._COLUMNS).select(F.lit("missing").alias("stat_type"), F.col("column").alias("name"), F.col("n_missing").alias("value")),
        reports.filled_counts(r, ev._NORMS).select(F.lit("filled").alias("stat_type"), F.col("column").alias("name"), F.col("n_filled").alias("value")),
        reports.changed_counts(r, ev._RAW_NORM).select(F.lit("changed").alias("stat_type"), F.col("column").alias("name"), F.col("n_changed").alias("value")),
        r.groupBy(F.col("source_file").alias("name")).agg(F.count(F.lit(1)).alias("value")).select(F.lit("rows").alias("stat_type"), "name", "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NORMALISATION_SQL = f"""SELECT 'missing' AS stat_type, "column" AS name, n_missing AS value FROM ({ev._missing_sql()}) UNION ALL SELECT 'filled', "column", n_filled FROM ({ev._filled_sql()})
UNION ALL SELECT 'changed', "column", n_changed FROM ({ev.QUERIES['agg04_changed'][1]}) UNION ALL SELECT 'rows', source_file, count(*) FROM records_normalised GROUP BY source_file"""


def parsed_replies(spark, sf_dir):
    """Decisions of the log written as replies and parsed again."""
    log = table(spark, sf_dir, _LOG)
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct("label", "confidence", "reason_code")), F.lit("\n```"))
    parsed = log.select("anchor_id", "candidate_id", "timestamp", decisions.parse_decision(reply).alias("d"), decisions.keyword_label(F.concat(F.lit("I say "), "label")).alias("keyword"))
    return parsed.select("anchor_id", "candidate_id", "timestamp", "d.label", "d.confidence", "d.reason_code", "keyword")


PARSED_SQL = f"""SELECT anchor_id, candidate_id, timestamp, CASE WHEN label IN ('match', 'non-match', 'uncertain') THEN label END AS label, CASE WHEN label IN ('match', 'non-match', 'uncertain') THEN confidence END AS confidence,
CASE WHEN label IN ('match', 'non-match', 'uncertain') THEN reason_code END AS reason_code, CASE WHEN label IN ('match', 'non-match', 'uncertain') THEN label END AS keyword FROM {_LOG}"""


def affiliation_packets(spark, sf_dir):
    """Packets of affiliation pairs with their label by the quality-control rules."""
    r = table(spark, sf_dir, "records_normalised")
    m = affiliation_mentions(r).dropDuplicates(["affil_instance_id"])
    cards = evidence.affiliation_cards(m, r)
    packets = evidence.affiliation_packets(evidence.pair_cards(affiliation_pairs(m), cards, "affil_instance_id", "AIN"))
    s = labelling.ain_signals(packets)
    return s.select(
        "anchor_id", "candidate_id", "anchor_affil_norm", "candidate_affil_norm", "anchor_affil_acronyms", F.round("affil_str_sim", 4).alias("affil_str_sim"),
        F.round("token_jaccard", 4).alias("token_jaccard"), "acronym_overlap", labelling.ain_label().alias("label"), labelling.autofill_ain(labelling.fallback(F.col("anchor_linked_authors_fallback")))["rule"].alias("rule"),
    )


def blanked_cards(spark, sf_dir):
    """Author cards without co-authors and affiliations: the ablation's fields are empty, the rest stays."""
    c = evidence.without_fields(ev.author_cards(spark, sf_dir), ["coauthors_norm", "affiliations_norm"])
    a = F.col("card.anchor")
    return c.select("anchor_id", "candidate_id", a["author_norm"].alias("author_norm"), F.coalesce(F.array_join(a["coauthors_norm"], ";"), F.lit("")).alias("coauthors"), a["affiliations_norm"].alias("affiliations"), a["record"]["year"].alias("year"))


_NAME = STRIP_ID("(" + ev._SAFE.format("author_norm") + ")")
BLANKED_SQL = f"""WITH {ev._ONE}, rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY source_file NULLS FIRST, row_id_in_file NULLS FIRST) AS rk FROM records_normalised) WHERE rk = 1)
SELECT p.anchor_id, p.candidate_id, {_NAME.replace('author_norm', 'a.author_norm')} AS author_norm, '' AS coauthors, '' AS affiliations, r.year_int AS year
FROM (SELECT DISTINCT anchor_id, candidate_id FROM {_LOG}) p JOIN one a ON a.author_instance_id = p.anchor_id JOIN one c ON c.author_instance_id = p.candidate_id LEFT JOIN rec r ON r.record_id = a.record_id"""

_ELIGIBLE = "SELECT author_instance_id, name_key, year_int FROM author_instances WHERE NOT truncation_flag AND name_key <> ''"


def curve_points(spark, sf_dir):
    """Points of the curve that reach the floor."""
    c = ev._curve(spark, sf_dir).filter((F.col("n_pred_match") > 0) & (F.col("precision_match") >= 0.55))
    return c.select("system", "i", "n_pred_match")


def valid_pairs(spark, sf_dir):
    log = table(spark, sf_dir, _LOG).withColumn("split", F.when(F.col("retry_count") == 0, "DEV ").when(F.col("retry_count") == 1, "test"))
    return labelling.valid_pairs(log, "label", "split").select("anchor_id", "candidate_id", "timestamp", "label")


def metric_violations(spark, sf_dir):
    return quality.metric_violations(ev.metric_suite(spark, sf_dir), ["precision_match", "recall_match", "f1_match", "coverage"])


def evidence_items(spark, sf_dir):
    """How often each kind of evidence item is used, and the categories it shows."""
    items = table(spark, sf_dir, _LOG).select(F.explode("evidence_used").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return items.withColumn("fired", F.array_join(guards.fired_categories(F.array("item"), "AND"), "|"))


NATIVE = ["context", "deterministic", "same_id"]


def _baseline_sides(spark, sf_dir):
    one = unique_instances(table(spark, sf_dir, "author_instances"))
    pairs = table(spark, sf_dir, "candidates_and").select("anchor_id", "candidate_id").distinct()
    return with_sides(pairs, one, "author_instance_id", ["author_norm", "author_id", "coauthor_keys", "record_affil_prefix", "year_int"])


def native_baselines(spark, sf_dir):
    """Candidate pairs by every baseline without a subsequence ratio, as one long table."""
    return baselines.run(_baseline_sides(spark, sf_dir), "AND", NATIVE).withColumn("score", F.round("score", 9))


def all_baselines(spark, sf_dir):
    return baselines.run(_baseline_sides(spark, sf_dir), "AND").withColumn("score", F.round("score", 9))


BASELINES_SQL = f"""WITH {mq._ONE}, p AS (SELECT DISTINCT anchor_id, candidate_id FROM candidates_and),
s AS (SELECT anchor_id, candidate_id, coalesce(a.author_norm <> '' AND a.author_norm = c.author_norm, false) AS same_name, coalesce(a.record_affil_prefix <> '' AND a.record_affil_prefix = c.record_affil_prefix, false) AS same_prefix,
 coalesce(a.author_id <> '' AND a.author_id = c.author_id, false) AS same_id, {JACCARD('a.coauthor_keys', 'c.coauthor_keys')} AS j FROM p JOIN one a ON a.author_instance_id = anchor_id JOIN one c ON c.author_instance_id = candidate_id)
SELECT anchor_id, candidate_id, 'context' AS system, round(0.35::DOUBLE * j + 0.10::DOUBLE * CAST(same_prefix AS DOUBLE), 9) AS score, false AS auxiliary FROM s
UNION ALL SELECT anchor_id, candidate_id, 'deterministic', CASE WHEN same_name AND same_prefix THEN 1.0 WHEN same_name THEN 0.5 ELSE 0.0 END, false FROM s
UNION ALL SELECT anchor_id, candidate_id, 'same_id', CAST(same_id AS DOUBLE), true FROM s"""


def benchmark_candidates(spark, sf_dir):
    """Candidates whose anchor is an anchor of the benchmark."""
    anchors = mq.benchmark(spark, sf_dir).filter("split = 'dev'").select("anchor_id").distinct()
    return table(spark, sf_dir, "candidates_and").join(anchors, "anchor_id", "left_semi").groupBy("anchor_id", "candidate_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "udf03_baselines": (native_baselines, BASELINES_SQL),
    "udf03_all_baselines": (all_baselines, None),
    "flt11_benchmark_candidates": (benchmark_candidates, f"WITH {mq._BENCH} SELECT anchor_id, candidate_id, count(*) AS n FROM candidates_and WHERE anchor_id IN (SELECT anchor_id FROM bench WHERE split = 'dev') GROUP BY anchor_id, candidate_id"),
    "jn11_benchmark_routing": (benchmark_routing, _JOINED),
    "jn13_gold_mismatches": (gold_mismatches, f"WITH {mq._BENCH}, {_ROUTE} SELECT b.anchor_id, b.candidate_id, gold_label AS \"left\", label_final AS \"right\" FROM bench b JOIN rt ON rt.anchor_id = b.anchor_id AND rt.candidate_id = b.candidate_id WHERE gold_label IS DISTINCT FROM label_final"),
    "jn16_with_ranks": (with_ranks, f"WITH {mq._BENCH}, {_ROUTE}, rk AS ({mq.RANKED_SQL.strip()}) SELECT b.*, coalesce(label_final, 'uncertain') AS label_final, coalesce(rank, 2147483647) AS rank FROM bench b LEFT JOIN rt ON rt.anchor_id = b.anchor_id AND rt.candidate_id = b.candidate_id LEFT JOIN rk ON rk.anchor_id = b.anchor_id AND rk.candidate_id = b.candidate_id"),
    "jn17_diagnostics": (diagnostics, _DIAG),
    "flt09_disagreements": (
        lambda s, d: joins.disagreements(diagnostics(s, d)).select("anchor_id", "candidate_id", "kind"),
        f"SELECT anchor_id, candidate_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY anchor_id, candidate_id) AS k FROM (SELECT *, CASE WHEN gold_label = 'uncertain' AND routed IN ('match', 'non-match') THEN 'gold_uncertain_but_decided' WHEN gold_label = 'match' AND routed IS DISTINCT FROM 'match' THEN 'gold_match_missed' WHEN gold_label = 'non-match' AND routed IS DISTINCT FROM 'non-match' THEN 'gold_nonmatch_missed' END AS kind FROM ({_DIAG})) WHERE kind IS NOT NULL) WHERE k <= 20",
    ),
    "jn21_label_lookup": (label_lookup, f"WITH {mq._BENCH} SELECT r.anchor_id, r.candidate_id, timestamp, run_id, gold_label FROM {_LOG} r JOIN bench b ON b.anchor_id = r.anchor_id AND b.candidate_id = r.candidate_id"),
    "set02_shared_splits": (shared_splits, f"SELECT anchor_id, candidate_id FROM {_LOG} WHERE md5(coalesce(timestamp, '')) < '8' INTERSECT SELECT anchor_id, candidate_id FROM {_LOG} WHERE md5(coalesce(timestamp, '')) >= '8'"),
    "set03_nodes": (nodes, f"SELECT anchor_id AS node FROM {_LOG} UNION SELECT candidate_id FROM {_LOG}"),
    "rul10_variants": (variants, VARIANTS_SQL),
    "rul08_all_methods": (all_methods, ALL_METHODS_SQL),
    "agg20_cluster_diagnostics": (
        cluster_diagnostics,
        mq._REACH + ", " + mq._CONF + ", z AS (SELECT entity_id, count(*) AS n FROM mem GROUP BY entity_id) SELECT count(*) AS num_clusters, count(*) FILTER (n = 1) AS num_singletons, count(*) FILTER (n > 1) AS num_multi, max(n) AS largest, CAST(sum(n) AS BIGINT) AS members, (SELECT count(*) FROM conf) AS conflict_count, round((SELECT count(*) FROM conf) / sum(n), 9) AS conflict_rate FROM z",
    ),
    "snk05_normalisation_log": (normalisation_log, NORMALISATION_SQL),
    "jsn08_parsed_replies": (parsed_replies, PARSED_SQL),
    "jsn11_affiliation_packets": (affiliation_packets, None),
    "jsn09_blanked_cards": (blanked_cards, BLANKED_SQL),
    "flt01_eligible": (lambda s, d: table(s, d, "author_instances").filter(~F.col("truncation_flag") & (F.col("name_key") != "")).select("author_instance_id", "name_key", "year_int"), _ELIGIBLE),
    "flt06_valid_pairs": (valid_pairs, f"SELECT anchor_id, candidate_id, timestamp, label FROM {_LOG} WHERE anchor_id <> '' AND candidate_id <> '' AND lower({STRIP('label')}) IN ('match', 'non-match', 'uncertain') AND retry_count IN (0, 1)"),
    "flt08_curve_points": (curve_points, f"WITH {ev._CURVE} SELECT system, CAST(i AS INTEGER) AS i, tp + fp AS n_pred_match FROM q WHERE tp + fp > 0 AND pm >= 0.55"),
    "dq03_metric_violations": (metric_violations, f"SELECT count(*) FILTER (precision_match NOT BETWEEN 0 AND 1) AS precision_match, count(*) FILTER (recall_match NOT BETWEEN 0 AND 1) AS recall_match, count(*) FILTER (f1_match NOT BETWEEN 0 AND 1) AS f1_match, count(*) FILTER (coverage NOT BETWEEN 0 AND 1) AS coverage FROM ({ev.QUERIES['agg12_metric_suite'][1]})"),
    "arr06_evidence_items": (evidence_items, f"SELECT item, n, array_to_string({mq._fired('[item]')}, '|') AS fired FROM (SELECT item, count(*) AS n FROM (SELECT unnest(evidence_used) AS item FROM {_LOG}) GROUP BY item)"),
    "src09_task_sample": (
        lambda s, d: tables.task_pairs(table(s, d, "candidates_and").select("task", "anchor_id", "candidate_id").distinct(), "AND", 50).select("anchor_id", "candidate_id"),
        f"SELECT anchor_id, candidate_id FROM (SELECT DISTINCT anchor_id, candidate_id FROM candidates_and WHERE task = 'AND') ORDER BY {ev._DRAW}, anchor_id, candidate_id LIMIT 50",
    ),
    "arr03_id_lists": (
        lambda s, d: table(s, d, "records_normalised").select("source_file", "row_id_in_file", F.array_join(text.split_list(F.col("`Author(s) ID`")), "|").alias("ids"), F.col("author_ids_list").isNull().alias("no_list")),
        f"SELECT source_file, row_id_in_file, array_to_string({LIST('\"Author(s) ID\"', ';')}, '|') AS ids, author_ids_list IS NULL AS no_list FROM records_normalised",
    ),
}
