"""Queries of metrics, sampling, labelling, evidence, reports and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import evidence, guards, labelling, metrics, quality, reports, sampling, tfidf
from weft.operators.mentions import affiliation_mentions, unique_instances
from weft.plans.match_queries import _AFFIL_CTE, _LOG
from weft.plans.runtime import table
from weft.plans.text_queries import LIST, SIDES, SP, STRIP, TOKENS, _affil_pairs, _AFFIL_PAIRS_SQL

# ---------------------------------------------------------------- metrics over the log: label is gold


def _labelled(spark, sf_dir):
    log = table(spark, sf_dir, _LOG)
    return log.select(
        "anchor_id", "candidate_id", F.coalesce("run_id", F.lit("")).alias("run_id"), F.coalesce("reason_code", F.lit("")).alias("system"), "confidence", "signals_count",
        guards.three_class(F.col("label")).alias("gold"), guards.three_class(F.lower(F.trim("label_final"))).alias("predicted"), "label",
    )


_L = f"""l AS (SELECT anchor_id, candidate_id, coalesce(run_id, '') AS run_id, coalesce(reason_code, '') AS system, confidence, signals_count, label,
  CASE WHEN label IN ('match', 'non-match') THEN label ELSE 'uncertain' END AS gold,
  CASE WHEN lower(trim(label_final)) IN ('match', 'non-match') THEN lower(trim(label_final)) ELSE 'uncertain' END AS predicted FROM {_LOG})"""

_COUNTS = """count(*) AS n_total, count(*) FILTER (gold IN ('match', 'non-match')) AS n_gold_binary, count(*) FILTER (predicted IN ('match', 'non-match')) AS n_auto_decided,
 count(*) FILTER (predicted = 'match' AND gold = 'match') AS tp, count(*) FILTER (predicted = 'match' AND gold = 'non-match') AS fp,
 count(*) FILTER (predicted = 'non-match' AND gold = 'non-match') AS tn, count(*) FILTER (predicted = 'non-match' AND gold = 'match') AS fn,
 count(*) FILTER (predicted = 'uncertain' AND gold = 'match') AS abstained_match, count(*) FILTER (predicted = 'uncertain' AND gold = 'non-match') AS abstained_nonmatch"""


def _rates(by):
    keys = "".join(f"{b}, " for b in by)
    return f"""c AS (SELECT {keys}{_COUNTS} FROM x {('GROUP BY ' + ', '.join(by)) if by else ''}),
r AS (SELECT *, CASE WHEN n_gold_binary > 0 THEN CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END END AS pm,
 CASE WHEN n_gold_binary > 0 THEN CASE WHEN tp + fn + abstained_match > 0 THEN tp / (tp + fn + abstained_match) ELSE 0.0 END END AS rm,
 CASE WHEN n_gold_binary > 0 THEN CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 1.0 END END AS pn,
 CASE WHEN n_gold_binary > 0 THEN CASE WHEN tn + fp + abstained_nonmatch > 0 THEN tn / (tn + fp + abstained_nonmatch) ELSE 0.0 END END AS rn FROM c)
SELECT {keys}n_total, n_gold_binary, tp, fp, tn, fn, n_total - n_gold_binary AS n_uncertain_gold, abstained_match + abstained_nonmatch AS n_abstained_on_binary,
 round(n_auto_decided / n_total, 9) AS coverage, round(pm, 9) AS precision_match, round(rm, 9) AS recall_match, round(CASE WHEN pm + rm > 0 THEN 2 * pm * rm / (pm + rm) WHEN pm IS NOT NULL THEN 0.0 END, 9) AS f1_match,
 round(pn, 9) AS precision_nonmatch, round(rn, 9) AS recall_nonmatch, round(CASE WHEN pn + rn > 0 THEN 2 * pn * rn / (pn + rn) WHEN pn IS NOT NULL THEN 0.0 END, 9) AS f1_nonmatch,
 round(CASE WHEN n_gold_binary > 0 THEN (tp + tn) / n_gold_binary END, 9) AS accuracy_3way FROM r"""


def _shown(df, by):
    rates = ["coverage", "precision_match", "recall_match", "f1_match", "precision_nonmatch", "recall_nonmatch", "f1_nonmatch", "accuracy_3way"]
    counts = ["n_total", "n_gold_binary", "tp", "fp", "tn", "fn", "n_uncertain_gold", "n_abstained_on_binary"]
    return df.select(*by, *counts, *(F.round(c, 9).alias(c) for c in rates))


def metric_suite(spark, sf_dir):
    return _shown(metrics.metric_suite(_labelled(spark, sf_dir), "gold", "predicted", ["run_id", "system"]), ["run_id", "system"])


def slices(spark, sf_dir):
    """The suite of overlapping slices: all, by run, by system."""
    tags = F.array(F.lit("overall"), F.concat(F.lit("run_"), "run_id"), F.concat(F.lit("system_"), "system"))
    tagged = _labelled(spark, sf_dir).withColumn("slice", F.explode(tags))
    return _shown(metrics.metric_suite(tagged, "gold", "predicted", ["slice"]), ["slice"])


def sweep(spark, sf_dir):
    """The suite over a grid of match thresholds and signal counts: rows are folded to their distinct
    (label, confidence, signals, gold) first, so the grid multiplies a small table."""
    folded = _labelled(spark, sf_dir).groupBy("label", "confidence", "signals_count", "gold").agg(F.count(F.lit(1)).alias("n"))
    grid = F.array(*(F.struct(F.lit(t).alias("t_match"), F.lit(m).alias("m_signals")) for t in (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.99) for m in (0, 1, 2, 3)))
    x = folded.select("*", F.explode(grid).alias("g")).select("label", "confidence", "signals_count", "gold", "n", "g.*")
    x = x.withColumn("predicted", guards.reapplied(F.col("label"), F.col("confidence"), F.col("signals_count"), F.col("t_match"), F.col("m_signals")))
    counts = metrics._count_exprs("gold", "predicted", F.col("n"))
    return _shown(metrics.derived(x.groupBy("t_match", "m_signals").agg(*(e.alias(k) for k, e in counts.items()))), ["t_match", "m_signals"])


SWEEP_SQL = f"""WITH {_L}, g AS (SELECT t_match, m_signals FROM (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.99]::DOUBLE[]) AS t_match), (SELECT unnest([0, 1, 2, 3]) AS m_signals)),
x AS (SELECT t_match, m_signals, gold, CASE WHEN label = 'non-match' AND confidence >= 0.85 THEN 'non-match' WHEN label = 'match' AND confidence >= t_match AND signals_count >= m_signals THEN 'match' ELSE 'uncertain' END AS predicted FROM l, g),
{_rates(['t_match', 'm_signals'])}"""


def sweep_pivot(spark, sf_dir):
    return sweep(spark, sf_dir).groupBy("m_signals").pivot("t_match", [0.5, 0.85, 0.99]).agg(F.first("f1_match")).toDF("m_signals", "t50", "t85", "t99")


SWEEP_PIVOT_SQL = f"SELECT m_signals, max(f1_match) FILTER (t_match = 0.5) AS t50, max(f1_match) FILTER (t_match = 0.85) AS t85, max(f1_match) FILTER (t_match = 0.99) AS t99 FROM ({SWEEP_SQL}) GROUP BY m_signals"


def confusion(spark, sf_dir):
    return metrics.confusion_table(_labelled(spark, sf_dir), "gold", "predicted").withColumnRenamed("non-match", "non_match").withColumnRenamed("All", "total")


CONFUSION_SQL = f"""WITH {_L} SELECT coalesce(gold, 'All') AS gold, count(*) FILTER (predicted = 'match') AS "match", count(*) FILTER (predicted = 'non-match') AS non_match,
count(*) FILTER (predicted = 'uncertain') AS uncertain, count(*) AS total FROM l GROUP BY ROLLUP (gold)"""


def _curve(spark, sf_dir):
    scored = _labelled(spark, sf_dir).filter("label <> 'error'")
    return metrics.curve(scored, "confidence", "gold", metrics.grid(), ["system"])


def pr_curve(spark, sf_dir):
    c = _curve(spark, sf_dir)
    rates = ["precision_match", "recall_match", "f1_match", "precision_nonmatch", "recall_nonmatch", "f1_nonmatch"]
    return c.select("system", "i", "n_pred_match", "n_pred_nonmatch", "n_total", *(F.round(r, 9).alias(r) for r in rates))


_CURVE = f"""{_L}, g AS (SELECT i, 0.0::DOUBLE + i * (1.0::DOUBLE / 100) AS t FROM range(101) AS r(i)),
c AS (SELECT system, i, any_value(t) AS t, count(*) AS n_total, count(*) FILTER (gold = 'match') AS m, count(*) FILTER (gold = 'non-match') AS u,
  count(*) FILTER (gold = 'match' AND confidence >= t) AS tp, count(*) FILTER (gold = 'non-match' AND confidence >= t) AS fp FROM l, g WHERE label <> 'error' AND gold IN ('match', 'non-match') GROUP BY system, i),
d AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS pm, CASE WHEN m > 0 THEN tp / m ELSE 0.0 END AS rm,
  CASE WHEN n_total - tp - fp > 0 THEN (u - fp) / (n_total - tp - fp) ELSE 1.0 END AS pn, CASE WHEN u > 0 THEN (u - fp) / u ELSE 0.0 END AS rn FROM c),
q AS (SELECT *, CASE WHEN pm + rm > 0 THEN 2 * pm * rm / (pm + rm) ELSE 0.0 END AS fm, CASE WHEN pn + rn > 0 THEN 2 * pn * rn / (pn + rn) ELSE 0.0 END AS fn FROM d)"""
CURVE_SQL = f"""WITH {_CURVE} SELECT system, CAST(i AS INTEGER) AS i, tp + fp AS n_pred_match, n_total - tp - fp AS n_pred_nonmatch, n_total, round(pm, 9) AS precision_match, round(rm, 9) AS recall_match,
round(fm, 9) AS f1_match, round(pn, 9) AS precision_nonmatch, round(rn, 9) AS recall_nonmatch, round(fn, 9) AS f1_nonmatch FROM q"""


def operating_points(spark, sf_dir):
    p = metrics.operating_points(_curve(spark, sf_dir), 0.55, 0.55, ["system"])
    return p.select("system", *(F.round(c, 6).alias(c) for c in ("t_f1", "best_f1", "t_floor", "t_high", "t_low")), "achieved_floor")


POINTS_SQL = f"""WITH {_CURVE},
o AS (SELECT system, (list(t ORDER BY fm DESC, i))[1] AS t_f1, max(fm) AS best_f1, min(t) FILTER (tp + fp > 0 AND pm >= 0.55) AS t_floor, max(t) FILTER (n_total - tp - fp > 0 AND pn >= 0.55) AS tl FROM q GROUP BY system)
SELECT system, round(t_f1, 6) AS t_f1, round(best_f1, 6) AS best_f1, round(t_floor, 6) AS t_floor, round(coalesce(t_floor, 1.0), 6) AS t_high, round(least(coalesce(tl, 0.0), coalesce(t_floor, 1.0)), 6) AS t_low, t_floor IS NOT NULL AS achieved_floor FROM o"""


def applied(spark, sf_dir):
    """Predictions of the log's confidences by a single threshold and by a band."""
    s = F.col("confidence")
    l = _labelled(spark, sf_dir).select("anchor_id", "candidate_id", "run_id", "confidence", metrics.apply_threshold(s, F.lit(0.8)).alias("single"), metrics.apply_band(s, F.lit(0.6), F.lit(0.9)).alias("band"))
    return l.groupBy("run_id", "single", "band").agg(F.count(F.lit(1)).alias("n"))


APPLIED_SQL = f"""WITH {_L} SELECT run_id, CASE WHEN confidence IS NULL THEN 'uncertain' WHEN confidence >= 0.8 THEN 'match' ELSE 'non-match' END AS single,
CASE WHEN confidence >= 0.9 THEN 'match' WHEN confidence < 0.6 THEN 'non-match' ELSE 'uncertain' END AS band, count(*) AS n FROM l GROUP BY ALL"""


def bootstrap(spark, sf_dir):
    return metrics.bootstrap(_labelled(spark, sf_dir), "gold", "predicted", ["anchor_id", "candidate_id"])


# ---------------------------------------------------------------- sampling

_IDS = ["anchor_id", "candidate_id"]


def _scored(spark, sf_dir):
    c = table(spark, sf_dir, "candidates_and").filter("similarity_score is not null and not isnan(similarity_score)")
    return c.groupBy(*_IDS).agg(F.max("similarity_score").alias("score"))


_SCORED = "c AS (SELECT anchor_id, candidate_id, max(similarity_score) AS score FROM candidates_and WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score) GROUP BY ALL)"
_DRAW = "md5(concat_ws('|', '42', anchor_id, candidate_id))"


def bins(spark, sf_dir):
    return sampling.quantile_bins(_scored(spark, sf_dir), "score")


_BINS = f"""{_SCORED}, e AS (SELECT quantile_cont(score, [0.0, 0.2, 0.4, 0.6, 0.8]) AS q FROM c), cut AS (SELECT list_filter(list_distinct(q[2:]), lambda x: x > q[1]) AS cuts FROM e),
b AS (SELECT anchor_id, candidate_id, score, CAST(len(list_filter(cuts, lambda x: score > x)) AS INTEGER) AS bin FROM c, cut)"""


def binned_sample(spark, sf_dir):
    return sampling.per_bin_sample(bins(spark, sf_dir), 1000, 5000, _IDS)


_BIN_SAMPLE = f"""{_BINS}, r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {_DRAW}, anchor_id, candidate_id) AS k FROM b),
t AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN k <= 1000 THEN 0 ELSE 1 END, {_DRAW}, anchor_id, candidate_id) AS t FROM r WHERE k <= 5000),
smp AS (SELECT anchor_id, candidate_id, score, bin FROM t WHERE t <= 5000)"""


def split_sample(spark, sf_dir):
    return sampling.first_rows_split(binned_sample(spark, sf_dir), 1000, ["bin", *_IDS]).select(*_IDS, "split")


def strata(spark, sf_dir):
    return sampling.strata(_scored(spark, sf_dir), "score").select(*_IDS, "stratum")


_STRATA = f"""{_SCORED}, q AS (SELECT quantile_cont(score, 0.2) AS lo, quantile_cont(score, 0.8) AS hi FROM c),
st AS (SELECT anchor_id, candidate_id, score, CASE WHEN score >= hi THEN 'matchlike' WHEN score < lo THEN 'nonmatchlike' ELSE 'hard' END AS stratum FROM c, q)"""


def quota_sample(spark, sf_dir):
    return sampling.quota_sample(sampling.strata(_scored(spark, sf_dir), "score"), {"matchlike": 250, "hard": 500, "nonmatchlike": 250}, _IDS).select(*_IDS, "stratum")


QUOTA_SQL = f"""WITH {_STRATA}, r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_DRAW}, anchor_id, candidate_id) AS k FROM st),
t AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN k <= CASE stratum WHEN 'hard' THEN 500 ELSE 250 END THEN 0 ELSE 1 END, {_DRAW}, anchor_id, candidate_id) AS t FROM r WHERE k <= 1000)
SELECT anchor_id, candidate_id, stratum FROM t WHERE t <= 1000"""


def uniform_sample(spark, sf_dir):
    return sampling.sample(_scored(spark, sf_dir), 200, _IDS).select(*_IDS)


def not_sampled(spark, sf_dir):
    return _scored(spark, sf_dir).select(*_IDS).join(uniform_sample(spark, sf_dir), _IDS, "left_anti")


_UNIFORM = f"SELECT anchor_id, candidate_id FROM c ORDER BY {_DRAW}, anchor_id, candidate_id LIMIT 200"

# ---------------------------------------------------------------- evidence and labelling


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, _LOG).select(*_IDS).distinct()


def author_cards(spark, sf_dir):
    one = unique_instances(table(spark, sf_dir, "author_instances"))
    return evidence.pair_cards(_pairs(spark, sf_dir), evidence.author_cards(one, table(spark, sf_dir, "records_normalised")), "author_instance_id", "AND")


def author_packets(spark, sf_dir):
    return evidence.author_packets(author_cards(spark, sf_dir))


_SAFE = "CASE WHEN {0} IS NULL OR lower(trim({0})) IN ('nan', 'none') THEN '' ELSE {0} END"
_ONE = SIDES.split("WITH ")[1].split("p AS (")[0].strip().rstrip(",")
_NAME = rf"regexp_replace(regexp_replace({_SAFE.format('author_norm')}, '{SP}*\([0-9]{{6,20}}\)', '', 'g'), '^{SP}+|{SP}+$', '', 'g')"
PACKETS_SQL = f"""WITH {_ONE}, names AS (SELECT record_id, author_pos, {_NAME} AS name FROM one), rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY source_file NULLS FIRST, row_id_in_file NULLS FIRST) AS rk FROM records_normalised) WHERE rk = 1),
pr AS (SELECT record_id, list({{'p': author_pos, 'n': name}} ORDER BY author_pos, name) AS l FROM (SELECT DISTINCT * FROM names) GROUP BY record_id),
card AS (SELECT author_instance_id AS id, {_NAME} AS author_norm, list_transform(list_filter(l, lambda x: x.p <> one.author_pos), lambda x: x.n) AS co, {_SAFE.format('r."affiliations_norm"')} AS aff,
  {_SAFE.format('r."Title"')} AS title, {_SAFE.format('r."Source title"')} AS st, CAST(r.year_int AS VARCHAR) AS yr FROM one LEFT JOIN pr ON pr.record_id = one.record_id LEFT JOIN rec r ON r.record_id = one.record_id),
j AS (SELECT id, author_norm, CASE WHEN len(co) > 15 THEN array_to_string(co[1:15], ' | ') || ' | …' ELSE array_to_string(co, ' | ') END AS co, aff, title, st, yr FROM card)
SELECT p.anchor_id, p.candidate_id, a.author_norm AS anchor_author_norm, a.co AS anchor_coauthors_norm, a.aff AS anchor_affiliations_norm, a.title AS anchor_title, a.st AS anchor_source_title, a.yr AS anchor_year,
 c.author_norm AS candidate_author_norm, c.co AS candidate_coauthors_norm, c.aff AS candidate_affiliations_norm, c.title AS candidate_title, c.st AS candidate_source_title, c.yr AS candidate_year
FROM (SELECT DISTINCT anchor_id, candidate_id FROM {_LOG}) p JOIN j a ON a.id = p.anchor_id JOIN j c ON c.id = p.candidate_id"""


def card_json(spark, sf_dir):
    return evidence.limited(author_cards(spark, sf_dir)).select(*_IDS, F.to_json("card").alias("card"), "truncated")


def prompts(spark, sf_dir):
    p = evidence.prompts(evidence.without_fields(author_cards(spark, sf_dir), ["coauthors_norm"]), "Compare: {{EVIDENCE_CARD}}")
    return p.select(*_IDS, "prompt_chars", F.get_json_object(F.substring("prompt", 10, 2**31 - 1), "$.task").alias("task"))


def linked_authors(spark, sf_dir):
    cards = evidence.affiliation_cards(affiliation_mentions(table(spark, sf_dir, "records_normalised")).dropDuplicates(["affil_instance_id"]), table(spark, sf_dir, "records_normalised"))
    return cards.select("affil_instance_id", F.array_join("side.linked_authors_norm", ";").alias("linked"), F.col("side.linked_authors_fallback").alias("fallback"))


def _set(x):
    return f"list_distinct(list_filter({TOKENS('lower(' + x + ')')}, lambda y: length(y) >= 2))"


_HIT = f"len(list_intersect({_set('p')}, w)) > 0"
_PARTS = f"list_filter(list_transform(string_split(s, ','), lambda q: {STRIP('q')}), lambda q: q <> '')"
LINKED_SQL = f"""WITH {_AFFIL_CTE}, rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY source_file NULLS FIRST, row_id_in_file NULLS FIRST) AS rk FROM records_normalised) WHERE rk = 1),
d AS (SELECT id, any_value(record_id) AS record_id, any_value(affil_norm) AS affil_norm FROM ai GROUP BY id),
t AS (SELECT d.id, {_set('d.affil_norm')} AS w, {LIST('r.authors_with_affiliations_norm', ';')} AS segs, {LIST('r.authors_norm', ',')} AS everyone FROM d LEFT JOIN rec r ON r.record_id = d.record_id),
s AS (SELECT id, w, everyone, unnest(segs) AS s, unnest(range(len(segs))) AS n FROM t),
o AS (SELECT id, n, s, w, {_PARTS} AS parts FROM s WHERE len(w) > 0 AND len(list_intersect(w, {_set('s')})) >= len(w) * 0.30),
h AS (SELECT id, n, parts, list_position(list_transform(parts, lambda p: {_HIT}), true) AS stop FROM o),
m AS (SELECT id, n, array_to_string(CASE WHEN coalesce(stop, 0) > 0 THEN parts[1:stop - 1] ELSE parts END, ', ') AS name FROM h),
g AS (SELECT id, string_agg(name, ';' ORDER BY n) AS linked FROM m WHERE name <> '' GROUP BY id)
SELECT t.id AS affil_instance_id, CASE WHEN g.id IS NULL THEN array_to_string(everyone, ';') ELSE linked END AS linked, g.id IS NULL AS fallback FROM t LEFT JOIN g ON g.id = t.id"""


def packet_labels(spark, sf_dir):
    """Quality-control labels of the author packets, and the autofill labels, whose signals are others."""
    packets = author_packets(spark, sf_dir)
    control = labelling.and_signals(packets).select(*_IDS, *(F.round(c, 4).alias(c) if c != "coauthor_overlap_count" else F.col(c) for c in ("name_sim", "coauthor_overlap_count", "affil_sim")), labelling.and_label().alias("label"))
    auto = labelling.autofill_and_signals(packets).select(*_IDS, labelling.autofill_and().alias("a"), labelling.autofill_details("AND").alias("details"))
    return control.join(auto.select(*_IDS, F.col("a.label").alias("auto"), "a.rule", "details"), _IDS)


def label_rules(spark, sf_dir):
    """The label rules over given signals: confidence, counts and letters of the log stand in."""
    letter = F.when(F.col("retry_count") > 0, F.substring("anchor_id", 1, 1)).otherwise("")
    p = table(spark, sf_dir, _LOG).select(
        *_IDS, "timestamp", F.col("confidence").alias("name_sim"), F.col("signals_count").alias("coauthor_overlap_count"), (1 - F.col("confidence")).alias("affil_sim"),
        letter.alias("surname_a"), F.substring("candidate_id", 1, 1).alias("surname_b"), (F.col("retry_count") > 0).alias("fell_back"),
        F.col("confidence").alias("affil_str_sim"), (F.col("retry_count") / 2.0).alias("token_jaccard"), (F.col("signals_count") > 2).alias("acronym_overlap"),
    )
    out = p.select(*_IDS, "timestamp", labelling.and_label().alias("and_label"), labelling.ain_label().alias("ain_label"), labelling.autofill_and().alias("a"), labelling.autofill_ain(F.col("fell_back")).alias("i"))
    return out.select(*_IDS, "timestamp", "and_label", "ain_label", F.col("a.label").alias("and_auto"), F.col("a.rule").alias("and_rule"), F.col("i.label").alias("ain_auto"), F.col("i.rule").alias("ain_rule"))


_RULES_CTE = f"""p AS (SELECT anchor_id, candidate_id, timestamp, confidence AS n, signals_count AS co, 1 - confidence AS a, CASE WHEN retry_count > 0 THEN left(anchor_id, 1) ELSE '' END AS x, left(candidate_id, 1) AS y,
 retry_count > 0 AS fb, retry_count / 2.0 AS tj, signals_count > 2 AS ao FROM {_LOG}),
r AS (SELECT *, CASE WHEN n >= 0.98 AND (co >= 1 OR a >= 0.95) THEN 'match' WHEN n <= 0.60 THEN 'non-match' ELSE 'uncertain' END AS and_label,
 CASE WHEN n >= 0.95 AND (tj >= 0.55 OR ao) THEN 'match' WHEN n <= 0.45 THEN 'non-match' ELSE 'uncertain' END AS ain_label,
 CASE WHEN n >= 0.97 AND (co >= 1 OR a >= 0.95) AND (x = '' OR y = '' OR x = y) THEN CASE WHEN co >= 1 THEN 'AND_MATCH_NAME+COAUTH' ELSE 'AND_MATCH_NAME+AFFIL' END
      WHEN x <> '' AND y <> '' AND x <> y AND n <= 0.85 THEN 'AND_NONMATCH_SURNAME_MISMATCH' WHEN n <= 0.70 THEN 'AND_NONMATCH_LOWNAME' ELSE '' END AS and_rule,
 CASE WHEN n >= 0.95 AND (ao OR tj >= 0.60) AND NOT (fb AND n < 0.97) THEN CASE WHEN ao THEN 'AIN_MATCH_STR+ACRO' ELSE 'AIN_MATCH_STR+JAC' END
      WHEN n <= 0.45 AND tj <= 0.20 AND NOT ao THEN 'AIN_NONMATCH_STR+JAC' ELSE '' END AS ain_rule FROM p),
z AS (SELECT *, CASE WHEN and_rule LIKE '%NONMATCH%' THEN 'non-match' WHEN and_rule <> '' THEN 'match' END AS and_auto, CASE WHEN ain_rule LIKE '%NONMATCH%' THEN 'non-match' WHEN ain_rule <> '' THEN 'match' END AS ain_auto FROM r)"""
LABEL_RULES_SQL = f"WITH {_RULES_CTE} SELECT anchor_id, candidate_id, timestamp, and_label, ain_label, and_auto, and_rule, ain_auto, ain_rule FROM z"


def fill_labels(spark, sf_dir):
    """Final labels filled by the author rules over the stand-in signals, counted with their audit columns."""
    log = table(spark, sf_dir, _LOG)
    p = log.select(
        "label_final", F.col("confidence").alias("name_sim"), F.col("signals_count").alias("coauthor_overlap_count"), (1 - F.col("confidence")).alias("affil_sim"),
        F.when(F.col("retry_count") > 0, F.substring("anchor_id", 1, 1)).otherwise("").alias("surname_a"), F.substring("candidate_id", 1, 1).alias("surname_b"),
    )
    rule = labelling.autofill_and()
    filled = labelling.fill_labels(p, "label_final", rule["label"], rule["rule"], labelling.autofill_details("AND"))
    return filled.groupBy("label_final", "auto_filled", "auto_rule", (F.col("auto_metrics") == "").alias("no_metrics")).agg(F.count(F.lit(1)).alias("n"))


FILL_SQL = f"""WITH {_RULES_CTE.replace("anchor_id, candidate_id, timestamp, confidence AS n", "coalesce(label_final, '') AS lf, confidence AS n", 1)},
k AS (SELECT *, {STRIP('lf')} <> '' AND lower({STRIP('lf')}) NOT IN ('nan', 'none') AS kept FROM z)
SELECT CASE WHEN NOT kept AND and_auto IS NOT NULL THEN and_auto ELSE lf END AS label_final, CASE WHEN NOT kept AND and_auto IS NOT NULL THEN 'true' ELSE 'false' END AS auto_filled,
 CASE WHEN kept THEN 'skipped:already_filled' ELSE and_rule END AS auto_rule, kept AS no_metrics, count(*) AS n FROM k GROUP BY ALL"""


# ---------------------------------------------------------------- tf-idf


def tfidf_scores(spark, sf_dir):
    texts = table(spark, sf_dir, "affil_spellings").select(F.col("spelling_id").alias("id"), F.col("affil_text").alias("text"))
    pairs = _affil_pairs(spark, sf_dir).select(F.col("a").alias("anchor_id"), F.col("b").alias("candidate_id"))
    return tfidf.pair_cosine(pairs, tfidf.vectors(texts)).withColumn("score", F.round("score", 6))


TFIDF_SQL = _AFFIL_PAIRS_SQL.rstrip() + r""",
w AS (SELECT spelling_id AS id, regexp_extract_all(lower(affil_text), '[\p{L}\p{N}_]{2,}') AS w FROM affil_spellings),
g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL), st AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term),
kept AS (SELECT * FROM st ORDER BY total DESC, term LIMIT 20000),
raw AS (SELECT id, tf.term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM affil_spellings)) / (1.0 + df)) + 1) AS w FROM tf JOIN kept ON kept.term = tf.term),
v AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw),
d AS (SELECT a, b, sum(x.w * y.w) AS s FROM s JOIN v x ON x.id = a JOIN v y ON y.id = b AND y.term = x.term GROUP BY a, b)
SELECT s.a AS anchor_id, s.b AS candidate_id, round(least(1.0, greatest(0.0, coalesce(d.s, 0.0))), 6) AS score FROM s LEFT JOIN d ON d.a = s.a AND d.b = s.b"""

# ---------------------------------------------------------------- reports and quality

_NORMS = ["authors_norm", "author_full_names_norm", "affiliations_norm", "authors_with_affiliations_norm", "author_ids_list", "affiliations_acronyms", "year_int"]
_RAW_NORM = [("Authors", "authors_norm"), ("Author full names", "author_full_names_norm"), ("Affiliations", "affiliations_norm"), ("Authors with affiliations", "authors_with_affiliations_norm")]
_COLUMNS = ["Authors", "Author full names", "Author(s) ID", "Title", "Year", "Source title", "DOI", "Affiliations", "Abstract", "EID", "record_id", "authors_norm", "affiliations_norm", "year_int"]


def _missing_sql():
    parts = []
    for c in _COLUMNS:
        blank = "" if c == "year_int" else f" OR {STRIP(chr(34) + c + chr(34))} = ''"
        parts.append(f"SELECT '{c}' AS \"column\", count(*) FILTER (\"{c}\" IS NULL{blank}) AS n_missing, count(*) AS n_rows FROM records_normalised")
    return " UNION ALL ".join(parts)


def _filled_sql():
    tests = {"author_ids_list": "len(author_ids_list) > 0", "affiliations_acronyms": "len(affiliations_acronyms) > 0", "year_int": "true"}
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NOT NULL AND {tests.get(c, c + chr(32) + '<> ' + chr(39) * 2)}) AS n_filled FROM records_normalised" for c in _NORMS)


def best_system(spark, sf_dir):
    suite = metrics.metric_suite(_labelled(spark, sf_dir), "gold", "predicted", ["run_id", "system"]).withColumn("f1", F.round("f1_match", 9))
    return reports.best_system(suite, ["run_id"], "system", "f1")


BEST_SQL = f"""WITH {_L}, x AS (SELECT * FROM l), suite AS (SELECT * FROM (WITH {_rates(['run_id', 'system'])}))
SELECT run_id, system, f1_match AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY f1_match DESC, system) AS k FROM suite WHERE f1_match IS NOT NULL) WHERE k = 1"""

COSTS_SQL = f"""SELECT *, round(i / nullif(n_with_usage, 0), 6) AS avg_input_tokens, round(o / nullif(n_with_usage, 0), 6) AS avg_output_tokens, round(i / 1e6 * 3.0 + o / 1e6 * 15.0, 6) AS cost_usd,
 round((i / 1e6 * 3.0 + o / 1e6 * 15.0) * 1000 / nullif(n_with_usage, 0), 6) AS cost_per_1k, CAST(epoch(last_seen::TIMESTAMPTZ) - epoch(first_seen::TIMESTAMPTZ) AS BIGINT) AS duration_s, i AS input_tokens, o AS output_tokens
FROM (SELECT CASE WHEN grouping(model) = 1 THEN 'TOTAL' ELSE model END AS model, count(*) AS n_decisions, count(*) FILTER (stub) AS n_stubs, count(input_tokens) FILTER (NOT stub) AS n_with_usage,
 count(*) FILTER (NOT stub AND retry_count > 0) AS n_retries, count(*) FILTER (NOT stub AND (label = 'error' OR reason_code LIKE 'api_error%')) AS n_api_errors,
 CAST(coalesce(sum(input_tokens) FILTER (NOT stub), 0) AS BIGINT) AS i, CAST(coalesce(sum(output_tokens) FILTER (NOT stub), 0) AS BIGINT) AS o, min(timestamp) FILTER (NOT stub) AS first_seen, max(timestamp) FILTER (NOT stub) AS last_seen
 FROM (SELECT *, coalesce(model_id, '') AS model, coalesce(backend = 'requests_only', false) AS stub FROM {_LOG}) GROUP BY ROLLUP (model))""".replace("SELECT *, round(i", "SELECT * EXCLUDE (i, o), round(i", 1)


QUERIES = {
    "agg12_metric_suite": (metric_suite, f"WITH {_L}, x AS (SELECT * FROM l), {_rates(['run_id', 'system'])}"),
    "jsn12_slices": (
        slices,
        f"WITH {_L}, x AS (SELECT 'overall' AS slice, gold, predicted FROM l UNION ALL SELECT 'run_' || run_id, gold, predicted FROM l UNION ALL SELECT 'system_' || system, gold, predicted FROM l), {_rates(['slice'])}",
    ),
    "agg17_sweep": (sweep, SWEEP_SQL),
    "agg18_sweep_pivot": (sweep_pivot, SWEEP_PIVOT_SQL),
    "agg11_confusion": (confusion, CONFUSION_SQL),
    "agg14_pr_curve": (pr_curve, CURVE_SQL),
    "sel01_operating_points": (operating_points, POINTS_SQL),
    "rul07_applied": (applied, APPLIED_SQL),
    "agg25_bootstrap": (bootstrap, None),
    "smp01_bins": (bins, f"WITH {_BINS} SELECT * FROM b"),
    "smp01_bin_sample": (binned_sample, f"WITH {_BIN_SAMPLE} SELECT * FROM smp"),
    "smp02_split": (split_sample, f"WITH {_BIN_SAMPLE} SELECT anchor_id, candidate_id, CASE WHEN row_number() OVER (ORDER BY bin, anchor_id, candidate_id) <= 1000 THEN 'dev' ELSE 'test' END AS split FROM smp"),
    "smp03_strata": (strata, f"WITH {_STRATA} SELECT anchor_id, candidate_id, stratum FROM st"),
    "smp04_quota": (quota_sample, QUOTA_SQL),
    "smp05_uniform": (uniform_sample, f"WITH {_SCORED} {_UNIFORM}"),
    "set04_not_sampled": (not_sampled, f"WITH {_SCORED}, u AS ({_UNIFORM}) SELECT anchor_id, candidate_id FROM c EXCEPT SELECT anchor_id, candidate_id FROM u"),
    "jsn01_author_packets": (author_packets, PACKETS_SQL),
    "jsn04_card_json": (card_json, None),
    "jsn03_prompts": (prompts, None),
    "jn26_linked_authors": (linked_authors, LINKED_SQL),
    "rul02_packet_labels": (packet_labels, None),
    "rul04_label_rules": (label_rules, LABEL_RULES_SQL),
    "rul06_fill_labels": (fill_labels, FILL_SQL),
    "sim11_tfidf": (tfidf_scores, TFIDF_SQL),
    "agg01_rows_per_file": (lambda s, d: table(s, d, "records_normalised").groupBy("query_frame", "source_file").agg(F.count(F.lit(1)).alias("n")), "SELECT query_frame, source_file, count(*) AS n FROM records_normalised GROUP BY ALL"),
    "agg02_missingness": (lambda s, d: reports.missingness(table(s, d, "records_normalised"), _COLUMNS), _missing_sql()),
    "agg03_filled": (lambda s, d: reports.filled_counts(table(s, d, "records_normalised"), _NORMS), _filled_sql()),
    "agg04_changed": (
        lambda s, d: reports.changed_counts(table(s, d, "records_normalised"), _RAW_NORM),
        " UNION ALL ".join(f"SELECT '{r}' AS \"column\", count(*) FILTER (\"{r}\" IS NOT NULL AND \"{r}\" IS DISTINCT FROM {n}) AS n_changed FROM records_normalised" for r, n in _RAW_NORM),
    ),
    "agg05_instance_stats": (
        lambda s, d: reports.instance_stats(table(s, d, "author_instances")),
        "SELECT count(*) AS total, count(*) FILTER (truncation_flag) AS truncated, count(*) FILTER (NOT truncation_flag) AS eligible, round(100.0 * count(*) FILTER (coalesce(author_id, '') = '') / count(*), 6) AS missing_id_pct, round(100.0 * count(*) FILTER (year_int IS NULL) / count(*), 6) AS missing_year_pct FROM author_instances",
    ),
    "arr05_acronym_frequency": (
        lambda s, d: reports.element_frequency(table(s, d, "records_normalised"), "affiliations_acronyms"),
        "SELECT element, count(*) AS n FROM (SELECT unnest(affiliations_acronyms) AS element FROM records_normalised) GROUP BY element ORDER BY n DESC, element LIMIT 20",
    ),
    "agg24_label_counts": (lambda s, d: reports.value_counts(table(s, d, _LOG), "label_final"), f"SELECT label_final AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM {_LOG}), 2) AS pct FROM {_LOG} GROUP BY label_final"),
    "agg19_costs": (lambda s, d: reports.cost_report(table(s, d, _LOG)), COSTS_SQL),
    "agg21_runtime": (
        lambda s, d: reports.runtime_summary(reports.cost_report(table(s, d, _LOG)), "AND"),
        f"""WITH c AS ({COSTS_SQL}) SELECT 'AND' AS task, 'C5 (LLM verify -- API call span)' AS stage, duration_s::DOUBLE AS duration_sec, duration_s / 60 AS duration_min, n_with_usage AS n_pairs,
        duration_s * 1000 / n_with_usage AS sec_per_1k_pairs, n_with_usage > 0 AS data_available FROM c WHERE model = 'TOTAL'
        UNION ALL SELECT 'all', unnest(['C4 (blocking/candidate generation)', 'C6 (guard application)', 'C7 (clustering/union-find)']), NULL, NULL, NULL, NULL, false""",
    ),
    "agg22_score_summary": (
        lambda s, d: reports.score_summary(table(s, d, "candidates_and"), "best_pass_id", "similarity_score"),
        "SELECT best_pass_id, min(x) AS min_score, max(x) AS max_score, round(avg(x), 12) AS mean_score, count(x) AS n_scored FROM (SELECT best_pass_id, CASE WHEN NOT isnan(similarity_score) THEN similarity_score END AS x FROM candidates_and) GROUP BY best_pass_id",
    ),
    "agg23_best_system": (best_system, BEST_SQL),
    "srt02_system_order": (
        lambda s, d: reports.system_order(_labelled(s, d).select("system").distinct(), "system", "name_only", ["thin"]),
        f"WITH {_L} SELECT system, CAST(row_number() OVER (ORDER BY CASE system WHEN 'name_only' THEN 0 WHEN 'thin' THEN 2 ELSE 1 END, system) AS INTEGER) AS place FROM (SELECT DISTINCT system FROM l)",
    ),
    "dq01_predictions": (
        lambda s, d: quality.prediction_violations(table(s, d, _LOG)),
        f"SELECT count(*) AS n_rows, count(*) FILTER (label_final IS NULL OR label_final NOT IN ('match', 'non-match', 'uncertain')) AS bad_label, count(*) FILTER (confidence IS NULL OR confidence NOT BETWEEN 0 AND 1) AS bad_confidence, count(*) FILTER (anchor_id IS NULL OR candidate_id IS NULL) AS null_id, count(*) - count(DISTINCT (anchor_id, candidate_id)) AS repeated_pairs FROM {_LOG}",
    ),
    "dq02_scores": (
        lambda s, d: quality.score_violations(table(s, d, "candidates_and"), "similarity_score"),
        "SELECT count(*) AS n_rows, count(*) FILTER (similarity_score IS NULL) AS null_score, count(*) FILTER (isnan(similarity_score)) AS nan_score, count(*) FILTER (NOT isnan(similarity_score) AND similarity_score NOT BETWEEN 0 AND 1) AS out_of_range, count(*) - count(DISTINCT (anchor_id, candidate_id)) AS repeated_pairs FROM candidates_and",
    ),
    "dq03_split_overlap": (lambda s, d: quality.split_overlap(table(s, d, _LOG).withColumn("split", text.blank_if_null(F.col("run_id"))), "split"), f"SELECT anchor_id, candidate_id FROM {_LOG} GROUP BY ALL HAVING count(DISTINCT coalesce(run_id, '')) > 1"),
    "dq07_incomplete_codes": (lambda s, d: quality.incomplete_codes(table(s, d, _LOG).select("anchor_id", "candidate_id", "retry_count", F.col("signals_count").alias("code")), "code"), f"SELECT anchor_id, candidate_id, retry_count, signals_count AS code FROM {_LOG} WHERE signals_count NOT IN (0, 1, 2) OR signals_count IS NULL"),
}
