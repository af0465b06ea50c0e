"""Metrics, thresholds, sampling, labels, evidence and checks."""

import pytest
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import decisions, evidence, labelling, metrics, quality, reports, sampling, tfidf


def test_metric_suite(spark):
    rows = [("match", "match")] * 3 + [("match", "uncertain"), ("match", "non-match"), ("non-match", "match"), ("non-match", "non-match"), ("uncertain", "match")]
    r = metrics.metric_suite(spark.createDataFrame(rows, "g string, p string"), "g", "p").first()
    assert (r.tp, r.fp, r.tn, r.fn, r.n_gold_binary, r.n_auto_decided) == (3, 1, 1, 1, 7, 7)
    assert r.precision_match == 0.75 and r.recall_match == 0.6 and r.coverage == 7 / 8
    only = metrics.metric_suite(spark.createDataFrame([("uncertain", "match")], "g string, p string"), "g", "p").first()
    assert only.precision_match is None and only.coverage == 1.0
    none = metrics.metric_suite(spark.createDataFrame([("match", "uncertain")], "g string, p string"), "g", "p").first()
    assert none.precision_match == 1.0 and none.recall_match == 0.0


def test_curve_and_points(spark):
    rows = [(0.9, "match"), (0.8, "non-match"), (0.7, "match"), (0.2, "non-match"), (None, "match"), (0.5, "uncertain")]
    c = metrics.curve(spark.createDataFrame(rows, "s double, g string"), "s", "g", metrics.grid())
    by = {r.i: r for r in c.collect()}
    assert len(by) == 101 and by[0].n_pred_match == 4 and by[85].precision_match == 1.0 and by[85].recall_match == 0.5 and by[100].precision_match == 1.0
    p = metrics.operating_points(c, 0.99, 0.99).first()
    assert p.t_floor == pytest.approx(0.81) and p.t_low == pytest.approx(0.69)
    q = metrics.operating_points(c, 1.1, 1.1).first()
    assert q.t_floor is None and (q.t_low, q.t_high) == (0.0, 1.0)


def test_thresholds(spark):
    df = spark.createDataFrame([(0.5,), (0.9,), (None,)], "s double")
    assert [r[0] for r in df.select(metrics.apply_threshold(F.col("s"), F.lit(0.9))).collect()] == ["non-match", "match", "uncertain"]
    assert [r[0] for r in df.select(metrics.apply_threshold(F.col("s"), F.lit(None).cast("double"))).collect()] == ["uncertain"] * 3
    assert [r[0] for r in df.select(metrics.apply_band(F.col("s"), F.lit(0.6), F.lit(0.9))).collect()] == ["non-match", "match", "uncertain"]


def test_bootstrap(spark):
    rows = [("a", str(i), "match" if i % 2 else "non-match", "match" if i % 3 else "non-match") for i in range(200)]
    df = spark.createDataFrame(rows, "a string, c string, g string, p string")
    got = {r.metric: r for r in metrics.bootstrap(df, "g", "p", ["a", "c"], 300).collect()}
    point = metrics.metric_suite(df, "g", "p").first()
    assert len(got) == 6 and all(got[m].low <= point[m] <= got[m].high and got[m].high - got[m].low < 0.3 for m in got)
    assert metrics.bootstrap(df.limit(0), "g", "p", ["a", "c"], 10).filter("low is not null").count() == 0


def test_sampling(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("a"), F.lit("c").alias("c"), (F.col("id") / 1000).alias("score"))
    bins = sampling.quantile_bins(df, "score")
    assert {r["count"] for r in bins.groupBy("bin").count().collect()} == {200}
    assert sampling.quantile_bins(df.withColumn("score", F.lit(0.5)), "score").select("bin").distinct().count() == 1
    s = sampling.per_bin_sample(bins, 250, 600, ["a", "c"])
    assert s.count() == 600 and s.distinct().count() == 600
    strata = sampling.strata(df, "score")
    q = sampling.quota_sample(strata, {"matchlike": 300, "hard": 50, "nonmatchlike": 50}, ["a", "c"])
    assert q.count() == 400 and q.filter("stratum = 'matchlike'").count() == 200
    assert sampling.parse_quota("a=1, b=2") == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        sampling.parse_quota("a=x")


def test_quantiles_and_draws_without_sorting_all(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for x in (rng.normal(size=3001), np.round(rng.random(2000), 2), np.r_[np.zeros(900), 1e-300, 1e9, rng.random(50) * 1e-9], np.array([0.25])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "s double")
        want = np.quantile(x, [0.0, 0.2, 0.5, 0.8, 1.0])
        assert np.allclose(sampling.edges(df, "s", [0.0, 0.2, 0.5, 0.8, 1.0]), want, rtol=1e-12, atol=0)
    assert sampling.edges(spark.createDataFrame([], "s double"), "s", [0.5]) == []
    df = spark.range(20000).selectExpr("id", "cast(id % 3 as int) as bin")
    got = {(r.bin, r._k): r.id for r in sampling._first_drawn(df, "bin", 30, ["id"], 42).collect()}
    all_ = df.select("bin", "id", sampling.draw("id").alias("d")).toPandas().sort_values(["bin", "d"])
    want = {(b, k + 1): i for b, g in all_.groupby("bin") for k, i in enumerate(g["id"][:30])}
    assert got == want


def test_evaluation_needs_dev_rows(spark):
    from weft.plans import pipeline

    with pytest.raises(ValueError):
        pipeline.evaluate(spark.createDataFrame([("s", "test", "match", 0.5)], "system string, split string, gold_label string, score double"))
    bad = spark.createDataFrame([(0.2, 0.1), (0.1, 0.2), (None, 0.1)], "low double, high double")
    assert quality.inverted_intervals(bad, "low", "high").count() == 1


AND = "anchor_author_norm string, candidate_author_norm string, anchor_coauthors_norm string, candidate_coauthors_norm string, anchor_affiliations_norm string, candidate_affiliations_norm string"


def test_author_labels(spark):
    rows = [("doe, j", "doe, j", "x | y", "y", "", ""), ("doe, j", "doe, j", "", "", "a b", "c d"), ("doe, j", "zzz", "", "", "", ""), ("", None, "x", "x", "a", "a"), ("doe, j (123456)", "doe, j", "", "", "lab a", "lab a")]
    packets = spark.createDataFrame(rows, AND)
    p = labelling.and_signals(packets)
    got = p.select("name_sim", "coauthor_overlap_count", labelling.and_label().alias("l")).collect()
    assert [r.l for r in got] == ["match", "uncertain", "non-match", "non-match", "match"]
    assert got[0].coauthor_overlap_count == 1 and got[3].name_sim == 0.0
    auto = [r[0] for r in labelling.autofill_and_signals(packets).select(labelling.autofill_and()["rule"]).collect()]
    assert auto == ["AND_MATCH_NAME+COAUTH", "", "AND_NONMATCH_LOWNAME", "AND_NONMATCH_LOWNAME", "AND_MATCH_NAME+AFFIL"]


@pytest.mark.parametrize(
    "n, co, affil, a, b, expected",
    [
        (0.97, 1, 0.0, "x", "x", "match"), (0.97, 0, 0.95, "", "x", "match"), (0.97, 1, 0.0, "x", "y", None), (0.97, 0, 0.94, "x", "x", None), (0.969, 1, 1.0, "x", "x", None),
        (0.85, 3, 1.0, "x", "y", "non-match"), (0.85, 0, 0.0, "x", "x", None), (0.85, 0, 0.0, "", "y", None), (0.70, 5, 1.0, "x", "x", "non-match"), (0.70, 0, 0.0, "", "", "non-match"), (0.71, 0, 0.0, "", "", None),
    ],
)
def test_autofill_author_rules(spark, n, co, affil, a, b, expected):
    df = spark.createDataFrame([(n, co, affil, a, b)], "name_sim double, coauthor_overlap_count int, affil_sim double, surname_a string, surname_b string")
    assert df.select(labelling.autofill_and()["label"]).first()[0] == expected


@pytest.mark.parametrize(
    "s, j, acronym, fell_back, expected",
    [
        (0.95, 0.60, False, False, "match"), (0.95, 0.59, False, False, None), (0.95, 0.0, True, False, "match"), (0.96, 0.9, True, True, None), (0.97, 0.9, True, True, "match"),
        (0.45, 0.20, False, False, "non-match"), (0.45, 0.21, False, False, None), (0.45, 0.20, True, False, None), (0.46, 0.0, False, False, None),
    ],
)
def test_autofill_affiliation_rules(spark, s, j, acronym, fell_back, expected):
    df = spark.createDataFrame([(s, j, acronym, fell_back)], "affil_str_sim double, token_jaccard double, acronym_overlap boolean, fb boolean")
    assert df.select(labelling.autofill_ain(F.col("fb"))["label"]).first()[0] == expected


@pytest.mark.parametrize("name_sim, expected", [(0.60, "non-match"), (0.61, "uncertain"), (0.98, "uncertain")])
def test_author_label_boundaries(spark, name_sim, expected):
    df = spark.createDataFrame([(name_sim, 0, 0.0)], "name_sim double, coauthor_overlap_count int, affil_sim double")
    assert df.select(labelling.and_label()).first()[0] == expected


def test_affiliation_labels(spark):
    rows = [("univ of x", "univ of x", "abc", "ABC"), ("univ", "labo y", "", ""), ("", "", "", "")]
    p = labelling.ain_signals(spark.createDataFrame(rows, "anchor_affil_norm string, candidate_affil_norm string, anchor_affil_acronyms string, candidate_affil_acronyms string"))
    assert [r[0] for r in p.select(labelling.ain_label()).collect()] == ["match", "non-match", "non-match"]
    assert p.first().acronym_overlap


def test_fill_labels(spark):
    df = spark.createDataFrame([("match", "x"), ("", "y"), (None, "z"), (" ", None)], "old string, new string")
    got = labelling.fill_labels(df, "old", F.col("new"), F.lit("r"), F.lit("m"))
    assert [tuple(r) for r in got.select("old", "auto_filled", "auto_rule", "auto_metrics").collect()] == [
        ("match", "false", "skipped:already_filled", ""), ("y", "true", "r", "m"), ("z", "true", "r", "m"), (" ", "false", "", "m")
    ]
    assert [r.old for r in labelling.fill_labels(df, "old", F.col("new"), F.lit("r"), F.lit("m"), overwrite=True).collect()] == ["x", "y", "z", " "]


def test_surnames(spark):
    df = spark.createDataFrame([("doe jan",), ("Solo",), ("",), (None,), ("Jan F. Doe (123456)",), ("doe, jan",)], "n string")
    assert [tuple(r[0]) for r in df.select(text.surname_initial(F.col("n"))).collect()] == [("jan", "d"), ("", ""), ("", ""), ("", ""), ("doe", "j"), ("jan", "d")]


def test_decisions_without_label(spark):
    rows = spark.createDataFrame([("a", None, "api_error: x"), ("b", None, None)], "anchor_id string, d string, error string")
    log = rows.select(F.from_json(F.lit("{}"), decisions.DECISION_SCHEMA).alias("x"), "anchor_id", "error").select("x.*", F.col("anchor_id").alias("id"), F.col("error").alias("e"))
    log = log.drop("anchor_id", "error").withColumnsRenamed({"id": "anchor_id", "e": "error"})
    got = decisions.flatten_decisions(log.unionByName(log.withColumn("decision", F.from_json(F.lit('{"confidence": 0.5}'), log.schema["decision"].dataType))))
    assert [(r.label, r.confidence, r.reason_code) for r in got.collect()] == [("error", 0.0, "api_error: x"), ("error", 0.0, ""), ("error", 0.5, "api_error: x"), ("error", 0.5, "")]


def test_linked_authors(spark):
    rows = [("univ of soran, soran", "doe j., univ of soran, soran; roe k., other lab, city"), ("zzz qqq", "doe j., univ"), (None, None)]
    df = spark.createDataFrame(rows, "a string, w string")
    assert [r[0] for r in df.select(evidence.linked_authors(F.col("a"), F.col("w"))).collect()] == [["doe j."], [], []]


def test_card_limit(spark):
    df = spark.createDataFrame([("x" * 31000, "y")], "a string, b string").select(F.struct("a", F.array("b").alias("l")).alias("card"))
    r = evidence.limited(df).first()
    assert r.truncated and len(r.card.a) == 403 and r.card.l == ["y"]


def test_quality(spark):
    df = spark.createDataFrame([("a", "b", "match", 0.5), ("a", "b", "what", 1.5), (None, "c", "match", None)], "anchor_id string, candidate_id string, label_final string, confidence double")
    r = quality.prediction_violations(df).first()
    assert (r.n_rows, r.bad_label, r.bad_confidence, r.null_id, r.repeated_pairs) == (3, 1, 2, 1, 1)
    with pytest.raises(ValueError):
        quality.require_columns(df, ["nope"])
    with pytest.raises(ValueError):
        quality.assert_none(df, "rows")


def test_reports(spark):
    df = spark.createDataFrame([(" ", 1), (None, None), ("x", 2)], "a string, n int")
    assert {r.column: r.n_missing for r in reports.missingness(df).collect()} == {"a": 2, "n": 1}
    assert reports.to_markdown([{"a": 0.5, "b": None}], ["a", "b"]).endswith("| 0.5000 |  |")
    assert "a\\_b" in reports.to_latex([{"a_b": 1}], ["a_b"])


def test_tfidf(spark):
    texts = spark.createDataFrame([("1", "red blue"), ("2", "red blue"), ("3", "green"), ("4", None)], "id string, text string")
    pairs = spark.createDataFrame([("1", "2"), ("1", "3"), ("1", "4")], "anchor_id string, candidate_id string")
    got = {r.candidate_id: r.score for r in tfidf.pair_cosine(pairs, tfidf.vectors(texts)).collect()}
    assert got["2"] == pytest.approx(1.0) and got["3"] == 0.0 and got["4"] == 0.0


def test_baselines(spark):
    from weft.operators import baselines

    row = ("p", "q", "doe j", "doe j", "lab a", "lab a", "1", None, ["x"], ["x"], 2000, None)
    names = "anchor_id, candidate_id, a_author_norm, c_author_norm, a_record_affil_prefix, c_record_affil_prefix, a_author_id, c_author_id, a_coauthor_keys, c_coauthor_keys, a_year_int, c_year_int".split(", ")
    types = ["string"] * 8 + ["array<string>"] * 2 + ["int"] * 2
    df = spark.createDataFrame([row], ", ".join(f"{n} {t}" for n, t in zip(names, types)))
    got = {r.system: (round(r.score, 9), r.auxiliary) for r in baselines.run(df, "AND").collect()}
    assert got == {"context": (0.45, False), "deterministic": (1.0, False), "fuzzy": (0.8, False), "same_id": (0.0, True)}
    assert baselines.run(df.limit(0), "AND").count() == 0
    with pytest.raises(ValueError):
        baselines.run(df, "AND", ["nobody"])
