"""Confusion counts, coverage-aware precision and recall, curves, operating points, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.similarity import f_beta

COUNTS = ("n_total", "n_gold_binary", "n_auto_decided", "tp", "fp", "tn", "fn", "abstained_match", "abstained_nonmatch")


def _count_exprs(gold: str, predicted: str, weight=None) -> dict:
    g, p = F.col(gold), F.col(predicted)
    yes, no, unsure = p == "match", p == "non-match", ~p.isin("match", "non-match")
    conditions = {
        "n_total": F.lit(True), "n_gold_binary": g.isin("match", "non-match"), "n_auto_decided": yes | no,
        "tp": yes & (g == "match"), "fp": yes & (g == "non-match"), "tn": no & (g == "non-match"), "fn": no & (g == "match"),
        "abstained_match": unsure & (g == "match"), "abstained_nonmatch": unsure & (g == "non-match"),
    }
    if weight is None:
        return {k: F.count_if(c) for k, c in conditions.items()}
    return {k: F.coalesce(F.sum(F.when(c, weight)), F.lit(0)) for k, c in conditions.items()}


def derived(counted: DataFrame) -> DataFrame:
    """Adds all rates to confusion counts; they are null without binary gold.  A precision without any
    prediction is 1, a recall without any true case 0."""
    c = F.col
    binary = c("n_gold_binary") > 0

    def share(n, d, empty):
        return F.when(binary, F.coalesce(F.try_divide(n, d), F.lit(empty)))

    true_match, true_non = c("tp") + c("fn") + c("abstained_match"), c("tn") + c("fp") + c("abstained_nonmatch")
    pm, rm = share(c("tp"), c("tp") + c("fp"), 1.0), share(c("tp"), true_match, 0.0)
    pn, rn = share(c("tn"), c("tn") + c("fn"), 1.0), share(c("tn"), true_non, 0.0)
    coverage = F.coalesce(F.try_divide("n_auto_decided", "n_total"), F.lit(0.0))
    return counted.withColumns(
        {
            "n_uncertain_gold": c("n_total") - c("n_gold_binary"), "n_uncertain_predicted": c("n_total") - c("n_auto_decided"),
            "n_abstained_on_binary": c("abstained_match") + c("abstained_nonmatch"), "n_true_match": true_match, "n_true_nonmatch": true_non,
            "coverage": coverage, "uncertain_rate": 1.0 - coverage,
            "precision_match": pm, "recall_match": rm, "f1_match": f_beta(pm, rm),
            "precision_nonmatch": pn, "recall_nonmatch": rn, "f1_nonmatch": f_beta(pn, rn),
            "accuracy_3way": share(c("tp") + c("tn"), c("n_gold_binary"), 0.0), "macro_f1": (f_beta(pm, rm) + f_beta(pn, rn)) / 2.0,
        }
    )


def metric_suite(pairs: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """One row per group of all counts and rates; labels outside match and non-match are uncertain."""
    return derived(pairs.groupBy(*(by or [])).agg(*(e.alias(k) for k, e in _count_exprs(gold, predicted).items())))


def confusion_table(pairs: DataFrame, gold: str, predicted: str, labels=("match", "non-match", "uncertain")) -> DataFrame:
    """gold x predicted counts with margins: one row per gold label and one named All."""
    rolled = pairs.rollup(gold).agg(*(F.count_if(F.col(predicted) == x).alias(x) for x in labels), F.count(F.lit(1)).alias("All"), F.grouping(gold).alias("_all"))
    return rolled.select(F.when(F.col("_all") == 1, "All").otherwise(F.col(gold)).alias("gold"), *(F.col(f"`{x}`") for x in labels), "All")


def curve(scores: DataFrame, score: str, gold: str, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """Match (score >= t) and non-match (score < t) precision, recall and F1 of every threshold.

    Only rows with binary gold and a score count.  One pass: scores are first counted per grid interval
    and class, a table as small as the grid, and the curve is a running sum over that."""
    by = by or []
    n = len(thresholds)
    grid = F.array(*(F.lit(float(t)) for t in thresholds))
    binary = scores.filter(F.col(gold).isin("match", "non-match") & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    passed = F.aggregate(grid, F.lit(0), lambda k, t: k + F.when(F.col(score) >= t, 1).otherwise(0))
    counted = binary.groupBy(*by, passed.alias("k")).agg(F.count_if(F.col(gold) == "match").alias("m"), F.count_if(F.col(gold) == "non-match").alias("u"))
    cell = F.struct("k", "m", "u")
    cells = counted.groupBy(*by).agg(F.collect_list(cell).alias("cells"), F.sum("m").alias("n_match"), F.sum("u").alias("n_non"))  # at most n + 1 cells

    def above(field, i):
        return F.aggregate("cells", F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["k"] > i, x[field]).otherwise(F.lit(0)))

    rows = cells.select(*by, "n_match", "n_non", F.posexplode(grid).alias("i", "threshold"), "cells")
    rows = rows.select(*by, "i", "threshold", "n_match", "n_non", above("m", F.col("i")).alias("tp"), above("u", F.col("i")).alias("fp"))
    tn, fn = F.col("n_non") - F.col("fp"), F.col("n_match") - F.col("tp")
    pm, rm = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0)), F.coalesce(F.try_divide("tp", "n_match"), F.lit(0.0))
    pn, rn = F.coalesce(F.try_divide(tn, tn + fn), F.lit(1.0)), F.coalesce(F.try_divide(tn, F.col("n_non")), F.lit(0.0))
    assert n
    return rows.select(
        *by, F.col("i").cast("int").alias("i"), "threshold", pm.alias("precision_match"), rm.alias("recall_match"), f_beta(pm, rm).alias("f1_match"),
        (F.col("tp") + F.col("fp")).alias("n_pred_match"), pn.alias("precision_nonmatch"), rn.alias("recall_nonmatch"), f_beta(pn, rn).alias("f1_nonmatch"),
        (tn + fn).alias("n_pred_nonmatch"), (F.col("n_match") + F.col("n_non")).alias("n_total"),
    )


def grid(start: float = 0.0, stop: float = 1.0, step: float = 0.01) -> list[float]:
    n = round((stop - start) / step)
    return [start + i * ((stop - start) / n) for i in range(n + 1)]


def operating_points(curve_: DataFrame, floor_match: float, floor_nonmatch: float, by: list[str] | None = None) -> DataFrame:
    """One row per group: the threshold of best F1 (lowest on ties), the lowest one reaching the match
    floor (null if none), and the band t_low..t_high (fallbacks 0 and 1; t_low at most t_high)."""
    c = F.col
    ok_m = (c("n_pred_match") > 0) & (c("precision_match") >= floor_match)
    ok_n = (c("n_pred_nonmatch") > 0) & (c("precision_nonmatch") >= floor_nonmatch)
    out = curve_.groupBy(*(by or [])).agg(
        F.max_by("threshold", F.struct("f1_match", -c("i"))).alias("t_f1"), F.max("f1_match").alias("best_f1"),
        F.min(F.when(ok_m, c("threshold"))).alias("t_floor"), F.max(F.when(ok_n, c("threshold"))).alias("t_low_raw"),
    )
    high = F.coalesce("t_floor", F.lit(1.0))
    return out.withColumns({"achieved_floor": c("t_floor").isNotNull(), "t_high": high, "t_low": F.least(F.coalesce("t_low_raw", F.lit(0.0)), high)}).drop("t_low_raw")


def apply_threshold(score, t):
    """match from t on, non-match below; all uncertain if t is null."""
    return F.when(t.isNull() | score.isNull(), "uncertain").when(score >= t, "match").otherwise("non-match")


def apply_band(score, low, high):
    """match from high on, non-match below low, else uncertain."""
    return F.when(score >= high, "match").when(score < low, "non-match").otherwise("uncertain")


def bootstrap(pairs: DataFrame, gold: str, predicted: str, id_: list[str], resamples: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(metric, low, high, n): percentile intervals of six rates over binary-gold pairs.

    Resampling n pairs with replacement needs only how often each kind of pair (gold x predicted, at most
    six) is drawn.  Pairs are folded to these counts first, and each resample draws them from the multinomial
    distribution with a generator seeded by ``seed`` and its number; so any number of pairs costs one
    aggregation, and the resamples run distributed.  ``id_`` doesn't take part in it.
    """
    spark = pairs.sparkSession
    binary = pairs.filter(F.col(gold).isin("match", "non-match"))
    kinds = binary.groupBy(F.col(gold).alias("g"), F.when(F.col(predicted).isin("match", "non-match"), F.col(predicted)).otherwise("uncertain").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    kind = sorted((r.g, r.p, r.n) for r in kinds.collect())  # at most six rows
    total = sum(k[2] for k in kind)
    names = ["precision_match", "recall_match", "f1_match", "precision_nonmatch", "recall_nonmatch", "f1_nonmatch"]
    if not total:
        return spark.createDataFrame([(m, None, None, 0) for m in names], "metric string, low double, high double, n bigint")
    draws = spark.range(resamples).withColumnRenamed("id", "b")

    def multinomial(frames):
        import numpy as np

        weights = [k[2] / total for k in kind]
        for pdf in frames:
            counts = np.array([np.random.default_rng([seed, int(b)]).multinomial(total, weights) for b in pdf["b"]]).reshape(len(pdf), len(kind))
            for i in range(len(kind)):
                pdf[f"c{i}"] = counts[:, i]
            yield pdf

    drawn = draws.mapInPandas(multinomial, "b bigint, " + ", ".join(f"c{i} bigint" for i in range(len(kind))))

    def count(g, p):
        return sum((F.col(f"c{i}") for i, k in enumerate(kind) if k[:2] == (g, p)), F.lit(0))

    tp, fp, um = count("match", "match"), count("non-match", "match"), count("match", "uncertain")
    tn, fn, un = count("non-match", "non-match"), count("match", "non-match"), count("non-match", "uncertain")
    pm, rm, pn, rn = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn + um), F.try_divide(tn, tn + fn), F.try_divide(tn, tn + fp + un)
    values = F.array(*(F.struct(F.lit(n).alias("metric"), v.alias("v")) for n, v in zip(names, [pm, rm, f_beta(pm, rm), pn, rn, f_beta(pn, rn)])))
    each = drawn.select(F.explode(values).alias("x")).select("x.*").filter("v is not null")
    gathered = each.groupBy("metric").agg(F.array_sort(F.collect_list("v")).alias("v"))  # as many as resamples
    n = F.size("v")
    low, high = F.greatest(F.lit(0), F.floor(F.lit(alpha / 2) * n)), F.least(n - 1, F.ceil(F.lit(1 - alpha / 2) * n) - 1)
    return gathered.select("metric", F.when(n >= 2, F.get("v", low.cast("int"))).alias("low"), F.when(n >= 2, F.get("v", high.cast("int"))).alias("high"), n.cast("bigint").alias("n"))


