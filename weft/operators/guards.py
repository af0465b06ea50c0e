"""Routing of decisions through confidence and evidence guards, and tuning of the match threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that show a kind of evidence, by task and category; matched as substrings.
SIGNALS = {
    "AND": {
        "NAME": ("name", "author_name", "surname", "initials", "first_name", "last_name", "given_name", "full_name", "name_similarity"),
        "COAUTHOR": ("coauthor", "co-author", "coauthors", "co-authors", "collaborator", "collaborators", "shared_coauthor"),
        "AFFIL": ("affiliation", "affil", "institution", "university", "department", "lab", "laboratory", "org", "organisation", "organization", "affiliation_similarity"),
    },
    "AIN": {
        "STRING": ("string", "affil_string", "text", "raw_string", "normalised", "string_similarity", "str_sim", "levenshtein"),
        "ACRONYM": ("acronym", "abbreviation", "acro", "acronyms", "acronym_overlap"),
        "LINKED_AUTHORS": ("linked_author", "linked_authors", "author_list", "linked_author_overlap"),
    },
}


def _shows(pattern: str):
    return lambda item: F.coalesce(F.lower(item).rlike(pattern), F.lit(False))


def fired_categories(evidence: Column, task: str) -> Column:
    """Sorted array of the categories that at least one evidence item shows."""
    hits = []
    for category in sorted(SIGNALS[task]):
        pattern = "|".join(sorted(SIGNALS[task][category]))
        hits.append(F.when(F.exists(evidence, _shows(pattern)), F.lit(category)))
    return F.array_compact(F.array(*hits))


def route(decisions: DataFrame, task: str, t_match: float = 0.85, t_nonmatch: float = 0.85, m_signals: int = 2) -> DataFrame:
    """Adds label_final, override_reason, signals_count, fired_categories and routed_to_human.

    Errors go to a human as uncertain; a non-match needs its confidence only; a match needs confidence
    and m_signals kinds of evidence; the rest is uncertain.  Null evidence shows nothing.
    """
    fired = fired_categories(F.coalesce("evidence_used", F.array().cast("array<string>")), task)
    error = F.col("label") == "error"
    n = F.size(fired)
    sure_no = (F.col("label") == "non-match") & (F.col("confidence") >= t_nonmatch)
    sure_yes = (F.col("label") == "match") & (F.col("confidence") >= t_match)
    final = F.when(error, "uncertain").when(sure_no, "non-match").when(sure_yes & (n >= m_signals), "match").otherwise("uncertain")
    reason = F.when(error, "error_row").when(
        ~sure_no & sure_yes & (n < m_signals), F.concat(F.lit("match_guard_insufficient_signals:"), n.cast("string"), F.lit(f"<{m_signals}"))
    )
    return decisions.withColumns(
        {
            "label_final": final,
            "override_reason": F.coalesce(reason, F.lit("")),
            "signals_count": F.when(error, 0).otherwise(n),
            "fired_categories": F.when(error, "").otherwise(F.array_join(fired, "|")),
            "routed_to_human": final == "uncertain",
        }
    )


def threshold_grid(spark, start: float, stop: float, step: float) -> DataFrame:
    """(i, t): the grid from start to stop in steps, rounded to ten digits."""
    n = round((stop - start) / step)
    return spark.range(0, n + 1, 1, 1).select(F.col("id").alias("i"), F.round(F.lit(start) + F.col("id") * F.lit(step), 10).alias("t"))


def match_threshold_curve(decisions: DataFrame, gold: str, task: str, grid: list[float], m_signals: int = 2) -> DataFrame:
    """(t, n_auto_match, tp, n_gold_match, precision, recall) of each t, in one aggregation.

    The grid isn't joined: each row adds itself to the thresholds it passes (an array as long as the
    grid), so the rows are read and counted once."""
    enough = F.size(fired_categories(F.coalesce("evidence_used", F.array().cast("array<string>")), task)) >= m_signals
    candidate = (F.col("label") == "match") & enough
    sums = []
    for i, t in enumerate(grid):
        auto = candidate & (F.col("confidence") >= t)
        sums += [F.count_if(auto).alias(f"n{i}"), F.count_if(auto & (F.col(gold) == "match")).alias(f"tp{i}")]
    one = decisions.agg(F.count_if(F.col(gold) == "match").alias("n_gold_match"), *sums)
    rows = F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"n{i}").alias("n_auto_match"), F.col(f"tp{i}").alias("tp"), F.col("n_gold_match")) for i, t in enumerate(grid)))
    each = one.select(F.explode(rows).alias("r")).select("r.*")
    return each.withColumns({
        "precision": F.try_divide("tp", "n_auto_match"), "recall": F.when(F.col("n_auto_match") == 0, 0.0).otherwise(F.coalesce(F.try_divide("tp", "n_gold_match"), F.lit(0.0))),
    })


def tuned_match_threshold(curve: DataFrame, floor: float, initial: float) -> DataFrame:
    """One row: the smallest threshold whose precision reaches the floor, else the initial one."""
    best = F.min(F.when(F.col("precision") >= floor, F.col("t")))
    return curve.agg(F.coalesce(best, F.lit(initial)).alias("tuned_t_match"), best.isNull().alias("fallback_to_initial"))


def three_class(label: Column) -> Column:
    """match, non-match, or uncertain for anything else."""
    return F.when(label.isin("match", "non-match"), label).otherwise("uncertain")


def reapplied(label: Column, confidence: Column, signals: Column, t_match: Column, m_signals: Column, t_nonmatch: float = 0.85) -> Column:
    """Final label for other thresholds from counted signals."""
    return (
        F.when((label == "non-match") & (confidence >= t_nonmatch), "non-match")
        .when((label == "match") & (confidence >= t_match) & (signals >= m_signals), "match")
        .otherwise("uncertain")
    )
