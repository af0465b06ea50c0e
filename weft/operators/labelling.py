"""Rule-based labels of annotation packets and the policy for writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import similarity as sim
from weft.functions import text

#: Thresholds of the quality-control labels.
AND_THRESHOLDS = {"name_match": 0.98, "affil_match": 0.95, "name_nonmatch": 0.60}
AIN_THRESHOLDS = {"text_match": 0.95, "jaccard_match": 0.55, "text_nonmatch": 0.45}


def overlap_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def and_signals(p: DataFrame) -> DataFrame:
    """Adds name_sim, coauthor_overlap_count and affil_sim to packets, for the quality-control rules.

    Packets have anchor_* and candidate_* author_norm, coauthors_norm (pipe lists), affiliations_norm.
    Two empty names give 0 everywhere."""
    names = [text.strip_numeric_id(text.normalise_label_text(F.col(f"{s}_author_norm"))) for s in ("anchor", "candidate")]
    affils = [text.normalise_label_text(F.col(f"{s}_affiliations_norm")) for s in ("anchor", "candidate")]
    out = p.withColumns({"_na": names[0], "_nc": names[1], "_fa": affils[0], "_fc": affils[1]})
    none = (F.col("_na") == "") & (F.col("_nc") == "")
    return out.withColumns(
        {
            "name_sim": F.when(none, 0.0).otherwise(sim.ratio(F.col("_na"), F.col("_nc"))),
            "coauthor_overlap_count": F.when(none, 0).otherwise(overlap_count(text.pipe_set(F.col("anchor_coauthors_norm")), text.pipe_set(F.col("candidate_coauthors_norm")))),
            "affil_sim": F.when(none, 0.0).otherwise(sim.token_set_ratio(F.col("_fa"), F.col("_fc"))),
        }
    ).drop("_na", "_nc", "_fa", "_fc")


def autofill_and_signals(p: DataFrame) -> DataFrame:
    """Adds name_sim (words sorted), affil_sim, coauthor_overlap_count, surname_a, surname_b to packets, for the
    autofill rules.  Two empty names give 0 everywhere; a surname is '' where it can't be told."""
    names = [text.strip(text.compare_name(F.col(f"{s}_author_norm"))) for s in ("anchor", "candidate")]
    affils = [text.strip(text.compare_name(F.col(f"{s}_affiliations_norm"))) for s in ("anchor", "candidate")]
    out = p.withColumns({"_na": names[0], "_nc": names[1], "_fa": affils[0], "_fc": affils[1]})
    none = (F.col("_na") == "") & (F.col("_nc") == "")
    shared = overlap_count(text.compare_names(F.col("anchor_coauthors_norm")), text.compare_names(F.col("candidate_coauthors_norm")))
    return out.withColumns(
        {
            "name_sim": F.when(none, 0.0).otherwise(sim.token_sort_ratio(F.col("_na"), F.col("_nc"))),
            "affil_sim": F.when(none, 0.0).otherwise(sim.token_set_ratio(F.col("_fa"), F.col("_fc"))),
            "coauthor_overlap_count": F.when(none, 0).otherwise(shared),
            "surname_a": text.surname_initial(F.col("_na"))["surname"], "surname_b": text.surname_initial(F.col("_nc"))["surname"],
        }
    ).drop("_na", "_nc", "_fa", "_fc")


def and_label(t: dict = AND_THRESHOLDS) -> Column:
    """match: name alike and a shared co-author or affiliation; non-match: name unlike; else uncertain."""
    n = F.col("name_sim")
    backed = (F.col("coauthor_overlap_count") >= 1) | (F.col("affil_sim") >= t["affil_match"])
    return F.when((n >= t["name_match"]) & backed, "match").when(n <= t["name_nonmatch"], "non-match").otherwise("uncertain")


def ain_signals(p: DataFrame) -> DataFrame:
    """Adds affil_str_sim, token_jaccard and acronym_overlap to packets with anchor_* and candidate_*
    affil_norm and affil_acronyms (pipe lists)."""
    a, c = (text.normalise_label_text(F.col(f"{s}_affil_norm")) for s in ("anchor", "candidate"))
    out = p.withColumns({"_a": a, "_c": c})
    none = (F.col("_a") == "") & (F.col("_c") == "")
    acr = [text.pipe_acronyms(F.col(f"{s}_affil_acronyms")) for s in ("anchor", "candidate")]
    return out.withColumns(
        {
            "affil_str_sim": F.when(none, 0.0).otherwise(sim.token_set_ratio(F.col("_a"), F.col("_c"))),
            "token_jaccard": F.when(none, 0.0).otherwise(sim.jaccard(text.token_set(F.col("_a")), text.token_set(F.col("_c")))),
            "acronym_overlap": ~none & sim.overlaps(*acr),
        }
    ).drop("_a", "_c")


def ain_label(t: dict = AIN_THRESHOLDS) -> Column:
    s = F.col("affil_str_sim")
    backed = (F.col("token_jaccard") >= t["jaccard_match"]) | F.col("acronym_overlap")
    return F.when((s >= t["text_match"]) & backed, "match").when(s <= t["text_nonmatch"], "non-match").otherwise("uncertain")


#: Thresholds of the autofill rules and the names they leave behind.
AUTOFILL_AND = {"match": 0.97, "affil": 0.95, "surnames_differ": 0.85, "nonmatch": 0.70}
AUTOFILL_AIN = {"match": 0.95, "match_fallback": 0.97, "jaccard": 0.60, "nonmatch": 0.45, "jaccard_nonmatch": 0.20}
AND_RULES = {"coauthor": "AND_MATCH_NAME+COAUTH", "affil": "AND_MATCH_NAME+AFFIL", "surname": "AND_NONMATCH_SURNAME_MISMATCH", "low": "AND_NONMATCH_LOWNAME"}
AIN_RULES = {"acronym": "AIN_MATCH_STR+ACRO", "jaccard": "AIN_MATCH_STR+JAC", "nonmatch": "AIN_NONMATCH_STR+JAC"}
SKIPPED = "skipped:already_filled"


def _rule(label: str, tag: str) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(tag).alias("rule"))


def _no_rule() -> Column:
    return F.struct(F.lit(None).cast("string").alias("label"), F.lit("").alias("rule"))


def autofill_and(t: dict = AUTOFILL_AND) -> Column:
    """struct(label, rule) from the autofill signals; a null label where no rule fires.

    match: names alike, backed by a co-author or the affiliation, and no differing surnames; non-match:
    names unlike with differing surnames, or very unlike.  Surnames only count where both can be told."""
    n, shared = F.col("name_sim"), F.col("coauthor_overlap_count") >= 1
    told = (F.col("surname_a") != "") & (F.col("surname_b") != "")
    differ = told & (F.col("surname_a") != F.col("surname_b"))
    alike = (n >= t["match"]) & ~differ
    return (
        F.when(alike & shared, _rule("match", AND_RULES["coauthor"]))
        .when(alike & (F.col("affil_sim") >= t["affil"]), _rule("match", AND_RULES["affil"]))
        .when(differ & (n <= t["surnames_differ"]), _rule("non-match", AND_RULES["surname"]))
        .when(n <= t["nonmatch"], _rule("non-match", AND_RULES["low"]))
        .otherwise(_no_rule())
    )


def fallback(flag: Column) -> Column:
    """Whether the anchor's linked authors are a fallback."""
    return F.lower(text.safe_text(flag)).isin("true", "1", "yes")


def autofill_ain(fell_back: Column, t: dict = AUTOFILL_AIN) -> Column:
    """struct(label, rule) from the affiliation signals; a null label where no rule fires.  Texts must be more
    alike where the anchor's linked authors are a fallback; a non-match shares no acronym and few words."""
    s, j, acronym = F.col("affil_str_sim"), F.col("token_jaccard"), F.col("acronym_overlap")
    alike = s >= F.when(fell_back, t["match_fallback"]).otherwise(t["match"])
    return (
        F.when(alike & acronym, _rule("match", AIN_RULES["acronym"]))
        .when(alike & (j >= t["jaccard"]), _rule("match", AIN_RULES["jaccard"]))
        .when((s <= t["nonmatch"]) & (j <= t["jaccard_nonmatch"]) & ~acronym, _rule("non-match", AIN_RULES["nonmatch"]))
        .otherwise(_no_rule())
    )


def autofill_details(task: str) -> Column:
    """The signals as text, for the audit column; surnames only where both can be told."""
    if task == "AND":
        told = (F.col("surname_a") != "") & (F.col("surname_b") != "")
        names = F.when(told, F.format_string(", sur_a='%s', sur_b='%s'", "surname_a", "surname_b")).otherwise("")
        return F.concat(F.format_string("name_sim=%.3f, co_ov=%d, affil_sim=%.3f", "name_sim", "coauthor_overlap_count", "affil_sim"), names)
    yes = lambda c: F.when(c, "True").otherwise("False")
    return F.format_string("str_sim=%.3f, jac=%.3f, acro=%s, fallback=%s", "affil_str_sim", "token_jaccard", yes(F.col("acronym_overlap")), yes(fallback(F.col("anchor_linked_authors_fallback"))))


def fill_labels(df: DataFrame, existing: str, label: Column, rule: Column, details: Column, overwrite: bool = False) -> DataFrame:
    """``existing`` filled with ``label`` where it is null or blank (anywhere with overwrite) and a rule fired,
    and the audit columns auto_filled ('true', 'false'), auto_rule, auto_metrics."""
    old = text.blank_if_null(F.col(existing))
    keep = (text.strip(text.safe_text(F.col(existing))) != "") & F.lit(not overwrite)
    fills = ~keep & label.isNotNull()
    return df.withColumns(
        {
            "auto_filled": F.when(fills, "true").otherwise("false"),
            "auto_rule": F.when(keep, SKIPPED).when(fills, rule).otherwise(""),
            "auto_metrics": F.when(keep, "").otherwise(details),
            existing: F.when(fills, label).otherwise(old),
        }
    )


def valid_pairs(df: DataFrame, label: str, split: str) -> DataFrame:
    """Rows with both ids, a known label and a known split."""
    ids = (text.blank_if_null(F.col("anchor_id")) != "") & (text.blank_if_null(F.col("candidate_id")) != "")
    return df.filter(ids & (text.label_class(F.col(label)) != "") & (text.split_class(F.col(split)) != ""))
