"""Similarity functions.  Set measures are native; the subsequence ratios run in Arrow functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.text import blank_if_null, tokens, words


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0.0 if both are empty or null."""
    x, y = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel: one integer holds a row of the table."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2.0 * lcs_length(a, b) / total if total else 1.0


def token_set_of(a: str, b: str) -> float:
    """Best ratio among the common tokens alone and with either side's other tokens."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, x - y, y - x
    if both and (not only_x or not only_y):
        return 1.0
    common, left, right = (" ".join(sorted(s)) for s in (both, only_x, only_y))
    base = len(common) + bool(common)
    best = 0.0
    # with the common part in front, only the rests can differ
    total = 2 * base + len(left) + len(right)
    if total:
        best = 2.0 * (base + lcs_length(left, right)) / total
    if common:
        for rest in (left, right):
            best = max(best, 2.0 * len(common) / (len(common) + base + len(rest)))
    return best


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else ratio_of(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_of(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """1 - (insertions + deletions) / (both lengths); 1.0 for two empty texts."""
    x, y = blank_if_null(a), blank_if_null(b)
    differ = x != y  # equal texts reach the Arrow function as null, as a condition around it wouldn't skip it
    return F.coalesce(_ratio(F.when(differ, x), F.when(differ, y)), F.lit(1.0))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(F.array_join(F.array_sort(words(a)), " "), F.array_join(F.array_sort(words(b)), " "))


def token_set_ratio(a: Column, b: Column) -> Column:
    """0.0 if either side has no token."""
    return _token_set(blank_if_null(a), blank_if_null(b))


def equal_filled(a: Column, b: Column) -> Column:
    """1.0 if both texts are the same and not empty, else 0.0."""
    return F.when((blank_if_null(a) != "") & a.eqNullSafe(b), 1.0).otherwise(0.0)


def and_score(a: str, b: str, name: Column | None = None) -> Column:
    """0.55 name ratio + 0.35 co-author Jaccard + 0.10 same affiliation prefix; a, b: column prefixes."""
    name = ratio(F.col(f"{a}author_norm"), F.col(f"{b}author_norm")) if name is None else name
    return 0.55 * name + and_context_score(a, b)


def and_context_score(a: str, b: str) -> Column:
    """The native part of ``and_score``."""
    return 0.35 * jaccard(F.col(f"{a}coauthor_keys"), F.col(f"{b}coauthor_keys")) + 0.10 * equal_filled(
        F.col(f"{a}record_affil_prefix"), F.col(f"{b}record_affil_prefix")
    )


def ain_context_score(a: str, b: str) -> Column:
    """The native part of ``ain_score``."""
    return 0.35 * jaccard(tokens(F.col(f"{a}affil_norm")), tokens(F.col(f"{b}affil_norm"))) + 0.15 * overlaps(
        F.col(f"{a}affil_acronyms"), F.col(f"{b}affil_acronyms")
    ).cast("double")


def ain_score(a: str, b: str) -> Column:
    """0.50 token-set ratio + 0.35 token Jaccard + 0.15 shared acronym."""
    return 0.50 * token_set_ratio(F.col(f"{a}affil_norm"), F.col(f"{b}affil_norm")) + ain_context_score(a, b)


def deterministic_and(name_a, name_b, affil_a, affil_b) -> Column:
    """1.0 same name and affiliation, 0.5 same name, else 0.0; empty values are never the same."""
    name = equal_filled(name_a, name_b) == 1.0
    return F.when(name & (equal_filled(affil_a, affil_b) == 1.0), 1.0).when(name, 0.5).otherwise(0.0)


def year_closeness(a: Column, b: Column) -> Column:
    """max(0, 1 - difference / 10); 0 where a year is missing."""
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.abs(a - b) / 10.0), F.lit(0.0))


def fuzzy_and(name_a, name_b, affil_a, affil_b, year_a, year_b) -> Column:
    return 0.60 * token_sort_ratio(name_a, name_b) + 0.20 * equal_filled(affil_a, affil_b) + 0.20 * year_closeness(year_a, year_b)


def fuzzy_ain(text_a, text_b, acronyms_a, acronyms_b) -> Column:
    return 0.50 * token_set_ratio(text_a, text_b) + 0.30 * token_sort_ratio(text_a, text_b) + 0.20 * jaccard(acronyms_a, acronyms_b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """(cosine + 1) / 2 of two vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return (dot(a, b) / (norm + eps) + 1.0) / 2.0


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    """0.0 if both are 0; null if either is null."""
    b = beta * beta
    return F.when(precision.isNull() | recall.isNull(), None).when(precision + recall > 0, (1 + b) * precision * recall / (b * precision + recall)).otherwise(0.0)
