"""Data-quality checks as one-pass aggregates of violation counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("match", "non-match", "uncertain")


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def prediction_violations(df: DataFrame, label: str = "label_final", confidence: str = "confidence") -> DataFrame:
    """One row: rows, unknown labels, confidences outside 0..1, null ids, surplus rows of repeated pairs."""
    require_columns(df, ["anchor_id", "candidate_id", label, confidence])
    pairs = F.count_distinct(F.struct("anchor_id", "candidate_id"))
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n_rows"), F.count_if(F.col(label).isNull() | ~F.col(label).isin(*LABELS)).alias("bad_label"),
        F.count_if(F.col(confidence).isNull() | ~F.col(confidence).between(0.0, 1.0)).alias("bad_confidence"),
        F.count_if(F.col("anchor_id").isNull() | F.col("candidate_id").isNull()).alias("null_id"), (n - pairs).alias("repeated_pairs"),
    )


def score_violations(df: DataFrame, score: str) -> DataFrame:
    """One row: rows, null, NaN and out-of-range scores, surplus rows of repeated pairs."""
    s, n = F.col(score), F.count(F.lit(1))
    return df.agg(
        n.alias("n_rows"), F.count_if(s.isNull()).alias("null_score"), F.count_if(F.isnan(s)).alias("nan_score"),
        F.count_if(~F.isnan(s) & ~s.between(0.0, 1.0)).alias("out_of_range"), (n - F.count_distinct(F.struct("anchor_id", "candidate_id"))).alias("repeated_pairs"),
    )


def metric_violations(df: DataFrame, rates: list[str]) -> DataFrame:
    """One row: how many values of each rate lie outside 0..1."""
    return df.agg(*(F.count_if(F.col(c).isNotNull() & ~F.col(c).between(0.0, 1.0)).alias(c) for c in rates))


def inverted_intervals(df: DataFrame, low: str, high: str) -> DataFrame:
    """Rows whose interval ends before it begins; none is expected."""
    return df.filter(F.col(low).isNotNull() & F.col(high).isNotNull() & (F.col(low) > F.col(high)))


def split_overlap(df: DataFrame, split: str) -> DataFrame:
    """Pairs in more than one split; none is expected."""
    return df.groupBy("anchor_id", "candidate_id").agg(F.count_distinct(split).alias("n")).filter("n > 1").select("anchor_id", "candidate_id")


def assert_none(df: DataFrame, message: str) -> None:
    if not df.isEmpty():
        raise ValueError(f"{message}: {[r.asDict() for r in df.limit(5).collect()]}")


def assert_same_count(a: DataFrame, b: DataFrame, message: str) -> None:
    if (m := a.count()) != (n := b.count()):
        raise ValueError(f"{message}: {m} and {n} rows")


def incomplete_codes(df: DataFrame, code: str) -> DataFrame:
    """Rows whose label code isn't 0, 1 or 2."""
    value = F.trim(F.coalesce(F.col(code).cast("string"), F.lit(""))).try_cast("double")
    return df.filter(value.isNull() | ~value.isin(0.0, 1.0, 2.0))
