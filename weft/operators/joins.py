"""Joins of benchmark, routing and candidate tables with the checks their results need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators.decisions import PAIR
from weft.operators.quality import assert_none

NO_RANK = 2**31 - 1


def complete_join(benchmark: DataFrame, routing: DataFrame) -> DataFrame:
    """Inner join on the pair; an error if a benchmark pair has no or several routing rows."""
    seen = routing.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    checked = benchmark.select(*PAIR).join(seen, PAIR, "left")
    assert_none(checked.filter("n is null or n > 1"), "benchmark pairs without exactly one routing row")
    return benchmark.join(routing, PAIR)


def split_part(joined: DataFrame, name: str) -> DataFrame:
    return joined.filter(F.col("split") == name)


def shared_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs in both tables; none is expected of dev and test."""
    return a.select(*PAIR).intersect(b.select(*PAIR))


def gold_mismatches(a: DataFrame, b: DataFrame, column: str = "gold_label") -> DataFrame:
    """Pairs whose labels differ between two tables."""
    joined = a.select(*PAIR, F.col(column).alias("left")).join(b.select(*PAIR, F.col(column).alias("right")), PAIR)
    return joined.filter(~F.col("left").eqNullSafe(F.col("right")))


def with_ranks(benchmark: DataFrame, routing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Benchmark with final label ('uncertain' if never routed) and rank (NO_RANK if never found)."""
    r = routing.select(*PAIR, "label_final")
    c = candidates.select(*PAIR, "rank")
    out = benchmark.join(r, PAIR, "left").join(c, PAIR, "left")
    return out.withColumns({"label_final": F.coalesce("label_final", F.lit("uncertain")), "rank": F.coalesce("rank", F.lit(NO_RANK))})


def diagnostics(benchmark: DataFrame, decisions: DataFrame, routing: DataFrame) -> DataFrame:
    """Benchmark with what was decided and how it was routed; nulls where neither happened."""
    d = decisions.select(*PAIR, F.col("label").alias("decided"), "confidence")
    r = routing.select(*PAIR, F.col("label_final").alias("routed"))
    return benchmark.join(d, PAIR, "left").join(r, PAIR, "left")


def labels_for(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Rows with their label looked up by pair; an error if one has none."""
    joined = rows.join(labels.select(*PAIR, label), PAIR, "left")
    assert_none(joined.filter(F.col(label).isNull()).select(*PAIR), "pairs without a label")
    return joined


def disagreements(df: DataFrame, n: int = 20) -> DataFrame:
    """Up to n pairs of each kind: gold uncertain but decided, gold match not found as one, gold non-match not
    found as one (a pair without final label isn't found)."""
    g, p = F.col("gold_label"), F.coalesce("routed", F.lit(""))
    kind = (
        F.when((g == "uncertain") & p.isin("match", "non-match"), "gold_uncertain_but_decided")
        .when((g == "match") & (p != "match"), "gold_match_missed")
        .when((g == "non-match") & (p != "non-match"), "gold_nonmatch_missed")
    )
    order = W.partitionBy("kind").orderBy(*PAIR)
    return df.withColumn("kind", kind).filter("kind is not null").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n).drop("k")
