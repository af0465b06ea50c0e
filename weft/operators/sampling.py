"""Deterministic sampling: order by a hash of the id instead of a random generator."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.plans.runtime import Scratch


def draw(*ids: str, seed: int = 42) -> Column:
    """A hex text whose order is the sample order of rows with these ids."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *ids))


def sample(df: DataFrame, n: int, ids: list[str], seed: int = 42) -> DataFrame:
    """n rows, uniformly by hash."""
    return df.orderBy(draw(*ids, seed=seed), *ids).limit(n)


BUCKETS = 1000


def _ranked(values: DataFrame, ranks: list[int], low: float, high: float) -> dict[int, float]:
    """The values at ranks (from 0) of the column x: intervals are cut into buckets, counted in one pass a
    round, until each holds one distinct value.  The driver sees bucket counts only."""
    open_ = {r: (low, high, 0) for r in ranks}
    while todo := sorted({(lo, hi) for lo, hi, _ in open_.values() if lo < hi}):
        cells = []
        for k, (lo, hi) in enumerate(todo):
            bucket = F.least(F.floor((F.col("x") - lo) / (hi - lo) * BUCKETS), F.lit(BUCKETS - 1))
            cells.append(F.when(F.col("x").between(lo, hi), F.struct(F.lit(k).alias("k"), bucket.alias("bucket"))))
        counted = values.select("x", F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.k", "c.bucket").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        found: dict = {}
        for r in counted.collect():
            found.setdefault(todo[r.k], []).append((r.lo, r.hi, r.n))
        for rank, (lo, hi, below) in open_.items():
            if lo < hi:
                for x, y, n in sorted(found[lo, hi]):
                    if below + n > rank:
                        break
                    below += n
                open_[rank] = (x, y, below)
    return {r: lo for r, (lo, _, _) in open_.items()}


def edges(df: DataFrame, score: str, quantiles: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation, of the scores that are neither null nor NaN; [] without any.

    No task holds the distinct scores: a few passes of bucket counts find the values at the ranks needed."""
    s = F.col(score).cast("double")
    values = Scratch(df.sparkSession, "scores").keep(df.select(s.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x")))
    one = values.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not one.n:
        return []
    at = [q * (one.n - 1) for q in quantiles]
    found = _ranked(values, sorted({r for p in at for r in (math.floor(p), math.ceil(p))}), one.lo, one.hi)
    out = []
    for p in at:
        low, high = math.floor(p), math.ceil(p)
        x, y = found[low], found[high]
        out.append(x if low == high or x == y else (high - p) * x + (p - low) * y)
    return out


def _first_drawn(df: DataFrame, group: str, need: int, ids: list[str], seed: int) -> DataFrame:
    """The first ``need`` rows of each group by draw, with _d and their place _k.

    Draws are uniform, so all but slightly more than ``need`` rows are left out by a threshold before any
    window sorts them; a group where the threshold left too few (which chance makes all but impossible) is
    taken whole."""
    drawn = Scratch(df.sparkSession, "drawn").keep(df.withColumn("_d", draw(*ids, seed=seed)))
    sizes = {r[group]: r["n"] for r in drawn.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}  # bins or strata: a handful
    enough = need + 8 * math.sqrt(need) + 40
    limits = {g: f"{int(enough / n * 16**12):012x}" for g, n in sizes.items() if n > enough}
    place = F.row_number().over(W.partitionBy(group).orderBy("_d", *ids))
    if not limits:
        return drawn.withColumn("_k", place).filter(F.col("_k") <= need)
    below = F.lit(False)
    for g, limit in limits.items():
        below = below | ((F.col(group) == g) & (F.col("_d") < limit))
    kept = drawn.filter(below | ~F.col(group).isin(*limits))
    counts = {r[group]: r["n"] for r in kept.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(counts.get(g, 0) < min(need, n) for g, n in sizes.items()):
        kept = drawn
    return kept.withColumn("_k", place).filter(F.col("_k") <= need)


def quantile_bins(df: DataFrame, score: str, bins: int = 5) -> DataFrame:
    """Adds bin (0..): intervals between the distinct quantiles, closed on the right, the first also on
    the left; rows without a score have a null bin.  Equal scores are all in bin 0, where intervals of equal
    width would put them too."""
    low, *cut = edges(df, score, [i / bins for i in range(bins)]) or [0.0]
    cut = sorted({c for c in cut if c > low})
    n = F.lit(0)
    for c in cut:
        n = n + F.when(F.col(score) > c, 1).otherwise(0)
    return df.withColumn("bin", F.when(F.col(score).isNotNull(), n))


def per_bin_sample(binned: DataFrame, per_bin: int, total: int, ids: list[str], seed: int = 42) -> DataFrame:
    """per_bin rows of each bin by hash; what bins lack is refilled from the remainder up to ``total``."""
    # no bin can give more than the whole sample
    ranked = _first_drawn(binned.filter("bin is not null"), "bin", total, ids, seed)
    order = W.partitionBy(F.lit(0)).orderBy(F.when(F.col("_k") <= per_bin, 0).otherwise(1), "_d", *ids)
    return ranked.withColumn("_t", F.row_number().over(order)).filter(F.col("_t") <= total).drop("_d", "_k", "_t")


def first_rows_split(sampled: DataFrame, n_dev: int, order: list[str]) -> DataFrame:
    """Adds split: dev for the first n_dev rows in order, else test; for samples only (one window)."""
    k = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))
    return sampled.withColumn("split", F.when(k <= n_dev, "dev").otherwise("test"))


def strata(df: DataFrame, score: str) -> DataFrame:
    """Adds stratum: matchlike from the 80th percentile, nonmatchlike below the 20th, else hard."""
    q = edges(df, score, [0.2, 0.8]) or [0.0, 0.0]
    return df.withColumn("stratum", F.when(F.col(score) >= q[1], "matchlike").when(F.col(score) < q[0], "nonmatchlike").otherwise("hard"))


def quota_sample(df: DataFrame, quotas: dict[str, int], ids: list[str], seed: int = 42) -> DataFrame:
    """Rows per stratum by hash up to its quota; shortfalls are refilled from other strata's surplus."""
    total = sum(quotas.values())
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col("stratum")]
    ranked = _first_drawn(df, "stratum", total, ids, seed)
    order = W.partitionBy(F.lit(0)).orderBy(F.when(F.col("_k") <= quota, 0).otherwise(1), "_d", *ids)
    return ranked.withColumn("_t", F.row_number().over(order)).filter(F.col("_t") <= total).drop("_d", "_k", "_t")


def parse_quota(text: str) -> dict[str, int]:
    """'a=1,b=2' to a dict; an unreadable part is an error."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, sep, value = part.partition("=")
        if not sep or not value.strip().isdigit():
            raise ValueError(f"not a quota: {part!r}")
        out[name.strip()] = int(value)
    return out
