"""Per-key results when a handful of keys hold most rows.

Every aggregate here is algebraic, so each task folds its rows into a bounded hash table (Spark's
partial HashAggregate, which spills by sorting when full) and only compact partial states are
shuffled.  The exact distinct count is planned by Spark as two levels: states are first hashed by
(key, item), which spreads a hot key over all tasks, and only then folded per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_stats(df: DataFrame, key: str, item: str, score: str) -> DataFrame:
    """(key, n_rows, n_items, mean_score) of each value of ``key``.

    Null keys form one row with a null key.  Repeated rows count in n_rows and in the mean.  Null
    items aren't counted; the mean is over scores that are neither null nor NaN and is null if a key
    has none.  An empty table gives no rows.  Other columns, whatever their names, are ignored.
    """
    s = F.col(score).cast("double")
    rows = df.select(F.col(key).alias("key"), F.col(item).alias("item"), F.when(~F.isnan(s), s).alias("score"))
    return rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("item").alias("n_items"),
        F.avg("score").alias("mean_score"),
    )


def heavy_keys(df: DataFrame, key: str, item: str, score: str, share: float) -> DataFrame:
    """The rows of ``key_stats`` whose key isn't null and holds more than ``share`` of all rows."""
    stats = key_stats(df, key, item, score)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return stats.filter(F.col("key").isNotNull() & (F.col("n_rows") > F.lit(share) * total))
