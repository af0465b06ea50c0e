"""Problem 6: per-key results of candidates_and without imbalance."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators.heavy_keys import heavy_keys, key_stats
from weft.plans.runtime import table

HEAVY_SHARE = 0.025


def p6_found(spark, sf_dir):
    c = table(spark, sf_dir, "candidates_and")
    return heavy_keys(c, "best_block_key", "anchor_id", "similarity_score", HEAVY_SHARE).select(
        F.col("key").alias("best_block_key")
    )


def _stats(column):
    def run(spark, sf_dir):
        c = table(spark, sf_dir, "candidates_and")
        return key_stats(c, column, "anchor_id", "similarity_score").select(
            F.col("key").alias(column), "n_rows", F.col("n_items").alias("n_anchors"), F.round("mean_score", 12).alias("mean_score")
        )

    return run


def _stats_sql(column):
    return f"""
SELECT {column}, count(*) AS n_rows, count(DISTINCT anchor_id) AS n_anchors,
       round(avg(CASE WHEN NOT isnan(similarity_score) THEN similarity_score END), 12) AS mean_score
FROM candidates_and GROUP BY {column}"""


QUERIES = {
    "p6_found": (
        p6_found,
        """
SELECT best_block_key FROM candidates_and WHERE best_block_key IS NOT NULL
GROUP BY best_block_key HAVING count(*) > 0.025 * (SELECT count(*) FROM candidates_and)""",
    ),
    "p6_block_stats": (_stats("best_block_key"), _stats_sql("best_block_key")),
    "p6_pass_stats": (_stats("best_pass_id"), _stats_sql("best_pass_id")),
}
