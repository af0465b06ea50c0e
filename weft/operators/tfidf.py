"""TF-IDF cosine of text pairs, as joins and sums on terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def word_grams(c, n_max: int = 2):
    """Lower-case words of two or more characters and their n-grams."""
    w = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    positions = F.transform(w, lambda _, i: i + 1)

    def grams(n):
        starts = F.filter(positions, lambda i: i + n - 1 <= F.size(w))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    parts = [w, *(grams(n) for n in range(2, n_max + 1))]
    return F.concat(*parts)


def vectors(texts: DataFrame, n_max: int = 2, max_features: int = 20_000) -> DataFrame:
    """(id, term, weight): unit vectors of 1 + ln(tf) times ln((1 + n) / (1 + df)) + 1, over the
    max_features terms of the highest total count (ties by term); texts: (id, text), distinct ids."""
    terms = texts.select("id", F.explode(word_grams(F.col("text"), n_max)).alias("term"))
    tf = terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    kept = stats.orderBy(F.col("total").desc(), "term").limit(max_features)
    n = texts.agg(F.count(F.lit(1))).scalar()
    raw = tf.join(kept, "term").select("id", "term", ((1.0 + F.log("tf")) * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / norm).alias("weight"))


def pair_cosine(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(anchor_id, candidate_id, score) of distinct pairs; 0 where they share no term."""
    distinct = pairs.select("anchor_id", "candidate_id").distinct()
    a, c = weights.toDF("anchor_id", "term", "wa"), weights.toDF("candidate_id", "term", "wc")
    hits = distinct.join(a, "anchor_id").join(c, ["candidate_id", "term"]).groupBy("anchor_id", "candidate_id").agg(F.sum(F.col("wa") * F.col("wc")).alias("s"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("s", F.lit(0.0))))
    return distinct.join(hits, ["anchor_id", "candidate_id"], "left").select("anchor_id", "candidate_id", score.alias("score"))
