"""Average-linkage clustering of a sparse similarity graph, distributed.

Average linkage is reducible: pairs of clusters that are each other's nearest neighbour can be merged
at the same time without changing the dendrogram.  Each round finds every cluster's best neighbour,
merges the reciprocal ones above the threshold and sums the similarities of parallel edges; pairs
without an edge have similarity 0.  Clusters without a neighbour above the threshold can never merge
again, so their edges are dropped.  Nothing is gathered but one row per cluster and per edge.

Every round merges at least one pair, so the rounds end by themselves; they become many only for few
edges, in chains of rising similarity.  Once at most ``local_edges`` edges are left, the same rounds go
on in the memory of one task, with the same result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.runtime import Scratch

#: Edges that one task finishes by itself: under 100 MB with their names.
LOCAL_EDGES = 250_000


def _hash(a: str, b: str) -> int:
    """Spark's xxhash64(a, b)."""
    import xxhash

    h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def merges_of(edges: pd.DataFrame, threshold: float) -> list[tuple[str, str]]:
    """(old, last) of every cluster that is absorbed, composed over all rounds, from edges (a, b, s, na, nb),
    a < b; s: sum over the pairs of copies."""
    names, codes = np.unique(np.concatenate([edges["a"].to_numpy(object), edges["b"].to_numpy(object)]), return_inverse=True)
    # names sort by UTF-8 bytes in Spark; a cluster is called by its smallest name
    by_bytes = np.argsort(np.array([x.encode() for x in names], dtype=object), kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[by_bytes] = np.arange(len(names))
    names, codes = names[by_bytes], rank[codes]
    a, b = codes[: len(edges)], codes[len(edges) :]
    s = edges["s"].to_numpy(float)
    weight = np.zeros(len(names))
    weight[a], weight[b] = edges["na"], edges["nb"]
    h = np.array([_hash(names[x], names[y]) for x, y in zip(a, b)], np.int64)
    root = np.arange(len(names))
    while True:
        mean = s / (weight[a] * weight[b])
        strong = mean >= threshold
        alive = np.zeros(len(names), bool)
        alive[a[strong]] = alive[b[strong]] = True
        keep = alive[a] & alive[b]
        a, b, s, h, mean = a[keep], b[keep], s[keep], h[keep], mean[keep]
        if not len(a):
            break
        order = np.lexsort((b, a, h, mean))  # best last
        best = np.full(len(names), -1, np.int64)
        best[a[order]] = order  # the last of equal indexes stays
        both = np.full(len(names), -1, np.int64)
        both[b[order]] = order
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first = np.where(best < 0, -1, place[np.maximum(best, 0)])
        second = np.where(both < 0, -1, place[np.maximum(both, 0)])
        top = np.maximum(first, second)  # place of each cluster's best edge
        edge = np.arange(len(a))
        merged = edge[(top[a] == place) & (top[b] == place) & (mean >= threshold)]
        into = np.arange(len(names))
        into[b[merged]] = a[merged]
        weight[a[merged]] += weight[b[merged]]
        root[b[merged]] = a[merged]
        x, y = into[a], into[b]
        changed = (x != a) | (y != b)
        apart = x != y
        x, y, s, h, changed = x[apart], y[apart], s[apart], h[apart], changed[apart]
        low, high = np.minimum(x, y), np.maximum(x, y)
        pair, at, of = np.unique(low * len(names) + high, return_index=True, return_inverse=True)
        total = np.bincount(of, s, len(pair))
        renamed = np.bincount(of, changed, len(pair)) > 0
        a, b, s, h = low[at], high[at], total, h[at].copy()
        for e in np.flatnonzero(renamed):
            h[e] = _hash(names[a[e]], names[b[e]])
    while (root[root] != root).any():
        root = root[root]
    return [(names[x], names[root[x]]) for x in np.flatnonzero(root != np.arange(len(root)))]


def _finisher(threshold: float):
    def run(frames):
        held = [f for f in frames if len(f)]
        if held:
            yield pd.DataFrame(merges_of(pd.concat(held, ignore_index=True), threshold), columns=["old", "new"])

    return run


def average_linkage(edges: DataFrame, weights: DataFrame, threshold: float, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, cluster) of every node with an edge; edges: (a, b, s), a < b, each pair once, 0 < s <= 1;
    weights: (node, n), how many copies a node stands for, for every node.

    Two clusters merge while the mean similarity over all pairs of their copies is at least
    ``threshold``; equal means are settled by a hash of the pair.  A cluster's name is its smallest node.
    Empty: no rows.
    """
    scratch = Scratch(edges.sparkSession, "linkage")
    sized = edges.join(weights.toDF("a", "na"), "a").join(weights.toDF("b", "nb"), "b")
    first = current = scratch.keep(sized.select("a", "b", (F.col("s") * F.col("na") * F.col("nb")).alias("s"), "na", "nb"))
    merges, depth = [], 0
    while True:
        if current.count() <= local_edges:
            local = scratch.keep(current.coalesce(1).mapInPandas(_finisher(threshold), "old string, new string"))
            if current is not first:
                scratch.drop(current)
            depth += 1
            merges.append(local)
            break
        mean = F.col("s") / (F.col("na") * F.col("nb"))
        rank = F.struct(mean.alias("mean"), F.xxhash64("a", "b").alias("h"), "a", "b", "na", "nb")
        strong = current.select("a", "b", rank.alias("rank")).filter(F.col("rank.mean") >= threshold)
        best = strong.select(F.explode(F.array("a", "b")).alias("x"), "rank").groupBy("x").agg(F.max("rank").alias("rank"))
        # every end of a strong edge is an end of a best pair; a pair that is best for both ends merges
        pairs = best.groupBy("rank.a", "rank.b", "rank.na", "rank.nb").agg((F.count(F.lit(1)) == 2).alias("both"))
        pairs = scratch.keep(pairs.toDF("a", "b", "na", "nb", "both"))
        merged = pairs.filter("both")
        if merged.isEmpty():
            break
        depth += 1
        merges.append(merged.select(F.col("b").alias("old"), F.col("a").alias("new")))
        alive = pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct()
        ends = F.array(*(F.struct(F.col(c).alias("x"), F.col("a").alias("to"), (F.col("na") + F.col("nb")).alias("n")) for c in "ab"))
        moved = merged.select(F.explode(ends).alias("e")).select("e.*")
        state = alive.join(moved, "x", "left")  # (x, to, n) of every cluster that can still merge
        left = current.join(state.toDF("a", "ta", "ma"), "a").join(state.toDF("b", "tb", "mb"), "b").select(
            F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"), F.coalesce("ma", "na").alias("nx"), F.coalesce("mb", "nb").alias("ny"), "s"
        )
        x_first = F.col("x") < F.col("y")
        ordered = left.filter("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "s",
            F.when(x_first, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(x_first, F.col("ny")).otherwise(F.col("nx")).alias("nb"),
        )
        following = scratch.keep(ordered.groupBy("a", "b", "na", "nb").agg(F.sum("s").alias("s")).select("a", "b", "s", "na", "nb"))
        if current is not first:
            scratch.drop(current)
        current = following
    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if not merges:
        return nodes.withColumn("cluster", F.col("node"))
    parents = merges[0]
    for m in merges[1:]:
        parents = parents.unionAll(m)
    # a cluster is absorbed once at most, so the merges are a forest as deep as there were rounds
    for _ in range(math.ceil(math.log2(depth)) if depth > 1 else 0):
        parents = scratch.keep(parents)
        parents = parents.join(parents.toDF("new", "further"), "new", "left").select("old", F.coalesce("further", "new").alias("new"))
    return nodes.join(parents, F.col("node") == F.col("old"), "left").select("node", F.coalesce("new", "node").alias("cluster"))
