"""Entities as connected components of match edges, and the conflicts inside them.

Nodes are numbered in their order, so the rounds move 8-byte numbers.  Components by alternating
large-star and small-star steps: every node is linked to the smallest node it can see, first for its
larger neighbours, then for its smaller ones, until nothing changes; the number of rounds grows with the
logarithm of the component size.  Once at most ``local_edges`` edges are left, one task finishes them.
Edges are tables in the shared folder.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators.blocking import numbered, with_numbers
from weft.plans.runtime import Scratch

#: Edges of two 8-byte numbers that one task finishes by itself.
LOCAL_EDGES = 200_000


def _roots(frames):
    """(node, root) of every node of all edges (a, b), by union-find; the root is the smallest node."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in frames:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            parent.setdefault(a, a), parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "root": pd.Series([find(x) for x in nodes], dtype="int64")})


def local_roots(edges: DataFrame) -> DataFrame:
    """(node, root) of numbered edges (a, b), in one task: for few edges only."""
    return edges.select("a", "b").coalesce(1).mapInPandas(_roots, "node bigint, root bigint")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over (a, b) edges."""
    if large:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        out = joined.select(F.col("b").alias("x"), F.col("m").alias("y")).unionAll(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def connected(edges: DataFrame, left: str, right: str, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) of every node of an edge table; root is the component's smallest node.  Null ends and
    self-loops link nothing."""
    scratch = Scratch(edges.sparkSession, "graph")
    named = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x <> y").distinct()
    numbers = numbered(named.select(F.explode(F.array("x", "y"))))
    linked = with_numbers(with_numbers(named, "x", numbers), "y", numbers)
    current = scratch.keep(linked.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    before, roots = None, None
    while roots is None:
        now = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now[0] <= local_edges:
            roots = local_roots(current)
        elif now == before:
            ends = current.select(F.col("b").alias("node")).distinct()
            roots = current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(ends.select("node", F.col("node").alias("root")))
        else:
            following = scratch.keep(_star(_star(current, True), False))
            scratch.drop(current)
            current, before = following, now
    return roots.join(numbers.toDF("node_id", "node"), "node").join(numbers.toDF("root_id", "root"), "root").select(F.col("node_id").alias("node"), F.col("root_id").alias("root"))


def entities(pairs: DataFrame, left: str, right: str, match) -> DataFrame:
    """(entity_id, node_id) of every id of the pairs, single ones included.

    entity_id is the SHA-256 of the sorted members joined by newlines, as consumers of entity tables
    expect it; it is the one result here that needs a component's members in one place."""
    nodes = pairs.select(F.explode(F.array(left, right)).alias("node")).filter("node is not null").distinct()
    roots = nodes.join(connected(pairs.filter(match), left, right), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    ids = roots.groupBy("root").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("node")), "\n"), 256).alias("entity_id"))
    return roots.join(ids, "root").select("entity_id", F.col("node").alias("node_id"))


def conflicts(pairs: DataFrame, members: DataFrame, left: str, right: str, nonmatch) -> DataFrame:
    """(entity_id, node_a, node_b): distinct non-match pairs with both ends in one entity."""
    no = pairs.filter(nonmatch).select(F.col(left).alias("node_a"), F.col(right).alias("node_b")).distinct()
    a, b = members.toDF("entity_id", "node_a"), members.toDF("entity_b", "node_b")
    return no.join(a, "node_a").join(b, "node_b").filter("entity_id = entity_b").select("entity_id", "node_a", "node_b")


def conflict_summary(found: DataFrame, members: DataFrame, sample: int = 5) -> DataFrame:
    """(entity_id, num_members, num_conflicts, sample_edges as JSON) of each entity with a conflict."""
    sizes = members.groupBy("entity_id").agg(F.count(F.lit(1)).alias("num_members"))
    order = W.partitionBy("entity_id").orderBy("node_a", "node_b")
    first = found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample)
    samples = first.groupBy("entity_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("k", "node_a", "node_b"))), lambda x: F.array(x["node_a"], x["node_b"]))).alias("sample_edges"))
    counts = found.groupBy("entity_id").agg(F.count(F.lit(1)).alias("num_conflicts"))
    return counts.join(sizes, "entity_id").join(samples, "entity_id").select("entity_id", "num_members", "num_conflicts", "sample_edges")


def cluster_sizes(members: DataFrame) -> DataFrame:
    """One row: clusters, singletons, largest, members."""
    sizes = members.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("num_clusters"), F.count_if(F.col("n") == 1).alias("num_singletons"), F.max("n").alias("largest"), F.sum("n").alias("members"))


def size_distribution(members: DataFrame) -> DataFrame:
    """(size, clusters): how many clusters have each size."""
    sizes = members.groupBy("entity_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


def largest_clusters(members: DataFrame, n: int = 20) -> DataFrame:
    """(entity_id, size) of the n largest clusters, ties by id."""
    sizes = members.groupBy("entity_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.orderBy(F.col("size").desc(), "entity_id").limit(n)
