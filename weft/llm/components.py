"""Connected components by low-diameter decomposition.

Each level draws an exponential shift per vertex; the larger the shift, the earlier a vertex starts to
grow a cluster.  A vertex joins the cluster that reaches it first (or its own), ties going to the
smaller order.  After LAST_START rounds every vertex is in a cluster of small diameter; clusters become
super-vertices, inter-cluster edges (a constant fraction of the edges in expectation) form the next
level's graph, and the assignments of all levels are composed.  Shifts are capped so that a level has a
fixed number of rounds, one plan; the cap changes cluster radii only, never the components.

All state is keyed by 8-byte vertex numbers, messages to a vertex are min-combined before the shuffle,
vertices with very many edges are split into linked copies, and each level ends in tables in the shared
folder.  Once at most ``local_edges`` edges are left, one task finishes them by union-find: levels over few
edges would only keep the driver busy.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.graph import LOCAL_EDGES, local_roots
from weft.plans.runtime import Scratch

RATE = 0.4
LAST_START = 4
#: A vertex with more edges is split into copies, so no task holds all edges of a hub.
MAX_DEGREE = 500_000


def _draw(level: int, salt: str):
    """Uniform in (0, 1), a function of the vertex and the level only."""
    bits = F.xxhash64(F.lit(level), F.lit(salt), F.col("v")).bitwiseAND(F.lit((1 << 52) - 1))
    return (bits.cast("double") + 0.5) / float(1 << 52)


def _decompose(edges: DataFrame, level: int) -> DataFrame:
    """(v, c): the cluster of each vertex of the symmetric edge table (v, w).

    A vertex gets the center with the smallest (start + distance, order).  As no vertex starts later than
    LAST_START, as many relaxations over the edges settle all of them."""
    shift = -F.log(_draw(level, "shift")) / RATE
    start = (F.lit(LAST_START) - F.least(F.floor(shift), F.lit(LAST_START))).cast("int")
    first = F.struct(start.alias("arrival"), F.xxhash64(F.lit(level), F.lit("order"), "v").alias("order"), F.col("v").alias("c"))
    vertices = edges.select("v").distinct()
    state = vertices.select("v", first.alias("at"))
    steps = edges.withColumn("cost", F.lit(1)).unionAll(vertices.select("v", F.col("v").alias("w"), F.lit(0).alias("cost")))
    for _ in range(LAST_START):
        later = F.struct((F.col("at.arrival") + F.col("cost")).alias("arrival"), F.col("at.order").alias("order"), F.col("at.c").alias("c"))
        state = state.join(steps, "v").groupBy(F.col("w").alias("v")).agg(F.min(later).alias("at"))
    return state.select("v", F.col("at.c").alias("c"))


def _split_hubs(edges: DataFrame, level: int, most: int, scratch: Scratch) -> DataFrame:
    """The edges with each hub's spread over copies that are linked to the hub: the same components."""
    degrees = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    hubs = scratch.keep(degrees.select("v", F.ceil(F.col("n") / most).alias("k")))
    if hubs.isEmpty():
        return edges
    numbered = hubs.select("v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("i"))
    # negative numbers are free, and each level has its own range of them
    copies = scratch.keep(numbered.withColumn("copy", -(F.monotonically_increasing_id() + 1 + level * (1 << 56))))
    half = edges.filter("v < w")
    for end, other in (("v", "w"), ("w", "v")):
        known = half.join(hubs.toDF(end, "k"), end, "left").withColumn("i", F.pmod(F.xxhash64(other), "k"))
        taken = known.join(copies.toDF(end, "i", f"{end}_copy"), [end, "i"], "left")
        half = taken.select("v", "w", *(c for c in ("v_copy", "w_copy") if c in taken.columns))
    moved = half.select(F.coalesce("v_copy", "v").alias("v"), F.coalesce("w_copy", "w").alias("w"))
    return scratch.keep(_both(moved.unionAll(copies.select("v", "copy"))))


def components(pairs: DataFrame, left: str, right: str, links, max_degree: int = MAX_DEGREE, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(group_id, node_id): every distinct id of the two columns with the smallest id (by UTF-8 bytes)
    of all ids linked to it directly or through others.

    links: a Column; a pair links where it is true (null doesn't).  Direction, repeats and self-pairs
    don't matter; null ids are no ids and link nothing; a pair with one null id still brings the other.
    Empty tables give no rows.
    """
    scratch = Scratch(pairs.sparkSession, "components")
    rows = pairs.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b"), F.coalesce(links, F.lit(False)).alias("linked"))
    ids = rows.select(F.explode(F.array("a", "b")).alias("node_id")).filter("node_id is not null").distinct()
    nodes = scratch.keep(ids.withColumn("v", F.monotonically_increasing_id()))  # fixed once written
    linked = rows.filter("linked and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    half = linked.join(nodes.select(F.col("node_id").alias("a"), F.col("v")), "a").join(
        nodes.select(F.col("node_id").alias("b"), F.col("v").alias("w")), "b"
    )
    edges = scratch.keep(_both(half.select("v", "w")))
    absorbed, level = [], 0
    while size := edges.count() // 2:
        if size <= local_edges:
            rest = local_roots(edges.filter("v < w").toDF("a", "b"))
            absorbed.append(scratch.keep(rest.filter("node <> root").toDF("v", "c")))
            break
        if size > max_degree:
            edges = _split_hubs(edges, level, max_degree, scratch)
        clusters = scratch.keep(_decompose(edges, level))
        far = clusters.select(F.col("v").alias("w"), F.col("c").alias("d"))
        crossing = edges.filter("v < w").join(clusters, "v").join(far, "w").filter("c <> d")
        next_edges = scratch.keep(_both(crossing.select(F.least("c", "d").alias("v"), F.greatest("c", "d").alias("w")).distinct()))
        absorbed.append(clusters.filter("v <> c"))
        scratch.drop(edges)
        edges, level = next_edges, level + 1
    if not absorbed:
        return nodes.select(F.col("node_id").alias("group_id"), "node_id")
    # a vertex is absorbed once at most, so the assignments of all levels are a forest as deep as there
    # were levels; they are composed by doubling
    total = absorbed[0]
    for part in absorbed[1:]:
        total = total.unionAll(part)
    for _ in range(math.ceil(math.log2(len(absorbed))) if len(absorbed) > 1 else 0):
        total = scratch.keep(total)
        total = total.join(total.toDF("c", "further"), "c", "left").select("v", F.coalesce("further", "c").alias("c"))
    labelled = nodes.join(total, "v", "left").select("node_id", F.coalesce("c", "v").alias("c"))
    smallest = labelled.groupBy("c").agg(F.min("node_id").alias("group_id"))
    return labelled.join(smallest, "c").select("group_id", "node_id")


def _both(half: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    return half.select(F.explode(F.array(F.struct("v", "w"), F.struct(F.col("w").alias("v"), F.col("v").alias("w")))).alias("e")).select("e.*")
