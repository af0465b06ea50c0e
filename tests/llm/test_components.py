import random

import pytest
from pyspark.sql import functions as F

from weft.llm.components import components


def brute(rows):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, l in rows:
        for x in (a, b):
            if x is not None:
                root.setdefault(x, x)
        if a is not None and b is not None and l:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((find(x), x) for x in root)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "a string, b string, l boolean").withColumn("v", F.lit(1)).withColumn("group_id", F.lit("x"))
    return sorted((r.group_id, r.node_id) for r in components(df, "a", "b", F.col("l"), **options).collect())


def chain(n):
    return [(f"{i:03}", f"{i + 1:03}", True) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        chain(60),
        [("hub", f"leaf{i:03}", True) for i in range(150)],
        [(f"{i}", f"{j}", True) for i in range(12) for j in range(12)],
        [("a", "b", True), ("b", "a", True), ("a", "b", True), ("c", "c", True), ("d", None, True), (None, "e", True), (None, None, True), ("f", "g", None), ("g", "h", False)],
    ],
    ids=["chain", "star", "clique", "odd"],
)
def test_shapes(spark, rows):
    assert run(spark, rows, local_edges=0) == brute(rows)
    assert run(spark, rows, max_degree=7, local_edges=0) == brute(rows)  # hubs are split
    assert run(spark, rows, local_edges=20) == brute(rows)  # the rest in one task


def test_random(spark):
    rng = random.Random(7)
    rows = [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}", rng.random() < 0.6) for _ in range(220)]
    assert run(spark, rows) == brute(rows) == run(spark, rows, local_edges=0)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [("a", "b", False)]) == [("a", "a"), ("b", "b")]
