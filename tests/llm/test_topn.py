import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.llm import topn

SCHEMA = "g string, i string, p int, s double"


def brute(rows, n):
    best = {}
    for g, i, p, s in rows:
        if g is None or i is None or s is None or s != s:
            continue
        key = (2**63 if p is None else p, -s)
        best[g, i] = min(best.get((g, i), key), key)
    out = []
    for g in {k[0] for k in best}:
        ranked = sorted((v, i.encode()) for (x, i), v in best.items() if x == g)
        out += [(g, k + 1, i.decode()) for k, (_, i) in enumerate(ranked[:n])]
    return sorted(out)


def run(spark, rows, n, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("group", F.lit(0)).withColumn("pos", F.lit("x")).withColumn("k", F.lit(1))
    return sorted((r.group, r.pos, r.item) for r in topn.top_n(df.repartition(5), "g", "i", "p", "s", n, **options).collect())


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(3000):
        g = rng.choice(["hot", "hot", f"g{rng.randrange(300)}", None])
        i = rng.choice([None, "", "é", "a" * 40, "a" * 40 + "b", f"id{rng.randrange(80)}"]) if rng.random() < 0.3 else f"id{rng.randrange(500)}"
        rows.append((g, i, rng.choice([1, 2, 3, None, -5]), rng.choice([None, float("nan"), 0.0, -0.0, 0.5, rng.random(), -1.0, float("inf")])))
    rows += rows[:200]
    assert run(spark, rows, 3) == brute(rows, 3)
    assert run(spark, rows, 3, chunk_rows=50) == brute(rows, 3)  # many chunks per task
    assert run(spark, rows, 1000) == brute(rows, 1000)


def test_ties_go_to_the_smaller_id(spark):
    rows = [("g", f"x{i:03}", 1, 0.5) for i in range(200)] * 2
    assert run(spark, rows, 3) == [("g", 1, "x000"), ("g", 2, "x001"), ("g", 3, "x002")]


def test_empty(spark):
    assert run(spark, [], 3) == [] and run(spark, [(None, None, None, None)], 3) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=30))
def test_score_code_keeps_order(values):
    a = np.array(values)
    codes = topn.score_code(a)
    assert all((codes[i] < codes[j]) == (a[i] > a[j]) for i in range(len(a)) for j in range(len(a)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=20), min_size=2, max_size=12))
def test_id_words_keep_order(ids):
    rows = [tuple(r) for r in topn.id_words(ids).tolist()]
    assert all((rows[i] < rows[j]) == (ids[i] < ids[j]) for i in range(len(ids)) for j in range(len(ids)))
