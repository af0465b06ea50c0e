import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from weft.llm.terms import gram_counts, marked

SCHEMA = "terms array<string>, record string"


def brute(rows, n):
    counts, records = Counter(), defaultdict(set)
    for terms, record in rows:
        terms = [t for t in terms or [] if t is not None]
        for i in range(len(terms)):
            for k in range(1, n + 1):
                if i + k <= len(terms):
                    g = tuple(terms[i : i + k])
                    counts[g] += 1
                    records[g] |= {record} - {None}
    return sorted((g, c, len(records[g])) for g, c in counts.items())


def run(spark, rows, n, slices=4):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("suffix", F.lit(1)).withColumn("gram", F.lit("x"))
    return sorted((tuple(r.gram), r.occurrences, r.records) for r in gram_counts(df, "terms", "record", n, slices).collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [([rng.choice(["hot", "hot", "a", "b", "", None, f"t{rng.randrange(40)}"]) for _ in range(rng.randrange(9))], rng.choice([None, f"r{rng.randrange(60)}"])) for _ in range(400)]
    rows += [(None, "r1"), ([], "r2"), (["x" * 10000], "r3")] + rows[:50]
    for n in (1, 2, 4):
        assert run(spark, rows, n) == brute(rows, n)
    assert run(spark, rows, 3, slices=1) == brute(rows, 3)


def test_empty(spark):
    assert run(spark, [], 2) == []


def test_marks(spark):
    df = spark.createDataFrame([(1,), (3,), (6,), (5,)], "records long")
    assert [r.mark for r in marked(df, F.lit(100), 3, 0.05).collect()] == ["rare", None, "common", None]
    assert [r.mark for r in marked(df, F.lit(10), 3, 0.05).collect()] == ["rare", "common", "common", "common"]
