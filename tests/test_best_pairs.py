"""The k best candidates found group by group against those of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from weft.functions import similarity as sim
from weft.operators import best_pairs, blocking, mentions

SCHEMA = "author_instance_id string, author_id string, name_key string, year_int int, record_affil_prefix string, coauthor_keys array<string>, truncation_flag boolean, author_norm string, query_frame string, record_id string, author_pos int"
COLUMNS = ["anchor_id", "candidate_id", "best_pass_id", "best_block_key", "pass_priority", "score", "rank", "a_year_int", "c_year_int", "a_query_frame", "c_query_frame"]


def instances(spark, n, several, rng):
    rows = []
    for i in range(n):
        for _ in range(rng.choice([1, 1, 2])):
            if not rows or rows[-1][0] != f"i{i:04}" or several:
                key = rng.choice(["doe|j", "doe|j", "doe|j", "roe|a", "", None])
                row = (f"i{i:04}", rng.choice(["", "", "", "", str(rng.randrange(n // 4)), None]), key, rng.choice([None, *range(2000, 2017)]), rng.choice(["lab a", "lab b", "lab c", "", None]), rng.choice([None, [], ["x|a"], ["x|a", "y|b", "x|a"], [f"z|{i % 9}"]]))
                name = None if rng.random() < 0.02 else f"{''.join(rng.choice('abé') for _ in range(rng.choice([2, 5, 9])))}, j{'o' * rng.choice([0, 1, 130])} doe"
                row += (rng.random() < 0.05, name, rng.choice(["q", None]), rng.choice("rs"), i)
            rows.append(row)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n, several, cut", [(300, True, 40), (900, False, 8192), (900, False, 150)])
def test_best_of_all_pairs(spark, monkeypatch, n, several, cut):
    monkeypatch.setattr(best_pairs, "SLICE", cut)
    df = instances(spark, n, several, random.Random(n + cut))
    unique = mentions.unique_instances(df)
    columns = ["coauthor_keys", "record_affil_prefix", "year_int", "query_frame"]
    for k, with_names in ((3, True), (50, True), (3, False), (50, False)):
        score = sim.and_score("a_", "c_", F.col("name_ratio")) if with_names else sim.and_context_score("a_", "c_")
        slow = blocking.author_candidates(df, unique, columns, score, k)
        fast = best_pairs.best_pairs(df, k, 5, with_names)
        shown = COLUMNS if with_names else COLUMNS[:7]
        assert sorted(map(str, fast.select(shown).collect())) == sorted(map(str, slow.select(shown).collect()))


def test_large_groups_give_one_task_a_slice_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(best_pairs, "SLICE", 100)
    df = instances(spark, 900, False, random.Random(2))
    cut = best_pairs._sliced(best_pairs._rows(df, "author_norm"), df, "name_key")
    sizes = [r["n"] for r in cut.filter("anchor").groupBy("key", "slice").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 200 and sum(sizes) == blocking._eligible(df).count()


def test_ratios_of_a_group():
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abcd é") for _ in range(rng.choice([0, 1, 7, 63, 64, 65, 128, 200]))) for _ in range(120)})
    group = best_pairs.Names(names)
    for i in range(len(names)):
        assert group.ratios(i).tolist() == [sim.ratio_of(names[i], x) for x in names]


def test_only_ids_that_may_repeat_are_brought_together(spark):
    df = instances(spark, 200, True, random.Random(5))
    buckets = best_pairs._again(df)
    assert 0 < buckets.count() < 200
    everything = df.select(best_pairs._bucket()).distinct()
    rows = [sorted(map(str, best_pairs._rows(df, "author_norm", x).collect())) for x in (buckets, everything)]
    assert rows[0] == rows[1]


def test_ids_are_short_on_the_way(spark):
    texts = ["", "a", "ab", "AB", "é", "00", "0g", "ab" * 32, "abc"]
    short = best_pairs._short(F.col("x"))
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", F.length(short).alias("n"), best_pairs._long(short).alias("y")).collect()
    assert [r.y for r in got] == texts and got[7].n == 33
