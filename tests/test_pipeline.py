"""Settings and the composed pipelines."""

import pytest
from pyspark.sql import functions as F
from test_matching import RECORD

from weft.plans import pipeline
from weft.sources import config


def test_settings(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("match:\n  top_k: 10\n  t_match: 0.9\n")
    settings, digest = config.load(config.MatchSettings, str(p), "match")
    assert settings.top_k == 10 and settings.year_window == 5 and len(digest) == 64
    p.write_text("nope: 1\n")
    with pytest.raises(ValueError, match="unknown"):
        config.load(config.EvalSettings, str(p))
    p.write_text("alpha: 2\n")
    with pytest.raises(ValueError):
        config.load(config.EvalSettings, str(p))
    p.write_text("")
    assert config.load(config.EvalSettings, str(p))[0] == config.EvalSettings()
    assert config.evaluation_split(None, 0) == "dev" and config.evaluation_split(None, 3) == "test" and config.evaluation_split(str(p), 0) == "test"


def records(spark):
    rows = [
        ("r1", "e1", "q", 2020, None, "Doe, John; Roe, Ann", None, "doe, john; roe, ann", ["1", "2"], "Lab A", "lab a"),
        ("r2", "e2", "q", 2021, None, "Doe, John; Poe, Max", None, "doe, john; poe, max", ["1", ""], "Lab A", "lab a"),
        ("r3", "e3", "q", 2001, None, "Doe, John", None, "doe, john", [], "Lab B", "lab b"),
    ]
    return spark.createDataFrame(rows, RECORD)


def test_match_without_decisions(spark):
    m = pipeline.match_authors(records(spark))
    assert m.candidates.count() == 2 and m.mentions.count() == 5  # 2001 lies outside the year window
    assert {r.label_final for r in m.routed.collect()} == {"uncertain"}
    assert m.entities.select("entity_id").distinct().count() == 5 and m.conflicts.count() == 0


def test_match_with_decisions(spark):
    c = pipeline.match_authors(records(spark)).candidates
    decided = c.select("anchor_id", "candidate_id", F.lit("match").alias("label"), F.lit(0.95).alias("confidence"), F.array(F.lit("name"), F.lit("coauthor")).alias("evidence_used"), F.lit(None).cast("string").alias("error"))
    m = pipeline.match_authors(records(spark), decided.limit(1))
    assert m.entities.select("entity_id").distinct().count() == 4 and m.entities.count() == 5
    assert sorted(r.label_final for r in m.routed.collect()) == ["match", "uncertain"]


def test_evaluate(spark):
    rows = [("s", split, "match" if i > 5 else "non-match", i / 10) for i in range(10) for split in ("dev", "test")]
    points, suite = pipeline.evaluate(spark.createDataFrame(rows, "system string, split string, gold_label string, score double"))
    assert points.first().achieved_floor and {r.method: r.f1_match for r in suite.collect()} == {"f1_optimal": 1.0, "precision_floor": 1.0, "two_threshold": 1.0}


def test_match_affiliations(spark):
    m = pipeline.match_affiliations(records(spark))
    assert m.mentions.count() == 3 and m.candidates.count() == 2  # Lab A twice, one each way
    assert {(r.best_pass_id, r.score > 0.8) for r in m.candidates.collect()} == {("ain_tok3", True)}
    assert {r.label_final for r in m.routed.collect()} == {"uncertain"} and m.entities.select("entity_id").distinct().count() == 3
    decided = m.candidates.select("anchor_id", "candidate_id", F.lit("match").alias("label"), F.lit(0.95).alias("confidence"), F.array(F.lit("affil_string"), F.lit("acronym")).alias("evidence_used"), F.lit(None).cast("string").alias("error"))
    assert pipeline.match_affiliations(records(spark), decided).entities.select("entity_id").distinct().count() == 2


def test_context_candidates_are_the_best_of_all_pairs(spark):
    """Without making all pairs of a block the best k are the same, whatever is null, tied or repeated."""
    import random

    from weft.functions import similarity as sim
    from weft.operators import blocking, mentions

    rng = random.Random(5)
    rows = []
    for i in range(260):
        key = rng.choice(["doe|j", "doe|j", "roe|a", "", None])
        row = (f"i{i:03}", rng.choice(["", "", "", "7", None]), key, rng.choice([None, 2000, 2004, 2009, 2016]), rng.choice(["lab a", "lab b", "", None]), rng.choice([None, [], ["x|a"], ["x|a", "y|b"], ["z|c"]]), rng.random() < 0.05, "n", "q", "r", i)
        rows += [row] * rng.choice([1, 1, 1, 2])
    df = spark.createDataFrame(rows, "author_instance_id string, author_id string, name_key string, year_int int, record_affil_prefix string, coauthor_keys array<string>, truncation_flag boolean, author_norm string, query_frame string, record_id string, author_pos int")
    unique = mentions.unique_instances(df)
    for k in (3, 20):
        fast = blocking.author_context_candidates(df, unique, k)
        slow = blocking.author_candidates(df, unique, ["coauthor_keys", "record_affil_prefix"], sim.and_context_score("a_", "c_"), k)
        columns = ["anchor_id", "candidate_id", "best_pass_id", "best_block_key", "pass_priority", "score", "rank"]
        assert sorted(map(tuple, fast.select(columns).collect())) == sorted(map(tuple, slow.select(columns).collect()))
