"""The match pipeline and the evaluation, composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import similarity as sim
from weft.operators import blocking, decisions, graph, guards, mentions, metrics
from weft.sources.config import EvalSettings, MatchSettings


@dataclass
class Matched:
    """Lazy tables of one run."""

    mentions: DataFrame
    candidates: DataFrame
    decisions: DataFrame
    routed: DataFrame
    entities: DataFrame
    conflicts: DataFrame


def match_authors(records: DataFrame, decided: DataFrame | None = None, settings: MatchSettings = MatchSettings()) -> Matched:
    """Normalised records to author entities.

    decided: earlier decisions (anchor_id, candidate_id, label, confidence, evidence_used, error); pairs
    without a valid one get the stub decision, which never merges.
    """
    found = mentions.author_mentions(records)
    unique = mentions.unique_instances(found)
    columns = ["coauthor_keys", "record_affil_prefix"]
    candidates = blocking.author_candidates(found, unique, columns, sim.and_score("a_", "c_", F.col("name_ratio")), settings.top_k, settings.year_window)
    candidates = candidates.select("anchor_id", "candidate_id", "best_pass_id", "best_block_key", "pass_priority", "score", "rank")
    return _matched("AND", found, unique.select(F.col("author_instance_id").alias("node")), candidates, decided, settings)


def match_affiliations(records: DataFrame, decided: DataFrame | None = None, settings: MatchSettings = MatchSettings()) -> Matched:
    """Normalised records to affiliation entities, in the same way; the guards know other kinds of evidence."""
    found = mentions.affiliation_mentions(records)
    candidates = blocking.affiliation_candidates(found, sim.ain_score("a_", "c_"), settings.top_k)
    candidates = candidates.select("anchor_id", "candidate_id", "best_pass_id", "best_block_key", "pass_priority", F.col("similarity_score").alias("score"), "rank")
    return _matched("AIN", found, found.select(F.col("affil_instance_id").alias("node")).distinct(), candidates, decided, settings)


def _matched(task: str, found: DataFrame, nodes: DataFrame, candidates: DataFrame, decided: DataFrame | None, settings: MatchSettings) -> Matched:
    """Decisions, routing, entities and conflicts of candidates; every node is in an entity, linked or not."""
    used = ["anchor_id", "candidate_id", "label", "confidence", "evidence_used"]
    stub = decisions.stub_decisions(candidates if decided is None else decisions.still_open(candidates, decided)).select(*used)
    log = stub if decided is None else stub.unionByName(decisions.last_decision(decided, ["confidence"], used[2:]).filter("label <> 'error'"))
    routed = guards.route(log, task, settings.t_match, settings.t_nonmatch, settings.m_signals)
    single = nodes.select(F.col("node").alias("anchor_id"), F.col("node").alias("candidate_id"), F.lit("self").alias("label_final"))
    edges = routed.select("anchor_id", "candidate_id", "label_final").unionByName(single)
    members = graph.entities(edges, "anchor_id", "candidate_id", F.col("label_final") == "match")
    bad = graph.conflicts(edges, members, "anchor_id", "candidate_id", F.col("label_final") == "non-match")
    return Matched(found, candidates, log, routed, members, bad)


def evaluate(scored: DataFrame, settings: EvalSettings = EvalSettings()) -> tuple[DataFrame, DataFrame]:
    """(operating points tuned on dev rows, metrics of them on test rows) per system.

    scored: system, split, gold_label, score.  Test rows never take part in tuning; without dev rows there is
    nothing to tune on, which is an error."""
    if scored.filter("split = 'dev'").isEmpty():
        raise ValueError("no dev rows to tune thresholds on")
    grid = metrics.grid(settings.grid_start, settings.grid_stop, settings.grid_step)
    points = metrics.operating_points(metrics.curve(scored.filter("split = 'dev'"), "score", "gold_label", grid, ["system"]), settings.precision_floor, settings.precision_floor, ["system"])
    test = scored.filter("split = 'test'").join(points, "system")
    methods = F.array(
        F.struct(F.lit("f1_optimal").alias("method"), metrics.apply_threshold(F.col("score"), F.col("t_f1")).alias("predicted")),
        F.struct(F.lit("precision_floor").alias("method"), metrics.apply_threshold(F.col("score"), F.col("t_floor")).alias("predicted")),
        F.struct(F.lit("two_threshold").alias("method"), metrics.apply_band(F.col("score"), F.col("t_low"), F.col("t_high")).alias("predicted")),
    )
    long = test.select("system", F.col("gold_label").alias("gold"), F.explode(methods).alias("m")).select("system", "gold", "m.*")
    return points, metrics.metric_suite(long, "gold", "predicted", ["system", "method"])
