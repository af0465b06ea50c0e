"""Mentions, blocking, decisions, guards and entities on small tables."""

import itertools
import random

from pyspark.sql import functions as F

from weft.operators import blocking, decisions, graph, guards, heavy_keys, mentions

RECORD = (
    "record_id string, EID string, query_frame string, year_int int, `Authors` string, `Author full names` string, authors_norm string, author_full_names_norm string, "
    "author_ids_list array<string>, `Affiliations` string, affiliations_norm string"
)


def record(spark, n=2, **over):
    names = "; ".join(f"Doe{i}, John" for i in range(n))
    base = dict(record_id="r", EID="e", query_frame="q", year_int=2020, Authors=None, full=names, authors_norm=None, full_norm=names.lower(), ids=["1"], aff="Lab X (ABC), City; Other", aff_norm="lab x (abc), city; other") | over
    return spark.createDataFrame([tuple(base.values())], RECORD)


def test_author_mentions(spark):
    rows = mentions.author_mentions(record(spark)).orderBy("author_pos").collect()
    assert [r.author_id for r in rows] == ["1", ""] and rows[0].author_norm == "doe0, john"
    assert rows[0].coauthor_keys == ["john|d"] and not rows[0].truncation_flag and rows[0].record_affil_prefix == "lab x (abc),"
    assert mentions.author_mentions(record(spark, 99)).first().truncation_flag is False
    assert mentions.author_mentions(record(spark, 100)).first().truncation_flag is True
    assert mentions.author_mentions(record(spark, full=None, full_norm=None)).count() == 0
    assert mentions.author_mentions(record(spark).limit(0)).count() == 0


def test_affiliation_mentions(spark):
    rows = mentions.affiliation_mentions(record(spark)).orderBy("affil_pos").collect()
    assert [r.affil_acronyms for r in rows] == [["ABC"], []] and rows[0].prefix_key == "lab x (abc),"
    assert mentions.affiliation_mentions(record(spark, aff=None)).count() == 0


def instances(spark, rows):
    return spark.createDataFrame(rows, "author_instance_id string, author_id string, name_key string, record_affil_prefix string, year_int int, truncation_flag boolean")


def test_author_pairs_years_and_priority(spark):
    i = instances(spark, [("a", "1", "k", "p", 2000, False), ("b", "1", "k", "p", 2005, False), ("c", "", "k", "p", 2006, False), ("d", "", "k", "", None, False), ("e", "1", "k", "p", 2000, True)])
    got = {(r.anchor_id, r.candidate_id): r.best_pass_id for r in blocking.author_pairs(i).collect()}
    assert got[("a", "b")] == "pass1_author_id" and got[("a", "c")] == "pass3_name_key_affil" and got[("a", "d")] == "pass2_name_key" and got[("b", "c")] == "pass2_name_key"
    assert not any("e" in k for k in got) and len(got) == 12


def test_block_cap(spark):
    rows = [(f"{i:03}", "r", i, ["ABC", "XYZ"], "", "") for i in range(60)]
    i = spark.createDataFrame(rows, "affil_instance_id string, record_id string, affil_pos int, affil_acronyms array<string>, token_prefix_key string, prefix_key string")
    got = blocking.affiliation_pairs(i).collect()
    assert len(got) == 50 * 49 + 10 * 50 and {r.best_block_key for r in got} == {"acro:ABC"}


def test_top_k_ties(spark):
    rows = [("a", f"c{i}", 2, 0.5) for i in range(5)] + [("a", "z", 1, 0.1)]
    s = spark.createDataFrame(rows, "anchor_id string, candidate_id string, pass_priority int, score double")
    assert [r.candidate_id for r in blocking.top_k(s, 3).orderBy("rank").collect()] == ["z", "c0", "c1"]


LOG = "anchor_id string, candidate_id string, label string, confidence double, reason_code string, abstention_reason string, timestamp string"


def test_last_decision(spark):
    rows = [("a", "b", "match", 0.9, "x", "old", "1"), ("a", "b", "uncertain", 0.4, "y", None, "2"), ("a", "b", "error", 0.0, None, None, "3"), ("c", "d", "error", 0.0, None, None, "1"), ("c", "d", "error", 0.0, None, "why", "2")]
    log = spark.createDataFrame(rows, LOG)
    cols = ["label", "reason_code", "abstention_reason"]
    strict = {(r.anchor_id): r for r in decisions.last_decision(log, ["timestamp"], cols).collect()}
    assert strict["a"].label == "uncertain" and strict["a"].abstention_reason is None and strict["c"].label == "error"
    compat = {(r.anchor_id): r for r in decisions.last_decision(log, ["timestamp"], cols, compat=True).collect()}
    assert compat["a"].label == "uncertain" and compat["a"].abstention_reason == "old"


def test_parse_decision(spark):
    rows = ['{"label":"match","confidence":0.9,"reason_code":"r","evidence_used":["name"]}', 'text {"label":"non-match","confidence":0.2} end', '{"label":"maybe","confidence":0.2}', '{"label":"match","confidence":2}', "", None]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    got = [r[0] and r[0].label for r in df.select(decisions.parse_decision(F.col("x"))).collect()]
    assert got == ["match", "non-match", None, None, None, None]
    assert df.select(decisions.keyword_label(F.lit("I think non-match"))).first()[0] == "non-match"


def test_routing(spark):
    rows = [("match", 0.9, ["name", "coauthor"]), ("match", 0.9, ["name"]), ("match", 0.5, ["name", "affil"]), ("non-match", 0.85, None), ("error", 1.0, ["name"]), ("uncertain", 1.0, [])]
    got = guards.route(spark.createDataFrame(rows, "label string, confidence double, evidence_used array<string>"), "AND").collect()
    assert [r.label_final for r in got] == ["match", "uncertain", "uncertain", "non-match", "uncertain", "uncertain"]
    assert got[1].override_reason == "match_guard_insufficient_signals:1<2" and got[4].override_reason == "error_row" and got[4].signals_count == 0
    assert [r.routed_to_human for r in got] == [False, True, True, False, True, True]


def test_tuned_threshold(spark):
    rows = [("match", 0.9, ["name", "affil"], "match"), ("match", 0.8, ["name", "affil"], "non-match"), ("match", 0.7, ["name", "affil"], "match"), ("match", 0.7, ["name", "affil"], "match")]
    log = spark.createDataFrame(rows, "label string, confidence double, evidence_used array<string>, gold string")
    curve = guards.match_threshold_curve(log, "gold", "AND", [0.9, 0.8, 0.7])
    assert guards.tuned_match_threshold(curve, 0.75, 0.85).first().tuned_t_match == 0.7  # not contiguous
    assert guards.tuned_match_threshold(curve, 1.1, 0.85).first().fallback_to_initial


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_connected_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"{rng.randrange(60):03}", f"{rng.randrange(60):03}") for _ in range(45)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)]
    got = {r.node: r.root for r in graph.connected(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {k: v for k, v in brute_components([e for e in edges if e[0] != e[1]]).items()}


def test_entities_and_conflicts(spark):
    rows = [("a", "b", "match"), ("b", "c", "match"), ("a", "c", "non-match"), ("d", "d", "match"), ("e", "f", "non-match")]
    pairs = spark.createDataFrame(rows, "x string, y string, l string")
    members = graph.entities(pairs, "x", "y", F.col("l") == "match")
    assert members.groupBy("entity_id").count().filter("count = 3").count() == 1 and members.count() == 6
    found = graph.conflicts(pairs, members, "x", "y", F.col("l") == "non-match")
    assert [(r.node_a, r.node_b) for r in found.collect()] == [("a", "c")]
    assert graph.conflict_summary(found, members).first().sample_edges == '[["a","c"]]'
    assert graph.entities(pairs.limit(0), "x", "y", F.col("l") == "match").count() == 0


def test_heavy_keys(spark):
    rows = [("h", f"a{i % 7}", 0.5) for i in range(70)] + [(None, "a", 1.0)] * 20 + [(f"k{i}", "a", float("nan")) for i in range(10)] + [("k0", None, None)]
    df = spark.createDataFrame(rows, "k string, a string, s double").withColumn("key", F.lit(1)).withColumn("n_rows", F.lit(1))
    got = {r.key: r for r in heavy_keys.key_stats(df, "k", "a", "s").collect()}
    assert (got["h"].n_rows, got["h"].n_items, got["h"].mean_score) == (70, 7, 0.5)
    assert got[None].n_rows == 20 and got["k0"].mean_score is None and got["k0"].n_items == 1
    assert [r.key for r in heavy_keys.heavy_keys(df, "k", "a", "s", 0.5).collect()] == ["h"]
    assert heavy_keys.key_stats(df.limit(0), "k", "a", "s").count() == 0


def test_coauthors(spark):
    rows = [("r", 0, "a (123456)"), ("r", 1, "b"), ("r", 2, None), ("s", 0, "x")]
    got = {(r.record_id, r.author_pos): r.coauthors for r in mentions.coauthor_names(spark.createDataFrame(rows, "record_id string, author_pos int, author_norm string")).collect()}
    assert got == {("r", 0): ["b", ""], ("r", 1): ["a", ""], ("r", 2): ["a", "b"], ("s", 0): []}
    assert len(list(itertools.chain(got))) == 4
