"""Sources, sinks and the decision stream."""

import json

import pytest

from weft.sources import sinks, tables
from weft.streaming import decisions as stream

HEADERS = ["Authors", "Title", "EID"]


def test_headers(tmp_path):
    p = tmp_path / "h.txt"
    p.write_text('﻿Authors\n\n "Title" \nEID\n', encoding="utf-8")
    assert tables.expected_headers(str(p)) == HEADERS
    tables.validate_headers(HEADERS, HEADERS)
    with pytest.raises(ValueError, match="missing"):
        tables.validate_headers(HEADERS, ["Title", "Authors"])


def test_exports(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('﻿Authors,Title,EID\n"A; B","two\nlines ""q""",1\nNA,None,\n', encoding="utf-8")
    df = tables.read_exports(spark, [str(p), str(p)], HEADERS, "q1").orderBy("row_id_in_file")
    rows = df.collect()
    assert len(rows) == 4 and rows[0].Title == 'two\nlines "q"' and rows[0].source_file == "x.csv"
    assert rows[2].Authors is None and rows[2].Title is None and rows[2].EID is None and rows[2].row_id_in_file == 1
    records = tables.canonical_records([df], HEADERS)
    assert records.select("record_id").distinct().count() == 2 and records.columns[-1] == "record_id"


def decision(a, label=None, t="1", **x):
    d = {"anchor_id": a, "candidate_id": "c", "task": "AND", "timestamp": t, **x}
    return json.dumps(d | ({"decision": {"label": label, "confidence": 0.9, "evidence_used": ["name"], "reason_code": "r"}} if label else {}))


def test_decision_log(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text("\n".join([decision("a", "match", usage={"input_tokens": 5, "output_tokens": 2}), "", decision("b"), '{"anchor_id": "z", "decision": {}}']), encoding="utf-8")
    rows = {r.anchor_id: r for r in tables.read_decisions(spark, str(p)).collect()}
    assert rows["a"].label == "match" and rows["a"].input_tokens == 5 and rows["b"].label == "error" and rows["b"].confidence == 0.0 and rows["z"].label == "error"
    (tmp_path / "e.jsonl").write_text("")
    assert tables.read_decisions(spark, str(tmp_path / "e.jsonl")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_decisions(spark, str(tmp_path / "no.jsonl"))


def test_annotations(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Anchor,candidate,Choice,fold\na,b,Same,DEV\nc,d,?,test\n")
    rows = tables.read_annotations(spark, str(p)).orderBy("anchor_id").collect()
    assert [(r.gold_label, r.split) for r in rows] == [("match", "dev"), ("", "test")]
    j = tmp_path / "a.json"
    j.write_text(json.dumps([{"data": {"anchor_id": "a", "candidate_id": "b", "split": "dev"}, "annotations": [{"result": [{"value": {"choices": []}}, {"value": {"choices": ["different"]}}]}]}]))
    assert tables.read_annotations(spark, str(j)).first().gold_label == "non-match"
    with pytest.raises(ValueError):
        tables.annotation_format("x.txt")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    out = str(tmp_path / "t")
    assert sinks.write_parquet(df, out) and not sinks.write_parquet(df, out, force=False)
    m = sinks.write_manifest(str(tmp_path / "m.json"), "stage", [], [out])
    assert len(m["outputs"][out]) == 64
    sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.write_jsonl(df, str(tmp_path / "j"), resume=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    f = tmp_path / "f.txt"
    f.write_text("x")
    inventory = sinks.collect_artefacts({"f": str(f), "g": str(tmp_path / "none")}, str(tmp_path / "out"))
    assert [r["exists"] for r in inventory] == [True, False] and (tmp_path / "out/f.txt").exists()
    assert sinks.backup(str(f), "1").endswith(".1.bak")


def test_pairs(spark, tmp_path):
    spark.createDataFrame([("a", "b", "AND"), ("a", "c", "AIN")], "anchor_id string, candidate_id string, task string").write.parquet(str(tmp_path / "p"))
    p = tables.read_pairs(spark, str(tmp_path / "p"))
    assert p.columns == ["anchor_id", "candidate_id", "task", "gold_label", "split"] and tables.task_pairs(p, "AND", 1).count() == 1


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.jsonl").write_text(decision("a", "uncertain", "1") + "\n" + decision("b", None, "1") + "\n")
    (src / "2.jsonl").write_text(decision("a", "match", "2") + "\n" + decision("a", None, "3") + "\n" + decision("b", "match", "2") + "\n")
    folded = stream.last_decisions(stream.decision_stream(spark, str(src)))
    q = folded.writeStream.outputMode("complete").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.anchor_id: r.label for r in spark.table("folded").collect()} == {"a": "match", "b": "match"}
    out = str(tmp_path / "out")
    q = stream.decision_stream(spark, str(src)).writeStream.foreachBatch(stream.upsert_to(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = max((tmp_path / "out").iterdir(), key=lambda p: (p / "_SUCCESS").stat().st_mtime)
    assert {r.anchor_id: r.label for r in spark.read.parquet(str(last)).collect()} == {"a": "match", "b": "match"}
