"""Queries that write a table in a source's format to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.plans.match_queries import _LOG
from weft.plans.runtime import Scratch, table
from weft.sources import tables
from weft.streaming import decisions as stream

_TEXTS = ["Authors", "Title", "Year", "Affiliations", "Abstract", "EID"]


def csv_roundtrip(spark, sf_dir):
    """Records written as CSV (multi-line quoted cells, doubled quotes) and read with NA tokens nulled."""
    r = table(spark, sf_dir, "records_normalised").select("source_file", "row_id_in_file", *_TEXTS)
    path = f"{Scratch(spark, 'csv').root}/x"
    r.write.options(header=True, escape='"', quoteAll=True, emptyValue="").csv(path)
    back = spark.read.schema(r.schema).options(header=True, multiLine=True, escape='"').csv(path)
    return tables.nulled(back, _TEXTS)


_NA = ", ".join("'" + t + "'" for t in tables.NA_TOKENS)
CSV_SQL = "SELECT source_file, row_id_in_file, " + ", ".join(f'CASE WHEN "{c}" NOT IN ({_NA}) THEN "{c}" END AS "{c}"' for c in _TEXTS) + " FROM records_normalised"


def canonical(spark, sf_dir):
    """Union of the two query frames with record ids from EIDs."""
    r = table(spark, sf_dir, "records_normalised").select(*(F.col(f"`{c}`") for c in _TEXTS), "query_frame", "source_file", "row_id_in_file")
    frames = [r.filter(F.col("query_frame") == f) for f in ("frame_a", "frame_b")]
    return tables.canonical_records(frames, _TEXTS).select("query_frame", "source_file", "row_id_in_file", "record_id")


CANONICAL_SQL = "SELECT query_frame, source_file, row_id_in_file, sha256(coalesce(\"EID\", '')) AS record_id FROM records_normalised WHERE query_frame IN ('frame_a', 'frame_b')"


def _write_log(spark, sf_dir, files: int) -> str:
    """The routing log as nested JSONL; errors have no decision."""
    log = table(spark, sf_dir, _LOG)
    decision = F.when(F.col("label") != "error", F.struct("label", "confidence", "evidence_used", "reason_code", "abstention_reason"))
    nested = log.select(
        "run_id", "task", "anchor_id", "candidate_id", "prompt_version", "model_id", decision.alias("decision"), "error", "retry_count", "backend",
        F.struct("input_tokens", "output_tokens").alias("usage"), "timestamp",
    )
    path = f"{Scratch(spark, 'log').root}/jsonl"
    nested.repartition(files, "anchor_id").write.json(path)
    return path


def decision_log(spark, sf_dir):
    back = tables.read_decisions(spark, _write_log(spark, sf_dir, 4))
    return back.select("run_id", "anchor_id", "candidate_id", "label", "confidence", F.size("evidence_used").alias("n_evidence"), "reason_code", "abstention_reason", "error", "retry_count", "input_tokens", "output_tokens", "timestamp")


DECISION_LOG_SQL = f"""SELECT run_id, anchor_id, candidate_id, label, CASE WHEN label = 'error' THEN 0.0 ELSE confidence END AS confidence, CAST(CASE WHEN label = 'error' THEN 0 ELSE coalesce(len(evidence_used), 0) END AS INTEGER) AS n_evidence,
coalesce(CASE WHEN label <> 'error' THEN reason_code END, error, '') AS reason_code, CASE WHEN label <> 'error' THEN abstention_reason END AS abstention_reason, error, retry_count, input_tokens, output_tokens, timestamp FROM {_LOG}"""


def token_usage(spark, sf_dir):
    usage = tables.read_token_usage(spark, _write_log(spark, sf_dir, 2))
    return usage.groupBy("model_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("retry_count").alias("retries"))


TOKEN_USAGE_SQL = f"SELECT model_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(retry_count) AS BIGINT) AS retries FROM {_LOG} GROUP BY model_id"


def streamed_decisions(spark, sf_dir):
    """The log as a stream of files, folded to the latest valid decision of each pair."""
    scratch = Scratch(spark, "stream")
    folded = stream.last_decisions(stream.decision_stream(spark, _write_log(spark, sf_dir, 3), files_per_batch=1))
    out = f"{scratch.root}/out"

    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(out)

    q = folded.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("anchor_id", "candidate_id", "label", "timestamp")


STREAMED_SQL = f"""SELECT anchor_id, candidate_id, label, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, candidate_id
ORDER BY label <> 'error' DESC, timestamp DESC NULLS LAST, label DESC NULLS LAST, CASE WHEN label = 'error' THEN 0.0 ELSE confidence END DESC NULLS LAST) AS k FROM {_LOG}) WHERE k = 1"""


def pair_source(spark, sf_dir):
    """Pairs of a parquet file without gold columns."""
    scratch = Scratch(spark, "pairs")
    scratch.keep(table(spark, sf_dir, "candidates_and").select("anchor_id", "candidate_id", "task"))
    return tables.task_pairs(tables.read_pairs(spark, f"{scratch.root}/1"), "AND")


PAIR_SOURCE_SQL = "SELECT anchor_id, candidate_id, task, CAST(NULL AS VARCHAR) AS gold_label, CAST(NULL AS VARCHAR) AS split FROM candidates_and WHERE task = 'AND'"

QUERIES = {
    "src04_csv": (csv_roundtrip, CSV_SQL),
    "src06_canonical": (canonical, CANONICAL_SQL),
    "src08_pairs": (pair_source, PAIR_SOURCE_SQL),
    "src10_decision_log": (decision_log, DECISION_LOG_SQL),
    "src16_token_usage": (token_usage, TOKEN_USAGE_SQL),
    "stream_decisions": (streamed_decisions, STREAMED_SQL),
}
