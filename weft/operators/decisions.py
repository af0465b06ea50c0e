"""Logs of pair decisions: flattening, the last valid decision of each pair, and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["anchor_id", "candidate_id"]

DECISION_SCHEMA = """
run_id string, task string, anchor_id string, candidate_id string, prompt_version string, model_id string,
temperature double, top_p double, max_tokens int,
decision struct<label: string, confidence: double, evidence_used: array<string>, reason_code: string, abstention_reason: string>,
error string, retry_count int, backend string, usage struct<input_tokens: int, output_tokens: int>, timestamp string
"""


def flatten_decisions(log: DataFrame) -> DataFrame:
    """One flat row per log line.  A missing or empty decision is label 'error' with confidence 0 and no
    evidence, a decision without label is 'error' too; without a reason code the error text stands for it."""
    d = F.col("decision")
    missing = d.isNull() | (d["label"].isNull() & d["confidence"].isNull() & d["evidence_used"].isNull() & d["reason_code"].isNull() & d["abstention_reason"].isNull())
    return log.select(
        "run_id", "task", "anchor_id", "candidate_id", "prompt_version", "model_id",
        F.coalesce(d["label"], F.lit("error")).alias("label"),
        F.when(missing, 0.0).otherwise(F.coalesce(d["confidence"], F.lit(0.0))).alias("confidence"),
        F.when(missing, F.array().cast("array<string>")).otherwise(F.coalesce(d["evidence_used"], F.array().cast("array<string>"))).alias("evidence_used"),
        F.coalesce(d["reason_code"], F.col("error"), F.lit("")).alias("reason_code"), F.when(~missing, d["abstention_reason"]).alias("abstention_reason"),
        "error", F.coalesce("retry_count", F.lit(0)).alias("retry_count"), "backend",
        F.col("usage.input_tokens").alias("input_tokens"), F.col("usage.output_tokens").alias("output_tokens"), "timestamp",
    )


def last_decision(decisions: DataFrame, order: list, columns: list[str], compat: bool = False) -> DataFrame:
    """One row per pair: the last row by ``order`` that isn't an error, else the last error.

    compat: column by column the last non-null value instead of the whole row.  Both are one aggregation
    that combines before the shuffle; no pair's rows are gathered.
    """
    rank = F.struct((F.col("label") != "error").alias("ok"), *(F.col(c) if isinstance(c, str) else c for c in order))
    if compat:
        values = [F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns]
        return decisions.groupBy(*PAIR).agg(*values)
    return decisions.groupBy(*PAIR).agg(F.max_by(F.struct(*columns), rank).alias("r")).select(*PAIR, "r.*")


#: Class of an error by its HTTP status.
STATUS_CLASSES = {400: "INVALID_REQUEST", 401: "AUTH", 402: "BILLING", 403: "PERMISSION", 404: "MODEL_NOT_FOUND", 429: "RATE_LIMIT"}


def error_classes(message, status=None) -> "F.Column":
    """Class of an error: by its HTTP status where there is one (billing words win over 400 and unknown
    ones), else by the keywords of its text, the first that fits."""
    m = F.lower(F.coalesce(message, F.lit("")))
    limits = m.contains("usage") & m.contains("limit")
    billing = m.contains("billing") | m.contains("credit")
    by_text = (
        F.when(m.contains("empty_response_content") | m.contains("list index out of range"), "INVALID_RESPONSE")
        .when(m.contains("auth") | m.contains("unauthorized") | m.contains("api key"), "AUTH")
        .when(billing | limits, "BILLING")
        .when(m.contains("rate") | m.contains("429"), "RATE_LIMIT")
        .when(m.contains("connect") | m.contains("timeout") | m.contains("network"), "NETWORK")
        .otherwise("UNKNOWN")
    )
    if status is None:
        return by_text
    known = F.create_map(*(F.lit(x) for kv in STATUS_CLASSES.items() for x in kv))[status]
    by_status = F.when((status == 400) & limits, "BILLING").when((status > 404) & (status != 429) & billing, "BILLING").otherwise(F.coalesce(known, F.lit("UNKNOWN")))
    return F.when(status.isNull(), by_text).otherwise(by_status)


def still_open(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs without any valid decision yet (left anti join)."""
    done = decisions.filter(F.col("label").isNotNull() & (F.col("label") != "error")).select(*PAIR).distinct()
    return pairs.join(done, PAIR, "left_anti")


def resume_plan(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(pair, action): 'skip' if decided, 'force_uncertain' after an invalid response, 'retry' after any
    other error, else 'run'."""
    state = decisions.groupBy(*PAIR).agg(
        F.max(F.col("label") != "error").alias("decided"),
        F.max((F.col("label") == "error") & (error_classes(F.col("error")) == "INVALID_RESPONSE")).alias("invalid"),
    )
    joined = pairs.select(*PAIR).distinct().join(state, PAIR, "left")
    action = F.when(F.col("decided"), "skip").when(F.col("invalid"), "force_uncertain").when(F.col("decided").isNotNull(), "retry").otherwise("run")
    return joined.select(*PAIR, action.alias("action"))


def stub_decisions(pairs: DataFrame) -> DataFrame:
    """The decision that asks for nothing: uncertain with confidence 0."""
    return pairs.select(
        *PAIR, F.lit("uncertain").alias("label"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("evidence_used"),
        F.lit("insufficient_evidence").alias("reason_code"), F.lit("requests_only_stub").alias("abstention_reason"), F.lit("requests_only").alias("backend"),
    )


def parse_decision(raw) -> "F.Column":
    """struct(label, confidence, reason_code, evidence_used) of a reply text, or null if it breaks the rules.

    Tries the text (without ``` fences), then its first {...}; label must be one of three and confidence
    within 0 and 1.
    """
    schema = "label string, confidence double, reason_code string, evidence_used array<string>"
    plain = F.regexp_replace(F.trim(raw), r"(?m)^\s*```.*$", "")
    parsed = F.from_json(plain, schema)
    inner = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*?\})", 1), schema)
    best = F.when(parsed["label"].isNotNull(), parsed).otherwise(inner)
    ok = best["label"].isin("match", "non-match", "uncertain") & best["confidence"].between(0.0, 1.0)
    return F.when(ok, best)


def keyword_label(raw) -> "F.Column":
    """Label named in a free text, the longest first; null if none is."""
    m = F.lower(raw)
    return F.when(m.rlike("non-?match"), "non-match").when(m.contains("uncertain"), "uncertain").when(m.contains("match"), "match")


