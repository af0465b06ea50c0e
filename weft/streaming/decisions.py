"""The decision log as a stream: new lines are folded into the last valid decision of each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.decisions import DECISION_SCHEMA, PAIR, flatten_decisions, last_decision

COLUMNS = ["label", "confidence", "evidence_used", "reason_code", "retry_count", "timestamp"]


def decision_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Flat rows of a folder to which JSONL files are added."""
    raw = spark.readStream.schema(DECISION_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return flatten_decisions(raw)


def last_decisions(stream: DataFrame) -> DataFrame:
    """Streaming aggregate (complete or update mode): one state row per pair, the latest by timestamp of
    its valid decisions, else of its errors."""
    rank = F.struct((F.col("label") != "error").alias("ok"), "timestamp", "label", "confidence")
    return stream.groupBy(*PAIR).agg(F.max_by(F.struct(*COLUMNS), rank).alias("r")).select(*PAIR, "r.*")


def upsert_to(path: str):
    """foreachBatch sink: each batch replaces the pairs it decides in a parquet table (two folders in
    turn, so a reader never sees a half-written one).  Repeating a batch changes nothing."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        current, following = f"{path}/{epoch % 2}", f"{path}/{(epoch + 1) % 2}"
        new = batch.select(*PAIR, *COLUMNS)
        try:
            old = spark.read.parquet(current)
            new = old.unionByName(new)
        except Exception as e:  # the first batch has nothing to read
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        last_decision(new, ["timestamp", "confidence"], COLUMNS).write.mode("overwrite").parquet(following)

    return run
