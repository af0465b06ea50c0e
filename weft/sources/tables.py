"""Reading exports, decision logs, annotation files and parquet, always with an explicit schema."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.text import label_class, split_class
from weft.operators.decisions import DECISION_SCHEMA, flatten_decisions
from weft.operators.quality import require_columns

#: Cell texts that mean a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)


def expected_headers(path: str) -> list[str]:
    """One header per line, without outer white space and one pair of double quotes; blank lines don't count."""
    out = []
    for line in Path(path).read_text(encoding="utf-8-sig").splitlines():
        name = line.strip()
        if len(name) >= 2 and name[0] == name[-1] == '"':
            name = name[1:-1].strip()
        if name:
            out.append(name)
    return out


def csv_headers(path: str) -> list[str]:
    with open(path, encoding="utf-8-sig", newline="") as f:
        return [h.strip().strip('"') for h in next(csv.reader(f), [])]


def validate_headers(expected: list[str], observed: list[str]) -> None:
    """Raises one error naming missing and extra headers and the first difference in order."""
    missing, extra = [h for h in expected if h not in observed], [h for h in observed if h not in expected]
    shared_e, shared_o = [h for h in expected if h in observed], [h for h in observed if h in expected]
    moved = next(((e, o) for e, o in zip(shared_e, shared_o) if e != o), None)
    if missing or extra or moved:
        raise ValueError(f"headers differ: missing {missing}, extra {extra}, first out of order {moved}")


def nulled(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Texts that mean a missing value become null."""
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")) for c in columns or df.columns})


def read_exports(spark: SparkSession, paths: list[str], headers: list[str], query_frame: str) -> DataFrame:
    """All-text scan of CSV exports with query_frame, source_file and row_id_in_file (from 0, in file order).

    Quoted cells may hold newlines and doubled quotes.  Such a file can't be split, so one task reads it
    in order and a running number within the task is its row number.
    """
    for p in paths:
        validate_headers(headers, csv_headers(p))
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    # one relation per file: a task then holds rows of one file only, in file order
    frames = []
    for p in paths:
        df = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', enforceSchema=False, encoding="UTF-8").csv(p)
        numbered = nulled(df, headers).withColumn("_id", F.monotonically_increasing_id())
        frames.append(numbered.select(*(F.col(f"`{h}`") for h in headers), F.lit(query_frame).alias("query_frame"), F.lit(Path(p).name).alias("source_file"), F.col("_id").cast("int").alias("row_id_in_file")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def canonical_records(frames: list[DataFrame], headers: list[str]) -> DataFrame:
    """Union of the frames with record_id, the SHA-256 of the EID ('' if missing)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("record_id", F.sha2(F.coalesce("EID", F.lit("")), 256)).select(
        *(F.col(f"`{h}`") for h in headers), "query_frame", "source_file", "row_id_in_file", "record_id"
    )


def normalised_records(records: DataFrame) -> DataFrame:
    """Adds the normalised columns: normalised texts, id list, acronyms, year."""
    from weft.functions import text

    named = {"authors_norm": "Authors", "author_full_names_norm": "Author full names", "affiliations_norm": "Affiliations", "authors_with_affiliations_norm": "Authors with affiliations"}
    return records.withColumns(
        {k: text.normalise_text(F.col(f"`{v}`")) for k, v in named.items()}
        | {"author_ids_list": text.split_list(F.col("`Author(s) ID`")), "affiliations_acronyms": text.acronyms(F.col("Affiliations")), "year_int": text.safe_int(F.col("Year"))}
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """anchor_id, candidate_id, task, gold_label, split; the last two null where the file lacks them."""
    df = spark.read.parquet(path)
    require_columns(df, ["anchor_id", "candidate_id", "task"])
    for c in ("gold_label", "split"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select("anchor_id", "candidate_id", "task", "gold_label", "split")


def task_pairs(pairs: DataFrame, task: str, limit: int | None = None, seed: int = 42) -> DataFrame:
    """The pairs of a task; with limit, a uniform sample by hash."""
    from weft.operators.sampling import sample

    out = pairs.filter(F.col("task") == task)
    return sample(out, limit, ["anchor_id", "candidate_id"], seed) if limit else out


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL decision log as a flat table; broken and blank lines don't count."""
    return flatten_decisions(spark.read.schema(DECISION_SCHEMA).option("mode", "DROPMALFORMED").json(path))


def read_token_usage(spark: SparkSession, path: str) -> DataFrame:
    return read_decisions(spark, path).select("task", "model_id", "run_id", "label", "retry_count", "input_tokens", "output_tokens", "timestamp")


#: Accepted column names of annotation exports, by meaning, first match wins.
COLUMN_ALIASES = {
    "anchor_id": ("anchor_id", "anchor", "id_a", "left_id"), "candidate_id": ("candidate_id", "candidate", "id_b", "right_id"),
    "gold_label": ("gold_label", "label", "annotation", "choice", "decision"), "split": ("split", "fold", "partition"), "stratum": ("stratum", "strata", "stratum_tag", "tier"),
}


def pick_column(columns: list[str], meaning: str, required: bool = True) -> str | None:
    lower = {c.lower(): c for c in reversed(columns)}
    for alias in COLUMN_ALIASES[meaning]:
        if alias in lower:
            return lower[alias]
    if required:
        raise ValueError(f"no column for {meaning} among {columns}")
    return None


def annotation_format(path: str, given: str | None = None) -> str:
    kind = given or {".csv": "csv", ".json": "json", ".jsonl": "json"}.get(Path(path).suffix.lower())
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown annotation format: {path}")
    return kind


def read_annotations(spark: SparkSession, path: str, given: str | None = None) -> DataFrame:
    """anchor_id, candidate_id, gold_label, split, stratum of a labelling tool's CSV or JSON export."""
    if annotation_format(path, given) == "csv":
        df = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
        found = {m: pick_column(df.columns, m, m in ("anchor_id", "candidate_id", "gold_label")) for m in COLUMN_ALIASES}
        df = df.select(*((F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(m) for m, c in found.items()))
    else:
        value = "value: struct<choices: array<string>>"
        fields = "anchor_id: string, candidate_id: string, split: string, stratum: string"
        schema = f"data struct<{fields}>, annotations array<struct<result: array<struct<{value}>>>>"
        raw = spark.read.schema(schema).option("multiLine", True).json(path)
        results = F.get("annotations", F.lit(0))["result"]
        labelled = F.filter(results, lambda r: F.size(r["value"]["choices"]) > 0)
        df = raw.select("data.anchor_id", "data.candidate_id", F.get(labelled, F.lit(0))["value"]["choices"][0].alias("gold_label"), "data.split", "data.stratum")
    return df.withColumns({"gold_label": label_class(F.col("gold_label")), "split": split_class(F.col("split"))})


def read_annotation_csv(spark: SparkSession, path: str, only_dev: bool = False) -> DataFrame:
    """All text, missing cells ''."""
    df = spark.read.options(header=True, multiLine=True, escape='"').csv(path).fillna("")
    return df.filter(F.lower("split") == "dev") if only_dev else df


def first_existing(*paths: str) -> str:
    for p in paths:
        if Path(p).exists():
            return p
    raise FileNotFoundError(f"none of {paths}")


def require_artefacts(paths: list[str]) -> None:
    missing = [p for p in paths if not Path(p).exists()]
    if missing:
        raise FileNotFoundError(f"missing: {missing}")


def read_thresholds(path: str) -> dict:
    import json

    return json.loads(Path(path).read_text(encoding="utf-8"))


def tuned_thresholds(manifest: dict, task: str, default: float = 0.85) -> dict[str, float]:
    """t_match and t_nonmatch of a tuning manifest, nested by task."""
    own = manifest.get(task.lower(), {})
    return {"t_match": float(own.get("tuned_t_match", default)), "t_nonmatch": float(own.get("t_nonmatch", default))}


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows of several parquet files with their split's name."""
    out = None
    for name, path in paths.items():
        df = spark.read.parquet(path).withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out
