"""Writing tables, logs and manifests."""

from __future__ import annotations

import hashlib
import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, force: bool = True) -> bool:
    """Overwrites; without force, an existing output is left alone.  True if written."""
    if not force and exists(df.sparkSession, path):
        return False
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return True


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for reports, not for large tables."""
    df.coalesce(1).write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_jsonl(df: DataFrame, path: str, resume: bool = False) -> None:
    df.write.mode("append" if resume else "overwrite").json(path)


def exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def file_digest(path: str) -> str:
    """SHA-256 of a file, or of the names and digests of a folder's files."""
    p = Path(path)
    if p.is_dir():
        parts = [f"{f.relative_to(p)}:{file_digest(str(f))}" for f in sorted(p.rglob("*")) if f.is_file() and not f.name.startswith((".", "_"))]
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()
    digest = hashlib.sha256()
    with p.open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def write_manifest(path: str, stage: str, inputs: list[str], outputs: list[str], **details) -> dict:
    """JSON with the digest of every input and output."""
    manifest = {"stage": stage, "inputs": {p: file_digest(p) for p in inputs}, "outputs": {p: file_digest(p) for p in outputs}, **details}
    Path(path).write_text(json.dumps(manifest, indent=2, sort_keys=True), encoding="utf-8")
    return manifest


def collect_artefacts(declared: dict[str, str], folder: str) -> list[dict]:
    """Copies what exists into ``folder``; an inventory row per artefact: name, exists, size, digest."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    rows = []
    for name, source in declared.items():
        p = Path(source)
        row = {"name": name, "source": source, "exists": p.is_file(), "bytes": p.stat().st_size if p.is_file() else 0, "sha256": file_digest(source) if p.is_file() else ""}
        if p.is_file():
            shutil.copy2(p, Path(folder) / p.name)
        rows.append(row)
    return rows


def backup(path: str, stamp: str) -> str:
    """Copies a file before it is changed in place."""
    target = f"{path}.{stamp}.bak"
    shutil.copy2(path, target)
    return target
