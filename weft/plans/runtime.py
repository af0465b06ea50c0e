"""Session-level helpers: table access and cutting of lineage in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: set[str] = set()
_ROOTS: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_up() -> None:
    """Deletes all intermediate tables of this process from the shared folder; runs at exit by itself.

    Results are lazy and read them, so nothing may read a result afterwards."""
    while _ROOTS:
        spark, path = _ROOTS.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session is gone already
            return


atexit.register(clean_up)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, only where that is unset
    (single-machine runs), a temporary folder of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
        own = f"{tempfile.gettempdir()}/weft-{spark.sparkContext.applicationId}"
        if own not in _OWN:
            _OWN.add(own)
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor re-reads them.

    ``keep(df)`` writes and reads back; ``drop(df)`` deletes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        _ROOTS.append((spark, self.root))
        self.count = 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                _delete(self.spark, path)


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
