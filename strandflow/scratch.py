"""Tables that cut a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables written inside each scope that is open, the innermost last.
_SCOPES: list[dict[str, SparkSession]] = []


def scratch_path(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir; in a folder of our own only where the session names none and is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(spark, "_strandflow_scratch", None) or f"file://{tempfile.mkdtemp(prefix='strandflow-')}"
        spark._strandflow_scratch = found
    path = f"{found}/strandflow/{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1][path] = spark
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows once, as Parquet in the shared folder, and read them back."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _paths(df: DataFrame) -> set[str]:
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    return {f for f in folders if f.rpartition("/")[0].endswith("/strandflow")}


def release(df: DataFrame) -> None:
    """Delete the tables of materialise() that df reads, once nothing else does."""
    for path in _paths(df):
        _delete(df.sparkSession, path)


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those that a DataFrame in the list given reads."""
    made: dict[str, SparkSession] = {}
    kept: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield kept
    finally:
        _SCOPES.remove(made)
        names = {p.rpartition("/")[2] for df in kept for p in _paths(df)}
        for path, spark in made.items():
            if path.rpartition("/")[2] not in names:
                _delete(spark, path)
            elif _SCOPES:
                _SCOPES[-1][path] = spark
