"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_chunks(chunks: DataFrame, path: str, by: Sequence[str] = ("species",)) -> None:
    """Add chunks to a data set. Their order is in their keys, so appending needs no offsets."""
    chunks.write.mode("append").partitionBy(*by).parquet(path)


def _place(spark: SparkSession, path: str):
    """A path, and the file system it is in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def append_once(rows: DataFrame, path: str, batch: str, by: Sequence[str] = ()) -> bool:
    """Add a named batch of rows to a data set, so that adding it again changes nothing; False if it was there already.

    A batch has a folder of its own, which counts only once its name is in the manifest, one empty file for each batch. The name
    is written last: a job that ends before leaves nothing that `appended` reads, and its repetition replaces what it left.
    """
    if not batch[:1].isalpha() or any(c in batch for c in "/=:"):
        raise ValueError(f"{batch!r} cannot name a batch")
    spark = rows.sparkSession
    done, files = _place(spark, f"{path}/_batches/{batch}")
    if files.exists(done):
        return False
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={batch}")
    files.mkdirs(done.getParent())
    files.create(done, True).close()
    return True


def appended(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the batches in a data set's manifest, with the name of their batch."""
    manifest, files = _place(spark, f"{path}/_batches")
    names = sorted(f.getPath().getName() for f in files.listStatus(manifest)) if files.exists(manifest) else []
    if not names:
        raise ValueError(f"no batch at {path}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in names]).withColumn("batch", F.col("batch").cast("string"))


def predictions(rows: DataFrame, path: str, by: Sequence[str] = ("species",), p: str = "p", batch: str | None = None) -> None:
    """Add predictions to a data set, as numbers of 32 bits; order is in their keys, as with chunks. With a name for the batch,
    adding it again changes nothing."""
    narrow = rows.withColumn(p, F.col(p).cast("array<float>"))
    if batch is None:
        append_chunks(narrow, path, by)
    else:
        append_once(narrow, path, batch, by)


def hint_files(hints: DataFrame, path: str, files: int | None = None) -> None:
    """Tab-separated hints; each file holds a range of sequences, sorted by sequence and start, both strands together."""
    order = ["seqid", "start"]
    ranged = hints.repartitionByRange(files, *order) if files else hints.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").option("emptyValue", "").csv(path, sep="\t", quote="")


def matrices(tables: DataFrame, path: str, by: Sequence[str]) -> None:
    """A folder of CSV files for each combination of the columns in `by`, such as filter and kind of table."""
    tables.repartition(*by).write.mode("overwrite").partitionBy(*by).csv(path, header=True)


def fasta(sequences: DataFrame, path: str, width: int = 80) -> None:
    """(seqid, sequence) as FASTA."""
    lines = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    sequences.select(F.concat(F.lit(">"), F.col("seqid").cast("string"), F.lit("\n"), lines)).write.mode("overwrite").text(path)


def run_metadata(spark: SparkSession, path: str, attributes: dict[str, str]) -> None:
    """One row of provenance beside a data set, with the time of writing."""
    row = spark.range(1).select(F.current_timestamp().cast("string").alias("timestamp"), F.create_map(*[F.lit(x) for kv in attributes.items() for x in kv]).alias("attributes"))
    row.write.mode("append").parquet(path)
