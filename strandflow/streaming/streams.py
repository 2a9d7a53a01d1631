"""Streams: incremental confusion matrices, tumbling, sliding and session windows.

Each takes a streaming DataFrame and returns one; `drain` runs a stream over all that is available and returns the
result as a table, so a stream can be held against its batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.scratch import scratch_path

TIME = "ts"


def source(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of Parquet files; times without zone are taken in the session's."""
    schema = spark.read.parquet(path).schema
    either = f"{path[:-1]}[{path[-1]}]"  # as a pattern, the path may be one file as well as a folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(either)
    return rows.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema.fields])


def confusion(stream: DataFrame, ref: str, pred: str) -> DataFrame:
    return stream.groupBy(F.col(ref).alias("ref"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, by: list[str], size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum by tumbling (or sliding) window; rows later than the watermark are dropped by the engine."""
    window = F.window(TIME, size, slide) if slide else F.window(TIME, size)
    grouped = stream.withWatermark(TIME, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, by: list[str], gap: str, late: str | None = "1 hour") -> DataFrame:
    """Runs of rows less than `gap` apart; rows later than the watermark are dropped by the engine (late None: none are)."""
    grouped = (stream.withWatermark(TIME, late) if late else stream).groupBy(F.session_window(TIME, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run until nothing is left to read; the last complete result, or all that was appended, as a table."""
    spark = stream.sparkSession
    path = scratch_path(spark)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")

    running = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(keep).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
