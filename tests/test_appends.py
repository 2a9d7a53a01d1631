"""Appends that may be repeated."""

import pytest
from pyspark.sql import functions as F

from strandflow.sources import writers as W


def test_a_job_that_broke_off_is_repeated(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = lambda low, high: spark.range(low, high, 1, 4).select("id", (F.col("id") % 2).alias("species"), F.array(F.col("id") / 4).alias("p"))
    with pytest.raises(ValueError, match="no batch"):
        W.appended(spark, path)
    W.predictions(rows(0, 10), path, batch="first")
    breaks = rows(10, 2000).withColumn("id", F.when(F.col("id") == 1900, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        W.predictions(breaks, path, batch="second")
    assert W.appended(spark, path).count() == 10
    # Files that a killed job left behind are neither read nor kept.
    rows(5000, 5005).write.partitionBy("species").parquet(f"{path}/batch=second", mode="append")
    assert W.appended(spark, path).count() == 10
    for _ in range(2):
        W.predictions(rows(10, 2000), path, batch="second")
    assert not W.append_once(rows(0, 1), path, "first", ["species"])
    found = W.appended(spark, path)
    assert sorted(r["id"] for r in found.collect()) == list(range(2000))
    assert {(r["batch"], r["species"]): r["n"] for r in found.groupBy("batch", "species").agg(F.count("*").alias("n")).collect()} == {("first", 0): 5, ("first", 1): 5, ("second", 0): 995, ("second", 1): 995}
    assert dict(found.dtypes)["p"] == "array<float>"
    for bad in ("", "a/b", "_x", "a=b"):
        with pytest.raises(ValueError):
            W.append_once(rows(0, 1), path, bad)
