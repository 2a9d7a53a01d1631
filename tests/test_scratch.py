"""Scratch tables and their release."""

import os

import pytest
from pyspark.sql import functions as F

from strandflow.scratch import _paths, materialise, release, scope


def exists(df):
    return all(os.path.isdir(p.removeprefix("file:")) for p in _paths(df))


def test_tables_go_with_their_scope(spark):
    with scope() as kept:
        first = materialise(spark.range(5))
        with scope() as inner:
            second = materialise(first.select((F.col("id") + 1).alias("id")))
            third = materialise(second)
            inner.append(third)
        paths = [_paths(x) for x in (first, third)]
        assert all(paths) and not any(os.path.isdir(p.removeprefix("file:")) for p in _paths(second))
        kept.append(third)
    assert exists(third) and third.count() == 5 and not os.path.isdir(next(iter(paths[0])).removeprefix("file:"))
    release(third)
    assert not exists(third)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            materialise(spark.range(1))
