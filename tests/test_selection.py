"""Medians and samples by counting against sorted lists."""

import random
from statistics import mean, median, pstdev

import pytest
from pyspark.sql import functions as F

from strandflow.operators import dataset as D
from strandflow.operators import selection


@pytest.mark.parametrize("bins", [3, 4096])
def test_medians_of_groups(spark, monkeypatch, bins):
    monkeypatch.setattr(selection, "BINS", bins)
    rng = random.Random(bins)
    values = {0: [rng.gauss(0, 1) for _ in range(3000)], 1: [5.0] * 50, 2: [1.0, 2.0], 3: [-1.5e308, 1.5e308, 0.0], 4: [float(rng.randrange(4)) for _ in range(401)], 5: [1e-300, 2e-300, 1e300]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [(2, None), (2, float("nan")), (6, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    assert {r["k"]: r["median"] for r in selection.medians(df, ["k"], "v").collect()} == {k: median(v) for k, v in values.items()}
    found = selection.nth_values(df.where("k = 0"), [], "v", {"first": F.lit(0), "tenth": F.lit(9), "last": F.col("n") - 1}).first()
    ordered = sorted(values[0])
    assert (found["n"], found["first"], found["tenth"], found["last"]) == (3000, ordered[0], ordered[9], ordered[-1])
    assert selection.medians(df.limit(0), ["k"], "v").count() == 0


def test_large_summary_is_the_summary(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([0.25, 0.5, rng.random()]), rng.random() < 0.5) for k in range(3) for _ in range(200 + k)]
    df = spark.createDataFrame(rows, "k int, f1 double, full boolean")
    got = {r["k"]: r for r in D.large_summary(df, ["k"], "f1", {"all": F.lit(True), "full": F.col("full")}).collect()}
    for k in range(3):
        for name, own in (("all", [v for q, v, _ in rows if q == k]), ("full", [v for q, v, f in rows if q == k and f])):
            want = {"median": median(own), "mean": mean(own), "std": pstdev(own)}
            assert all(abs(got[k][f"{name}_{what}"] - x) < 1e-12 for what, x in want.items())


def test_large_samples_are_the_first_by_hash(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 7) for i in range(900)], "id int, v int")
    plain = lambda n: {r["id"] for r in D.sample(df, ["id"], n, "s").collect()}
    wanted = {n: plain(n) for n in (1, 250, 899, 900)}
    monkeypatch.setattr(D, "SMALL_SAMPLE", 0)
    for n, ids in wanted.items():
        found = [r["id"] for r in D.sample(df.repartition(5), ["id"], n, "s").collect()]
        assert len(found) == n and set(found) == ids
    assert D.sample(df, ["id"], 5000, "s").count() == 900 and D.sample(df.limit(0), ["id"], 5000, "s").count() == 0
    twice = df.unionByName(df)
    assert D.sample(twice, ["id"], 501, "s").count() == 501
