"""Scans, unions and chains in bins and blocks give what a window or a fold over the whole key gives."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.operators import annotate as A
from strandflow.operators import chains, scans
from strandflow.operators import intervals as I
from strandflow.operators import overlap as O
from strandflow.operators import segment as S


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("width", [3, 17, 1 << 16])
def test_scans_are_windows(spark, width):
    rng = random.Random(width)
    at = sorted(rng.sample(range(9000), 3000))  # up to 3,000 bins for one key
    df = spark.createDataFrame([(0, p, rng.randrange(-9, 10)) for p in at] + [(k, p, p) for k in (1, 2) for p in range(0, 50, 7)], "k int, p long, v long").repartition(5)
    rows = scans.binned(df, "p", width)
    over = Window.partitionBy("k").orderBy("p")
    upto, ahead = over.rowsBetween(Window.unboundedPreceding, 0), over.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select("k", "p", F.lag("v").over(over).alias("b"), F.sum("v").over(upto).alias("s"), F.max("v").over(ahead).alias("m"), F.sum(F.when(F.col("v") > 5, 1).otherwise(0)).over(upto).alias("r"))
    found = scans.with_before(rows, ["k"], "p", ["v"])
    found = scans.with_running(found, ["k"], "p", F.col("v"), "s")
    found = scans.with_running(found, ["k"], "p", F.col("v"), "m", F.max, own=False)
    found = scans.with_runs(found, ["k"], "p", F.col("v") > 5, "r")
    shown = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    assert shown(found.select("k", "p", F.col("before.v").alias("b"), "s", "m", "r")) == shown(plain)
    assert shown(found.select("k", "p", "r")) == shown(plain.select("k", "p", "r"))


@pytest.mark.parametrize("width", [2, 40, 1 << 16])
def test_runs_and_unions_across_bins(spark, width):
    rng = random.Random(5)
    rows, at = [], 0
    for row in range(2000):  # one sequence in 1,000 bins
        plus = (row // 90) % 2 == 0
        size = 20 if rng.random() > 0.05 else 11
        at += 20 if rng.random() < 0.05 else 0
        rows.append(("s", row, at, at + size) if plus else ("s", row, at + size, at))
        at += size
    df = spark.createDataFrame(rows, "seqid string, row_id long, start long, end long").repartition(6)
    ends, begun = set(), 0
    for i in range(1, len(rows) + 1):
        if i == len(rows):
            ends.add((begun, i))
            break
        (_, _, a, b), (_, _, c, d) = rows[i - 1], rows[i]
        if (c < d) != (a < b) or abs(d - c) != 20 or abs(b - a) != 20 or c != b:
            ends.add((begun, i))
            begun = i
    assert set(rows_of(I.contiguous_segments(df, 20, ["seqid"], width=width), "first_row", "end_row")) == ends
    spans = [(k, s, s + rng.choice([0, 1, 3, 9, 200])) for k in range(2) for s in rng.choices(range(5000), k=700)]
    covered = {(k, p) for k, s, e in spans for p in range(s, e)}
    # stretches that touch are one
    want = sorted((k, p) for k, p in covered if (k, p - 1) not in covered)
    found = A.union_of(spark.createDataFrame(spans, "k int, p_start long, p_end long"), ["k"], width=width)
    assert rows_of(found, "k", "start") == want
    assert {(r["k"], p) for r in found.collect() for p in range(r["start"], r["end"])} == covered


def packed(sizes, most):
    batch, used, out = 0, 0, []
    for n in sizes:
        if used and used + n > most:
            batch, used = batch + 1, 0
        used += n
        out.append(batch)
    return out


@pytest.mark.parametrize("blocks", [1, 3, 64])
def test_packs_are_those_of_a_fold(spark, monkeypatch, blocks):
    monkeypatch.setattr(chains, "WIDTH", blocks)
    rng = random.Random(blocks)
    lists = {0: [rng.choice([1, 2, 3, 5, 9, 13, 40]) for _ in range(4000)], 1: [0, 0, 50, 0, 0, 1, 12, 0, 1], 2: [12], 3: [99] * 5, None: [4] * 10}
    lists |= {k: [rng.randrange(0, 14) for _ in range(rng.randrange(1, 60))] for k in range(4, 30)}
    rows = [(k, 10 * i, s) for k, sizes in lists.items() if k is not None for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "k int, o long, s int").repartition(7)
    want = sorted((k, 10 * i, b) for k, sizes in lists.items() if k is not None for i, b in enumerate(packed(sizes, 12)))
    assert rows_of(O.greedy_pack(df, ["k"], "o", "s", 12, width=1000), "k", "o", "batch") == want
    assert O.greedy_pack(df.limit(0), ["k"], "o", "s", 12).count() == 0


@pytest.mark.parametrize("blocks", [600, 1000, None])
def test_cuts_without_a_row_for_a_region(spark, blocks):
    rng = np.random.default_rng(8)
    regions, bases = [], []
    for k in range(3):
        at = 7 * k
        for nth, n in enumerate([40, 30_000 if k == 0 else 41, 3, 10, 11, 12, 700, 25, 3000, 2001]):
            steps = rng.choice([0, 0, 0, 0.015625, 0.25], n) * rng.choice([-1, 1], n)
            p = np.clip(0.75 + np.cumsum(steps), 0.5, 1.0) if nth % 2 else np.full(n, 0.75)
            cls = nth % 2
            regions.append((k, at, cls, p.tolist()))
            bases += [(k, at, at + n, at + i, cls, float(v)) for i, v in enumerate(p)]
            at += n + 5
    of = lambda c: (F.when(c == 0, 100).otherwise(10), F.when(c == 0, 300).otherwise(50))
    whole = S.divided(spark.createDataFrame(regions, "k int, r_start long, cls int, p array<double>"), "p", *of(F.col("cls")))
    rows = spark.createDataFrame(bases, "k int, r_start long, r_end long, pos long, cls int, v double").repartition(8)
    found = S.cuts(rows, ["k"], "v", *of(F.col("cls")), reach=400, width=512, blocks=blocks)
    shown = lambda df: sorted((r["k"], r["r_start"], r["start"], r["end"], round(r["score"], 6)) for r in df.collect())
    want = shown(whole)
    assert shown(found) == want and len(want) > 700
    assert S.cuts(rows.limit(0), ["k"], "v", *of(F.col("cls")), reach=400).count() == 0


def test_groups_of_batches():
    import pyarrow as pa

    from strandflow.operators.batches import whole_groups

    keys = [1, 1, 2, 3, 3, 3, 3, 4, None, None, 5]
    table = pa.record_batch([pa.array(keys), pa.array(range(len(keys)))], names=["k", "i"])
    for size in (1, 2, 3, 11):
        seen = []
        for batch, borders in whole_groups(iter([table.slice(i, size) for i in range(0, len(keys), size)]), 1):
            seen += [batch.column(0).to_pylist()[a:b] for a, b in zip(borders, borders[1:], strict=False)]
        assert seen == [[1, 1], [2], [3] * 4, [4], [None, None], [5]]
