"""Windows, pools, folds and segments against hand-made values."""

import pytest
from pyspark.sql import functions as F

from strandflow.operators import overlap as O
from strandflow.operators import segment as S
from strandflow.operators import training


def tracks(spark, *ps):
    return spark.createDataFrame([(k, i, p) for k, track in enumerate(ps) for i, p in enumerate(track)], "k int, pos long, p array<double>")


def sure(*spans, n=100):
    """One class is certain everywhere but in the spans."""
    return [[0.5, 0.5] if any(a <= i < b for a, b in spans) else [1.0, 0.0] for i in range(n)]


def test_confident_regions(spark):
    df = tracks(spark, sure(), sure((0, 100)), sure((30, 40)), sure((0, 20)), sure((80, 100)), sure((5, 6)), [[1.0, 0.0]] * 50 + [[0.0, 1.0]] * 50)
    got = {}
    for r in S.confident_regions(df, ["k"]).collect():
        got.setdefault(r["k"], []).append((r["start"], r["end"]))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(0, 100)], 2: [(0, 29), (40, 100)], 3: [(20, 100)], 4: [(0, 79)], 5: [(6, 100)], 6: [(0, 49), (50, 100)]}


def test_divided_regions(spark):
    flat = [0.9] * 40
    step = [0.9] * 20 + [0.2] * 20
    df = spark.createDataFrame([(0, flat), (1, step), (2, [0.9] * 8)], "k int, p array<double>")
    rows = S.divided(df, "p", F.lit(10), F.lit(500)).collect()
    got = {}
    for r in rows:
        got.setdefault(r["k"], []).append((r["start"], r["end"]))
    assert got == {0: [(5, 35)], 1: [(5, 25), (25, 35)]}
    assert sum(e - s for s, e in got[1]) == 30


def test_hints_convert_strands(spark):
    df = spark.createDataFrame([("a", 1000, True, 2, 10, 20, 0.5), ("a", 2000, False, 3, 10, 20, 0.5)], "seqid string, chunk_start long, is_plus boolean, cls int, start long, end long, score double")
    rows = S.hints(df, "x").orderBy("start").collect()
    assert [(r["type"], r["start"], r["end"], r["strand"]) for r in rows] == [("CDSpart", 1011, 1020, "+"), ("intronpart", 1981, 1990, "-")]
    wide = S.hints(df, "x", as_before=True).where("strand = '-'").first()
    assert (wide["start"], wide["end"]) == (1980, 1991)


def windows_of(spark, values, size, offset):
    ranges = spark.createDataFrame([(1, len(values))], "k int, length long")
    w = O.windows(ranges, size, offset).withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    track = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, pos long, v double")
    return w.withColumn("pos", F.col("w_start") + F.col("off")).join(track, ["k", "pos"])


@pytest.mark.parametrize("n,size,offset,core", [(20, 8, 4, 6), (23, 8, 4, 8), (8, 8, 4, 6), (30, 10, 5, 6)])
def test_unchanged_windows_merge_back_to_the_input(spark, n, size, offset, core):
    values = [float((i * 7) % 11) for i in range(n)]
    df = windows_of(spark, values, size, offset).withColumn("p", F.array("v", F.col("v") + 1))
    rows = O.overlap_mean(df, ["k"], size, core).orderBy("pos").collect()
    assert [r["p"][0] for r in rows] == values and [r["p"][1] for r in rows] == [v + 1 for v in values]


def test_trimmed_overlap(spark):
    """Five windows of one class each, scaled down: offset 5, windows 20, all or half of them kept."""
    ranges = spark.createDataFrame([(1, 40)], "k int, length long")
    w = O.windows(ranges, 20, 5).withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("p", F.array(*[F.when(F.col("w") == i, 1.0).otherwise(0.0) for i in range(5)]))
    at = lambda core: {r["pos"]: r["p"] for r in O.overlap_mean(w, ["k"], 20, core).collect()}
    full, half = at(20), at(10)
    assert full[0] == [1, 0, 0, 0, 0] and full[7] == [0.5, 0.5, 0, 0, 0] and full[17] == [0.25, 0.25, 0.25, 0.25, 0] and full[39] == [0, 0, 0, 0, 1]
    assert half[4] == [1, 0, 0, 0, 0] and half[12] == [0.5, 0.5, 0, 0, 0] and half[17] == [0, 0.5, 0.5, 0, 0] and half[39] == [0, 0, 0, 0, 1]


def test_overlap_parameters():
    assert O.check_parameters(20) == (10, 15)
    for bad in ((20, 16, 15), (20, 6, 15), (20, 5, 0), (20, 5, 25)):
        with pytest.raises(ValueError):
            O.check_parameters(*bad)


def test_stretched_weights(spark):
    rows = spark.createDataFrame([([1.0, 1.0, 1.0, 8.0, 1.0, 1.0, 1.0, 1.0],), ([1.0, 20.0, 1.0, 1.0, 40.0, 1.0],)], "w array<double>").select(O.stretched(F.col("w"), 3).alias("x")).collect()
    assert rows[0]["x"] == [1, 2, 4, 8, 4, 2, 1, 1]
    assert rows[1]["x"] == [10, 20, 10, 20, 40, 20]


def test_pools_drop_the_overhang_and_weigh(spark):
    df = spark.createDataFrame([(1, i, i % 3, 0 if i == 4 else 1, i // 5) for i in range(11)], "k int, off int, cls int, sw int, flag int")
    rows = O.pool(df, ["k"], 5, F.lit(11), [O.pool_weight(F.col("sw")).alias("sw"), O.class_weight(F.col("cls"), (1, 10, 100)).alias("cw"), O.transition_weight([F.col("flag")], [30]).alias("tw")]).orderBy("pool").collect()
    assert [(r["sw"], r["cw"], r["tw"]) for r in rows] == [(0, 111, 1), (1, 111, 30)]


def test_greedy_pack(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 5, 5, 13, 2, 10])], "k int, o long, s long")
    assert [r["batch"] for r in O.greedy_pack(df, ["k"], "o", "s", 12).orderBy("o").collect()] == [0, 0, 1, 2, 3, 3]


def test_candidate_regions(spark):
    values = [0] * 20 + [1] * 20 + [0] * 20
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k int, pos long, genic double")
    rows = S.candidate_regions(df, ["k"], 10, 0.5, 0.9).collect()
    assert len(rows) == 1 and rows[0]["peak"] == 1.0 and rows[0]["start"] <= 20 and rows[0]["end"] >= 39


def test_early_stopping(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 3.0, 2.0, 2.0, 2.0, 9.0])] + [(2, i, float(i)) for i in range(6)], "k int, step long, f1 double")
    rows = {r["k"]: (r["last_check"], r["best"], r["stopped"]) for r in training.early_stopping(df, ["k"], "step", "f1", 2).collect()}
    assert rows == {1: (4, 3.0, True), 2: (5, 5.0, False)}


def test_models_run_in_tasks(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], "i int, x array<double>")
    rows = training.predict(df, lambda: lambda xs: [[sum(x), 1.0] for x in xs]).orderBy("i").collect()
    assert [r["p"] for r in rows] == [[3.0, 1.0], [3.0, 1.0]]


def test_baseline_learns_from_context(spark):
    seq = ("ATG" + "CCA" + "TAA" + "GGT") * 60
    rows = [(k, i, b, int(seq[i : i + 3] == "ATG")) for k in (0, 1) for i, b in enumerate(seq)]
    bases = training.with_context(spark.createDataFrame(rows, "k int, pos int, base string, cls int"), ["k"], reach=2)
    model = training.baseline(bases.where("k = 0"), reach=2)
    right = training.probabilities(model, bases.where("k = 1")).where(F.get("p", F.col("cls")) > 0.5).count()
    assert right == len(seq)


def test_stretch_weights_at_the_limits(spark, tmp_path):
    from strandflow.plans import catalog
    from tests.oracle import compare, connect

    rows = [(k, [x] + [0.0] * 30 + [x, 0.3] + [0.0] * 31) for k, x in enumerate((0.2, 0.15, 0.20001, 0.15001, 0.19999, None, float("nan")))]
    rows += [(7, None), (8, []), (9, [0.2, 0.3]), (10, [0.3] * 70)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    name = "stretch_weights"
    assert compare(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], str(tmp_path), connect(str(tmp_path))) == ""


def test_settings():
    from strandflow.config import settings

    found = settings({"window_size": 50, "peak_threshold": 1}, {"window_size": 80, "species": None})
    assert (found.window_size, found.peak_threshold, found.species) == (80, 1, "")
    with pytest.raises(ValueError):
        settings({"no_such": 1})
    with pytest.raises(TypeError):
        settings({"window_size": "80"})
    with pytest.raises(ValueError):
        settings(arguments={"overlap_offset": 7})
