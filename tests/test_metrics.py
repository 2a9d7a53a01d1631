"""Scores against published and hand-made matrices."""

import math

import pytest
from pyspark.sql import functions as F

from strandflow.functions import scores
from strandflow.operators import metrics as M


def matrix(spark, cells):
    return spark.createDataFrame([(r, p, n) for r, row in enumerate(cells) for p, n in enumerate(row)], "ref long, pred long, n long")


#: A published matrix; the scores below were published with it.
PUBLISHED = [[1297055, 151436, 692534, 188423], [159457, 32821, 99856, 16345], [5014284, 2002047, 2001614, 134915], [199752, 62334, 89647, 9550]]


def test_published_scores(spark):
    found = {r["name"]: r for r in M.score(matrix(spark, PUBLISHED), M.class_cells(M.GENIC) | M.genic_composites()).collect()}
    want = {"genic": (0.3729, 0.2081, 0.2671), "sub_genic": (0.6221, 0.2114, 0.3156), "legacy_cds": (0.6916, 0.2350, 0.3508)}
    for name, prf in want.items():
        assert tuple(round(found[name][k], 4) for k in ("precision", "recall", "f1")) == prf
    assert [round(found[n]["f1"], 4) for n in M.GENIC] == [0.2882, 0.0257, 0.3326, 0.0269]
    assert round(M.accuracy(matrix(spark, PUBLISHED)).first()["accuracy"], 4) == 0.2749


def test_small_matrix(spark):
    cm = matrix(spark, [[40, 3, 0, 7], [1, 30, 4, 0], [0, 0, 25, 5], [2, 6, 0, 17]])
    assert math.isclose(M.accuracy(cm).first()["accuracy"], 112 / 140)
    row = {r["name"]: r for r in M.score(cm, M.class_cells(M.GENIC)).collect()}["intron"]
    assert (row["tp"], row["fp"], row["fn"]) == (17, 12, 8)


def test_no_bases_give_zeros(spark):
    rows = M.score(matrix(spark, [[0] * 4] * 4), M.class_cells(M.PHASES) | M.phase_composites()).collect()
    assert all((r["precision"], r["recall"], r["f1"]) == (0, 0, 0) for r in rows)


def test_phase_composites(spark):
    cm = matrix(spark, [[50, 1, 2, 3], [4, 10, 5, 6], [7, 8, 20, 9], [10, 11, 12, 30]])
    rows = {r["name"]: r for r in M.score(cm, M.phase_composites()).collect()}
    assert (rows["any_phase"]["tp"], rows["any_phase"]["fp"], rows["any_phase"]["fn"]) == (111, 6, 21)
    assert (rows["internal_phase"]["tp"], rows["internal_phase"]["fp"], rows["internal_phase"]["fn"]) == (60, 51, 51)


def test_confusion_completes_cells_and_sums_to_the_rows(spark):
    df = spark.createDataFrame([(0, 0), (0, 3), (2, 1), (0, 0)], "ref int, pred int")
    rows = {(r["ref"], r["pred"]): r["n"] for r in M.confusion(df, 4).collect()}
    assert len(rows) == 16 and rows[0, 0] == 2 and sum(rows.values()) == 4
    shares = {(r["ref"], r["pred"]): r["share"] for r in M.normalized(M.confusion(df, 4)).collect()}
    assert shares[0, 3] == pytest.approx(1 / 3) and shares[1, 1] is None


def test_entropy_skips_zero_probabilities(spark):
    df = spark.createDataFrame([([0.25] * 4, 0, 0), ([0.5, 0.5, 0.0, 0.0], 0, 0), ([0.7, 0.1, 0.1, 0.1], 1, 0)], "p array<double>, ref int, batch int")
    rows = {r["ref"]: r["h"] for r in M.class_entropy(df, 4).collect()}
    assert rows[0] == pytest.approx(1.0) and 0 < rows[1] < 1


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([0.1, 0.4, 0.4, 0.1],)], "p array<double>")
    assert df.select(scores.argmax(F.col("p")).alias("a")).first()["a"] == 1


def test_length_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0, 1.0), (100, 2.0), (101, 4.0), (500, 6.0)], "length int, v double")
    rows = {r["bin_end"]: (r["mean_value"], r["n"]) for r in M.length_bins(df, [0, 100, 500], "length", "v").collect()}
    assert rows == {None: (1.0, 1), 100: (2.0, 1), 500: (5.0, 2)}
