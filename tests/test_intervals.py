"""Interval, annotation and chunk operators: hand-made values, and properties against plain loops."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandflow.functions import sequence as S
from strandflow.operators import annotate as A
from strandflow.operators import chunks as C
from strandflow.operators import coverage as V
from strandflow.operators import genes as G
from strandflow.operators import intervals as I

FEATURE = "seqid int, is_plus boolean, start long, end long, type string, phase int"


def test_minus_features_in_the_plus_frame(spark):
    row = I.to_plus_frame(spark.createDataFrame([(1, False, 40, 9, "transcript", 0)], FEATURE)).first()
    assert (row["p_start"], row["p_end"]) == (10, 41)


def test_chunk_grid(spark):
    rows = C.grid(spark.createDataFrame([("a", 1801)], "seqid string, length long"), 400).orderBy(F.desc("is_plus"), "chunk_idx").collect()
    assert [(r["start"], r["end"]) for r in rows] == [(0, 400), (400, 800), (800, 1200), (1200, 1600), (1600, 1801), (1801, 1600), (1600, 1200), (1200, 800), (800, 400), (400, 0)]


def test_transitions_of_features(spark):
    spans = [("tr", 41, 671), ("cds", 131, 401), ("in", 221, 311), ("in", 491, 581), ("tr", 705, 720)]
    track = [(k, p, int(any(k == t and s <= p < e for t, s, e in spans))) for k in ("tr", "cds", "in") for p in range(720)]
    dense = A.transitions(spark.createDataFrame(track, "kind string, pos int, m int"), ["kind"], "m").where("rises + falls > 0").collect()
    marks = sorted((r["kind"], r["pos"], r["rises"], r["falls"]) for r in dense)
    want = [("tr", p, 1, 0) for p in (40, 41, 704, 705)] + [("tr", p, 0, 1) for p in (670, 671)] + [("cds", p, 1, 0) for p in (130, 131)] + [("cds", p, 0, 1) for p in (400, 401)]
    want += [("in", p, 1, 0) for p in (220, 221, 490, 491)] + [("in", p, 0, 1) for p in (310, 311, 580, 581)]
    assert marks == sorted(want)
    stretches = spark.createDataFrame([(k, s, e) for k, s, e in spans], "kind string, start long, end long")
    borders = A.transition_borders(stretches, ["kind"], F.lit(0), F.lit(720)).collect()
    assert sorted((r["kind"], r["pos"], r["rises"], r["falls"]) for r in borders) == marks


def test_raster_classes_masks_and_lengths(spark):
    rows = [(1, True, 2, 10, "transcript", 0), (1, True, 4, 8, "cds", 0), (1, True, 6, 7, "intron", 0), (1, True, 0, 3, "transcript", 0), (1, True, 9, 12, "missing_utr", 0)]
    found = A.raster(spark.createDataFrame(rows, FEATURE), ["seqid", "is_plus"], F.lit(11), ["missing_utr"])
    cls = A.class_of(F.col("transcript"), F.col("cds"), F.col("intron"))
    got = {r["pos"]: (r["c"], r["gene_length"], r["sample_weight"]) for r in found.select("*", cls.alias("c")).collect()}
    assert got == {0: (1, 3, 1), 1: (1, 3, 1), 2: (1, 8, 1), 3: (1, 8, 1), 4: (2, 8, 1), 5: (2, 8, 1), 6: (3, 8, 1), 7: (2, 8, 1), 8: (1, 8, 1), 9: (1, 8, 0), 10: (0, 0, 0)}


def test_stretches_and_bases_agree(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(2), True, s, s + rng.randrange(0, 40), rng.choice([*A.TYPES, "err"]), 0) for s in (rng.randrange(150) for _ in range(80))]
    df = spark.createDataFrame(rows, FEATURE)
    flags = ["transcript", "cds", "intron", "sample_weight"]
    by_base = {(r["seqid"], r["pos"]): tuple(r[f] for f in flags) for r in A.raster(df, ["seqid"], F.lit(160), ["err"]).collect()}
    by_run = {(r["seqid"], p): tuple(r[f] for f in flags) for r in A.class_segments(df, ["seqid"], F.lit(160), ["err"], 32).collect() for p in range(r["start"], r["end"])}
    assert by_base == by_run


def test_phase_runs_in_reading_direction(spark):
    rows = [(1, p, p == 3, True, 1) for p in range(6)] + [(2, p, False, False, 0) for p in range(4)]
    df = spark.createDataFrame(rows, "f int, pos int, intron boolean, is_plus boolean, phase int")
    got = {(r["f"], r["pos"]): r["base_phase"] for r in A.coding_phase(df, ["f"], F.col("is_plus"), F.col("phase"), F.col("intron")).collect()}
    assert [got.get((1, p)) for p in range(6)] == [1, 0, 2, None, 1, 0]
    assert [got[2, p] for p in range(4)] == [0, 1, 2, 0]


def test_contiguous_segments(spark):
    plus = [(0, 0, 20000), (1, 20000, 40000), (2, 60000, 80000), (3, 80000, 100000), (4, 120000, 133333)]
    plus[3] = (3, 100000, 120000)
    rows = [("chr1", *r) for r in plus] + [("chr1", 5, 133333, 120000), ("chr1", 6, 120000, 100000), ("chr1", 7, 100000, 80000), ("chr1", 8, 60000, 40000), ("chr1", 9, 20000, 0)]
    found = I.contiguous_segments(spark.createDataFrame(rows, "seqid string, row_id long, start long, end long"), 20000, ["seqid"])
    assert sorted((r["first_row"], r["end_row"]) for r in found.collect()) == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 8), (8, 9), (9, 10)]


spans = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.integers(0, 25)), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None)
@given(spans, spans)
def test_depth_and_range_join_agree_with_loops(spark, a, b):
    left = spark.createDataFrame([(k, s, s + n, i) for i, (k, s, n) in enumerate(a)], "k int, a0 long, a1 long, i int")
    right = spark.createDataFrame([(k, s, s + n, j) for j, (k, s, n) in enumerate(b)], "k int, b0 long, b1 long, j int")
    got = sorted((r["i"], r["j"]) for r in I.range_join(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), 8).collect())
    assert got == sorted((i, j) for i, (k, s, n) in enumerate(a) for j, (q, t, m) in enumerate(b) if k == q and max(s, t) < min(s + n, t + m))
    runs = I.depth(left, ["k"], "a0", "a1", 16).collect()
    depth = {}
    for r in runs:
        for p in range(r["start"], r["end"]):
            assert (r["k"], p) not in depth
            depth[r["k"], p] = r["depth"]
    want = {}
    for k, s, n in a:
        for p in range(s, s + n):
            want[k, p] = want.get((k, p), 0) + 1
    assert depth == want


def test_sequences(spark):
    seq = "ACGTRYKMBVDHWSN"
    row = spark.createDataFrame([(seq,)], "s string").select(S.reverse_complement(F.col("s")).alias("r"), S.encode_all(F.col("s")).alias("x")).select("r", "x", S.reverse_complement_vectors(F.col("x")).alias("y"), F.transform("x", S.decode).alias("d")).first()
    assert row["r"] == "NSWDHBVKMRYACGT" and "".join(row["d"]) == seq
    again = spark.createDataFrame([(row["r"],)], "s string").select(S.encode_all(F.col("s")).alias("x")).first()["x"]
    assert again == row["y"]
    mers = spark.createDataFrame([("ACGTA",), ("AC",), ("",)], "s string").select(S.kmers(F.col("s"), 3).alias("m")).collect()
    assert [r["m"] for r in mers] == [["ACG", "CGT", "GTA"], [], []]


def test_padding_and_slices(spark):
    x = F.array(*map(F.lit, range(6)))
    row = spark.range(1).select(
        C.pad(x, 8, F.lit(-1)).alias("p"), C.strand_slice(x, F.lit(5), F.lit(2)).alias("m"), C.padding_to_front(F.array(*map(F.lit, [1, 2, -1])), F.lit(2)).alias("f"), C.n_chunks(F.lit(1801), 400).alias("n")
    ).first()
    assert row["p"] == [0, 1, 2, 3, 4, 5, -1, -1] and row["m"] == [4, 3, 2] and row["f"] == [-1, 1, 2] and row["n"] == 10


def test_cigar_blocks(spark):
    df = spark.createDataFrame([(10, "3S5M2I4N1D6=2H"), (0, "*")], "pos long, cigar string")
    rows = V.blocks(df.where("cigar <> '*'")).collect()
    assert [(r["kind"], r["p_start"], r["p_end"]) for r in rows] == [("covered", 10, 15), ("spliced", 15, 19), ("spliced", 19, 20), ("covered", 20, 26)]


def test_pileup_in_chunks_reads_backwards_on_minus(spark):
    runs = spark.createDataFrame([("a", 2, 5, 7)], "seqid string, start long, end long, depth long")
    chunks = C.grid(spark.createDataFrame([("a", 10)], "seqid string, length long"), 4)
    got = sorted((r["chunk_idx"], r["off"], r["n"], r["depth"]) for r in V.to_chunks(runs, chunks.where("not is_plus"), ["seqid"], 4).collect())
    assert got == [(1, 3, 1, 7), (2, 0, 2, 7)]


def test_strand_mates_are_symmetric(spark):
    chunks = C.grid(spark.createDataFrame([("s", "a", 1000)], "species string, seqid string, length long"), 300).withColumnRenamed("chunk_idx", "row_id")
    rows = G.strand_mates(chunks).collect()
    assert sorted((r["plus_row"], r["minus_row"]) for r in rows) == [(0, 3), (1, 2), (2, 1), (3, 0)]


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.randrange(3), True, s, s + rng.randrange(1, 30), "transcript", 0) for s in (rng.randrange(100) for _ in range(200))], FEATURE)
    one, many = (sorted(map(tuple, A.raster(df.repartition(n), ["seqid", "is_plus"]).collect())) for n in (1, 13))
    assert one == many


def rows_of(df):
    return sorted(tuple(x if not isinstance(x, float) else round(x, 9) for x in r) for r in df.collect())


def test_bins_make_no_difference(spark):
    import random

    from strandflow.operators import segment

    rng = random.Random(3)
    rows = []
    for key in range(3):
        for pos in range(rng.randrange(90, 150)):
            x = [rng.random() ** 4 for _ in range(3)]
            rows.append((key, pos, int(rng.random() < 0.3 + 0.4 * (pos // 20 % 2)), rng.random(), [v / sum(x) for v in x], rng.random() < 0.1))
    df = spark.createDataFrame(rows, "k long, pos long, m int, v double, p array<double>, flag boolean").repartition(3)
    for width in (1, 2, 7, 64):
        for f in (
            lambda w: A.transitions(df, ["k"], "m", width=w).drop("p"),
            lambda w: I.runs_of(df, ["k"], "pos", "m", w),
            lambda w: segment.cumulative_change(df, ["k"], "v", width=w).drop("p"),
            lambda w: segment.confident_regions(df, ["k"], pad=2, least=0.6, width=w),
            lambda w: segment.candidate_regions(df, ["k"], 9, 0.45, 0.6, value="m", coding="m", least_coding=2, width=w),
            lambda w: segment.next_where(df, ["k"], "pos", "flag", width=w).drop("p"),
        ):
            assert rows_of(f(width)) == rows_of(f(1 << 16)) != []


def test_one_stretch(spark):
    import pytest

    df = spark.createDataFrame([(i, 3 <= i < 7) for i in range(10)], "pos long, on boolean")
    assert I.single_stretch(df, "pos", "on").collect() == [(3, 7)]
    for bad in (df.where("pos <> 5"), df.where("not on")):
        with pytest.raises(Exception, match="not one stretch"):
            I.single_stretch(bad, "pos", "on").collect()


def test_mers_in_pieces(spark):
    import random
    from collections import Counter

    from strandflow.operators.dataset import count_mers

    rng = random.Random(4)
    rows = [(k % 3, "".join(rng.choices("ACGTNacgtX", k=rng.randrange(60)))) for k in range(50)] + [(None, "ACGTACGT"), (1, None), (2, "")]
    for k in (1, 3, 16):
        want = Counter()
        for key, seq in rows:
            s = (seq or "").upper().replace("X", "N")
            want.update((key, s[i : i + k]) for i in range(len(s) - k + 1))
        found = count_mers(spark.createDataFrame(rows, "species int, seq string"), ["species"], k)
        assert {(r["species"], r["mer"]): r["n"] for r in found.collect()} == dict(want)


def test_phases_from_lengths(spark):
    rows = [(i, i % 3, 10, 10 + i) for i in range(1, 12)]
    found = A.phase_counts(spark.createDataFrame(rows, "f long, phase int, p_start long, p_end long"), ["f"], F.col("phase"))
    want = {}
    for f, phase, start, end in rows:
        for k in range(end - start):
            want[f, (phase - k) % 3] = want.get((f, (phase - k) % 3), 0) + 1
    assert {(r["f"], r["base_phase"]): r["n"] for r in found.collect()} == want


@pytest.mark.parametrize("levels", [3, 16])
def test_greatest_over_stretches(spark, levels):
    import random

    rng = random.Random(levels)
    spans = [(0, 5 * i, 4000 - 3 * i, i) for i in range(400)] + [(0, -40, 3, 7), (1, 5, 5, 1), (2, 9, 10, 4)]  # nested, and negative places
    spans += [(k, s, s + rng.choice([1, 2, 9, 64, 700]), rng.randrange(1000)) for k in (3, 4) for s in rng.choices(range(2000), k=150)]
    df = spark.createDataFrame(spans, "k int, p_start long, p_end long, v int")
    runs = I.depth(df, ["k"]).drop("depth")
    found = {(r["k"], r["start"]): r["v"] for r in I.greatest_over(runs, df, ["k"], "v", levels=levels).collect()}
    want = {(r["k"], r["start"]): max(v for k, s, e, v in spans if k == r["k"] and s <= r["start"] < e) for r in runs.collect()}
    assert found == want and len(want) > 800


def test_dyadic_nodes_cover_a_span_once(spark):
    cases = [(s, e) for s in range(-9, 12) for e in range(s + 1, s + 20)]
    rows = spark.createDataFrame(cases, "s long, e long").select("s", "e", I.dyadic_nodes(F.col("s"), F.col("e")).alias("n")).collect()
    for r in rows:
        covered = sorted(p for level, node in r["n"] for p in range(node << level, (node + 1) << level))
        assert covered == list(range(r["s"], r["e"]))


@pytest.mark.parametrize("width", [7, 1 << 16])
def test_scores_of_overlapping_genes(spark, width):
    import random

    from strandflow.operators import genes as G

    rng = random.Random(width)
    bases = [(k, p, rng.randrange(4), rng.randrange(4), rng.randrange(3)) for k in (1, 2) for p in range(0, 300, 1 + k) for _ in range(rng.randrange(3))]
    genes = [(k, g, s, s + rng.choice([0, 1, 5, 60, 250])) for k in (1, 2, 3) for g, s in enumerate(rng.choices(range(-20, 320), k=40))]
    found = G.gene_wise(spark.createDataFrame(bases, "k int, pos int, ref int, pred int, sample_weight int"), spark.createDataFrame(genes, "k int, gene int, start long, end long"), ["k"], width)
    got = {(r["k"], r["gene"], r["name"]): (r["tp"], r["fp"], r["fn"]) for r in found.collect()}
    want = {}
    for k, g, s, e in genes:
        inside = [(r, p) for q, pos, r, p, w in bases if q == k and w and s <= pos < e]
        if inside:
            count = lambda keep, inside=inside: sum(keep(r, p) for r, p in inside)
            for c, name in enumerate(("ig", "utr", "exon", "intron")):
                want[k, g, name] = (count(lambda r, p, c=c: r == p == c), count(lambda r, p, c=c: r != c and p == c), count(lambda r, p, c=c: r == c and p != c))
            want[k, g, "legacy_cds"] = (count(lambda r, p: r >= 2 and p >= 2), count(lambda r, p: r < 2 <= p), count(lambda r, p: p < 2 <= r))
    assert {x: v for x, v in got.items() if x[2] not in ("sub_genic", "genic")} == want


def test_few_scores_of_genes_make_few_counts(spark):
    from strandflow.operators import genes as G

    bases = spark.range(200).selectExpr("1 AS k", "id AS pos", "id % 4 AS ref", "id % 3 AS pred", "1 AS sample_weight")
    genes = spark.range(20).selectExpr("1 AS k", "id AS gene", "id * 5 AS start", "id * 5 + 37 AS end")
    every, some = G.gene_wise(bases, genes, ["k"]), G.gene_wise(bases, genes, ["k"], only=["exon", "genic"])
    assert sorted(some.collect()) == sorted(every.where("name IN ('exon', 'genic')").collect())
    one = G.gene_wise(bases, genes, ["k"], only=["exon"])
    counts = set(re.findall(r"AS (c\d_\d)#", one._jdf.queryExecution().analyzed().toString()))
    assert counts == {"c0_0", "c0_2", "c2_0", "c2_2"} and one.count() == 20

