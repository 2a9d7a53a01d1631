"""Reports, logs, split search and orders of epochs, by hand and against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandflow.operators import chunks as C
from strandflow.operators import dataset as D
from strandflow.operators import meta as T
from strandflow.sources import readers as R
from strandflow.sources import writers as W


def lines(spark, *texts):
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "k string, t string")
    return T.numbered_lines(df, ["k"], "t")


def values(df):
    return {(r["k"], r["name"]): r["value"] for r in df.collect()}


def test_assembly_and_completeness(spark):
    quast = lines(spark, "Assembly\tx\n# contigs (>= 0 bp)\t7\n# contigs (>= 1000 bp)\t5\nTotal length (>= 50000 bp)\t90\nGC (%)\t41.5\nN50\t12\nother\t3\n")
    assert values(T.quast_values(quast, ["k"])) == {("k0", "contigs"): "7", ("k0", "contigs_gt_1k"): "5", ("k0", "total_len_gt_50k"): "90", ("k0", "gc_content"): "41.5", ("k0", "N50"): "12"}
    assert len(T.QUAST) == 18
    busco = lines(spark, "# text\n\tC:80.0%[S:70.0%,D:10.0%],F:5.0%,M:15.0%,n:40\n\t32\tComplete BUSCOs (C)\n\t6\tMissing BUSCOs (M)\n\t40\tTotal BUSCO groups searched\n", "\t3\tFragmented BUSCOs (F)\n")
    assert values(T.busco_values(busco, ["k"], "geno")) == {("k0", "busco_C_geno"): "32", ("k0", "busco_M_geno"): "6", ("k1", "busco_F_geno"): "3"}
    assert values(T.busco_values(busco, ["k"], "prot", scale=True)) == {("k0", "busco_C_prot"): "0.8000", ("k0", "busco_M_prot"): "0.1500", ("k1", "busco_F_prot"): None}


def test_counts_of_types_and_mers(spark):
    found = values(T.gff_type_counts(lines(spark, "12 CDS\n 3 gene\n9 region\n", ""), ["k"]))
    assert found[("k0", "CDS")] == "12" and found[("k0", "gene")] == "3" and found[("k0", "exon")] == "0"
    assert len(found) == 12 and {v for (k, _), v in found.items() if k == "k1"} == {"0"}
    mers = lines(spark, "50\tA\n7\tC\n")
    assert values(T.mer_values(mers, ["k"])) == {("k0", "A"): "50", ("k0", "C"): "7"}
    total = spark.createDataFrame([("k0", "200")], "k string, total_len string")
    assert values(T.mer_values(mers, ["k"], total)) == {("k0", "A"): "0.2500", ("k0", "C"): "0.0350"}


LOG = """start
| | ig | utr |
| ig | 5 | 1 |

+---+
x PRINT | | Precision | Recall | F1-Score |
| ig | 0.5 | 0.6 | 0.55 |
+---+
| genic | 0.7 | 0.8 | 0.75 |
+---+
Total acc: 0.9100
"""


def test_logs(spark):
    log = lines(spark, LOG, "nothing")
    assert [tuple(r) for r in T.logged_scores(log, ["k"]).orderBy("row_no").collect()] == [("k0", 1, 1, "ig", 0.55), ("k0", 1, 2, "genic", 0.75)]
    assert [tuple(r) for r in T.logged_accuracies(log, ["k"]).collect()] == [("k0", 0, 0.91)]
    many = lines(spark, "".join(f"| genic | 1 | 1 | 0.{i} |\n+--+\nTotal acc: 0.{i + 1}\n" for i in range(1, 8)))
    assert [tuple(r) for r in T.position_scores(many, ["k"]).orderBy("nth").collect()] == [("k0", i - 1, i / 10, (i + 1) / 10) for i in range(1, 8)]


def plain_splits(features, length, write_by, size, shift):
    """Ends of pieces by a walk over all places."""
    step, taken = write_by // size * size, set()
    for plus, start, end, kind in features:
        low, high = (start, end) if plus else (end + shift, start + shift)
        taken |= {x for x in (low, high) if x % size == 0}
        if kind == "cds":
            taken |= {x for x in range(math.ceil(low / size) * size, math.ceil(high / size) * size, size)}
    ends = []
    for i in range(step, length, step):
        ends += [x for x in range(i, min(i + step, length), size) if x not in taken][:1]
    return [*ends, length]


@pytest.mark.parametrize("as_before", [False, True])
def test_splits_avoid_features(spark, as_before):
    rng, features, wanted = random.Random(7), [], {}
    for seqid in range(12):
        own = []
        for _ in range(rng.randrange(25)):
            low = rng.randrange(60) * 10
            high = low + rng.choice([10, 20, 55, 130])
            plus = rng.random() < 0.5
            own.append((plus, *((low, high) if plus else (high - 1, low - 1)), rng.choice(["cds", "transcript"])))
        length = rng.choice([0, 1, 70, 640, 700, 705])
        wanted[seqid] = (length, plain_splits(own, length, 79, 10, -1 if as_before else 1) if length else [])
        features += [(seqid, *f) for f in own]
    coords = spark.createDataFrame([(s, n) for s, (n, _) in wanted.items()], "seqid bigint, length bigint")
    pieces = C.safe_splits(coords, spark.createDataFrame(features, "seqid bigint, is_plus boolean, start bigint, end bigint, type string"), ["seqid"], 79, 10, as_before=as_before)
    found = {s: [] for s in wanted}
    for r in pieces.orderBy("seqid", "start").collect():
        assert r["start"] == (found[r["seqid"]][-1] if found[r["seqid"]] else 0)
        found[r["seqid"]].append(r["end"])
    assert found == {s: ends for s, (_, ends) in wanted.items()}
    with pytest.raises(ValueError):
        C.safe_splits(coords, coords, ["seqid"], 5, 10)


def test_order_of_an_epoch(spark):
    df = spark.range(500).withColumn("twice", F.col("id") * 2)
    orders = [[tuple(r) for r in D.epoch_order(df.repartition(n), ["id"], 3, epoch).collect()] for n, epoch in ((2, 0), (7, 0), (2, 1))]
    assert orders[0] == orders[1] != orders[2] and orders[0] != sorted(orders[0])
    assert sorted(orders[2]) == [(i, 2 * i) for i in range(500)]


def test_training_files_and_predictions(spark, tmp_path):
    row = lambda s: spark.createDataFrame([(s, [0.25, 0.75])], "species string, x array<double>")
    for name in ("training_data.a", "training_data.b"):
        row(name).write.parquet(str(tmp_path / name))
    with pytest.raises(ValueError, match="no validation data"):
        R.chunk_sets(spark, str(tmp_path))
    row("v").write.parquet(str(tmp_path / "validation_data.a"))
    train, val = R.chunk_sets(spark, str(tmp_path))
    assert (train.count(), val.count()) == (2, 1)
    W.predictions(row("s").withColumnRenamed("x", "p"), str(tmp_path / "p"))
    W.predictions(row("s").withColumnRenamed("x", "p"), str(tmp_path / "p"))
    saved = spark.read.parquet(str(tmp_path / "p"))
    assert saved.count() == 2 and saved.schema["p"].dataType.elementType.simpleString() == "float"
