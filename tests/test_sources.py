"""Readers and writers, round trips and refusals."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from strandflow.operators import dataset as D
from strandflow.operators import meta as T
from strandflow.sources import readers as R
from strandflow.sources import writers as W


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one some text\nacgt\nNN\n>two\nGG\n\n>three\n")
    rows = {r["seqid"]: r["sequence"] for r in R.fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert rows == {"one": "ACGTNN", "two": "GG", "three": ""}
    (tmp_path / "b.fa").write_text(">one\nA\n>one\nC\n")
    with pytest.raises(Exception, match="duplicate one"):
        R.fasta(spark, str(tmp_path / "b.fa")).collect()
    W.fasta(spark.createDataFrame([("x", "ACGT" * 50)], "seqid string, sequence string"), str(tmp_path / "out"))
    assert R.fasta(spark, str(tmp_path / "out")).first()["sequence"] == "ACGT" * 50


def test_gff3(spark, tmp_path):
    (tmp_path / "a.gff").write_text("##gff-version 3\nc1\ts\tmRNA\t11\t41\t.\t-\t.\tID=t1;Parent=g1\nc1\ts\tCDS\t12\t20\t.\t+\t2\tParent=t1\n")
    rows = R.features_of(R.gff3(spark, str(tmp_path / "a.gff"))).orderBy("type").collect()
    assert [(r["type"], r["is_plus"], r["start"], r["end"], r["phase"], r["parent"]) for r in rows] == [("cds", True, 11, 20, 2, "t1"), ("transcript", False, 40, 9, None, "g1")]


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1\n@SQ\tSN:c1\tLN:500\nr1\t16\tc1\t5\t9\t3M\t*\t0\t0\tACG\tIII\nr2\t260\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    rows = R.sam(spark, str(tmp_path / "a.sam")).orderBy("qname").collect()
    assert (rows[0]["pos"], rows[0]["is_plus"], rows[0]["cigar"], rows[0]["unmapped"]) == (4, False, "3M", False)
    assert rows[1]["unmapped"] and rows[1]["secondary"]
    assert R.sam_lengths(spark, str(tmp_path / "a.sam")).first()["length"] == 500


def test_annotation_db(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE feature (id INTEGER PRIMARY KEY, name TEXT, plus BOOLEAN, score FLOAT)")
        con.executemany("INSERT INTO feature VALUES (?, ?, ?, ?)", [(i, f"f{i}", i % 2, i / 2) for i in range(50)])
    rows = R.annotation_table(spark, path, "feature").orderBy("id").collect()
    assert len(rows) == 50 and rows[3].asDict() == {"id": 3, "name": "f3", "plus": True, "score": 1.5}


def test_registry_and_mers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("# a comment\nlineage,priority,model,available_since\nplant,2,b,2022/11/28\nplant,1,a,2021/01/02\n")
    known = R.registry(spark, str(tmp_path / "m.csv"))
    assert known.orderBy("priority").first()["available_since"].isoformat() == "2021-01-02"
    assert [r["model"] for r in T.by_priority(known, ["lineage"], 1, ["priority"]).collect()] == ["a"]
    now = {r["model"]: (r["recognized"], r["better_exists"]) for r in T.current_models(known, spark.createDataFrame([("b",), ("z",)], "model string")).collect()}
    assert now == {"b": (True, True), "z": (False, False)}
    (tmp_path / "k.tsv").write_text("seqid\tmer\tcount\trest\nc\tAAC\t2\tx\nc\tGTT\t3\tx\n")
    assert [tuple(r) for r in D.canonical_mers(R.mer_counts(spark, str(tmp_path / "k.tsv")), ["seqid"]).collect()] == [("c", "AAC", 5)]


def test_chunks_of_one_size(spark, tmp_path):
    for name, n in (("a", 3), ("b", 3), ("c", 4)):
        spark.createDataFrame([("s", [1.0] * n)], "species string, x array<double>").write.parquet(str(tmp_path / name))
    assert R.chunk_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).count() == 2
    with pytest.raises(ValueError):
        R.chunk_files(spark, [str(tmp_path / "a"), str(tmp_path / "c")])


def test_appended_chunks_and_hints(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "species string, i int")
    W.append_chunks(df, str(tmp_path / "d"))
    W.append_chunks(df, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).where("species = 's1'").count() == 2
    hints = spark.createDataFrame([("b", "x", 9), ("a", "x", 5), ("a", "x", 1)], "seqid string, source string, start int")
    W.hint_files(hints, str(tmp_path / "h"), 1)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "h")).collect()] == ["a\tx\t1", "a\tx\t5", "b\tx\t9"]
    W.run_metadata(spark, str(tmp_path / "m"), {"commit": "c"})
    assert spark.read.parquet(str(tmp_path / "m")).first()["attributes"] == {"commit": "c"}
    W.matrices(spark.createDataFrame([("all", "cm", 1)], "filter string, kind string, n int"), str(tmp_path / "t"), ["filter", "kind"])
    assert spark.read.csv(str(tmp_path / "t"), header=True).first()["filter"] == "all"


def test_reports(spark, tmp_path):
    (tmp_path / "sp" / "method").mkdir(parents=True)
    (tmp_path / "sp" / "method" / "stats").write_text("# x\n        Base level:    77.0     |    80.0    |\n   Exon level: 50.0 | 50.0 |\n")
    rows = R.reports(spark, str(tmp_path / "*" / "*" / "stats"))
    assert (rows.first()["species"], rows.first()["method"]) == ("sp", "method")
    levels = T.level_statistics(T.numbered_lines(rows, ["species"], "text"), ["species"]).orderBy("level").collect()
    assert [(r["level"], r["sensitivity"], round(r["f1"], 4)) for r in levels] == [("base", 77.0, 78.4713), ("exon", 50.0, 50.0)]
    busco = spark.createDataFrame([("a", "  40 Complete\n 10 Missing\n 50 Total groups\n")], "k string, t string")
    assert [r["fraction"] for r in T.busco_counts(T.numbered_lines(busco, ["k"], "t"), ["k"]).orderBy("line_no").collect()] == [0.8, 0.2, 1.0]


def test_refusals(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="duplicate 1"):
        D.require_unique(df, ["k"]).collect()
    with pytest.raises(Exception, match="genomes: 2"):
        D.require_one(df, "genomes").collect()
    with pytest.raises(ValueError):
        D.keep_only(df)
    with pytest.raises(ValueError):
        D.ensemble([df], ["k"])


def test_sample_is_the_same_from_any_partitioning(spark):
    df = spark.range(1000)
    one, two = (sorted(r["id"] for r in D.sample(df.repartition(n), ["id"], 20, "s").collect()) for n in (1, 9))
    assert one == two and len(one) == 20


def test_table_names_are_made_unique(spark):
    df = spark.createDataFrame([("f", 0, "a"), ("f", 1, "a"), ("f", 2, "b")], "file string, table_no int, name string")
    assert [r["name"] for r in T.unique_names(df, ["file"], "name").orderBy("table_no").collect()] == ["a", "a_", "b"]
    assert df.select(T.stem(F.lit("/x/y.tar.gz")).alias("s")).first()["s"] == "y"
