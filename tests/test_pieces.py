"""Sequences in pieces give what whole sequences give."""

import random
from collections import Counter

import pytest

from strandflow.operators import pieces as P
from strandflow.sources import readers as R


@pytest.fixture
def records():
    rng = random.Random(6)
    return {name: "".join(rng.choice("ACGTN") for _ in range(n)) for name, n in (("one", 3000), ("two", 7), ("three", 0), ("four", 1024), ("five", 999))}


@pytest.mark.parametrize("block", [150, 700, 1 << 20])
def test_fasta_in_pieces(spark, tmp_path, records, block):
    text = ""
    for i, (name, seq) in enumerate(records.items()):
        lines = [seq[k : k + 61].lower() for k in range(0, len(seq), 61)]
        text += f">{name} of test\n" + ("\r\n" if i % 2 else "\n").join([*lines, ""]) + ("\n" if i == 1 else "")
    (tmp_path / "a.fa").write_bytes(text.encode())
    (tmp_path / "b.fa").write_text(">other\n" + "AC\n" * 400)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        rows = R.fasta_pieces(spark, str(tmp_path), 256).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(n, k): (k * 256, s[k * 256 : (k + 1) * 256]) for n, s in {**records, "other": "AC" * 400}.items() for k in range(-(-len(s) // 256))}
    assert {(r["seqid"], r["piece"]): (r["offset"], r["bases"]) for r in rows} == want and len(rows) == len(want)


def test_edges_windows_and_lengths(spark, records):
    whole = spark.createDataFrame(list(records.items()), "seqid string, sequence string")
    cut = P.cut(whole, ["seqid"], 64)
    assert {r["seqid"]: r["length"] for r in P.lengths(cut, ["seqid"]).collect()} == {n: len(s) for n, s in records.items() if s}
    mers = Counter((r["seqid"], r["bases"][k : k + 5]) for r in P.with_edges(cut, ["seqid"], 4).collect() for k in range(len(r["bases"]) - 4))
    assert mers == Counter((n, s[k : k + 5]) for n, s in records.items() for k in range(len(s) - 4))
    found = {(r["seqid"], r["start"]): r["bases"] for r in P.windows(cut, ["seqid"], 50, 30).collect()}
    assert found == {(n, k): s[k : k + 50] for n, s in records.items() for k in range(0, len(s) - 49, 30)}
    again = P.joined(cut.drop("piece").repartition(5), ["seqid"], 100)
    assert {(r["seqid"], r["offset"]): r["bases"] for r in again.collect()} == {(n, k): s[k : k + 100] for n, s in records.items() for k in range(0, len(s), 100)}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_mers_and_their_sequences(spark, records, block):
    from strandflow.operators.dataset import mers_and_holders

    rows = [*records.items(), ("one", "ACGTACGTT"), ("six", "ACGTT" * 50), (None, "ACGTTACGTT"), (None, "GGGGG" * 40)]
    cut = P.cut_with_edges(spark.createDataFrame(rows, "seqid string, sequence string"), ["seqid"], 64, 4)
    n = Counter(s[k : k + 5] for _, s in rows for k in range(len(s) - 4))
    of = {mer: {name for name, s in rows if name and mer in s} for mer in n}
    found = mers_and_holders(cut, ["seqid"], 5, block).collect()
    assert {r["mer"]: (r["n"], r["n_sequences"]) for r in found} == {mer: (n[mer], len(of[mer])) for mer in n} and len(found) == len(n)

