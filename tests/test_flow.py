"""A FASTA file to a file of hints, with a model that knows one class for each letter, against runs found by a loop."""

from itertools import groupby

import pytest

from strandflow.operators import flow
from strandflow.operators.segment import HINTS
from strandflow.sources import readers as R
from strandflow.sources import writers as W

SEQUENCES = {"one": "A" * 300 + "C" * 40 + "G" * 35 + "T" * 200 + "C" * 50 + "A" * 101, "short": "G" * 30, "tiny": "AC", "plain": "T" * 128}


def load():
    """Classes A, C, G, T; N is anything."""
    sure = {b: [0.97 if k == i else 0.01 for k in range(4)] for i, b in enumerate("ACGT")} | {"N": [0.25] * 4}
    return lambda batch: [[v for b in seq for v in sure[b]] for seq in batch]


def expected(width: int) -> set[tuple]:
    """The last base of a run is not certain unless the sequence ends there; five bases go at both ends."""
    out = set()
    for name, plus in SEQUENCES.items():
        n = len(plus)
        for strand, seq in (("+", plus), ("-", plus[::-1].translate(str.maketrans("ACGT", "TGCA")))):
            at = 0
            for base, run in groupby(seq):
                end = at + len(list(run))
                s, e = at + 5, (end if end == n else end - 1) - 5
                pieces = [(a, min(a + width, e)) for a in range(s, e, width)] if base in "CGT" else [(s, e)]
                for a, b in pieces if s < e else []:
                    span = (a + 1, b) if strand == "+" else (n - b + 1, n - a)
                    out.add((name, HINTS["ACGT".index(base)], *span, strand))
                at = end
    return out


@pytest.mark.parametrize("width", [64, 10_000])
def test_fasta_to_hints(spark, tmp_path, width):
    (tmp_path / "in.fa").write_text("".join(f">{k} text\n{v.lower()}\n" for k, v in SEQUENCES.items()) + ">empty\n")
    track = flow.predicted(R.fasta(spark, str(tmp_path / "in.fa")), load, 4, 64)
    W.hint_files(flow.hints_of(track, "test", width), str(tmp_path / "hints"), 2)
    cells = [r["value"].split("\t") for r in spark.read.text(str(tmp_path / "hints")).collect()]
    assert {(c[0], c[2], int(c[3]), int(c[4]), c[6]) for c in cells} == expected(10_000)
    assert {round(float(c[5]), 9) for c in cells} == {0.97} and {c[1] for c in cells} == {"test"}


def test_windows_cover_every_base_of_both_strands(spark):
    df = spark.createDataFrame(list(SEQUENCES.items()), "seqid string, sequence string")
    rows = flow.strand_windows(df, 64, 32).collect()
    for name, seq in SEQUENCES.items():
        for plus in (True, False):
            own = sorted((r["w_start"], r["x"], r["is_first"], r["is_last"]) for r in rows if r["seqid"] == name and r["is_plus"] == plus)
            strand = seq if plus else seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
            filled = strand.ljust(max(64, -(-len(seq) // 32) * 32), "N")
            assert [(s, x) for s, x, *_ in own] == [(s, filled[s : s + 64]) for s in range(0, len(filled) - 63, 32)]
            assert own[0][2] and own[-1][3] and sum(o[2] for o in own) == sum(o[3] for o in own) == 1
