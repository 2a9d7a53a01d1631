"""BAM files written here by the format's description, with an index, against the same alignments as text."""

import random
import struct
import zlib

import pytest

from strandflow.operators import coverage as V
from strandflow.sources import bam as B
from strandflow.sources import readers as R

LENGTHS = [("c1", 200_000), ("c2", 50_000), ("c:3", 10)]


def block(data: bytes) -> bytes:
    deflate = zlib.compressobj(wbits=-15)
    body = deflate.compress(data) + deflate.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def alignments() -> list[tuple]:
    rng = random.Random(4)
    out = []
    for ref, n in ((0, 300), (1, 120)):
        for pos in sorted(rng.randrange(LENGTHS[ref][1] - 3000) for _ in range(n)):
            ops = [(rng.randint(1, 50), "M"), (rng.randint(1, 2000), rng.choice("NDI")), (rng.randint(1, 50), "="), (3, "S")]
            out.append((f"r{len(out)}", ref, pos, rng.choice([0, 16, 1, 129, 256, 512]), ops))
    out.append(("many", 1, 49_000, 0, [(1, "M"), (1, "D")] * 40_000))
    return [*out, ("lost", -1, -1, 4, [])]


def record(name: str, ref: int, pos: int, flag: int, ops: list) -> bytes:
    written, tags = [n << 4 | B.OPS.index(op) for n, op in ops], b"NMC\x05XZZtext\0"
    if len(written) > 65535:
        tags += struct.pack(f"<2scci{len(written)}I", b"CG", b"B", b"I", len(written), *written)
        written = [4 << 4 | 4, 80_000 << 4 | 3]
    data = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 9, 0, len(written), flag, 4, -1, -1, 0) + name.encode() + b"\0"
    data += struct.pack(f"<{len(written)}I", *written) + b"\x12\x48" + b"\xff" * 4 + tags
    return struct.pack("<i", len(data)) + data


def csi(virtual: list[int], shift: int = 12, depth: int = 3) -> bytes:
    """The index with bins of its own width, deflated: each bin has the offset of the first record over it."""
    data = b"CSI\1" + struct.pack("<3i", shift, depth, 4) + b"aux!" + struct.pack("<i", len(LENGTHS))
    for ref in range(len(LENGTHS)):
        bins, first = {}, {}
        for i, (_, r, pos, _, ops) in enumerate(alignments()):
            if r != ref:
                continue
            end = pos + sum(n for n, op in ops if op in "MDN=X")
            level = next(x for x in range(depth, -1, -1) if pos >> shift + 3 * (depth - x) == end - 1 >> shift + 3 * (depth - x))
            number = lambda x, at: ((1 << 3 * x) - 1) // 7 + (at >> shift + 3 * (depth - x))
            bins.setdefault(number(level, pos), []).append((virtual[i], virtual[i + 1]))
            for x in range(depth + 1):
                for at in range(pos >> shift + 3 * (depth - x), (end - 1 >> shift + 3 * (depth - x)) + 1):
                    first.setdefault(((1 << 3 * x) - 1) // 7 + at, virtual[i])
        data += struct.pack("<i", len(bins) + 1)
        for number_, chunks in bins.items():
            data += struct.pack("<IQi", number_, first[number_], len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        data += struct.pack("<IQi4Q", ((1 << 3 * (depth + 1)) - 1) // 7 + 1, 0, 2, 1, 2, 3, 4)
    return b"".join(block(data[k : k + 500]) for k in range(0, len(data), 500)) + block(b"")


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A file whose records cross the borders of blocks, its index, and the alignments as text."""
    folder = tmp_path_factory.mktemp("bam")
    head = b"BAM\1" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", len(LENGTHS))
    for name, n in LENGTHS:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    data, begins = head, []
    for a in alignments():
        begins.append(len(data))
        data += record(*a)
    begins.append(len(data))
    size, out, where = 700, b"", []
    for k in range(0, len(data), size):
        where.append(len(out))
        out += block(data[k : k + size])
    where.append(len(out))
    out += block(b"")
    (folder / "a.bam").write_bytes(out)
    virtual = [where[b // size] << 16 | b % size for b in begins]
    index = b"BAI\1" + struct.pack("<i", len(LENGTHS))
    for ref in range(len(LENGTHS)):
        own = [i for i, a in enumerate(alignments()) if a[1] == ref]
        chunks = [(virtual[g[0]], virtual[g[-1] + 1]) for g in (own[k : k + 10] for k in range(0, len(own), 10))]
        index += struct.pack("<i", 2 if own else 0)
        if own:
            index += struct.pack("<Ii", 4681, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
            index += struct.pack("<Ii4Q", B.NO_CHUNKS, 2, 1, 2, 3, 4)
        first = {}
        for i in own:
            pos, end = alignments()[i][2], alignments()[i][2] + sum(n for n, op in alignments()[i][4] if op in "MDN=X")
            for w in range(pos >> 14, (end - 1 >> 14) + 1):
                first.setdefault(w, virtual[i])
        index += struct.pack("<i", max(first) + 1 if first else 0) + b"".join(struct.pack("<Q", first.get(w, 0)) for w in range(max(first, default=-1) + 1))
    (folder / "a.bam.bai").write_bytes(index)
    (folder / "bare.bam").write_bytes(out)
    (folder / "long.bam").write_bytes(out)
    (folder / "long.bam.csi").write_bytes(csi(virtual))
    names = [n for n, _ in LENGTHS] + ["*"]
    text = ["\t".join([q, str(f), names[ref], str(pos + 1), "9", "".join(f"{n}{op}" for n, op in ops) or "*", "*", "0", "0", "AC", "II"]) for q, ref, pos, f, ops in alignments()]
    (folder / "a.sam").write_text("\n".join(text) + "\n")
    return folder


def rows(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["a.bam", "bare.bam", "long.bam"])
def test_equals_the_text(spark, files, name):
    df = B.bam(spark, str(files / name), split=2000)
    assert df.rdd.getNumPartitions() > 3
    assert rows(df) == rows(R.sam(spark, str(files / "a.sam")))
    assert [tuple(r) for r in B.bam_lengths(spark, str(files / name)).collect()] == LENGTHS


@pytest.mark.parametrize("name", ["a.bam", "bare.bam", "long.bam"])
@pytest.mark.parametrize("region", ["c1", "c1:1-1", "c1:60000-61000", "c1:199999-200000", "c2:20,001-40,000", "c2:49500", "c:3"])
def test_regions(spark, files, name, region):
    ref, low, high = B.region_of(region, [n for n, _ in LENGTHS])
    expected = {q for q, r, pos, _, ops in alignments() if r == ref and pos < high and pos + sum(n for n, op in ops if op in "MDN=X") > low}
    assert {r["qname"] for r in B.bam(spark, str(files / name), region, split=2000).collect()} == expected


def test_depth_of_a_region(spark, files):
    reads = V.usable(B.bam(spark, str(files / "a.bam"), "c2"))
    total = V.totals(V.blocks(reads), ["seqid"]).first()
    used = [ops for _, ref, _, f, ops in alignments() if ref == 1 and not f & 0x304]
    assert total["covered"] == sum(n for ops in used for n, op in ops if op in "=XM")
    assert total["spliced"] == sum(n for ops in used for n, op in ops if op in "ND")


def test_refusals(spark, files, tmp_path):
    with pytest.raises(Exception, match="no file"):
        B.bam(spark, str(tmp_path / "none.bam")).collect()
    with pytest.raises(Exception, match="0 sequences are named c9"):
        B.bam(spark, str(files / "a.bam"), "c9").collect()
    (tmp_path / "cut.bam").write_bytes((files / "a.bam").read_bytes()[:3000])
    with pytest.raises(Exception, match="ends within|deflated|incomplete|Error"):
        B.bam(spark, str(tmp_path / "cut.bam")).collect()


@pytest.mark.parametrize("split", [1, 37, 500, 701, 5000, 1 << 20])
def test_any_split_without_an_index_gives_each_record_once(files, split):
    reader = B._BamReader({"path": str(files / "bare.bam"), "split": str(split)})
    names = [r[0].as_py() for p in reader.partitions() for batch in reader.read(p) for r in zip(batch.column(0), strict=True)]
    assert names == [a[0] for a in alignments()]


def test_a_guess_is_a_record_of_the_index(files):
    sequences, first = B.header(str(files / "bare.bam"))
    guess = B.Guess(str(files / "bare.bam"), [n for _, n in sequences])
    known = sorted({s for of in B.Index(str(files / "long.bam.csi")).starts for s in of} | {first})
    size = (files / "bare.bam").stat().st_size
    for offset in range(0, size, 97):
        found = guess.record(offset, size)
        assert found is None or found in known or found >= known[-1]
    assert guess.record(size - 5, 1 << 62) is None


def test_conditions_narrow_what_is_read(files):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

    for name in ("a.bam", "long.bam", "bare.bam"):
        whole = B._BamReader({"path": str(files / name), "split": "2000"})
        some = B._NarrowedBamReader({"path": str(files / name), "split": "2000"})
        filters = [EqualTo(("seqid",), "c2"), GreaterThanOrEqual(("pos",), 20_000), LessThan(("pos",), 30_000), StringContains(("qname",), "r")]
        assert list(some.pushFilters(filters)) == filters
        found = [q.as_py() for p in some.partitions() for batch in some.read(p) for q in batch.column(0)]
        assert found == [q for q, ref, pos, *_ in alignments() if ref == 1 and 20_000 <= pos < 30_000]
        assert name == "bare.bam" or len(some.partitions()) < len(whole.partitions())
        both = B._NarrowedBamReader({"path": str(files / name), "split": "2000"})
        list(both.pushFilters([In(("seqid",), ("c2", "*"))]))
        assert {q.as_py() for p in both.partitions() for batch in both.read(p) for q in batch.column(0)} == {q for q, ref, *_ in alignments() if ref in (1, -1)}


def test_pushed_filters_in_a_query(spark, files):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = B.bam(spark, str(files / "long.bam"), split=2000).where("seqid = 'c1' and pos >= 150000")
        assert {r["qname"] for r in found.collect()} == {q for q, ref, pos, *_ in alignments() if ref == 0 and pos >= 150_000}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
