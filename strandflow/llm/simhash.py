"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint is embedded as the vector of its segments' bit counts. Manhattan distance between two such vectors never
exceeds the Hamming distance of the fingerprints, so pairs within it are a superset of the links. The range join under
that distance uses a grid: with distance k, the segments are dealt into k + 3 blocks, and vectors within Manhattan
distance k agree on all of at least three blocks. Each choice of three blocks is a projection of the grid, and pairs
that share a cell of one are checked for Manhattan distance and then, exactly, for Hamming distance.

Skew: fingerprints are made distinct first, so copies cost nothing. Cells are counted; a cell with over CELL members
(a dense ball of near copies) is not paired. Its members are linked in an exact, linear way instead: fingerprints that
differ in at most two bits are neighbours of a common value at distance one or less, and each value links its (at most
65) neighbours to the least of them. That way holds for k = 2, the one
distance that is offered.

Defined results: a text without words has fingerprint zero and is linked like any other; null ids get their group's least
id, or null if it has none; repeated rows share a class; an empty table gives an empty table; only id and text are used,
so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm.common import bounded_batches, join_by_hot_key, materialise, tagged, with_pairs
from strandflow.llm.components import components

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Members of a grid cell that are still paired.
CELL = 64
#: Shingles whose bits are laid out at once.
SLICE = 100_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text, signed."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        line = b" ".join(words)
        starts = [0, *ends[:-shingle].tolist()]
        hashes = [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """64 bits, signed, of which each is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    most = 2 * ones > len(hashes)
    return int(np.packbits(most, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text), text not null, to (doc_id, tag, fingerprint); tag is a hash of the text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "tag", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tag"), "text").mapInArrow(run, "doc_id long, tag long, fingerprint long")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


_PAIRS = 0x5555555555555555


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, packed into the segments' own places."""
    low, high = fp.bitwiseAND(F.lit(_PAIRS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_PAIRS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    at = lambda v, k: F.shiftrightunsigned(v, 2 * k).bitwiseAND(F.lit(3))
    return reduce(lambda x, y: x + y, [F.abs(at(a, k) - at(b, k)) for k in range(32)])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def projections(distance: int) -> list[int]:
    """Masks of the segments that a projection keeps: three of distance + 3 blocks."""
    blocks = distance + 3
    masks = [sum(3 << (2 * k) for k in range(32) if k * blocks // 32 == b) for b in range(blocks)]
    return [_signed(sum(masks[b] for b in chosen)) for chosen in combinations(range(blocks), 3)]


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fingerprint), distinct, to pairs (a, b) that connect just what Hamming links connect."""
    if distance != 2:
        raise ValueError("dense cells are linked exactly for a distance of 2 only")
    fp = F.col("fingerprint")
    cells = distinct.select(fp, F.explode(F.array(*[F.struct(F.lit(i).alias("p"), embedding(fp).bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(projections(distance))])).alias("c"))
    cells = cells.select(fp, "c.p", "c.cell")
    counts = cells.groupBy("p", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(cells.join(counts, ["p", "cell"]))
    some = shared.where(F.col("n") <= CELL)
    other = some.select("p", "cell", F.col("fingerprint").alias("other"))
    near = some.join(other, ["p", "cell"]).where("fingerprint < other")
    near = near.where((manhattan(embedding(fp), embedding(F.col("other"))) <= distance) & (F.bit_count(fp.bitwiseXOR(F.col("other"))) <= distance))
    dense = shared.where(F.col("n") > CELL).select("fingerprint").distinct()
    values = dense.select(fp, F.explode(F.concat(F.array(fp), F.array(*[fp.bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)]))).alias("value"))
    least = values.withColumn("other", F.min("fingerprint").over(Window.partitionBy("value"))).where("fingerprint <> other")
    return near.select(fp.alias("a"), F.col("other").alias("b")).unionByName(least.select(fp.alias("a"), F.col("other").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text), text not null, to (doc_id, tag, fingerprint, component_id, component).

    tag is a hash of the text, component a number that all documents of a component have.
    """
    found = materialise(fingerprints(docs, shingle))
    classes = materialise(found.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = materialise(components(links(classes.select("fingerprint"), distance)))
    rooted = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint")
    groups = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    linked = join_by_hot_key(rooted, groups, "root", "members").select("fingerprint", "root", "component_id")
    lookup = classes.join(linked, "fingerprint", "left").select("fingerprint", "n", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fingerprint").alias("component"))
    lookup = materialise(lookup)
    return join_by_hot_key(found, lookup, "fingerprint", "n").select("doc_id", "tag", "fingerprint", "component_id", "component")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """docs, in the same columns, with the document of the least id of each component (null ids last)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = near_duplicates(docs.select("doc_id", text.alias("text")), shingle, distance)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first"))
    first = materialise(first.select("first.doc_id", "first.tag"))
    return with_pairs(tagged(docs, text), first, "left_semi").dropDuplicates(["doc_id", "__tag"]).drop("__tag")
