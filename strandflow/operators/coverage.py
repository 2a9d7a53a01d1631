"""Coverage from read alignments."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.operators import intervals

COVERED, SPLICED = "=XM", "ND"
KINDS = dict.fromkeys(COVERED, "covered") | dict.fromkeys(SPLICED, "spliced")
OPERATION = re.compile("([0-9]+)([MIDNSHP=X])")
#: Shifts of cut sites by strand.
TN5_PLUS, TN5_MINUS = 4, 5


def usable(df: DataFrame) -> DataFrame:
    """Reads that are mapped, primary and passed quality control."""
    return df.where(~(F.col("unmapped") | F.col("secondary") | F.col("qcfail")))


def blocks(alignments: DataFrame, cigar: str = "cigar", pos: str = "pos") -> DataFrame:
    """Each alignment's blocks on the reference: kind (covered or spliced), p_start, p_end. Other operations make none.
    The CIGAR itself goes, the other columns stay.

    Positions are sums of the lengths before them, in time linear in the operations: long reads have 100,000 of them.
    """
    kept = [c for c in alignments.columns if c != cigar]
    rows = alignments.select(*kept, F.col(cigar).alias("__cigar"), F.col(pos).cast("long").alias("__pos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, kinds, starts, ends = [], [], [], []
            for i, (text, at) in enumerate(zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), strict=True)):
                if at is None:
                    continue
                for n, op in OPERATION.findall(text or ""):
                    kind, size = KINDS.get(op), int(n)
                    if kind and size:
                        row.append(i)
                        kinds.append(kind)
                        starts.append(at)
                        at += size
                        ends.append(at)
            own = batch.select(list(range(len(kept)))).take(pa.array(row, pa.int64()))
            made = [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays([*own.columns, *made], names=[*kept, "kind", "p_start", "p_end"])

    fields = [T.StructField("kind", T.StringType()), T.StructField("p_start", T.LongType()), T.StructField("p_end", T.LongType())]
    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], *fields]))


def sense_is_plus(is_plus: Column, second_in_pair: Column, stranded: bool = True, sense: int = 2) -> Column:
    """Strand of the transcript: turned unless the read is second in its pair, the other way if sense is 1."""
    if not stranded:
        return is_plus
    turned = F.when(second_in_pair, is_plus).otherwise(~is_plus)
    return ~turned if sense == 1 else turned


def tn5_shift(df: DataFrame, length: Column, start: str = "p_start", end: str = "p_end", is_plus: str = "is_plus") -> DataFrame:
    """Intervals moved to the cut sites, within [0, length)."""
    moved = df.withColumn(start, F.when(F.col(is_plus), F.col(start) + TN5_PLUS).otherwise(F.col(start)))
    moved = moved.withColumn(end, F.when(F.col(is_plus), F.col(end)).otherwise(F.col(end) - TN5_MINUS))
    return moved.withColumn(start, F.greatest(F.lit(0), F.col(start))).withColumn(end, F.least(length, F.col(end))).where(F.col(start) < F.col(end))


def pileup(found: DataFrame, keys: Sequence[str], width: int = intervals.BIN) -> DataFrame:
    """(keys, kind, start, end, depth) of blocks."""
    return intervals.depth(found, [*keys, "kind"], width=width)


def totals(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of blocks, covered and spliced bases."""
    size = F.col("p_end") - F.col("p_start")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, size).otherwise(0)).cast("long").alias(kind)
    return found.groupBy(*keys).agg(F.count("*").alias("reads"), of("covered"), of("spliced"))


def to_chunks(runs: DataFrame, chunks: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Depth by chunk: (keys, chunk_idx, offsets with depth). Offsets count in reading direction; others are zero."""
    c = chunks.select(*keys, "chunk_idx", F.least("start", "end").alias("c_start"), F.greatest("start", "end").alias("c_end"), (F.col("start") < F.col("end")).alias("c_plus"))
    both = intervals.range_join(runs.withColumnsRenamed({"start": "r_start", "end": "r_end"}), c, keys, ("r_start", "r_end"), ("c_start", "c_end"), size)
    cut = both.withColumn("p_start", F.greatest("r_start", "c_start")).withColumn("p_end", F.least("r_end", "c_end"))
    off = F.when(F.col("c_plus"), F.col("p_start") - F.col("c_start")).otherwise(F.col("c_end") - F.col("p_end"))
    return cut.select(*keys, "chunk_idx", off.alias("off"), (F.col("p_end") - F.col("p_start")).alias("n"), "depth")
