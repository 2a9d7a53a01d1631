"""From sequences to hints: windows of both strands, a model's predictions, their overlap-mean, regions and hints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions import scores
from strandflow.functions import sequence as S
from strandflow.operators import intervals, overlap, segment, training
from strandflow.scratch import materialise


def strand_windows(sequences: DataFrame, size: int, offset: int) -> DataFrame:
    """(seqid, length, is_plus, w_start, is_first, is_last, x): windows along both strands in reading direction.

    The end is filled with N up to a whole number of offsets, and at least to one window. Each strand is cut once, in
    linear time, and windows are put together from the pieces. An empty sequence has none.
    """
    per = size // offset
    rows = sequences.where(F.length("sequence") > 0).select("seqid", F.length("sequence").cast("long").alias("length"), F.upper("sequence").alias("__seq"))
    both = rows.withColumn("is_plus", F.explode(F.array(F.lit(True), F.lit(False))))
    strand = F.when(F.col("is_plus"), F.col("__seq")).otherwise(S.reverse_complement(F.col("__seq")))
    whole = F.greatest(F.lit(size), F.ceil(F.col("length") / offset) * offset).cast("int")
    pieces = F.regexp_extract_all(F.rpad(strand, whole, F.lit("N")), F.lit(f".{{{offset}}}"), F.lit(0))
    cut = both.select("seqid", "length", "is_plus", pieces.alias("__pieces"))
    joined = F.transform(F.sequence(F.lit(0), F.size("__pieces") - per), lambda k: F.array_join(F.slice("__pieces", k + 1, F.lit(per)), ""))
    found = cut.select("seqid", "length", "is_plus", F.size("__pieces").alias("__n"), F.posexplode(joined).alias("__k", "x"))
    return found.select("seqid", "length", "is_plus", (F.col("__k").cast("long") * offset).alias("w_start"), (F.col("__k") == 0).alias("is_first"), (F.col("__k") == F.col("__n") - per).alias("is_last"), "x")


def predicted(sequences: DataFrame, load: Callable[[], Callable], n_classes: int, size: int, offset: int | None = None, core: int | None = None) -> DataFrame:
    """(seqid, is_plus, length, pos, p): the mean prediction at each base of both strands, in reading direction.

    `load` returns a model: a function from a list of strings of `size` letters to a list of arrays that hold the
    probabilities of each base one after another. Windows are dealt out, so a long sequence is predicted by many tasks.
    """
    offset, core = overlap.check_parameters(size, offset, core)
    keys = ["seqid", "is_plus", "length"]
    dealt = strand_windows(sequences, size, offset).repartition("seqid", "is_plus", "w_start")
    flat = training.predict(dealt, load).drop("x")
    vectors = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.slice("p", i * n_classes + 1, F.lit(n_classes)))
    bases = flat.select(*keys, "w_start", "is_first", "is_last", F.posexplode(vectors).alias("off", "p"))
    return overlap.overlap_mean(bases, keys, size, core, n_classes=n_classes).where("pos < length").select(*keys, "pos", "p")


def hints_of(track: DataFrame, source: str, width: int = intervals.BIN) -> DataFrame:
    """Hints of the confident regions of a track, as predicted() gives it. Each region is of one class: neighbours in it
    agree, as the mean of every two is over three quarters. Regions are cut from rows of bases, and never gathered."""
    keys = ["seqid", "is_plus", "length"]
    track = materialise(track)  # a model runs once
    regions = segment.confident_regions(track, keys, width=width).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    bases = track.select(*keys, "pos", (F.col("pos") + 1).alias("pos_end"), scores.argmax(F.col("p")).cast("int").alias("cls"), F.array_max("p").alias("best"))
    inside = materialise(intervals.range_join(regions, bases, keys, ("r_start", "r_end"), ("pos", "pos_end"), width))
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cls"))
    cut = segment.cuts(inside, [*keys, "cls"], "best", of(segment.STEPS), of(segment.MOST), max(segment.STEPS) + max(segment.MOST), width=width)
    placed = cut.withColumn("start", F.col("start") + F.col("r_start")).withColumn("end", F.col("end") + F.col("r_start"))
    return segment.hints(placed.withColumn("chunk_start", F.when(F.col("is_plus"), 0).otherwise(F.col("length")).cast("long")), source)
