"""Segmentation of probability tracks into regions and hints."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.operators import chains, intervals, scans
from strandflow.scratch import materialise

CONFIDENT = 0.75001
PAD = 5
#: Names of hints by class, and their step and greatest size.
HINTS = ("irpart", "UTRpart", "CDSpart", "intronpart")
STEPS = (100, 10, 10, 10)
MOST = (10000, 500, 500, 500)


def confident_regions(track: DataFrame, keys: Sequence[str], pad: int = PAD, least: float = CONFIDENT, p: str = "p", pos: str = "pos", width: int = intervals.BIN) -> DataFrame:
    """(keys, start, end): stretches in which one class is certain, of more than 2 * pad bases.

    A base is low if the larger class mean of it and the next one is below `least`. Positions count from 0 in each key and
    leave none out; a stretch after a low base counts that base in its length.
    """
    rows = intervals.with_neighbours(track.select(*keys, F.col(pos).cast("long").alias("pos"), p), "pos", 0, 1, width)
    window = Window.partitionBy(*keys, "__bin").orderBy("pos")
    both = F.zip_with(F.col(p), F.lead(p).over(window), lambda a, b: (a + b) / 2)
    low = rows.select(*keys, "pos", "__own", F.coalesce(F.array_max(both) < least, F.lit(False)).alias("low")).where("__own")
    runs = intervals.runs_of(low, keys, "pos", "low", width)
    sizes = runs.groupBy(*keys).agg(F.max("end").alias("__size"))
    wide = F.col("end") - F.col("start") + F.when(F.col("start") > 0, 1).otherwise(0) > 2 * pad
    whole = (F.col("start") == 0) & (F.col("end") == F.col("__size"))
    return runs.where("not low").join(sizes, list(keys)).where(wide | whole).select(*keys, "start", "end")


def cumulative_change(track: DataFrame, keys: Sequence[str], value: str, pos: str = "pos", width: int = intervals.BIN) -> DataFrame:
    """Running sum of absolute changes of a dense track."""
    rows = intervals.with_neighbours(track, pos, 1, 0, width)
    window = Window.partitionBy(*keys, "__bin").orderBy(pos)
    changed = rows.withColumn("__change", F.coalesce(F.abs(F.col(value) - F.lag(value).over(window)), F.lit(0.0))).where("__own").drop("__bin", "__own")
    return intervals.running_sum(changed, keys, pos, F.col("__change"), "cum", width).drop("__change")


def divided(regions: DataFrame, values: str, step: Column, most: Column, pad: int = PAD, stable: float = 0.1) -> DataFrame:
    """Each region (an array of its class's probabilities) cut where they have changed by more than `stable` since the last
    cut, where a piece would grow beyond `most`, and at its end: columns start, end, score. State passes from cut to cut,
    so each region is one fold over its steps, within its row."""
    kept = [c for c in regions.columns if c != values]
    rows = regions.where(F.size(values) > 2 * pad).select(*kept, step.cast("int").alias("__step"), most.cast("int").alias("__most"), F.col(values).cast("array<double>").alias("__p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, starts, ends, scores = [], [], [], []
            steps, limits, lists = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), batch.column(len(kept) + 2)
            for i, (by, limit) in enumerate(zip(steps, limits, strict=True)):
                p = lists[i].values.to_numpy(zero_copy_only=False)
                n, last = len(p), pad
                cum = np.concatenate([[0.0], np.cumsum(np.abs(np.diff(p)))])
                at = cum[pad]
                for start in range(pad, n - pad, by):
                    end = min(start + by, n - pad)
                    here = cum[min(end, n - 1)]
                    if here - at > stable or end - last > limit or end == n - pad:
                        row.append(i)
                        starts.append(last)
                        ends.append(end)
                        scores.append(float(p[last:end].sum() / (end - last)) if end > last else None)
                        last, at = end, here
            own = batch.select(list(range(len(kept)))).take(pa.array(row, pa.int64()))
            made = [pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*own.columns, *made], names=[*kept, "start", "end", "score"])

    fields = [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], *fields]))


def cuts(bases: DataFrame, keys: Sequence[str], value: str, step: Column, most: Column, reach: int, pad: int = PAD, stable: float = 0.1, width: int = intervals.BIN, blocks: int | None = None) -> DataFrame:
    """What divided() gives, from a row for each base (keys, r_start, r_end, pos, value; regions of a key do not overlap), so that
    no row holds a region: (keys, r_start, start, end, score), the last three within the region.

    Cuts can lie at every `step` bases. Changes are summed in bins, in whole numbers (units of 2**-32), so sums do not depend on
    the bins; the places where a cut can lie, with their sums, are a chain in which each cut leads to the next one. step, most:
    whole numbers, the same for all bases of a region; reach: at least the largest step + most. pad is 1 or more.
    """
    if pad < 1:
        raise ValueError("a region keeps a base at either end")
    unit = float(1 << 32)
    named = bases.select(*keys, "r_start", "r_end", "pos", F.col(value).cast("double").alias("__v"), step.cast("long").alias("__step"), most.cast("long").alias("most"))
    rows = scans.with_before(scans.binned(named, "pos", width), keys, "pos", ["r_start", "__v"], "__before")
    change = F.when(F.col("__before.r_start") == F.col("r_start"), F.abs(F.col("__v") - F.col("__before.__v"))).otherwise(0.0)
    whole = lambda x: F.floor(x * unit + 0.5).cast("long")
    summed = scans.with_running(rows.withColumn("__change", whole(change)).drop("__before"), keys, "pos", F.col("__change"), "changed")
    summed = scans.with_running(summed, keys, "pos", whole(F.col("__v")), "__total")
    place, last = F.col("pos") - F.col("r_start"), F.col("r_end") - F.col("r_start") - pad
    grid = ((place >= pad) & ((place - pad) % F.col("__step") == 0) & (place < last)) | (place == last)
    points = summed.where((F.col("r_end") - F.col("r_start") > 2 * pad) & grid)
    points = points.select(*keys, "r_start", place.alias("at"), "changed", "most", (F.col("__total") - whole(F.col("__v"))).alias("total"), (place == last).cast("int").alias("ends"))
    points = materialise(points)  # few beside the bases; several steps read them
    most_change = int(stable * unit)

    def following(x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(x["at"])
        by_change = np.searchsorted(x["changed"], x["changed"] + most_change, "right")
        by_size = np.searchsorted(x["at"], x["at"] + x["most"], "right")
        end = np.flatnonzero(x["ends"])
        found = np.minimum(np.minimum(by_change, by_size), end[0] if len(end) else n)
        return np.where(np.arange(n) < found, found, n)  # nothing follows the end

    region = [*keys, "r_start"]
    picked = chains.followed(points, region, "at", "at", reach, following, ["at", "changed", "most", "ends"], blocks).where("picked")
    pairs = scans.with_before(scans.binned(picked, "at", width), region, "at", ["at", "total"]).where("before is not null")
    score = (F.col("total") - F.col("before.total")) / unit / (F.col("at") - F.col("before.at"))
    return pairs.select(*region, F.col("before.at").alias("start"), F.col("at").alias("end"), score.alias("score"))


def gff_start(chunk_start: Column, start: Column, end: Column, is_plus: Column, as_before: bool = False) -> Column:
    """First base, counted from 1, of a region [start, end) of offsets in a chunk. On minus the chunk's start is its
    exclusive plus end. as_before: minus regions two bases wider, as in files written earlier."""
    return F.when(is_plus, chunk_start + start + 1).otherwise(chunk_start - end + (0 if as_before else 1))


def gff_end(chunk_start: Column, start: Column, end: Column, is_plus: Column, as_before: bool = False) -> Column:
    return F.when(is_plus, chunk_start + end).otherwise(chunk_start - start + (1 if as_before else 0))


def hints(regions: DataFrame, source: str, as_before: bool = False) -> DataFrame:
    """(seqid, chunk_start, is_plus, cls, start, end, score) to the nine columns of a hint file."""
    args = F.col("chunk_start"), F.col("start"), F.col("end"), F.col("is_plus")
    return regions.select(
        "seqid",
        F.lit(source).alias("source"),
        F.get(F.array(*map(F.lit, HINTS)), F.col("cls").cast("int")).alias("type"),
        gff_start(*args, as_before).alias("start"),
        gff_end(*args, as_before).alias("end"),
        F.col("score").alias("score"),
        F.when(F.col("is_plus"), "+").otherwise("-").alias("strand"),
        F.lit(".").alias("frame"),
        F.lit("source=H").alias("attributes"),
    )


def candidate_regions(track: DataFrame, keys: Sequence[str], window_size: int, edge: float, peak: float, value: str = "genic", pos: str = "pos", least_coding: int = 0, coding: str | None = None, width: int = intervals.BIN) -> DataFrame:
    """Runs of a dense track in which the sliding genic score reaches `edge`, kept if it reaches `peak` somewhere: (keys, start, end, peak).

    With `coding`, a run must hold `least_coding` bases of it.
    """
    half = window_size // 2
    rows = intervals.with_neighbours(track.select(*keys, F.col(pos).alias("pos"), F.col(value).alias("value"), (F.col(coding) if coding else F.lit(0)).alias("coding")), "pos", half, window_size - half - 1, width)
    in_bins = [*keys, "__bin"]
    around = Window.partitionBy(*in_bins).orderBy("pos").rowsBetween(-half, window_size - half - 1)
    high = rows.withColumn("score", F.avg("value").over(around)).where(F.col("__own") & (F.col("score") >= edge))
    within = Window.partitionBy(*in_bins).orderBy("start")
    ones = high.select(*in_bins, F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "score", "coding")
    runs = [F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), F.sum("coding").alias("coding")]
    parts = intervals.islands(ones, in_bins, ["start"], F.col("start") != F.lag("end").over(within)).groupBy(*in_bins, "island").agg(*runs).drop("island")
    joined = scans.with_runs(scans.with_before(parts, keys, "start", ["end"]), keys, "start", F.col("start") != F.col("before.end"))
    found = joined.groupBy(*keys, "run").agg(*runs)
    return found.where((F.col("score") >= peak) & (F.col("coding") >= least_coding)).select(*keys, "start", "end", F.col("score").alias("peak"))


def next_where(df: DataFrame, keys: Sequence[str], order: str, flag: str, name: str = "next_row", width: int = intervals.BIN) -> DataFrame:
    """For each row, the place (a whole number) of the next row with the flag: in its bin, or the first of a later bin."""
    rows = df.withColumn("__bin", F.floor(F.col(order) / width)).withColumn("__at", F.when(F.col(flag), F.col(order)))
    following = lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    bins = rows.groupBy(*keys, "__bin").agg(F.min("__at").alias("__first"))
    later = bins.select(*keys, "__bin", F.min("__first").over(following(Window.partitionBy(*keys).orderBy("__bin"))).alias("__later"))
    here = rows.withColumn("__here", F.min("__at").over(following(Window.partitionBy(*keys, "__bin").orderBy(order))))
    return here.join(later, [*keys, "__bin"]).select(*df.columns, F.coalesce("__here", "__later").alias(name))
