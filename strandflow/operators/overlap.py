"""Sliding windows over predictions, their overlap-mean, and pooling of bases with weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.operators import chains, intervals, scans


def check_parameters(chunk: int, offset: int | None = None, core: int | None = None) -> tuple[int, int]:
    """(offset, core), by default a half and three quarters of the chunk; an error if they do not fit."""
    offset, core = chunk // 2 if offset is None else offset, chunk * 3 // 4 if core is None else core
    if not (0 < offset <= core <= chunk) or chunk % offset:
        raise ValueError(f"offset {offset} and core {core} do not fit chunks of {chunk}")
    return offset, core


def window_starts(length: Column, size: int, offset: int) -> Column:
    """Starts of the windows in a range: every offset, and one more at the right edge if the last would end before it."""
    regular = F.when(length >= size, F.sequence(F.lit(0).cast("long"), length - size, F.lit(offset).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(regular, F.when(length >= size, F.array(length - size)).otherwise(F.array().cast("array<bigint>"))))


def windows(ranges: DataFrame, size: int, offset: int, length: str = "length") -> DataFrame:
    """Each range's windows: w, w_start, w_end, and whether they are the first or last."""
    starts = window_starts(F.col(length).cast("long"), size, offset)
    rows = ranges.withColumn("__starts", starts).select("*", F.posexplode("__starts").alias("w", "w_start"))
    return rows.withColumn("w_end", F.col("w_start") + size).withColumn("is_first", F.col("w") == 0).withColumn("is_last", F.col("w") == F.size("__starts") - 1).drop("__starts")


def mean_vector(p: str, n_classes: int) -> Column:
    """Mean of arrays of n_classes numbers, as an aggregate."""
    return F.array(*[F.avg(F.get(p, F.lit(k))) for k in range(n_classes)])


def classes_of(df: DataFrame, p: str) -> int:
    """Length of the arrays of a column, from one row."""
    first = df.select(F.size(p).alias("n")).first()
    return first["n"] if first else 0


def overlap_mean(predictions: DataFrame, keys: Sequence[str], size: int, core: int, p: str = "p", n_classes: int | None = None) -> DataFrame:
    """Mean vector at each position over the trimmed windows that cover it.

    predictions: keys, w_start, is_first, is_last, off, p. Windows lose (size - core) // 2 at either end, but not at the
    outer edges of their range. The one shuffle is by position and combines in the tasks. n_classes is read from a row if not given.
    """
    trim = (size - core) // 2
    kept = predictions.where((F.col("is_first") | (F.col("off") >= trim)) & (F.col("is_last") | (F.col("off") < size - trim)))
    mean = mean_vector(p, n_classes or classes_of(predictions, p))
    return kept.groupBy(*keys, (F.col("w_start") + F.col("off")).alias("pos")).agg(mean.alias(p), F.count("*").alias("n_windows"))


def pool(df: DataFrame, keys: Sequence[str], size: int, length: Column, aggregates: Sequence[Column], off: str = "off") -> DataFrame:
    """Aggregates by pool of `size` offsets; what is left over at the end of the chunk goes."""
    full = df.where(F.col(off) < length - length % size)
    return full.groupBy(*keys, F.floor(F.col(off) / size).alias("pool")).agg(*aggregates)


def pool_weight(weight: Column) -> Column:
    """1 if no base of the pool is masked."""
    return F.min(F.when(weight != 0, 1).otherwise(0))


def class_weight(cls: Column, weights: Sequence[float]) -> Column:
    """Sum of the weights of the classes that occur in the pool."""
    total = F.lit(0.0)
    for k, w in enumerate(weights):
        total = total + F.max(F.when(cls == k, F.lit(float(w))).otherwise(0.0))
    return total


def transition_weight(flags: Sequence[Column], weights: Sequence[float]) -> Column:
    """Sum over flags of their maximum in the pool times a weight; 1 where that is 0."""
    total = F.lit(0.0)
    for flag, w in zip(flags, weights, strict=True):
        total = total + F.max(flag) * F.lit(float(w))
    return F.when(total == 0, 1.0).otherwise(total)


def coverage_weight(score: Column, offset: float = 0.0) -> Column:
    """Mean of the scores, those above zero with an offset."""
    return F.avg(F.when(score > 0, score + offset).otherwise(score))


def normalized_coverage(x: Column, method: str | None) -> Column:
    return {None: x, "log": F.ln(x + 1.1), "linear": x / 100}[method]


def stretched(weights: Column, reach: int) -> Column:
    """Weights above 1 spread to their neighbours, halved with each step and at least 1.

    Of neighbours that several weights reach, the one written last, from the greater index, stays; centres keep their own.
    """

    def spread(_: Column, j: Column) -> Column:
        reached = [F.when(F.get(weights, j + d) > 1, F.greatest(F.lit(1.0), F.get(weights, j + d) / 2.0 ** abs(d))) for d in range(reach, -reach - 1, -1) if d]
        return F.coalesce(*[F.when(j + d >= 0, x) for d, x in zip([d for d in range(reach, -reach - 1, -1) if d], reached, strict=True)], F.get(weights, j))

    return F.transform(weights, lambda w, j: F.when(w > 1, w).otherwise(spread(w, j)))


def greedy_pack(df: DataFrame, keys: Sequence[str], order: str, size: str, most: int, width: int = intervals.BIN) -> DataFrame:
    """Items in order (a whole number) into batches of at most `most`: a batch closes when the next item would not fit. An
    item that is larger than that has a batch to itself.

    Where a batch ends depends on where it begins alone, so batches are a chain over running sums of the sizes, followed in
    blocks of them: no task holds all items of a key. Sizes are not negative.
    """
    rows = df.select(*keys, order, F.least(F.col(size).cast("long"), F.lit(most + 1)).alias("__size"))
    binned, by = scans.binned(rows, order, width), [order, "__size"]
    summed = scans.with_running(scans.with_running(binned, keys, by, F.col("__size"), "__sum"), keys, by, F.lit(1), "__nth").drop(scans.BIN)
    items = summed.withColumn("__from", F.col("__sum") - F.col("__size"))

    def following(x: dict[str, np.ndarray]) -> np.ndarray:
        start = x["__from"]
        return np.maximum(np.searchsorted(x["__sum"], start + most, "right"), np.searchsorted(start, start, "right"))

    packed = chains.followed(items, keys, "__nth", "__from", most + 2, following, ["__sum", "__from"])
    return packed.select(*keys, order, (F.col("picks") - 1).alias("batch"))


def position_means(df: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    return df.groupBy(*keys, position).agg(F.avg(value).alias("mean_value"))


def running(df: DataFrame, keys: Sequence[str], order: str, value: Column) -> Column:
    """Running sum in order."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
