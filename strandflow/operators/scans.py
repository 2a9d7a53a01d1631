"""Segmented scans: what a window over a whole key would give, from bins of its order and one summary for each bin.

A bin's rows are scanned on their own; of each bin only a summary (its last row, its sum, its greatest value) goes into a
window over the bins of the key, which carries to every bin what lies before it. So one long key spreads over many tasks, and
the rows are shuffled once, by key and bin. Keys are not null; `order` is a whole number, unique in its key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = "__bin"


def binned(df: DataFrame, order: str, width: int) -> DataFrame:
    """Rows with the bin (__bin) of their order."""
    return df.withColumn(BIN, F.floor(F.col(order) / width))


def _over_bins(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(BIN)


def with_before(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], name: str = "before") -> DataFrame:
    """Binned rows with those columns of the row before them in the key, as a struct; null for the first."""
    at, value = [*keys, BIN], F.struct(*columns)
    last = rows.groupBy(*at).agg(F.max_by(value, order).alias("__last"))
    carried = last.select(*at, F.lag("__last").over(_over_bins(keys)).alias("__carried"))
    here = rows.withColumn(name, F.lag(value).over(Window.partitionBy(*at).orderBy(order)))
    return here.join(carried, at).withColumn(name, F.coalesce(name, "__carried")).drop("__carried")


def with_running(rows: DataFrame, keys: Sequence[str], order: str | Sequence[str], value: Column, name: str, how: Callable[[Column | str], Column] = F.sum, own: bool = True) -> DataFrame:
    """Binned rows with the running sum (or F.max, F.min) of a value up to and with them, or, without `own`, before them."""
    at = [*keys, BIN]
    both = {F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.max: F.greatest, F.min: F.least}[how]
    whole = rows.groupBy(*at).agg(how(value).alias("__whole"))
    carried = whole.select(*at, how("__whole").over(_over_bins(keys).rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    within = Window.partitionBy(*at).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    return rows.withColumn("__here", how(value).over(within)).join(carried, at).withColumn(name, both(F.col("__carried"), F.col("__here"))).drop("__carried", "__here")


def with_runs(rows: DataFrame, keys: Sequence[str], order: str, starts: Column, name: str = "run") -> DataFrame:
    """Binned rows with the number of their run: where `starts` holds a new one begins."""
    flagged = rows.withColumn("__new", F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0))
    return with_running(flagged, keys, order, F.col("__new"), name).drop("__new")
