"""Exact order statistics of groups of any size, by histograms that are refined: no value is gathered but for counts.

A round splits what is still open of each group between its least and greatest value into BINS of equal width, counts the
values of each bin with its own least and greatest, and goes on in the bin that holds the wanted place. A group is done when
that bin has one value only. Each round is one pass that combines in the tasks, so a task sends BINS rows for each group at
most; the borders of a bin are values that occur, so every round leaves fewer distinct ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.scratch import materialise

BINS = 4096
#: Groups that are broadcast, a few numbers each.
BROADCAST_GROUPS = 1_000_000


def _bin(value: str) -> F.Column:
    half = lambda c: F.col(c) / 2  # noqa: E731  # of the whole range of numbers, the width would be infinite
    share = (half(value) - half("__low")) / (half("__high") - half("__low"))
    return F.when(F.col("__high") > F.col("__low"), F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(0).cast("int")


def nth_values(df: DataFrame, by: Sequence[str], value: str, places: dict[str, F.Column]) -> DataFrame:
    """(by, n, a column for each place): the value at each place, counted from 0 in ascending order, of each group. A place is made
    of the group's number of values `n`. Nulls, NaN and infinite values are not counted. Without `by`, all rows are one group.
    Groups are not null; rounds are run eagerly."""
    keys = list(by) or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(1))
    rows = rows.select(*keys, F.col(value).cast("double").alias("__v")).where(F.abs("__v") < float("inf"))
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("__name"), place.cast("long").alias("__place")) for name, place in places.items()]))
    open_ = materialise(groups.select(*keys, "n", "__low", "__high", each))
    sizes = open_.select(*keys, "n").distinct()
    done = open_.where("__low = __high").select(*keys, "__name", F.col("__low").alias("__value"))
    open_ = open_.where("__low < __high").drop("n")
    few = groups.count() <= BROADCAST_GROUPS
    at = [*keys, "__name"]
    while open_.take(1):
        # Of several places of a group, each row goes to those in whose range it still lies.
        side = F.broadcast(open_) if few else open_
        inside = rows.join(side, keys).where(F.col("__v").between(F.col("__low"), F.col("__high")))
        counted = inside.groupBy(*at, "__place", _bin("__v").alias("__bin")).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        upto = F.sum("__n").over(Window.partitionBy(*at).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
        held = counted.withColumn("__upto", upto).where((F.col("__place") < F.col("__upto")) & (F.col("__place") >= F.col("__upto") - F.col("__n")))
        found = materialise(held.select(*keys, "__low", "__high", "__name", (F.col("__place") - F.col("__upto") + F.col("__n")).alias("__place")))
        done = done.unionByName(found.where("__low = __high").select(*keys, "__name", F.col("__low").alias("__value")))
        open_ = found.where("__low < __high")
    wide = done.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == name, F.col("__value"))).alias(name) for name in places])
    return sizes.join(wide, keys).select(*by, "n", *places)


def medians(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """(by, median): the mean of the two middle values, exactly, without a buffer for a group's values."""
    n = F.col("n")
    found = nth_values(df, by, value, {"__a": F.floor((n - 1) / 2), "__b": F.floor(n / 2)})
    return found.select(*by, ((F.col("__a") + F.col("__b")) / 2).alias(name))
