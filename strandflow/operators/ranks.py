"""Ranks within few, large keys: rows are dealt out by ranges of key and order, and no task holds all rows of a key.

The rows are written once, in ranges. A range numbers its own rows of a key, and starts from the rows of the key in the ranges
before it: of that, only the one key that a range begins amid needs a number, so what is broadcast has at most a row for each range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.scratch import materialise

_PART = "__part"


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__{k}"]) for k in keys], left[_PART] == right["__at"])


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows as a written table with the number (__part) of their range of key and order."""
    return materialise(df.repartitionByRange(*keys, *order).withColumn(_PART, F.spark_partition_id()))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank", ranges: DataFrame | None = None) -> DataFrame:
    """Rows with their number from 1 within the key, in an order in which no two rows of a key are equal. Null keys are a key."""
    rows = ranged(df, keys, order) if ranges is None else ranges
    counts = rows.groupBy(_PART, *keys).agg(F.count("*").alias("__n"))
    ahead = F.sum("__n").over(Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.select(F.col(_PART).alias("__at"), *[F.col(k).alias(f"__{k}") for k in keys], ahead.alias("__ahead")).where("__ahead > 0")
    own = F.row_number().over(Window.partitionBy(_PART, *keys).orderBy(*order))
    here = rows.withColumn("__own", own)
    return here.join(F.broadcast(carried), _same(here, carried, keys), "left").select(*df.columns, (F.col("__own") + F.coalesce("__ahead", F.lit(0))).cast("long").alias(name))


def first_share(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], share: float) -> DataFrame:
    """The first rows of each key in order, up to a share of the key's rows, rounded up. Keys are not null."""
    rows = ranged(df, keys, order)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__size"))
    ranked = numbered(df, keys, order, "__rank", rows)
    return ranked.join(sizes, list(keys)).where(F.col("__rank") <= F.ceil(F.col("__size") * share)).select(*df.columns)
