"""Chunks: fixed-length slices of both strands of a coordinate, and arrays aligned with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(coordinates: DataFrame, size: int, length: str = "length") -> DataFrame:
    """A row for each chunk: is_plus, chunk_idx, start, end. Minus chunks run down, with start above end."""
    lows = F.sequence(F.lit(0).cast("long"), F.col(length) - 1, F.lit(size).cast("long"))
    rows = coordinates.where(F.col(length) > 0).withColumn("__low", F.explode(lows)).withColumn("__high", F.least(F.col("__low") + size, F.col(length)))
    n = F.ceil(F.col(length) / size)
    nth = F.floor(F.col("__low") / size)
    both = rows.withColumn("is_plus", F.explode(F.array(F.lit(True), F.lit(False))))
    return both.select(
        *coordinates.columns,
        "is_plus",
        F.when(F.col("is_plus"), nth).otherwise(n - 1 - nth).cast("long").alias("chunk_idx"),
        F.when(F.col("is_plus"), F.col("__low")).otherwise(F.col("__high")).alias("start"),
        F.when(F.col("is_plus"), F.col("__high")).otherwise(F.col("__low")).alias("end"),
    )


def n_chunks(length: Column, size: int) -> Column:
    """Chunks of both strands."""
    return 2 * F.ceil(length / size)


def pad(array: Column, size: int, fill: Column) -> Column:
    """The array with fill at its end, up to size."""
    return F.concat(array, F.array_repeat(fill, F.greatest(F.lit(0), size - F.size(array)).cast("int")))


def strand_slice(array: Column, start: Column, end: Column) -> Column:
    """Slice of a plus-frame array for a chunk: reversed on minus, where start is above end."""
    low, high = F.least(start, end).cast("int"), F.greatest(start, end).cast("int")
    cut = F.slice(array, low + 1, high - low)
    return F.when(start < end, cut).otherwise(F.reverse(cut))


def strand_slices(sequences: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """Every chunk of both strands with its part of the sequence: is_plus, chunk_idx, slice (reversed on minus).

    The sequence is cut once, in linear time, and goes; its columns are carried to each chunk but for that.
    """
    kept = [c for c in sequences.columns if c != seq]
    pieces = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = sequences.select(*kept, pieces.alias("__pieces")).select(*kept, F.size("__pieces").alias("__n"), F.posexplode("__pieces").alias("__k", "__piece"))
    both = rows.withColumn("is_plus", F.explode(F.array(F.lit(True), F.lit(False))))
    idx = F.when(F.col("is_plus"), F.col("__k")).otherwise(F.col("__n") - 1 - F.col("__k"))
    return both.select(*kept, "is_plus", idx.cast("long").alias("chunk_idx"), F.when(F.col("is_plus"), F.col("__piece")).otherwise(F.reverse("__piece")).alias("slice"))


def padding_to_front(array: Column, n_valid: Column) -> Column:
    """A padded array with its padding moved to the front."""
    n = n_valid.cast("int")
    return F.concat(F.slice(array, n + 1, F.size(array) - n), F.slice(array, F.lit(1), n))


def valid(off: Column, start: Column, end: Column) -> Column:
    """Whether an offset is a base and not padding: follows from the coordinates, no mask is stored."""
    return off < F.abs(end - start)


def flags(bases: DataFrame, keys: Sequence[str], cls: str = "cls", weight: str = "sample_weight", as_before: bool = False) -> DataFrame:
    """(keys, err_sample, fully_intergenic, is_annotated). err_sample tells whether the chunk has any valid base.

    as_before: fully_intergenic inverted, as in files written earlier.
    """
    intergenic = F.bool_and(F.col(cls) != 0) if as_before else F.bool_and(F.col(cls) == 0)
    return bases.groupBy(*keys).agg(F.bool_or(F.col(weight) != 0).alias("err_sample"), intergenic.alias("fully_intergenic"), F.bool_or(F.col(weight).isNotNull()).alias("is_annotated"))


def concat_channels(x: Column, *tracks: Column) -> Column:
    """Base vectors with further channels (one array of numbers each) behind them."""
    out = x
    for track in tracks:
        out = F.zip_with(out, track, lambda v, c: F.concat(v, F.array(c.cast("double"))))
    return out


def split_points(length: Column, write_by: int, size: int) -> Column:
    """Ends of the pieces in which a coordinate is written: write_by rounded to a multiple of the chunk size."""
    step = max(1, round(write_by / size)) * size
    return F.concat(F.filter(F.sequence(F.lit(0).cast("long"), length, F.lit(step).cast("long")), lambda x: (x > 0) & (x < length)), F.array(length))


def safe_splits(coordinates: DataFrame, features: DataFrame, keys: Sequence[str], write_by: int, size: int, length: str = "length", as_before: bool = False) -> DataFrame:
    """(keys, start, end): the pieces in which coordinates are written, cut where no feature is disturbed.

    A cut is wanted at every multiple of write_by, itself rounded down to a multiple of the chunk size. It moves on by
    chunks while it is at a border of a feature or within a CDS, and is left out if there is none before the next one.
    features: keys, is_plus, start, end (minus: start above end), type. as_before: borders on minus are taken two bases
    lower, as in files written earlier. Only chunk ends that are taken are shuffled, as places within their step.
    """
    step = write_by // size * size
    if step <= 0:
        raise ValueError(f"pieces of {write_by} hold no chunk of {size}")
    shift = -1 if as_before else 1
    plus = F.col("is_plus")
    low = F.when(plus, F.col("start")).otherwise(F.col("end") + shift)
    high = F.when(plus, F.col("end")).otherwise(F.col("start") + shift)
    n_low, n_high = F.ceil(F.col("__low") / size), F.ceil(F.col("__high") / size)
    inside = F.when((F.col("type") == "cds") & (n_low < n_high), F.sequence(n_low, n_high - 1)).otherwise(F.array().cast("array<bigint>"))
    borders = F.filter(F.array("__low", "__high"), lambda x: x % size == 0)
    taken = F.array_union(inside, F.transform(borders, lambda x: F.floor(x / size)))
    per = step // size
    spans = features.select(*keys, "type", low.cast("long").alias("__low"), high.cast("long").alias("__high"))
    ends = spans.select(*keys, F.explode(taken).alias("__n")).select(*keys, F.floor(F.col("__n") / per).alias("__step"), (F.col("__n") % per).alias("__k"))
    blocked = ends.where("__step > 0").groupBy(*keys, "__step").agg(F.collect_set("__k").alias("__taken"))
    wanted = coordinates.where(F.col(length) > 0).select(*keys, F.col(length).cast("long").alias("__length"))
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__length") - 1) / step))
    rows = wanted.withColumn("__step", F.explode(steps)).join(blocked, [*keys, "__step"], "left")
    places = F.sequence(F.lit(0).cast("long"), F.lit(per - 1).cast("long"))
    free = F.array_min(F.array_except(places, F.coalesce("__taken", F.array().cast("array<bigint>"))))
    at = F.when(F.col("__step") == 0, 0).otherwise(F.col("__step") * step + free * size)
    starts = rows.select(*keys, "__length", at.cast("long").alias("start")).where(F.col("start") < F.col("__length"))
    following = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    return starts.select(*keys, "start", F.coalesce(following, F.col("__length")).alias("end"))
