"""Interval algebra on stranded coordinates: clipping, sweeps, range joins, islands.

Intervals are half-open. Sweeps and range joins work on bins of positions, so that one long coordinate is spread over many
tasks: a sweep sums the deltas of a bin on its own and adds what the bins before it sum to; a range join is an equi-join
on bins in which each pair meets exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.operators import scans

BIN = 1 << 16


def plus_start(start: Column, end: Column, is_plus: Column) -> Column:
    """Start in the plus frame; on minus, start is inclusive and above end, which is exclusive."""
    return F.when(is_plus, start).otherwise(end + 1)


def plus_end(start: Column, end: Column, is_plus: Column) -> Column:
    return F.when(is_plus, end).otherwise(start + 1)


def to_plus_frame(features: DataFrame) -> DataFrame:
    args = F.col("start"), F.col("end"), F.col("is_plus")
    return features.select("*", plus_start(*args).alias("p_start"), plus_end(*args).alias("p_end"))


def clip(df: DataFrame, low: Column, high: Column, start: str = "p_start", end: str = "p_end") -> DataFrame:
    """Intervals cut to [low, high), with the length they had before; those outside go."""
    df = df.withColumn("full_length", F.col(end) - F.col(start))
    df = df.withColumn(start, F.greatest(F.col(start), low)).withColumn(end, F.least(F.col(end), high))
    return df.where(F.col(start) < F.col(end))


def bases(df: DataFrame, start: str = "p_start", end: str = "p_end", pos: str = "pos") -> DataFrame:
    """One row for each base of each interval."""
    return df.where(F.col(start) < F.col(end)).withColumn(pos, F.explode(F.sequence(F.col(start), F.col(end) - 1)))


def sweep(df: DataFrame, keys: Sequence[str], counters: dict[str, Column], start: str = "p_start", end: str = "p_end", width: int = BIN) -> DataFrame:
    """(keys, start, end, counters): stretches between borders, and for each counter the sum of its value over the
    intervals that cover the stretch; stretches that nothing covers are left out."""
    names = [*counters, "__covering"]
    deltas = df.where(F.col(start) < F.col(end)).select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), *[c.alias(n) for n, c in (counters | {"__covering": F.lit(1)}).items()])
    ends = F.explode(F.array(F.struct(F.col("__s").alias("pos"), F.lit(1).alias("sign")), F.struct(F.col("__e").alias("pos"), F.lit(-1).alias("sign"))))
    deltas = deltas.withColumn("x", ends)
    at = deltas.groupBy(*keys, F.col("x.pos").cast("long").alias("pos")).agg(*[F.sum(F.col(n) * F.col("x.sign")).alias(n) for n in names]).withColumn("bin", F.floor(F.col("pos") / width))
    order = Window.partitionBy(*keys).orderBy("bin")
    bins = at.groupBy(*keys, "bin").agg(*[F.sum(n).alias(n) for n in names], F.min("pos").alias("first"))
    carried = [(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)).alias(f"{n}_before") for n in names]
    bins = bins.select(*keys, "bin", *carried, F.lead("first").over(order).alias("next"))
    within = Window.partitionBy(*keys, "bin").orderBy("pos")
    running = [(F.col(f"{n}_before") + F.sum(n).over(within.rowsBetween(Window.unboundedPreceding, 0))).cast("long").alias(n) for n in names]
    runs = at.join(bins, [*keys, "bin"]).select(*keys, F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(within), F.col("next")).alias("end"), *running)
    return runs.where("__covering <> 0").drop("__covering")


def depth(df: DataFrame, keys: Sequence[str], start: str = "p_start", end: str = "p_end", width: int = BIN) -> DataFrame:
    """(keys, start, end, depth): stretches between borders with the number of intervals over them, zeros left out."""
    return sweep(df, keys, {"depth": F.lit(1)}, start, end, width)


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], l: tuple[str, str], r: tuple[str, str], width: int = BIN) -> DataFrame:  # noqa: E741
    """Pairs of overlapping intervals with equal keys; column names of both sides must differ but for the keys.

    Both sides are copied to each bin they touch; a pair counts only in the bin where its overlap begins.
    """
    spread = lambda df, s, e, name: df.where(F.col(s) < F.col(e)).withColumn(name, F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))
    a, b = spread(left, *l, "bin"), spread(right, *r, "bin")
    overlap = (F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1]))
    once = F.col("bin") == F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / width)
    return a.join(b, [*keys, "bin"]).where(overlap & once).drop("bin")


def dyadic_nodes(start: Column, end: Column) -> Column:
    """An interval cut into dyadic nodes, [node * 2**level, (node + 1) * 2**level): an array of (level, node), at most two of a level."""
    shifted = lambda x, level: F.call_function("shiftright", x, level)

    def of_level(level: Column) -> Column:
        low, high = -shifted(-start, level), shifted(end, level)
        own = lambda odd, node: F.when((low < high) & (odd % 2 != 0), F.struct(level.alias("level"), node.alias("node")))
        return F.array(own(low, low), own(high, high - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.log2(end - start)).cast("int")), of_level)))


def greatest_over(stretches: DataFrame, spans: DataFrame, keys: Sequence[str], value: str, start: str = "p_start", end: str = "p_end", levels: int = 16) -> DataFrame:
    """Stretches (keys, start, end, ...) of which no border of a span lies inside, with the greatest value of the spans over
    each; stretches under no span go. spans: keys, start, end, value, as named.

    Each span is cut into dyadic nodes, and of a node only its greatest value is kept, so spans that lie over each other cost
    nothing more. A stretch looks up the nodes of its first position: those of the lower levels on its own, those of higher
    ones, which many stretches share, once for its bin of 2**levels positions. So no node is joined to more than a bin's rows.
    """
    by = [*keys, "level", "node"]
    cut = spans.where(F.col(start) < F.col(end)).select(*keys, F.col(value).alias("__value"), F.inline(dyadic_nodes(F.col(start).cast("long"), F.col(end).cast("long"))))
    nodes = cut.groupBy(*by).agg(F.max("__value").alias("__value"))
    longest = spans.agg(F.max(F.col(end) - F.col(start))).first()[0] or 1
    top = max(0, int(longest).bit_length() - 1)
    low = min(levels - 1, top)
    rows = stretches.withColumn("__bin", F.floor(F.col("start") / (1 << levels)))
    up = lambda df, at, first, last, less: df.withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("node", F.call_function("shiftright", at, F.col("level") - less))
    near = up(rows, F.col("start").cast("long"), 0, low, 0).join(nodes, by)
    if top >= levels:
        bins = up(rows.select(*keys, "__bin").distinct(), F.col("__bin").cast("long"), levels, top, levels)
        far = bins.join(nodes, by).groupBy(*keys, "__bin").agg(F.max("__value").alias("__value"))
        near = near.drop("level", "node").unionByName(rows.join(far, [*keys, "__bin"]))
    return near.groupBy(*stretches.columns).agg(F.max("__value").alias(value))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, name: str = "island") -> DataFrame:
    """Rows numbered by run: a row where `breaks` holds begins a new one. `breaks` may use lag() over the same order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__new", F.when(F.coalesce(breaks, F.lit(False)), 1).otherwise(0)).withColumn(name, F.sum("__new").over(window).cast("long")).drop("__new")


def with_neighbours(df: DataFrame, pos: str, before: int, after: int, width: int = BIN) -> DataFrame:
    """Rows of a dense track by bin (__bin) of positions, with those of the bins beside it that are at most `before` ahead of
    it or `after` behind it (__own is false for them): a window over a bin then sees what a window over all would."""
    p = F.col(pos)
    own = F.floor(p / width)
    bins = F.sequence(F.floor((p - after) / width), F.floor((p + before) / width))
    return df.withColumn("__bin", F.explode(bins)).withColumn("__own", F.col("__bin") == own)


def running_sum(df: DataFrame, keys: Sequence[str], pos: str, value: Column, name: str, width: int = BIN) -> DataFrame:
    """Rows with the sum of a value up to their position: bins are summed on their own and carry in what is before them."""
    rows = df.withColumn("__bin", F.floor(F.col(pos) / width)).withColumn("__v", value)
    order = Window.partitionBy(*keys).orderBy("__bin")
    carried = F.sum("__t").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__t")
    before = rows.groupBy(*keys, "__bin").agg(F.sum("__v").alias("__t")).select(*keys, "__bin", carried.alias("__before"))
    within = Window.partitionBy(*keys, "__bin").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("__in", F.sum("__v").over(within)).join(before, [*keys, "__bin"])
    return summed.select(*df.columns, (F.col("__before") + F.col("__in")).alias(name))


def runs_of(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int = BIN) -> DataFrame:
    """(keys, value, start, end, n): stretches of equal consecutive values, by a whole number. Runs are found in bins of it,
    and runs, not rows, are then joined across the bins' borders."""
    in_bins = [*keys, "__bin"]
    within = Window.partitionBy(*in_bins).orderBy("start")
    rows = df.select(*keys, value, F.col(order).alias("start"), F.floor(F.col(order) / width).alias("__bin"))
    numbered = islands(rows, in_bins, ["start"], ~F.col(value).eqNullSafe(F.lag(value).over(within)) & F.lag("start").over(within).isNotNull())
    parts = numbered.groupBy(*in_bins, value, "island").agg(F.min("start").alias("start"), (F.max("start") + 1).alias("end"), F.count("*").alias("n")).drop("island")
    before = scans.with_before(parts, keys, "start", [value])
    joined = scans.with_runs(before, keys, "start", F.col("before").isNotNull() & ~F.col(value).eqNullSafe(F.col("before")[value]), "island")
    return joined.groupBy(*keys, value, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("island")


def contiguous_segments(chunks: DataFrame, size: int, keys: Sequence[str], adjacent: bool = True, order: str = "row_id", width: int = BIN) -> DataFrame:
    """Runs of chunks (row_id, seqid, start, end): broken at strand flips, at chunks that are not full, and, if adjacent,
    at gaps and changes of sequence. (keys, first_row, end_row). A key's rows are scanned in bins of their order."""
    before = lambda c: F.col("before")[c]
    full = F.abs(F.col("end") - F.col("start")) == size
    breaks = ((F.col("start") < F.col("end")) != (before("start") < before("end"))) | ~full | (F.abs(before("end") - before("start")) != size)
    if adjacent:
        breaks = breaks | (F.col("start") != before("end")) | (F.col("seqid") != before("seqid"))
    rows = scans.with_before(scans.binned(chunks, order, width), keys, order, ["start", "end", "seqid"])
    numbered = scans.with_runs(rows, keys, order, F.col("before").isNotNull() & breaks, "island")
    return numbered.groupBy(*keys, "island").agg(F.min(order).alias("first_row"), (F.max(order) + 1).alias("end_row")).drop("island")


def key_ranges(df: DataFrame, keys: Sequence[str], order: str = "row_id") -> DataFrame:
    """First place and number of rows of each key; keys by first appearance can be had by sorting on `first_row`."""
    return df.groupBy(*keys).agg(F.min(order).alias("first_row"), F.count("*").alias("n"))


def single_stretch(df: DataFrame, order: str, flag: str) -> DataFrame:
    """(start, end) of the one run of true values by position; an error if there is none or more than one."""
    found = df.where(F.col(flag)).agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"), F.countDistinct(order).alias("__n"))
    one = F.when(F.col("__n") == F.col("end") - F.col("start"), F.lit(True)).otherwise(F.raise_error(F.lit("not one stretch")).cast("boolean"))
    return found.where(one).drop("__n")
