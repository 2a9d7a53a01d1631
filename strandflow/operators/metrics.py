"""Masked confusion-matrix analytics.

Confusion matrices are long: (…, ref, pred, n), completed to all cells. Counting combines in the tasks, so what is
shuffled is a matrix for each task and group; everything after it works on a few rows for each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import scores

#: Names of the classes.
GENIC = ("ig", "utr", "exon", "intron")
PHASES = ("no_phase", "phase_0", "phase_1", "phase_2")

#: Composite scores: for each, lists of (ref, pred) cells that count as true positive, false positive, false negative.
Cells = list[tuple[int, int]]


def _summed(classes: Sequence[int], n: int) -> tuple[Cells, Cells, Cells]:
    """Sum of the classes' own counts."""
    others = lambda c: [k for k in range(n) if k != c]
    return [(c, c) for c in classes], [(r, c) for c in classes for r in others(c)], [(c, p) for c in classes for p in others(c)]


def _merged(classes: Sequence[int], n: int) -> tuple[Cells, Cells, Cells]:
    """The classes taken as one."""
    out = [k for k in range(n) if k not in classes]
    return [(r, p) for r in classes for p in classes], [(r, p) for r in out for p in classes], [(r, p) for r in classes for p in out]


def class_cells(names: Sequence[str]) -> dict[str, tuple[Cells, Cells, Cells]]:
    return {name: _summed([i], len(names)) for i, name in enumerate(names)}


def genic_composites() -> dict[str, tuple[Cells, Cells, Cells]]:
    return {"legacy_cds": _merged([2, 3], 4), "sub_genic": _summed([2, 3], 4), "genic": _summed([1, 2, 3], 4)}


def phase_composites() -> dict[str, tuple[Cells, Cells, Cells]]:
    off = [(r, p) for r in (1, 2, 3) for p in (1, 2, 3) if r != p]
    return {"any_phase": _merged([1, 2, 3], 4), "internal_phase": ([(c, c) for c in (1, 2, 3)], off, off), "phase": _summed([1, 2, 3], 4)}


def confusion(df: DataFrame, n_classes: int, by: Sequence[str] = (), ref: str = "ref", pred: str = "pred", complete: bool = True, n: str | None = None) -> DataFrame:
    """Counts of (ref, pred) in each group, with zeros for cells that do not occur if complete; column n, if named, counts a row so often."""
    counts = df.groupBy(*by, F.col(ref).cast("long").alias("ref"), F.col(pred).cast("long").alias("pred")).agg((F.sum(n) if n else F.count("*")).alias("n"))
    if not complete:
        return counts
    grid = F.array(*[F.struct(F.lit(r).cast("long").alias("ref"), F.lit(p).cast("long").alias("pred")) for r in range(n_classes) for p in range(n_classes)])
    cells = [F.sum(F.when((F.col("ref") == r) & (F.col("pred") == p), F.col("n"))).alias(f"c{r}_{p}") for r in range(n_classes) for p in range(n_classes)]
    wide = counts.groupBy(*by).agg(F.array(*[F.coalesce(c, F.lit(0)) for c in cells]).alias("n"))
    return wide.select(*by, F.explode(F.arrays_zip(grid.alias("cell"), F.col("n").alias("n"))).alias("x")).select(*by, "x.cell.ref", "x.cell.pred", "x.n")


def normalized(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of each cell in its reference class; null for a class without bases."""
    return cm.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(*by, "ref"))))


def score(cm: DataFrame, cells: dict[str, tuple[Cells, Cells, Cells]], by: Sequence[str] = ()) -> DataFrame:
    """(…, name, tp, fp, fn, precision, recall, f1) for each named set of cells; one pass over the matrix."""

    def count(chosen: Cells) -> Column:
        hit = F.lit(False)
        for r, p in chosen:
            hit = hit | ((F.col("ref") == r) & (F.col("pred") == p))
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("long")

    each = F.array(*[F.struct(F.lit(name).alias("name"), count(tp).alias("tp"), count(fp).alias("fp"), count(fn).alias("fn")) for name, (tp, fp, fn) in cells.items()])
    rows = cm.groupBy(*by).agg(each.alias("s")).select(*by, F.explode("s").alias("s")).select(*by, "s.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select("*", scores.precision(tp, fp).alias("precision"), scores.recall(tp, fn).alias("recall"), scores.f1(tp, fp, fn).alias("f1"))


def wide_scores(wide: DataFrame, cells: dict[str, tuple[Cells, Cells, Cells]], by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The same from matrices that are one row each, with a column c{ref}_{pred} for each cell; empty matrices go."""
    total = lambda columns: sum((F.col(c) for c in columns), F.lit(0)).cast("long")
    count = lambda chosen: total(f"c{r}_{p}" for r, p in chosen)
    each = F.array(*[F.struct(F.lit(name).alias("name"), count(tp).alias("tp"), count(fp).alias("fp"), count(fn).alias("fn")) for name, (tp, fp, fn) in cells.items()])
    rows = wide.where(total(names) > 0).select(*by, F.inline(each))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select("*", scores.precision(tp, fp).alias("precision"), scores.recall(tp, fn).alias("recall"), scores.f1(tp, fp, fn).alias("f1"))


def accuracy(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    right = F.sum(F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(0))
    return cm.groupBy(*by).agg(F.try_divide(right.cast("double"), F.sum("n")).alias("accuracy"), F.sum("n").cast("long").alias("n"))


def class_entropy(df: DataFrame, n_classes: int, p: str = "p", ref: str = "ref", batch: str = "batch") -> DataFrame:
    """Mean over batches of a class's mean entropy, as a share of the greatest possible; bases with a zero are skipped."""
    by_batch = df.select(F.col(ref).alias("ref"), F.col(batch).alias("batch"), scores.entropy(F.col(p)).alias("h")).groupBy("ref", "batch").agg(F.avg("h").alias("h"))
    return by_batch.groupBy("ref").agg((F.avg("h") / F.log2(F.lit(float(n_classes)))).alias("h"))


def tagged_confusion(df: DataFrame, n_classes: int, filters: dict[str, Column], ref: str = "ref", pred: str = "pred") -> DataFrame:
    """A matrix for each named filter, in one pass: a row is counted once for each filter that it passes."""
    tags = F.array_compact(F.array(*[F.when(keep, F.lit(name)) for name, keep in filters.items()]))
    return confusion(df.select(F.explode(tags).alias("filter"), ref, pred), n_classes, ["filter"], ref, pred)


def transition_filters(transitions: Column) -> dict[str, Column]:
    """The five filters over six transition flags."""
    has = lambda *at: F.lit(False) if not at else F.greatest(*[F.get(transitions, F.lit(i)) for i in at]) > 0
    return {"all": F.lit(True), "any": has(*range(6)), "transcript": has(0, 3), "coding": has(1, 4), "intron": has(2, 5)}


def threshold_counts(df: DataFrame, by: Sequence[str], first: str, second: str, bins: Sequence[float]) -> DataFrame:
    """Rows with first >= a and second >= b for all pairs of bins: binned once, then summed over the small table of bins."""
    place = lambda c: sum((F.when(F.col(c) >= b, 1).otherwise(0) for b in bins[1:]), F.when(F.col(c) >= bins[0], 0).otherwise(-1))
    binned = df.select(*by, place(first).alias("i"), place(second).alias("j")).where("i >= 0 and j >= 0").groupBy(*by, "i", "j").agg(F.count("*").alias("n"))
    # A cell counts for all bins up to its own: at most len(bins) ** 2 rows for each cell, whatever the input.
    at = binned.select(*by, "n", F.explode(F.sequence(F.lit(0), "i")).alias("a"), "j").select(*by, "n", "a", F.explode(F.sequence(F.lit(0), "j")).alias("b"))
    value = lambda c: F.get(F.array(*[F.lit(b) for b in bins]), F.col(c))
    return at.groupBy(*by, "a", "b").agg(F.sum("n").alias("n")).select(*by, value("a").alias("min_first"), value("b").alias("min_second"), "n")


def position_profile(df: DataFrame, block: int, off: str = "off", ref: str = "ref", pred: str = "pred") -> DataFrame:
    """Accuracy by block of offsets in the chunk."""
    right = F.count_if(F.col(ref) == F.col(pred))
    return df.groupBy(F.floor(F.col(off) / block).alias("block")).agg(F.count("*").alias("n"), right.alias("n_right"), (right / F.count("*")).alias("accuracy"))


def support_consensus(df: DataFrame, threshold: float, support: str, ref: str = "ref", pred: str = "pred") -> DataFrame:
    """Per cent of bases predicted as their class, by class and by high or low support; -1 where there are none."""
    high = F.col(support) >= threshold
    rate = lambda keep: F.coalesce(100 * F.try_divide(F.count_if(keep & (F.col(ref) == F.col(pred))).cast("double"), F.count_if(keep)), F.lit(-1.0))
    return df.groupBy(F.col(ref).alias("ref")).agg(rate(high).alias("high_pct"), rate(~high).alias("low_pct"))


def length_bins(df: DataFrame, edges: Sequence[int], length: str, value: str) -> DataFrame:
    """Mean and count by right-closed length bin; lengths outside all bins have a null bin."""
    bin_ = F.lit(None).cast("long")
    for lo, hi in reversed(list(zip(edges, edges[1:], strict=False))):
        bin_ = F.when((F.col(length) > lo) & (F.col(length) <= hi), F.lit(hi).cast("long")).otherwise(bin_)
    return df.groupBy(bin_.alias("bin_end")).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))
