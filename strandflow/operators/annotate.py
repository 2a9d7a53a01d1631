"""Annotation of bases: classes, masks, gene lengths, transitions and coding phase."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.operators import intervals, scans

TYPES = ("transcript", "cds", "intron")


def checked_type(type_: Column, errors: Sequence[str] = ()) -> Column:
    """The type, if it is known; an error otherwise."""
    return F.when(type_.isin(*TYPES, *errors), type_).otherwise(F.raise_error(F.concat(F.lit("unknown feature type "), type_)))


def raster(features: DataFrame, keys: Sequence[str], length: Column | None = None, errors: Sequence[str] = ()) -> DataFrame:
    """(keys, pos, transcript, cds, intron, gene_length, sample_weight) for every base that a feature covers.

    Flags are joined by or, error types clear the weight, and the longest transcript over a base, measured before
    clipping, gives the gene length. Features combine in the tasks before bases are shuffled.
    """
    plus = intervals.to_plus_frame(features).withColumn("type", checked_type(F.col("type"), errors))
    clipped = intervals.clip(plus, F.lit(0), length if length is not None else F.lit((1 << 62)))
    flag = lambda t: F.max(F.when(F.col("type") == t, 1).otherwise(0)).alias(t)
    return intervals.bases(clipped).groupBy(*keys, "pos").agg(
        *[flag(t) for t in TYPES],
        F.max(F.when(F.col("type") == "transcript", F.col("full_length")).otherwise(0)).alias("gene_length"),
        F.min(F.when(F.col("type").isin(*errors), 0).otherwise(1)).alias("sample_weight"),
    )


def class_segments(features: DataFrame, keys: Sequence[str], length: Column | None = None, errors: Sequence[str] = (), width: int = intervals.BIN) -> DataFrame:
    """The same flags and weight by stretch, (keys, start, end, transcript, cds, intron, sample_weight), from borders alone:
    the cost follows the number of features and not of bases."""
    plus = intervals.to_plus_frame(features).withColumn("type", checked_type(F.col("type"), errors))
    clipped = intervals.clip(plus, F.lit(0), length if length is not None else F.lit((1 << 62)))
    is_a = lambda *types: F.when(F.col("type").isin(*types), 1).otherwise(0)
    runs = intervals.sweep(clipped, keys, {t: is_a(t) for t in TYPES} | {"masks": is_a(*errors)}, width=width)
    flag = lambda t: F.when(F.col(t) > 0, 1).otherwise(0).alias(t)
    return runs.select(*keys, "start", "end", *[flag(t) for t in TYPES], F.when(F.col("masks") > 0, 0).otherwise(1).alias("sample_weight"))


def gene_length_segments(features: DataFrame, keys: Sequence[str], length: Column | None = None, width: int = intervals.BIN) -> DataFrame:
    """(keys, start, end, gene_length): stretches that a transcript covers, with the length, before clipping, of the longest
    one over them. Other bases have length zero and no stretch."""
    plus = intervals.to_plus_frame(features.where("type = 'transcript'"))
    clipped = intervals.clip(plus, F.lit(0), length if length is not None else F.lit((1 << 62))).select(*keys, "p_start", "p_end", "full_length")
    runs = intervals.depth(clipped, keys, width=width).drop("depth")
    return intervals.greatest_over(runs, clipped, keys, "full_length").select(*keys, "start", "end", F.col("full_length").alias("gene_length"))


def class_of(transcript: Column, cds: Column, intron: Column) -> Column:
    """0 intergenic, 1 untranslated, 2 coding, 3 intron; what lies outside of a transcript is intergenic."""
    return F.when(transcript == 0, 0).when(intron == 1, 3).when(cds == 1, 2).otherwise(1)


def merge_classes(cls: Column, from_: int = 1, to: int = 0) -> Column:
    return F.when(cls == from_, to).otherwise(cls)


def transitions(df: DataFrame, keys: Sequence[str], value: str, pos: str = "pos", width: int = intervals.BIN) -> DataFrame:
    """A dense 0/1 track with columns rises and falls: both bases at a change are marked, none at the edges."""
    rows = intervals.with_neighbours(df, pos, 1, 1, width)
    window = Window.partitionBy(*keys, "__bin").orderBy(pos)
    up = lambda a, b: F.when(a < b, 1).otherwise(0)
    here, before, after = F.col(value), F.lag(value).over(window), F.lead(value).over(window)
    marked = rows.select("*", (up(here, after) + up(before, here)).alias("rises"), (up(after, here) + up(here, before)).alias("falls"))
    return marked.where("__own").drop("__bin", "__own")


def transition_borders(segments: DataFrame, keys: Sequence[str], low: Column, high: Column) -> DataFrame:
    """The same marks from stretches (start, end) of a track, without a row for each base: (keys, pos, rises, falls)."""
    rise, fall = (F.struct(p.alias("pos"), F.lit(up).alias("rises"), F.lit(1 - up).alias("falls")) for p, up in ((F.col("start"), 1), (F.col("end"), 0)))
    inside = (F.col("m.pos") > low) & (F.col("m.pos") < high)
    marks = segments.select(*keys, F.explode(F.array(rise, fall)).alias("m")).where(inside)
    both = marks.select(*keys, F.explode(F.array(F.col("m.pos") - 1, F.col("m.pos"))).alias("pos"), "m.rises", "m.falls")
    return both.groupBy(*keys, "pos").agg(F.sum("rises").cast("long").alias("rises"), F.sum("falls").cast("long").alias("falls"))


def coding_phase(cds_bases: DataFrame, feature: Sequence[str], is_plus: Column, phase: Column, intron: Column | None = None) -> DataFrame:
    """Bases until the next codon: the k-th base of a feature in reading direction that no intron covers has phase - k mod 3."""
    coding = cds_bases if intron is None else cds_bases.where(~intron)
    order = Window.partitionBy(*feature).orderBy(F.when(is_plus, F.col("pos")).otherwise(-F.col("pos")))
    return coding.withColumn("base_phase", F.pmod(phase - (F.row_number().over(order) - 1), F.lit(3)).cast("long"))


def phase_counts(cds: DataFrame, keys: Sequence[str], phase: Column, start: str = "p_start", end: str = "p_end") -> DataFrame:
    """(keys, base_phase, n): the number of bases of each phase in features without introns, from their lengths alone."""
    n = F.col(end) - F.col(start)
    first = lambda r: F.pmod(phase - r, F.lit(3))  # noqa: E731  # the first base, from 0, of phase r
    of = F.array(*[F.struct(F.lit(r).cast("long").alias("base_phase"), F.floor((n - first(r) + 2) / 3).alias("n")) for r in range(3)])
    return cds.where(n > 0).select(*keys, F.inline(of)).groupBy(*keys, "base_phase").agg(F.sum("n").alias("n")).where("n > 0")


def coding_pieces(cds: DataFrame, introns: DataFrame, keys: Sequence[str], width: int = intervals.BIN) -> DataFrame:
    """Coding features (keys, is_plus, p_start, p_end, ...) cut where introns (keys, p_start, p_end) lie over them: a row for each
    piece, with start, end and `offset`, the feature's coding bases before the piece in reading direction. No base is made a row."""
    covered = union_of(introns, keys, width=width).withColumnsRenamed({"start": "i_start", "end": "i_end"})
    names = [c for c in cds.columns if c not in keys]
    feature = F.struct(*names)
    spans = cds.where("p_start < p_end").select(*keys, feature.alias("__f"), "p_start", "p_end")
    over = intervals.range_join(spans, covered, keys, ("p_start", "p_end"), ("i_start", "i_end"), width)
    cuts = over.select(*keys, "__f", "p_start", F.greatest("i_start", "p_start").alias("low"), F.least("i_end", "p_end").alias("high"))
    cuts = cuts.unionByName(spans.select(*keys, "__f", "p_start", F.col("p_end").alias("low"), F.col("p_end").alias("high")))
    along = Window.partitionBy(*keys, "__f").orderBy("low", "high")
    pieces = cuts.withColumn("start", F.coalesce(F.lag("high").over(along), "p_start")).withColumn("end", F.col("low")).where(F.col("start") < F.col("end"))
    before = lambda w: F.coalesce(F.sum(F.col("end") - F.col("start")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = Window.partitionBy(*keys, "__f")
    forward = F.col("is_plus" if "is_plus" in keys else "__f.is_plus")
    offset = F.when(forward, before(by.orderBy("start"))).otherwise(before(by.orderBy(F.desc("start"))))
    return pieces.select(*keys, "__f.*", "start", "end", offset.alias("offset"))


def phase_positions(pieces: DataFrame, phase: Column) -> DataFrame:
    """Pieces, with a row for each phase that occurs in them: base_phase, n, and the first and last position of that phase."""
    n = F.col("end") - F.col("start")
    first = lambda r: F.pmod(phase - F.col("offset") - r, F.lit(3))  # noqa: E731  # the first base of the piece, from 0, of phase r
    found = lambda r: F.floor((n - first(r) + 2) / 3)
    place = lambda r, k: F.when(F.col("is_plus"), F.col("start") + first(r) + 3 * k).otherwise(F.col("end") - 1 - first(r) - 3 * k)
    of = [F.struct(F.lit(r).cast("long").alias("base_phase"), found(r).alias("n"), place(r, F.lit(0)).alias("first"), place(r, found(r) - 1).alias("last")) for r in range(3)]
    return pieces.select("*", F.inline(F.array(*of))).where("n > 0")


def union_of(df: DataFrame, keys: Sequence[str], start: str = "p_start", end: str = "p_end", width: int = intervals.BIN) -> DataFrame:
    """(keys, start, end): maximal covered stretches. Intervals with the same start are one before they are shuffled, so a
    bin of starts has at most `width` rows, and how far those before it reach is carried in."""
    first = df.where(F.col(start) < F.col(end)).groupBy(*keys, F.col(start).alias("start")).agg(F.max(end).alias("end"))
    reached = scans.with_running(scans.binned(first, "start", width), keys, "start", F.col("end"), "reach", F.max, own=False)
    numbered = scans.with_runs(reached, keys, "start", F.col("start") > F.col("reach"))
    return numbered.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
