"""Gene graphs: borders, longest transcripts, intron chains, strand mates, and scores by gene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.operators import intervals, metrics


def gene_borders(graph: DataFrame, gene: Sequence[str], is_plus: Column | None = None) -> DataFrame:
    """Borders and number of transcripts of each gene, from features joined to their transcripts and genes."""
    rows = graph if is_plus is None else graph.where(is_plus)
    return rows.groupBy(*gene).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.countDistinct("transcript").alias("n_transcripts"), F.min("seqid").alias("seqid"))


def longest_transcript(cds: DataFrame, gene: Sequence[str], transcript: str = "transcript", length: str = "length") -> DataFrame:
    """Each gene's transcript with most coding bases; the smaller name if two have as many."""
    sums = cds.groupBy(*gene, transcript).agg(F.sum(length).alias("coding"))
    first = F.row_number().over(Window.partitionBy(*gene).orderBy(F.desc("coding"), transcript))
    return sums.withColumn("__nth", first).where("__nth = 1").drop("__nth")


def intron_chains(introns: DataFrame, transcript: Sequence[str]) -> DataFrame:
    """Each transcript's introns in order, as text, and their number."""
    chain = F.array_sort(F.collect_list(F.struct("start", "end")))
    rows = introns.groupBy(*transcript).agg(chain.alias("c"))
    return rows.select(*transcript, F.array_join(F.transform("c", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("chain"), F.size("c").cast("long").alias("n_introns"))


def intron_chain_matches(chains: DataFrame, side: str, by: Sequence[str] = ()) -> DataFrame:
    """Transcripts of two annotations with the number of the other annotation's transcripts that have the same chain.

    chains: by, chain and a column `side` that tells the annotation. Equal chains make a class; no pairs are made.
    """
    key = [*by, "chain"]
    counts = chains.groupBy(*key, side).agg(F.count("*").alias("__same"))
    counts = counts.groupBy(*key).agg(F.sum("__same").alias("__all"), F.map_from_entries(F.collect_list(F.struct(side, "__same"))).alias("__by_side"))  # two entries
    return chains.join(counts, key).withColumn("n_matches", (F.col("__all") - F.element_at("__by_side", F.col(side))).cast("long")).drop("__all", "__by_side")


def strand_mates(chunks: DataFrame, keys: Sequence[str] = ("species", "seqid")) -> DataFrame:
    """Pairs of a plus chunk and the minus chunk over the same bases: (keys, start, end, plus_row, minus_row)."""
    plus = chunks.where("start < end").select(*keys, "start", "end", F.col("row_id").alias("plus_row"))
    minus = chunks.where("start > end").select(*keys, F.col("end").alias("start"), F.col("start").alias("end"), F.col("row_id").alias("minus_row"))
    return plus.join(minus, [*keys, "start", "end"])


def gene_wise(bases: DataFrame, genes: DataFrame, keys: Sequence[str], width: int = intervals.BIN, n_classes: int = 4, only: Sequence[str] | None = None) -> DataFrame:
    """Scores of each gene over the bases within its borders, of all classes and composites or only those named; genes without an
    unmasked base are left out. Cells that all scores asked for treat alike are one running count, so few scores make narrow rows.

    bases: keys, pos, ref, pred, sample_weight; genes: keys, gene, start, end. Matrices are summed along a sequence, in bins, and
    read at both borders of a gene, so the cost follows bases and genes, and not how many genes lie over a base.
    """
    scored = metrics.class_cells(metrics.GENIC) | metrics.genic_composites()
    scored = {name: parts for name, parts in scored.items() if only is None or name in only}
    alike: dict[tuple, list[tuple[int, int]]] = {}
    for cell in ((r, p) for r in range(n_classes) for p in range(n_classes)):
        alike.setdefault(tuple(cell in part for parts in scored.values() for part in parts), []).append(cell)
    firsts = {cells[0] for cells in alike.values()}
    scored = {name: tuple([c for c in part if c in firsts] for part in parts) for name, parts in scored.items()}
    names = [f"c{cells[0][0]}_{cells[0][1]}" for cells in alike.values()]
    at_cell = F.col("ref") * n_classes + F.col("pred")
    in_class = (F.col("ref") >= 0) & (F.col("ref") < n_classes) & (F.col("pred") >= 0) & (F.col("pred") < n_classes)
    in_cell = [F.count_if(in_class & at_cell.isin([r * n_classes + p for r, p in cells])).alias(n) for cells, n in zip(alike.values(), names, strict=True)]
    counted = bases.where("sample_weight <> 0").groupBy(*keys, F.col("pos").cast("long").alias("pos")).agg(*in_cell)
    # A border comes before the base at its place: it reads what lies before it.
    borders = F.inline(F.array(*[F.struct(F.col(c).cast("long").alias("pos"), F.lit(sign).alias("sign")) for c, sign in (("start", -1), ("end", 1))]))
    marks = genes.where("start < end").select(*keys, "gene", borders)
    rows = marks.unionByName(counted.withColumn("sign", F.lit(2)), allowMissingColumns=True).withColumn("__bin", F.floor(F.col("pos") / width))
    at = [*keys, "__bin"]
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*at).orderBy("pos", "sign").rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy(*at).agg(*[F.sum(n).alias(n) for n in names]).select(*at, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in names])
    running = [(F.coalesce(F.sum(n).over(within), F.lit(0)) + F.col(f"{n}_before")).alias(n) for n in names]
    read = rows.join(bins, at).select(*keys, "gene", "sign", *running).where("sign < 2")
    wide = read.groupBy(*keys, "gene").agg(*[F.sum(F.col(n) * F.col("sign")).alias(n) for n in names])
    return metrics.wide_scores(wide, scored, [*keys, "gene"], names)
