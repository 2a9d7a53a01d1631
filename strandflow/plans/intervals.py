"""Queries of intervals and annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.operators import annotate as A
from strandflow.operators import intervals as I
from strandflow.plans.inputs import FEATURES, LENGTH, TRACK, coordinates, features, track
from strandflow.plans.registry import Tables, query
from strandflow.plans.sequences import _GRID, grid

_CLIP = 2500
_BASES = f"""{FEATURES}, clipped AS (SELECT *, p_end - p_start AS full_length, least(p_end, {_CLIP}) AS c_end FROM features WHERE p_start < {_CLIP}),
  covered AS (SELECT seqid, is_plus, type, full_length, unnest(range(p_start, c_end)) AS pos FROM clipped),
  raster AS (SELECT seqid, is_plus, pos, max(CASE WHEN type = 'transcript' THEN 1 ELSE 0 END) AS tr, max(CASE WHEN type = 'cds' THEN 1 ELSE 0 END) AS cds,
    max(CASE WHEN type = 'intron' THEN 1 ELSE 0 END) AS intron, max(CASE WHEN type = 'transcript' THEN full_length ELSE 0 END) AS gene_length FROM covered GROUP BY ALL)"""


def _plus(t: Tables) -> DataFrame:
    return I.to_plus_frame(features(t)).drop("start", "end")


@query("strand_filter", f"WITH {FEATURES} SELECT type, count(*) AS n FROM features WHERE is_plus GROUP BY type")
def strand_filter(t: Tables) -> DataFrame:
    return features(t).where("is_plus").groupBy("type").agg(F.count("*").alias("n"))


@query(
    "clip_interval",
    f"""WITH {FEATURES} SELECT seqid, is_plus, count(*) AS n, CAST(sum(least(p_end, 2000) - greatest(p_start, 100)) AS BIGINT) AS bases, CAST(sum(p_end - p_start) AS BIGINT) AS full_bases
    FROM features WHERE greatest(p_start, 100) < least(p_end, 2000) GROUP BY ALL""",
)
def clip_interval(t: Tables) -> DataFrame:
    cut = I.clip(_plus(t), F.lit(100), F.lit(2000))
    return cut.groupBy("seqid", "is_plus").agg(F.count("*").alias("n"), F.sum(F.col("p_end") - F.col("p_start")).alias("bases"), F.sum("full_length").alias("full_bases"))


@query("feature_raster", f"WITH {_BASES} SELECT seqid, is_plus, CAST(CASE WHEN tr = 0 THEN 0 WHEN intron = 1 THEN 3 WHEN cds = 1 THEN 2 ELSE 1 END AS BIGINT) AS cls, count(*) AS n FROM raster GROUP BY ALL")
def feature_raster(t: Tables) -> DataFrame:
    runs = A.class_segments(features(t), ["seqid", "is_plus"], F.lit(_CLIP), width=512)
    cls = A.class_of(F.col("transcript"), F.col("cds"), F.col("intron")).cast("long")
    return runs.groupBy("seqid", "is_plus", cls.alias("cls")).agg(F.sum(F.col("end") - F.col("start")).alias("n"))


@query("gene_lengths", f"WITH {_BASES} SELECT seqid, is_plus, CAST(sum(gene_length) AS BIGINT) AS total, max(gene_length) AS longest FROM raster GROUP BY ALL")
def gene_lengths(t: Tables) -> DataFrame:
    key = ["seqid", "is_plus"]
    runs = A.gene_length_segments(features(t), key, F.lit(_CLIP), width=512)
    found = runs.groupBy(*key).agg(F.sum((F.col("end") - F.col("start")) * F.col("gene_length")).alias("total"), F.max("gene_length").alias("longest"))
    every = _plus(t).where(F.col("p_start") < _CLIP).select(*key).distinct()
    return every.join(found, key, "left").select(*key, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "longest")])


@query(
    "range_join_binned",
    f"""WITH {FEATURES} SELECT a.seqid, a.is_plus, count(*) AS n, CAST(sum(least(a.p_end, b.p_end) - greatest(a.p_start, b.p_start)) AS BIGINT) AS shared
    FROM features a JOIN features b ON a.seqid = b.seqid AND a.is_plus = b.is_plus AND a.p_start < b.p_end AND b.p_start < a.p_end WHERE a.type = 'cds' AND b.type = 'intron' GROUP BY ALL""",
)
def range_join_binned(t: Tables) -> DataFrame:
    plus = _plus(t).select("seqid", "is_plus", "type", "p_start", "p_end")
    cds = plus.where("type = 'cds'").drop("type")
    introns = plus.where("type = 'intron'").select("seqid", "is_plus", F.col("p_start").alias("i_start"), F.col("p_end").alias("i_end"))
    both = I.range_join(cds, introns, ["seqid", "is_plus"], ("p_start", "p_end"), ("i_start", "i_end"), 64)
    shared = F.least("p_end", "i_end") - F.greatest("p_start", "i_start")
    return both.groupBy("seqid", "is_plus").agg(F.count("*").alias("n"), F.sum(shared).alias("shared"))


@query(
    "interval_bucket_join",
    f"""WITH {FEATURES}, splits AS (SELECT s_suppkey AS seqid, unnest(range(0, {LENGTH}, 500)) AS s_start FROM supplier)
    SELECT seqid, s_start, count(*) AS n, CAST(count(*) FILTER (WHERE p_end > s_start + 500) AS BIGINT) AS n_trailing FROM features JOIN splits USING (seqid) WHERE p_start < s_start + 500 AND p_end > s_start GROUP BY ALL""",
)
def interval_bucket_join(t: Tables) -> DataFrame:
    splits = coordinates(t).select("seqid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(500).cast("long"))).alias("s_start")).withColumn("s_end", F.col("s_start") + 500)
    both = I.range_join(_plus(t).select("seqid", "p_start", "p_end"), splits, ["seqid"], ("p_start", "p_end"), ("s_start", "s_end"), 500)
    return both.groupBy("seqid", "s_start").agg(F.count("*").alias("n"), F.count_if(F.col("p_end") > F.col("s_end")).alias("n_trailing"))


@query("pileup_coverage", f"""WITH {FEATURES}, b AS (SELECT seqid, is_plus, unnest(range(p_start, p_end)) AS pos FROM features), d AS (SELECT seqid, is_plus, pos, count(*) AS depth FROM b GROUP BY ALL)
    SELECT seqid, is_plus, depth, count(*) AS bases FROM d GROUP BY ALL""")
def pileup_coverage(t: Tables) -> DataFrame:
    runs = I.depth(_plus(t), ["seqid", "is_plus"], width=256)
    return runs.groupBy("seqid", "is_plus", "depth").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


@query("coverage_totals", f"WITH {FEATURES} SELECT seqid, count(*) AS reads, CAST(sum(CASE WHEN type <> 'intron' THEN p_end - p_start ELSE 0 END) AS BIGINT) AS covered, CAST(sum(CASE WHEN type = 'intron' THEN p_end - p_start ELSE 0 END) AS BIGINT) AS spliced FROM features GROUP BY seqid")
def coverage_totals(t: Tables) -> DataFrame:
    from strandflow.operators.coverage import totals

    blocks = _plus(t).select("seqid", F.when(F.col("type") == "intron", "spliced").otherwise("covered").alias("kind"), "p_start", "p_end")
    return totals(blocks, ["seqid"])


@query("coverage_multi_track", f"""WITH {FEATURES}, b AS (SELECT phase AS track, seqid, unnest(range(p_start, p_end)) AS pos FROM features), d AS (SELECT track, seqid, pos, count(*) AS depth FROM b GROUP BY ALL)
    SELECT CAST(track AS BIGINT) AS track, seqid, max(depth) AS deepest, CAST(sum(depth) AS BIGINT) AS total FROM d GROUP BY ALL""")
def coverage_multi_track(t: Tables) -> DataFrame:
    runs = I.depth(_plus(t).withColumn("track", F.col("phase").cast("long")), ["track", "seqid"], width=256)
    return runs.groupBy("track", "seqid").agg(F.max("depth").alias("deepest"), F.sum((F.col("end") - F.col("start")) * F.col("depth")).alias("total"))


@query(
    "transitions",
    f"""WITH {TRACK}, n AS (SELECT seqid, pos, genic, lag(genic) OVER w AS b, lead(genic) OVER w AS a FROM track WINDOW w AS (PARTITION BY seqid ORDER BY pos))
    SELECT seqid, pos, CAST((CASE WHEN NOT genic AND a THEN 1 ELSE 0 END) + (CASE WHEN NOT b AND genic THEN 1 ELSE 0 END) AS BIGINT) AS rises,
      CAST((CASE WHEN genic AND NOT a THEN 1 ELSE 0 END) + (CASE WHEN b AND NOT genic THEN 1 ELSE 0 END) AS BIGINT) AS falls FROM n""",
)
def transitions(t: Tables) -> DataFrame:
    dense = track(t).select("seqid", "pos", F.col("genic").cast("int").alias("m"))
    return A.transitions(dense, ["seqid"], "m").select("seqid", "pos", F.col("rises").cast("long").alias("rises"), F.col("falls").cast("long").alias("falls"))


@query(
    "cds_phase",
    f"""WITH {FEATURES}, f AS (SELECT DISTINCT seqid, gene, transcript, is_plus, phase, p_start, p_end FROM features WHERE type = 'cds'),
    b AS (SELECT seqid, gene, transcript, is_plus, phase, p_start, p_end, unnest(range(p_start, p_end)) AS pos FROM f),
    k AS (SELECT is_plus, ((phase - (CASE WHEN is_plus THEN pos - p_start ELSE p_end - 1 - pos END)) % 3 + 3) % 3 AS base_phase FROM b)
    SELECT is_plus, CAST(base_phase AS BIGINT) AS base_phase, count(*) AS n FROM k GROUP BY ALL""",
)
def cds_phase(t: Tables) -> DataFrame:
    key = ["seqid", "gene", "transcript", "is_plus", "phase", "p_start", "p_end"]
    cds = _plus(t).where("type = 'cds'").select(*key).distinct()
    return A.phase_counts(cds, ["is_plus"], F.col("phase"))


@query(
    "cds_phase_spliced",
    f"""WITH {FEATURES}, f AS (SELECT DISTINCT seqid, gene, transcript, is_plus, phase, p_start, p_end FROM features WHERE type = 'cds'),
    i AS (SELECT DISTINCT seqid, is_plus, unnest(range(p_start, p_end)) AS pos FROM features WHERE type = 'intron'),
    b AS (SELECT *, unnest(range(p_start, p_end)) AS pos FROM f),
    c AS (SELECT b.* FROM b ANTI JOIN i USING (seqid, is_plus, pos)),
    k AS (SELECT *, row_number() OVER (PARTITION BY seqid, gene, transcript, is_plus, phase, p_start, p_end ORDER BY CASE WHEN is_plus THEN pos ELSE -pos END) - 1 AS k FROM c)
    SELECT seqid, is_plus, CAST(((phase - k) % 3 + 3) % 3 AS BIGINT) AS base_phase, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM k GROUP BY ALL""",
)
def cds_phase_spliced(t: Tables) -> DataFrame:
    key = ["seqid", "is_plus"]
    cds = _plus(t).where("type = 'cds'").select(*key, "gene", "transcript", "phase", "p_start", "p_end").distinct()
    introns = _plus(t).where("type = 'intron'").select(*key, "p_start", "p_end")
    found = A.phase_positions(A.coding_pieces(cds, introns, key), F.col("phase"))
    return found.groupBy(*key, "base_phase").agg(F.sum("n").alias("n"), F.sum((F.col("first") + F.col("last")) * F.col("n") / 2).cast("long").alias("places"))


@query(
    "contig_segments",
    f"""WITH {_GRID}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY seqid ORDER BY NOT is_plus, chunk_idx) - 1 AS BIGINT) AS row_id FROM grid),
    l AS (SELECT *, lag("start") OVER w AS s0, lag("end") OVER w AS e0 FROM r WINDOW w AS (PARTITION BY seqid ORDER BY row_id)),
    b AS (SELECT *, sum(CASE WHEN s0 IS NULL THEN 0 WHEN ("start" < "end") <> (s0 < e0) OR abs("end" - "start") <> 400 OR abs(e0 - s0) <> 400 OR "start" <> e0 THEN 1 ELSE 0 END) OVER (PARTITION BY seqid ORDER BY row_id) AS k FROM l)
    SELECT seqid, min(row_id) AS first_row, max(row_id) + 1 AS end_row FROM b GROUP BY seqid, k""",
)
def contig_segments(t: Tables) -> DataFrame:
    rows = grid(t).withColumn("row_id", (F.row_number().over(Window.partitionBy("seqid").orderBy(~F.col("is_plus"), "chunk_idx")) - 1).cast("long"))
    return I.contiguous_segments(rows, 400, ["seqid"])


@query("contiguous_ranges", "SELECT user_id AS seqid, event_type, min(event_id) AS first_row, count(*) AS n FROM events GROUP BY ALL")
def contiguous_ranges(t: Tables) -> DataFrame:
    return I.key_ranges(t.events.withColumnRenamed("user_id", "seqid"), ["seqid", "event_type"], "event_id")


@query("seq_ranges", "SELECT source AS species, lang AS seqid, min(doc_id) AS first_row, count(*) AS n FROM documents GROUP BY ALL")
def seq_ranges(t: Tables) -> DataFrame:
    return I.key_ranges(t.documents.select(F.col("source").alias("species"), F.col("lang").alias("seqid"), "doc_id"), ["species", "seqid"], "doc_id")


@query(
    "bool_stretches",
    f"""WITH {TRACK}, l AS (SELECT *, lag(genic) OVER (PARTITION BY seqid ORDER BY pos) AS b FROM track),
    k AS (SELECT *, sum(CASE WHEN b IS NOT NULL AND b <> genic THEN 1 ELSE 0 END) OVER (PARTITION BY seqid ORDER BY pos) AS k FROM l)
    SELECT seqid, genic, min(pos) AS "start", max(pos) + 1 AS "end", count(*) AS n FROM k GROUP BY seqid, genic, k""",
)
def bool_stretches(t: Tables) -> DataFrame:
    return I.runs_of(track(t).select("seqid", "pos", "genic"), ["seqid"], "pos", "genic")


@query("coord_rates", f"""WITH {_BASES} SELECT seqid, count(*) AS n, round(avg(CASE WHEN tr = 0 THEN 1.0 ELSE 0.0 END), 9) AS intergenic_rate, round(avg(CASE WHEN intron = 1 THEN 1.0 ELSE 0.0 END), 9) AS masked_rate FROM raster GROUP BY seqid""")
def coord_rates(t: Tables) -> DataFrame:
    runs = A.class_segments(features(t), ["seqid", "is_plus"], F.lit(_CLIP), width=512).withColumn("n", F.col("end") - F.col("start"))
    share = lambda keep: F.round(F.sum(F.when(keep, F.col("n")).otherwise(0)) / F.sum("n"), 9)
    return runs.groupBy("seqid").agg(F.sum("n").alias("n"), share(F.col("transcript") == 0).alias("intergenic_rate"), share(F.col("intron") == 1).alias("masked_rate"))


@query(
    "covered_stretches",
    f"""WITH {FEATURES}, r AS (SELECT seqid, is_plus, p_start, p_end, max(p_end) OVER (PARTITION BY seqid, is_plus ORDER BY p_start, p_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM features WHERE type = 'transcript'),
    k AS (SELECT *, sum(CASE WHEN p_start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY seqid, is_plus ORDER BY p_start, p_end ROWS UNBOUNDED PRECEDING) AS k FROM r)
    SELECT seqid, is_plus, min(p_start) AS "start", max(p_end) AS "end" FROM k GROUP BY seqid, is_plus, k""",
)
def covered_stretches(t: Tables) -> DataFrame:
    return A.union_of(_plus(t).where("type = 'transcript'"), ["seqid", "is_plus"])
