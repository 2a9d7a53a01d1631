"""Queries of whole data sets, gene graphs, alignments, text and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import scores
from strandflow.operators import annotate as A
from strandflow.operators import coverage as V
from strandflow.operators import dataset as D
from strandflow.operators import genes as G
from strandflow.operators import meta as T
from strandflow.operators import ranks
from strandflow.plans.inputs import FEATURES, PAIRS, features, pairs, track
from strandflow.plans.registry import Tables, query
from strandflow.plans.sequences import _GRID, grid


@query("project_modes", "SELECT doc_id, lang AS err_sample, source AS is_annotated FROM documents")
def project_modes(t: Tables) -> DataFrame:
    named = t.documents.withColumnsRenamed({"text": "x", "lang": "err_sample", "source": "is_annotated"})
    return D.project_modes(named, ["anno_meta"], ["doc_id"])


@query("filter_fully_erroneous", "SELECT doc_id, quality FROM labels WHERE quality = 1 AND toxic = 0")
def filter_fully_erroneous(t: Tables) -> DataFrame:
    rows = t.labels.withColumn("err_sample", F.col("quality") == 1).withColumn("is_annotated", F.col("toxic") == 0)
    return D.keep_valid(rows).select("doc_id", "quality")


@query("filter_keep_seqids", f"WITH {FEATURES} SELECT seqid, type, count(*) AS n FROM features WHERE seqid IN (1, 2, 3, 5, 8) GROUP BY ALL")
def filter_keep_seqids(t: Tables) -> DataFrame:
    return D.keep_only(features(t), seqids=[1, 2, 3, 5, 8]).groupBy("seqid", "type").agg(F.count("*").alias("n"))


@query("mask_from_other", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def mask_from_other(t: Tables) -> DataFrame:
    return D.mask_by(t.documents.select("doc_id", "n_chars"), t.labels.where("toxic = 0"), ["doc_id"])


@query("match_existing", "SELECT d.doc_id, d.n_chars, l.quality, 'second' AS annotation_source FROM documents d LEFT JOIN labels l USING (doc_id)")
def match_existing(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left").withColumn("annotation_source", F.lit("second"))


@query("align_predictions", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def align_predictions(t: Tables) -> DataFrame:
    return D.align(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality", "toxic"), ["doc_id"])


@query("setdiff_errors", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def setdiff_errors(t: Tables) -> DataFrame:
    return D.without(t.documents.select("doc_id"), t.labels.where("toxic = 1"), ["doc_id"])


@query("intersect_genic", "SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def intersect_genic(t: Tables) -> DataFrame:
    of = lambda kind: t.events.where(F.col("event_type") == kind).select("user_id")
    return of("purchase").intersect(of("error"))


@query("merge_classes", f"WITH {PAIRS} SELECT CASE WHEN ref = 1 THEN 0 ELSE ref END AS cls, count(*) AS n FROM pairs GROUP BY ALL")
def merge_classes(t: Tables) -> DataFrame:
    return pairs(t).select(A.merge_classes(F.col("ref")).cast("long").alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))


@query("species_subset_sorted", f"""WITH {_GRID} SELECT seqid, is_plus, "start", "end", CAST(row_number() OVER (PARTITION BY seqid ORDER BY "start" > "end", "start", "end") AS BIGINT) AS row_no, CAST(NULL AS BIGINT) AS coverage FROM grid WHERE seqid IN (SELECT doc_id FROM documents WHERE source = 'src1')""")
def species_subset_sorted(t: Tables) -> DataFrame:
    rows = D.lexsorted(D.keep_only(grid(t), species=["src1"]))
    nth = F.row_number().over(Window.partitionBy("seqid").orderBy(F.col("start") > F.col("end"), "start", "end"))
    return rows.select("seqid", "is_plus", "start", "end", nth.cast("long").alias("row_no"), F.lit(None).cast("long").alias("coverage"))


@query("lexsort_chunks", f"""WITH {_GRID}, s AS (SELECT g.*, d.source AS species FROM grid g JOIN documents d ON d.doc_id = g.seqid)
    SELECT species, seqid, is_plus, "start", "end", CAST(row_number() OVER (PARTITION BY species ORDER BY seqid, "start" > "end", "start", "end") AS BIGINT) AS row_no FROM s""")
def lexsort_chunks(t: Tables) -> DataFrame:
    chunks = grid(t).select("species", "seqid", "is_plus", "start", "end")  # a written table keeps what it is given, so not the bases
    ranked = ranks.numbered(chunks, ["species"], ["seqid", F.col("start") > F.col("end"), "start", "end"], "row_no")
    return D.lexsorted(ranked).select("species", "seqid", "is_plus", "start", "end", "row_no")


@query("gff_type_filter", f"WITH {FEATURES} SELECT seqid, count(*) AS n FROM features WHERE type NOT IN ('cds', 'intron') GROUP BY seqid")
def gff_type_filter(t: Tables) -> DataFrame:
    return features(t).where(~F.col("type").isin("cds", "intron")).groupBy("seqid").agg(F.count("*").alias("n"))


@query("first_of_group", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b <> event_type")
def first_of_group(t: Tables) -> DataFrame:
    return D.first_of_group(t.events.select("user_id", "event_id", "event_type"), "event_type", "event_id", ["user_id"])


@query("multi_file_union", "SELECT 'benchmark' AS file, item_id AS seqid, length(text) AS length FROM benchmark UNION ALL SELECT 'documents', doc_id, length(text) FROM documents")
def multi_file_union(t: Tables) -> DataFrame:
    one = lambda df, name, key: df.select(F.lit(name).alias("file"), F.col(key).alias("seqid"), F.length("text").cast("long").alias("length"))
    return one(t.benchmark, "benchmark", "item_id").unionByName(one(t.documents, "documents", "doc_id"))


@query("truncate_n", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 100")
def truncate_n(t: Tables) -> DataFrame:
    return D.first_rows(t.events.select("event_id", "user_id"), 100, ["event_id"])


@query("sample_n_md5", "SELECT doc_id FROM documents ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)) LIMIT 50")
def sample_n_md5(t: Tables) -> DataFrame:
    return D.sample(t.documents.select("doc_id"), ["doc_id"], 50, "7")


@query(
    "n90_split",
    """WITH b AS (SELECT doc_id AS seqid, source AS species, n_chars AS length, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS before, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents),
    s AS (SELECT *, before < 0.9 * total AS large FROM b)
    SELECT seqid, species, large, CASE WHEN row_number() OVER (PARTITION BY species, large ORDER BY length DESC, seqid) % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM s""",
)
def n90_split(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("seqid"), F.col("source").alias("species"), F.col("n_chars").alias("length"))
    return D.n90_split(rows, ["species"]).select("seqid", "species", "large", "split")


@query(
    "most_certain",
    """WITH c AS (SELECT user_id AS chunk, sum(abs(value - 50)) AS error, floor(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END) * 10) AS stratum FROM events GROUP BY user_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY error, chunk) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM c) SELECT chunk, CAST(stratum AS BIGINT) AS stratum FROM r WHERE k <= ceil(n * 0.5)""",
)
def most_certain(t: Tables) -> DataFrame:
    chunks = t.events.groupBy(F.col("user_id").alias("chunk")).agg(F.sum(F.abs(F.col("value") - 50)).alias("error"), F.avg(F.when(F.col("event_type") == "view", 1.0).otherwise(0.0)).alias("ig"))
    return D.most_certain(chunks, 0.5, F.floor(F.col("ig") * 10)).select("chunk", "stratum")


_GRAPH = """graph AS (SELECT r_name AS species, n_name AS seqid, o_orderkey AS gene, l_suppkey AS transcript, date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) AS "start",
    date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) + CAST(l_quantity AS BIGINT) AS "end", CAST(l_quantity AS BIGINT) AS length, l_returnflag AS type
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey)"""


def _graph(t: Tables) -> DataFrame:
    """Features down to genes and genomes; the small tables are broadcast by their size."""
    start = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("long")
    places = t.customer.select("c_custkey", "c_nationkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(places, F.col("o_custkey") == F.col("c_custkey"))
    length = F.col("l_quantity").cast("long")
    return rows.select(F.col("r_name").alias("species"), F.col("n_name").alias("seqid"), F.col("o_orderkey").alias("gene"), F.col("l_suppkey").alias("transcript"), start.alias("start"), (start + length).alias("end"), length.alias("length"), F.col("l_returnflag").alias("type"))


@query("gene_borders", f'WITH {_GRAPH} SELECT species, gene, min("start") AS "start", max("end") AS "end", count(DISTINCT transcript) AS n_transcripts, min(seqid) AS seqid FROM graph WHERE type <> \'R\' GROUP BY ALL')
def gene_borders(t: Tables) -> DataFrame:
    return G.gene_borders(_graph(t).where("type <> 'R'"), ["species", "gene"])


@query("longest_transcript", f"WITH {_GRAPH}, s AS (SELECT gene, transcript, CAST(sum(length) AS BIGINT) AS coding FROM graph WHERE type = 'N' GROUP BY ALL) SELECT gene, transcript, coding FROM s QUALIFY row_number() OVER (PARTITION BY gene ORDER BY coding DESC, transcript) = 1")
def longest_transcript(t: Tables) -> DataFrame:
    return G.longest_transcript(_graph(t).where("type = 'N'"), ["gene"])


_CHAINS = "chains AS (SELECT l_orderkey AS transcript, l_linestatus AS src, string_agg(l_linenumber || '-' || (l_linenumber + 1), ',' ORDER BY l_linenumber, l_linenumber + 1) AS chain, count(*) AS n_introns FROM lineitem GROUP BY ALL)"


@query("intron_chain_match", f"WITH {_CHAINS} SELECT transcript, src, chain, n_introns, count(*) OVER (PARTITION BY chain) - count(*) OVER (PARTITION BY chain, src) AS n_matches FROM chains")
def intron_chain_match(t: Tables) -> DataFrame:
    introns = t.lineitem.select(F.col("l_orderkey").alias("transcript"), F.col("l_linestatus").alias("src"), F.col("l_linenumber").cast("long").alias("start"), (F.col("l_linenumber") + 1).cast("long").alias("end"))
    return G.intron_chain_matches(G.intron_chains(introns, ["transcript", "src"]), "src")


@query("strand_mates", f"""WITH {_GRID} SELECT p.seqid, p."start", p."end", p.chunk_idx AS plus_row, m.chunk_idx AS minus_row FROM grid p JOIN grid m ON m.seqid = p.seqid AND m."start" = p."end" AND m."end" = p."start" WHERE p.is_plus AND NOT m.is_plus""")
def strand_mates(t: Tables) -> DataFrame:
    return G.strand_mates(grid(t).withColumnRenamed("chunk_idx", "row_id"), ["seqid"])


@query("single_genome_check", "SELECT count(*) AS n FROM region WHERE r_regionkey = 0")
def single_genome_check(t: Tables) -> DataFrame:
    return D.require_one(t.region.where("r_regionkey = 0"), "genomes")


_GENES = "genes AS (SELECT o_custkey % (SELECT max(l_suppkey) + 1 FROM lineitem) AS seqid, o_orderkey AS gene, o_orderkey % 380 AS g_start, o_orderkey % 380 + 20 AS g_end FROM orders)"


@query(
    "gene_wise_scores",
    f"""WITH {PAIRS}, {_GENES}, m AS (SELECT seqid, gene, ref, pred FROM pairs JOIN genes USING (seqid) WHERE weight <> 0 AND off >= g_start AND off < g_end)
    SELECT seqid, gene, CAST(count(*) FILTER (WHERE ref = 2 AND pred = 2) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE ref <> 2 AND pred = 2) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE ref = 2 AND pred <> 2) AS BIGINT) AS fn FROM m GROUP BY ALL""",
)
def gene_wise_scores(t: Tables) -> DataFrame:
    bases = pairs(t).select("seqid", F.col("off").alias("pos"), "ref", "pred", F.col("weight").alias("sample_weight"))
    at, sequences = F.col("o_orderkey") % 380, t.lineitem.agg(F.max("l_suppkey") + 1).first()[0]
    genes = t.orders.select((F.col("o_custkey") % sequences).alias("seqid"), F.col("o_orderkey").alias("gene"), at.alias("start"), (at + 20).alias("end"))
    return G.gene_wise(bases, genes, ["seqid"], only=["exon"]).select("seqid", "gene", "tp", "fp", "fn")


_ALIGN = """align AS (SELECT l_orderkey AS qname, l_suppkey AS seqid, CAST(l_partkey AS BIGINT) AS pos, l_linestatus = 'O' AS is_plus, l_linenumber % 2 = 0 AS second, l_discount > 0.09 AS secondary, l_tax > 0.07 AS qcfail,
    1 + l_linenumber AS a, CAST(l_quantity AS BIGINT) AS b FROM lineitem), usable AS (SELECT * FROM align WHERE NOT (secondary OR qcfail)),
    blocks AS (SELECT seqid, is_plus, second, 'covered' AS kind, pos AS p_start, pos + b AS p_end FROM usable UNION ALL SELECT seqid, is_plus, second, 'spliced', pos + b, pos + b + 10 * a FROM usable
      UNION ALL SELECT seqid, is_plus, second, 'covered', pos + b + 10 * a, pos + b + 10 * a + a FROM usable)"""


def _alignments(t: Tables) -> DataFrame:
    """Alignments with a clip, two matches, an intron and an insertion."""
    a, b = (F.col("l_linenumber") + 1).cast("string"), F.col("l_quantity").cast("long").cast("string")
    cigar = F.concat(F.lit("5S"), b, F.lit("M"), a, F.lit("0N"), F.lit("2I"), a, F.lit("="))
    return t.lineitem.select(
        F.col("l_orderkey").alias("qname"), F.col("l_suppkey").alias("seqid"), F.col("l_partkey").cast("long").alias("pos"), (F.col("l_linestatus") == "O").alias("is_plus"),
        (F.col("l_linenumber") % 2 == 0).alias("second"), F.lit(False).alias("unmapped"), (F.col("l_discount") > 0.09).alias("secondary"), (F.col("l_tax") > 0.07).alias("qcfail"), cigar.alias("cigar"),
    )


@query("align_scan", f"WITH {_ALIGN} SELECT seqid, is_plus, count(*) AS n, min(pos) AS first FROM usable GROUP BY ALL")
def align_scan(t: Tables) -> DataFrame:
    return V.usable(_alignments(t)).groupBy("seqid", "is_plus").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query("cigar_intervals", f"WITH {_ALIGN} SELECT seqid, kind, count(*) AS n, CAST(sum(p_start) AS BIGINT) AS starts, CAST(sum(p_end) AS BIGINT) AS ends FROM blocks GROUP BY ALL")
def cigar_intervals(t: Tables) -> DataFrame:
    return V.blocks(V.usable(_alignments(t)).select("seqid", "pos", "cigar")).groupBy("seqid", "kind").agg(F.count("*").alias("n"), F.sum("p_start").alias("starts"), F.sum("p_end").alias("ends"))


@query("sense_strand", f"WITH {_ALIGN} SELECT is_plus, second, CASE WHEN second THEN is_plus ELSE NOT is_plus END AS sense, CASE WHEN second THEN NOT is_plus ELSE is_plus END AS sense_first, count(*) AS n FROM usable GROUP BY ALL")
def sense_strand(t: Tables) -> DataFrame:
    args = F.col("is_plus"), F.col("second")
    return V.usable(_alignments(t)).groupBy("is_plus", "second", V.sense_is_plus(*args).alias("sense"), V.sense_is_plus(*args, sense=1).alias("sense_first")).agg(F.count("*").alias("n"))


@query(
    "tn5_shift",
    f"""WITH {_ALIGN}, s AS (SELECT seqid, is_plus, greatest(0, CASE WHEN is_plus THEN p_start + 4 ELSE p_start END) AS s, least(length, CASE WHEN is_plus THEN p_end ELSE p_end - 5 END) AS e
      FROM blocks JOIN (SELECT seqid, max(p_end) - 2 AS length FROM blocks GROUP BY seqid) USING (seqid) WHERE kind = 'covered')
    SELECT seqid, is_plus, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS bases FROM s WHERE s < e GROUP BY ALL""",
)
def tn5_shift(t: Tables) -> DataFrame:
    found = V.blocks(V.usable(_alignments(t)).select("seqid", "is_plus", "pos", "cigar"))
    lengths = found.groupBy("seqid").agg((F.max("p_end") - 2).alias("length"))  # two bases short of the last block, so that it is clipped
    cut = V.tn5_shift(found.where("kind = 'covered'").join(lengths, "seqid"), F.col("length"))
    return cut.groupBy("seqid", "is_plus").agg(F.count("*").alias("n"), F.sum(F.col("p_end") - F.col("p_start")).alias("bases"))


@query(
    "ascii_table_parse",
    "WITH r AS (SELECT p_partkey, 0 AS table_no, 0 AS row_no, p_brand AS c0, 'f1' AS c1 FROM part UNION ALL SELECT p_partkey, 0, 1, p_type, CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 1, 0, 'b', CAST(p_partkey AS VARCHAR) FROM part) SELECT p_partkey, CAST(table_no AS BIGINT) AS table_no, CAST(row_no AS BIGINT) AS row_no, c0, c1 FROM r",
)
def ascii_table_parse(t: Tables) -> DataFrame:
    n, part = F.lit("\n"), F.col
    log = F.concat(F.lit("x PRINT +--+\nx PRINT | "), part("p_brand"), F.lit(" | f1 |\n| "), part("p_type"), F.lit(" | "), part("p_size").cast("string"), F.lit(" |\n+--+\ndone"), n, F.lit("| b | "), part("p_partkey").cast("string"), F.lit(" |"))
    rows = T.table_rows(T.numbered_lines(t.part.select("p_partkey", log.alias("log")), ["p_partkey"], "log"), ["p_partkey"])
    return rows.select("p_partkey", "table_no", "row_no", F.get("cells", F.lit(0)).alias("c0"), F.get("cells", F.lit(1)).alias("c1"))


@query(
    "meta_parse",
    """SELECT page_id, coalesce(nullif(regexp_extract(url, '/([0-9]+)', 1), ''), 'NA') AS number, coalesce(nullif(regexp_extract(url, 'page=([0-9]+)', 1), ''), 'NA') AS page FROM pages""",
)
def meta_parse(t: Tables) -> DataFrame:
    return t.pages.select("page_id", *T.labelled_numbers(F.col("url"), {"number": "/([0-9]+)", "page": "page=([0-9]+)"}))


@query("meta_unpivot", "SELECT p_partkey, 'p_retailprice' AS name, p_retailprice AS value FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS DOUBLE) FROM part")
def meta_unpivot(t: Tables) -> DataFrame:
    return T.unpivot(t.part, ["p_partkey"], ["p_size", "p_retailprice"])


@query("pivot_methods", """SELECT o_custkey % 50 AS species, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY ALL""")
def pivot_methods(t: Tables) -> DataFrame:
    counts = t.orders.groupBy((F.col("o_custkey") % 50).alias("species"), "o_orderstatus").agg(F.count("*").alias("n"))
    wide = T.pivot(counts, ["species"], "o_orderstatus", ["F", "O", "P"], "n")
    return wide.select("species", *[F.coalesce(k, F.lit(0)).alias(f"n_{k.lower()}") for k in "FOP"])


_REGISTRY = "registry AS (SELECT p_type AS lineage, p_size AS priority, p_partkey AS model FROM part)"


def _registry(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_type").alias("lineage"), F.col("p_size").alias("priority"), F.col("p_partkey").alias("model"))


@query("registry_ranked", f"WITH {_REGISTRY} SELECT lineage, model, priority, CAST(row_number() OVER (PARTITION BY lineage ORDER BY priority, model) AS BIGINT) AS rank FROM registry QUALIFY row_number() OVER (PARTITION BY lineage ORDER BY priority, model) <= 3")
def registry_ranked(t: Tables) -> DataFrame:
    return T.by_priority(_registry(t), ["lineage"], 3, ["priority", "model"])


@query(
    "registry_current",
    f"WITH {_REGISTRY}, b AS (SELECT *, min(priority) OVER (PARTITION BY lineage) AS best FROM registry), p AS (SELECT s_suppkey * 7 AS model FROM supplier) SELECT p.model, b.priority IS NOT NULL AS recognized, coalesce(b.priority > b.best, false) AS better_exists FROM p LEFT JOIN b USING (model)",
)
def registry_current(t: Tables) -> DataFrame:
    return T.current_models(_registry(t), t.supplier.select((F.col("s_suppkey") * 7).alias("model")))


@query("name_map", "SELECT page_id, regexp_replace('data/' || page_id || '/y', '/y$', '/phases') AS phases, regexp_extract(url, '^[a-z]+://([^./]*)', 1) AS stem FROM pages")
def name_map(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    return t.pages.select("page_id", T.phase_name(F.concat(F.lit("data/"), F.col("page_id").cast("string"), F.lit("/y"))).alias("phases"), T.stem(host).alias("stem"))


@query(
    "species_stats",
    f"""WITH {PAIRS} SELECT batch AS species, count(*) AS bases, round(count(*) FILTER (WHERE weight = 0) / count(*), 9) AS error_rate, round(count(*) FILTER (WHERE ref = 0 AND weight = 0) / count(*) FILTER (WHERE weight = 0), 9) AS ig_error_rate,
    {", ".join(f"round(count(*) FILTER (WHERE ref = {k}) / count(*), 9) AS rate_{k}" for k in range(4))} FROM pairs GROUP BY batch""",
)
def species_stats(t: Tables) -> DataFrame:
    masked, n = F.col("weight") == 0, F.count("*")
    return pairs(t).groupBy(F.col("batch").alias("species")).agg(
        n.alias("bases"),
        F.round(F.count_if(masked) / n, 9).alias("error_rate"),
        F.round(F.try_divide(F.count_if(masked & (F.col("ref") == 0)).cast("double"), F.count_if(masked)), 9).alias("ig_error_rate"),
        *[F.round(F.count_if(F.col("ref") == k) / n, 9).alias(f"rate_{k}") for k in range(4)],
    )


@query(
    "large_eval_summary",
    """SELECT event_type, round(median(value), 9) AS all_median, round(avg(value), 9) AS all_mean, round(stddev_pop(value), 9) AS all_std, round(median(value) FILTER (WHERE user_id % 2 = 0), 9) AS held_out_median,
    round(avg(value) FILTER (WHERE user_id % 2 = 0), 9) AS held_out_mean, round(stddev_pop(value) FILTER (WHERE user_id % 2 = 0), 9) AS held_out_std FROM events GROUP BY event_type""",
)
def large_eval_summary(t: Tables) -> DataFrame:
    found = D.large_summary(t.events, ["event_type"], "value", {"all": F.lit(True), "held_out": F.col("user_id") % 2 == 0})
    return found.select("event_type", *[F.round(c, 9).alias(c) for c in found.columns[1:]])


@query("describe_methods", "SELECT o_orderstatus AS method, round(avg(o_totalprice), 2) AS mean_value, round(stddev_samp(o_totalprice), 2) AS std_value, round(2 / (1 / avg(o_totalprice) + 1 / max(o_totalprice)), 2) AS harmonic FROM orders GROUP BY ALL")
def describe_methods(t: Tables) -> DataFrame:
    v = F.col("o_totalprice")
    return t.orders.groupBy(F.col("o_orderstatus").alias("method")).agg(F.round(F.avg(v), 2).alias("mean_value"), F.round(F.stddev_samp(v), 2).alias("std_value"), F.round(scores.harmonic_f1(F.avg(v), F.max(v)), 2).alias("harmonic"))


@query("fraction_of_total", "WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL) SELECT c_mktsegment, c_nationkey, round(n / sum(n) OVER (PARTITION BY c_nationkey), 9) AS fraction FROM c")
def fraction_of_total(t: Tables) -> DataFrame:
    counts = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return D.fraction_of_total(counts, ["c_nationkey"], "n").select("c_mktsegment", "c_nationkey", F.round("fraction", 9).alias("fraction"))


@query("stats_rollup", f"WITH {PAIRS} SELECT batch, ref, count(*) AS n, CAST(sum(weight) AS BIGINT) AS unmasked FROM pairs GROUP BY ROLLUP (batch, ref)")
def stats_rollup(t: Tables) -> DataFrame:
    return pairs(t).rollup("batch", "ref").agg(F.count("*").alias("n"), F.sum("weight").alias("unmasked"))


@query("position_averages", "SELECT event_type, extract('hour' FROM ts) AS position, round(avg(value), 9) AS mean_value FROM events GROUP BY ALL")
def position_averages(t: Tables) -> DataFrame:
    from strandflow.operators.overlap import position_means

    return position_means(t.events.withColumn("position", F.hour("ts").cast("long")), ["event_type"], "position", "value").withColumn("mean_value", F.round("mean_value", 9))


@query("species_track_counts", "SELECT user_id AS seqid, count(*) AS n FROM events GROUP BY ALL")
def species_track_counts(t: Tables) -> DataFrame:
    return track(t).groupBy("seqid").agg(F.count("*").alias("n"))
