"""How the driver's tables stand in for the engine's inputs: as DataFrames, and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.plans.registry import Tables

#: Length of the stand-in coordinates, in bases.
LENGTH = 2600
CHUNK = 400


def pairs(t: Tables) -> DataFrame:
    """Reference and predicted class of four, sample weight, batch: from lineitem."""
    return t.lineitem.select(
        (F.col("l_linenumber") % 4).cast("long").alias("ref"),
        (F.col("l_quantity").cast("long") % 4).alias("pred"),
        F.when(F.col("l_returnflag") != "N", 1).otherwise(0).alias("weight"),
        (F.col("l_orderkey") % 10).alias("batch"),
        F.col("l_suppkey").alias("seqid"),
        (F.col("l_partkey") % CHUNK).alias("off"),
        F.col("l_tax").alias("l_tax"),
        F.col("l_discount").alias("l_discount"),
        F.col("l_shipdate").alias("l_shipdate"),
    )


PAIRS = f"""pairs AS (SELECT CAST(l_linenumber % 4 AS BIGINT) AS ref, CAST(l_quantity AS BIGINT) % 4 AS pred,
  CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS weight, l_orderkey % 10 AS batch, l_suppkey AS seqid,
  l_partkey % {CHUNK} AS off, l_tax, l_discount, l_shipdate FROM lineitem)"""


def features(t: Tables) -> DataFrame:
    """Stranded features in the reference frame (minus: start > end): from lineitem."""
    start = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("long")
    end = start + F.col("l_quantity").cast("long")
    plus = F.col("l_linestatus") == "O"
    return t.lineitem.select(
        F.col("l_suppkey").alias("seqid"),
        plus.alias("is_plus"),
        F.when(plus, start).otherwise(end - 1).alias("start"),
        F.when(plus, end).otherwise(start - 1).alias("end"),
        F.when(F.col("l_returnflag") == "A", "transcript").when(F.col("l_returnflag") == "N", "cds").otherwise("intron").alias("type"),
        (F.col("l_linenumber") % 3).alias("phase"),
        F.col("l_orderkey").alias("gene"),
        F.col("l_partkey").alias("transcript"),
    )


#: The same, with the plus-frame interval [p_start, p_end) beside it.
FEATURES = """features AS (SELECT l_suppkey AS seqid, l_linestatus = 'O' AS is_plus,
  CASE WHEN l_returnflag = 'A' THEN 'transcript' WHEN l_returnflag = 'N' THEN 'cds' ELSE 'intron' END AS type,
  CAST(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) AS BIGINT) AS p_start,
  CAST(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) AS BIGINT) + CAST(l_quantity AS BIGINT) AS p_end,
  l_linenumber % 3 AS phase, l_orderkey AS gene, l_partkey AS transcript FROM lineitem)"""


def coordinates(t: Tables) -> DataFrame:
    """Coordinates of one genome: from supplier."""
    return t.supplier.select(F.col("s_suppkey").alias("seqid"), F.concat(F.lit("sp"), F.col("s_nationkey")).alias("species"), F.lit(LENGTH).cast("long").alias("length"))


def sequences(t: Tables) -> DataFrame:
    """Sequences over A, C, G, T, N, one letter for each of the text: from documents."""
    text = F.coalesce("text", F.lit(""))
    return t.documents.select(F.col("doc_id").alias("seqid"), F.col("source").alias("species"), F.regexp_replace(F.translate(text, "acgt", "ACGT"), "[^ACGT]", "N").alias("seq"), F.length(text).cast("long").alias("length"))


SEQUENCES = """sequences AS (SELECT doc_id AS seqid, source AS species,
  regexp_replace(translate(coalesce(text, ''), 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS seq FROM documents)"""


def vectors(t: Tables) -> DataFrame:
    """Probability vectors of four classes with a reference class: from embeddings."""
    p = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") + 1)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.select("vec_id", (F.col("label") % 4).cast("long").alias("ref"), (F.col("vec_id") % 5).alias("batch"), F.transform(p, lambda x: x / total).alias("p"))


VECTORS = """shifted AS (SELECT vec_id, CAST(label % 4 AS BIGINT) AS ref, vec_id % 5 AS batch,
  list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE) + 1) AS q FROM embeddings),
vectors AS (SELECT vec_id, ref, batch, list_transform(q, lambda x: x / list_sum(q)) AS p FROM shifted)"""


def track(t: Tables) -> DataFrame:
    """An ordered signal by sequence: from events. Position is the rank of the event in its sequence."""
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("event_id")
    genic = F.col("event_type").isin("click", "purchase")
    return t.events.select(F.col("user_id").alias("seqid"), (F.row_number().over(by) - 1).cast("long").alias("pos"), F.col("value").alias("value"), genic.alias("genic"), "event_type", "ts")


TRACK = """track AS (SELECT user_id AS seqid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS pos,
  value, event_type IN ('click', 'purchase') AS genic, event_type, ts FROM events)"""
