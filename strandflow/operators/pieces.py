"""Sequences in pieces: rows (keys, piece, offset, bases) of bounded length instead of one row for each sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined(parts: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Parts (keys, offset, bases) of sequences, in any order and of any length but without gaps, to pieces of `size` bases, the
    last one shorter: a part is cut at the borders of pieces, and no more than a piece is ever gathered."""
    length = F.length("bases").cast("long")
    numbers = F.sequence(F.floor(F.col("offset") / size), F.floor((F.col("offset") + length - 1) / size))
    cut = parts.where(length > 0).withColumn("piece", F.explode(numbers))
    low, high = F.greatest(F.col("offset"), F.col("piece") * size), F.least(F.col("offset") + length, (F.col("piece") + 1) * size)
    own = F.substring("bases", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int"))
    rows = cut.select(*keys, "piece", F.struct(low.alias("at"), own.alias("bases")).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["bases"]), "")
    return rows.groupBy(*keys, "piece").agg(whole.alias("bases")).select(*keys, "piece", (F.col("piece") * size).alias("offset"), "bases")


def cut(sequences: DataFrame, keys: Sequence[str], size: int, seq: str = "sequence") -> DataFrame:
    """Pieces of sequences that are rows already, in linear time; an empty sequence has none."""
    found = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = sequences.select(*keys, F.posexplode(found).alias("piece", "bases"))
    return rows.select(*keys, F.col("piece").cast("long").alias("piece"), (F.col("piece").cast("long") * size).alias("offset"), "bases")


def cut_with_edges(sequences: DataFrame, keys: Sequence[str], size: int, edge: int, seq: str = "sequence") -> DataFrame:
    """The same with the first `edge` bases of the next piece behind each one, and n_pieces, without a join; an edge is at most a
    piece long."""
    found = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    edged = F.transform("__pieces", lambda x, i: F.concat(x, F.coalesce(F.substring(F.get("__pieces", i + 1), 1, edge), F.lit(""))))
    rows = sequences.select(*keys, found.alias("__pieces")).select(*keys, F.size("__pieces").cast("long").alias("n_pieces"), F.posexplode(edged).alias("piece", "bases"))
    return rows.select(*keys, F.col("piece").cast("long").alias("piece"), "n_pieces", (F.col("piece").cast("long") * size).alias("offset"), "bases")


def with_edges(pieces: DataFrame, keys: Sequence[str], edge: int) -> DataFrame:
    """Pieces with the first `edge` bases of the next one behind them, so that what begins in a piece can be read from it alone:
    k-mers with an edge of k - 1, windows with one of their size less one. An edge is at most a piece long."""
    by = [*keys, "piece"]
    heads = pieces.select(*keys, (F.col("piece") - 1).alias("piece"), F.substring("bases", 1, edge).alias("__edge"))
    return pieces.join(heads, by, "left").withColumn("bases", F.concat("bases", F.coalesce("__edge", F.lit("")))).drop("__edge")


def lengths(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pieces.groupBy(*keys).agg(F.max(F.col("offset") + F.length("bases")).alias("length"))


def windows(pieces: DataFrame, keys: Sequence[str], size: int, step: int) -> DataFrame:
    """(keys, start, bases): windows of `size` bases at every `step`, those that fit; pieces are at least a window long."""
    rows = with_edges(pieces, keys, size - 1)
    first = F.pmod(-F.col("offset"), F.lit(step))
    own = F.length("bases") - size
    starts = F.when(own >= first, F.sequence(first, own.cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    at = rows.select(*keys, "offset", "bases", F.explode(starts).alias("__at"))
    return at.select(*keys, (F.col("offset") + F.col("__at")).alias("start"), F.substring("bases", (F.col("__at") + 1).cast("int"), F.lit(size)).alias("bases"))
