"""Helpers that the corpus operators share: tables, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.scratch import materialise, release, scope  # noqa: F401

#: Word separators of every contract here: space and U+0009 to U+000D.
SEPARATORS = r"[\x20\x09-\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"

#: A side of a join is broadcast only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 20_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id (long) and text (null: empty); further columns, whatever their names, go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of about 1 MB for Python workers, where the session still has Spark's default (64 MB, which is a whole task's
    texts): an executor holds several batches of each task on and off its heap, and gives back little of what it once took."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "1m")


def words_of(text: Column) -> Column:
    """Array of the words of a text; an empty array if it has none."""
    inner = F.btrim(text, F.lit(SEPARATOR_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SEPARATORS, -1))


def repeated(df: DataFrame, n: Column, nth: str = "__nth", block: int = 10_000) -> DataFrame:
    """Each row n times, numbered from 0 in column nth; numbers are made in blocks, so no row holds a long array."""
    zero, size = F.lit(0).cast("long"), F.lit(block).cast("long")
    blocks = df.where(n > 0).withColumn("__from", F.explode(F.sequence(zero, n - 1, size)))
    return blocks.withColumn(nth, F.explode(F.sequence(F.col("__from"), F.least(n, F.col("__from") + block) - 1))).drop("__from")


#: The same for rows of two numbers.
BROADCAST_PAIRS = 1_000_000


def tagged(docs: DataFrame, text: Column) -> DataFrame:
    """docs with __tag, a hash of the text, which with doc_id tells rows apart."""
    return docs.withColumn("__tag", F.xxhash64(text))


def with_pairs(docs: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    """Tagged documents that are (left_semi) or are not (left_anti) among the pairs (doc_id, tag), a written table. Texts are
    shuffled only if the pairs are too many to be broadcast."""
    side = broadcast_if_small(pairs.select(F.col("doc_id").alias("__pair_id"), F.col("tag").alias("__pair_tag")), pairs.count(), BROADCAST_PAIRS)
    return docs.join(side, docs["doc_id"].eqNullSafe(F.col("__pair_id")) & (docs["__tag"] == F.col("__pair_tag")), how)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit; Spark's shuffled join handles the rest."""
    return F.broadcast(df) if rows <= limit else df


def join_by_hot_key(left: DataFrame, lookup: DataFrame, key: str, weight: str, share: int = 2000, narrow: bool = True) -> DataFrame:
    """left joined (inner) to lookup, a written table, unique on key; weight in lookup is the number of left rows of the key.

    A lookup of few rows (of a few numbers, if narrow) is broadcast. Of a larger one, keys with over 1/share of all left rows
    are at most `share` keys, so that part is broadcast, and no task gathers a hot key. The rest, of which no key is large,
    goes by a shuffled join.
    """
    total, rows = lookup.agg(F.coalesce(F.sum(weight), F.lit(0)), F.count("*")).first()
    if narrow and rows <= BROADCAST_PAIRS:
        return left.join(F.broadcast(lookup), key)
    limit = max(1000, total // share)
    hot = lookup.where(F.col(weight) > limit)
    if not hot.take(1):
        return left.join(lookup, key)
    hot_keys = F.broadcast(hot.select(key))
    return left.join(F.broadcast(hot), key).unionByName(left.join(hot_keys, key, "left_anti").join(lookup.where(F.col(weight) <= limit), key))


def join_by_copies(left: DataFrame, lookup: DataFrame, key: str, weight: str, spread: Column, share: int = 2000) -> DataFrame:
    """The same for a lookup with wide rows, which are never broadcast: a row whose key has over 1/share of all left rows is
    copied once for each such share, and left rows are dealt to the copies by the hash of `spread`. The copies are at most
    `share` more than the rows, and only keys and numbers of copies, of at most `share` keys, are broadcast."""
    total = lookup.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    copies = F.ceil(F.col(weight) / max(1000, total // share)).cast("int")
    hot = lookup.select(key, copies.alias("__copies")).where("__copies > 1")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("__copy", F.pmod(F.xxhash64(spread), F.coalesce("__copies", F.lit(1))).cast("int")).drop("__copies")
    return dealt.join(lookup.withColumn("__copy", F.explode(F.sequence(F.lit(0), copies - 1))), [key, "__copy"]).drop("__copy")
