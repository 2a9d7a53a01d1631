"""Balanced shards by Karmarkar-Karp differencing, under the law `bytes`: the shards' total sizes are near equal.

Groups of equal texts are indivisible, whatever their size: a group larger than a shard's fair share has a shard to itself,
and the other shards are as near equal as that allows. Groups are taken in tiers, those of over 1/BUCKET_GROUPS of all bytes
first, then those of over 1/BUCKET_GROUPS of that, and so on; a tier is hashed into buckets of about BUCKET_GROUPS groups.
A task differences one bucket: the two partial partitions with the largest spread are combined in opposite order, again and
again, until one is left. One of these partial partitions is the bucket's share of what the tiers before left uneven, so that
small groups make up for large ones; a tier's last bucket has all that is left of the others. So nothing whole passes through
one task, and the driver sees as many numbers as there are shards.

Slots are numbered by counting rows in small (bucket, shard) cells and adding the cells' offsets, so no task holds a shard;
rows that repeat id and text are counted before they are shuffled and numbered afterwards.

Defined results: a null text has size 1, like an empty one, and both are one group; rows that repeat id and text get
slots of their own; null ids are placed; fewer groups than shards leave shards empty; an empty table gives an empty table;
only id and text are used, so further columns cannot clash.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm.common import broadcast_if_small, join_by_hot_key, materialise, repeated

#: Groups of a bucket, about.
BUCKET_GROUPS = 20_000
#: Rows of a bucket in which slots are counted.
SLOT_ROWS = 50_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions: rows of shard sums.

    Returns (place, total): column j of row i belongs in column place[i, j] of the total. Ties go by row order.
    """
    n, ways = sums.shape
    # A node holds its sums in descending order; `made` remembers for each combination which way its parts were turned.
    orders = [np.argsort(-s, kind="stable") for s in sums]
    nodes: dict[int, list[int]] = {i: sums[i][orders[i]].tolist() for i in range(n)}
    heap = [(s[-1] - s[0], i) for i, s in nodes.items()]
    heapq.heapify(heap)
    made: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = nodes.pop(a), nodes.pop(b)
        joined = [x[k] + y[ways - 1 - k] for k in range(ways)]
        order = sorted(range(ways), key=joined.__getitem__, reverse=True)
        nodes[n + len(made)] = s = [joined[k] for k in order]
        heapq.heappush(heap, (s[-1] - s[0], n + len(made)))
        made.append((a, b, order))
    where: dict[int, list[int]] = {n + len(made) - 1 if made else 0: list(range(ways))}
    for k in range(len(made) - 1, -1, -1):  # from the last combination down to the rows
        a, b, order = made[k]
        top = where.pop(n + k)
        mine = [0] * ways
        for rank, j in enumerate(order):
            mine[j] = top[rank]
        where[a], where[b] = mine, mine[::-1]
    place = np.empty((n, ways), np.int32)
    for i in range(n):
        place[i, orders[i]] = where[i]
    total = np.zeros(ways, sums.dtype)
    np.add.at(total, place.ravel(), sums.ravel())
    return place, total


def _differenced(left: list[int]):
    """Groups of a bucket get the shard that differencing them together with the partial partition `left` puts them in."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "group"], ascending=[False, True], ignore_index=True)
        sums = np.zeros((len(pdf) + 1, len(left)), np.int64)
        sums[0], sums[1:, 0] = left, pdf["size"]
        place, _ = difference(sums)
        shard_of = np.argsort(place[0])  # the shard whose part of `left` is in each column
        return pdf.assign(shard=shard_of[place[1:, 0]])[["group", "size", "n", "shard"]]

    return run


def _place(groups: DataFrame, left: np.ndarray, buckets: int) -> tuple[list[DataFrame], np.ndarray]:
    """Tables of (group, size, n, shard), and the bytes of each shard with them."""
    bucket, placed = F.pmod(F.xxhash64("group"), F.lit(buckets)), []
    for mine, share in [(bucket > 0, buckets)] * (buckets > 1) + [(bucket == 0, 1)]:
        uneven = ((left - left.min()) // share).tolist()
        placed.append(materialise(groups.where(mine).groupBy(bucket.alias("bucket")).applyInPandas(_differenced(uneven), "group binary, size long, n long, shard int")))
        left = left.copy()
        for r in placed[-1].groupBy("shard").agg(F.sum("size").alias("size")).collect():  # a row for each shard
            left[r["shard"]] += r["size"]
    return placed, left


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, text) to (doc_id, size, text_crc32, shard, slot)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group")))
    groups = materialise(rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    n_rows, total = groups.agg(F.sum("n"), F.sum("size")).first()
    least, tier, tiers = total or 0, F.lit(0), 0
    while least := least // BUCKET_GROUPS:
        tiers += 1
        tier = F.when(F.col("size") <= least, tiers).otherwise(tier)
    groups, left, placed = groups.withColumn("tier", tier), np.zeros(shards, np.int64), []
    for r in groups.groupBy("tier").agg(F.count("*").alias("n")).orderBy("tier").collect():  # a row for each tier
        more, left = _place(groups.where(F.col("tier") == r["tier"]).drop("tier"), left, -(-r["n"] // BUCKET_GROUPS))
        placed += more
    shard_of = reduce(DataFrame.unionByName, placed).drop("size") if placed else groups.select("group", "n", F.lit(0).alias("shard"))

    found = join_by_hot_key(rows, shard_of, "group", "n")
    cells = max(1, -(-(n_rows or 0) // SLOT_ROWS))
    cell = F.pmod(F.xxhash64("doc_id", "group"), F.lit(cells)).alias("cell")
    found = materialise(found.groupBy("shard", cell, "doc_id", "size", "text_crc32", "group").agg(F.count("*").alias("n")).drop("group"))
    counts = found.groupBy("shard", "cell").agg(F.sum("n").alias("n"))
    running = lambda *by: F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = broadcast_if_small(counts.select("shard", "cell", running("shard", ["cell"]).alias("before")), cells * shards)
    numbered = found.withColumn("first", running("cell", "shard", ["doc_id", "size", "text_crc32"])).join(offsets, ["shard", "cell"])
    slot = (F.col("before") + F.col("first") + F.col("__nth")).cast("long")
    return repeated(numbered, F.col("n")).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))
