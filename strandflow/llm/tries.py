"""Prefix trie of conversations: a node for each distinct sequence of first turns, with what sharing it would save.

A turn is known by a digest of its role and text. Conversations that are equal as a whole are one class, counted, before
any trie is built, so copies cost nothing. The classes are dealt out by the digest of their first turn; the subtries of a
bucket are built in one pandas call, as dictionaries from a digest to a child's number, and summed without recursion, in the
reverse order of their making, in which each node comes after all below it.

A first turn that heads more than LIMIT turns would make a task too large. Its node is left open, and its classes are dealt
out again by the next turn, and so on until every group is small or a single class. Open nodes are finished last, from the
deepest level up, from the sums of the nodes below them. The root is the open node of level zero.

The hash of the conversations that end in a node is that of a list in order, which no partial sums give. The ids are sorted
by range over many tasks, which write compressed pieces of the list; a node's pieces are then hashed one after the other, as
they come, so no list is ever held as a whole.

Defined results: turns go by their number, null first, and those of one number by their digest; null role or text is empty;
rows without conv_id are in no conversation; repeated rows are repeated turns; an empty table has no nodes, not even a root;
only conv_id, turn, role and text are used, so further columns cannot clash. A conversation is one row of its digests.
Digests have 128 bits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import BROADCAST_PAIRS, bounded_batches, broadcast_if_small, join_by_hot_key, materialise, words_of

#: Turns of a group that is built in one task, and about half of those of a bucket of groups.
LIMIT = 100_000
#: Ids of a piece of a list.
PIECE = 50_000

CONVERSATION = ["class", "path", "words", "n", "least"]
NODE = "parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, class string"


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, turns), an array of (turn, digest, words) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.size(words_of(text)).alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, turns) with the first h turns, h from 0 to most - 1 by a checksum of the id, replaced by those of the first
    conversation of the block of ids."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    heads = conversations.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("__head"), F.slice("turns", 1, most - 1).alias("__first"))
    both = conversations.withColumn("__head", F.col("conv_id") - F.col("conv_id") % block).join(heads, "__head", "left")
    first = F.coalesce(F.slice("__first", F.lit(1), h), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) to (conv_id, class, path, words): digests and numbers of words along the conversation."""
    path = F.transform("turns", lambda t: t["digest"])
    return conversations.select("conv_id", F.md5(F.array_join(path, "")).alias("class"), path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))


def list_digests(members: DataFrame) -> DataFrame:
    """(class, conv_id) to (class, ends_sha256), of the decimal ids in order, joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(ids) else np.empty(0, int)
            cuts = [k for a, b in zip(starts, [*starts[1:], len(ids)], strict=True) for k in range(a, b, PIECE)]
            blobs = [zlib.compress(",".join(map(str, ids[a:b].tolist())).encode(), 1) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(group[cuts], pa.string()), pa.array(ids[cuts], pa.int64()), pa.array(blobs, pa.binary())], names=["class", "first", "piece"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, sha = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for group, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if group != open_:
                    if open_ is not None:
                        done.append((open_, sha.hexdigest()))
                    open_, sha = group, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(zlib.decompress(blob.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], names=["class", "ends_sha256"])
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_]), pa.array([sha.hexdigest()])], names=["class", "ends_sha256"])

    bounded_batches(members.sparkSession)
    ordered = members.select("class", "conv_id").repartitionByRange("class", "conv_id").sortWithinPartitions("class", "conv_id")
    listed = ordered.mapInArrow(pieces, "class string, first long, piece binary")
    by_class = listed.repartition("class").sortWithinPartitions("class", "first").select("class", "piece")
    return by_class.mapInArrow(hashes, "class string, ends_sha256 string")


def _tries(level: int):
    """Builds the subtries of a bucket: rows (key, parent_key, parent_least, class, path, words, n, least) whose paths agree on
    their first `level` turns within a key; all nodes from that depth on."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tops: dict[str, int] = {}
        kids: list[dict[str, int]] = []
        parent: list[int] = []
        tokens: list[int] = []
        depth: list[int] = []
        n: list[int] = []
        least: list[int] = []
        ends: list[str | None] = []
        above: list[tuple[str | None, int | None]] = []

        def made(under: int, at: int, words: int, of: tuple[str | None, int | None]) -> int:
            for column, value in ((kids, {}), (parent, under), (tokens, words), (depth, at), (n, 0), (least, None), (ends, None), (above, of)):
                column.append(value)
            return len(parent) - 1

        for r in rows.itertuples(index=False):
            node = tops.get(r.key)
            if node is None:
                node = tops[r.key] = made(-1, level, int(r.words[level - 1]), (r.parent_key, r.parent_least))
            for d in range(level, len(r.path) + 1):
                if d > level:
                    child = kids[node].get(r.path[d - 1])
                    if child is None:
                        child = kids[node][r.path[d - 1]] = made(node, d, int(r.words[d - 1]), (None, None))
                    node = child
                n[node] += r.n
                least[node] = r.least if least[node] is None else min(least[node], r.least)
            ends[node] = r[0]
        leaves, saved = [0] * len(parent), [0] * len(parent)
        for node in reversed(range(len(parent))):
            leaves[node] = leaves[node] or 1
            saved[node] += (n[node] - 1) * tokens[node]
            if parent[node] >= 0:
                leaves[parent[node]] += leaves[node]
                saved[parent[node]] += saved[node]
        over = [least[p] if p >= 0 else a[1] for p, a in zip(parent, above, strict=True)]
        columns = ([a[0] for a in above], least, depth, over, n, [len(k) for k in kids], leaves, saved, ends)
        return pd.DataFrame({name: pd.Series(c, dtype=object if kind == "string" else "int64") for c, (name, kind) in zip(columns, (f.split() for f in NODE.split(", ")), strict=True)})

    return build


def nodes(classes: DataFrame, limit: int | None = None) -> DataFrame:
    """(class, path, words, n, least), a written table, to nodes as NODE has them."""
    limit = limit or LIMIT
    spark = classes.sparkSession
    total, least, turns = classes.agg(F.sum("n"), F.min("least"), F.sum(F.size("path") + 1)).first()
    if not total:
        return spark.createDataFrame([], NODE)
    here = classes.where(F.size("path") == 0).select("class").first()  # the one class without turns, if there is one
    opened = [spark.createDataFrame([("", None, least, None, total, 0, here and here[0])], "key string, parent_key string, conv_id long, parent_conv_id long, n_convs long, tokens int, class string")]
    rest = classes.where(F.size("path") > 0).select(F.get("path", F.lit(0)).alias("key"), F.lit("").alias("parent_key"), F.lit(least).cast("long").alias("parent_least"), *CONVERSATION)
    built: list[DataFrame] = []
    while True:
        level = len(opened)
        sizes = rest.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.size("path") - (level - 1)).alias("turns"))
        large = materialise(sizes.where((F.col("turns") > limit) & (F.col("c") > 1)))
        found = large.count()
        small = rest.join(broadcast_if_small(large.select("key"), found, BROADCAST_PAIRS), "key", "left_anti") if found else rest
        buckets = max(spark.sparkContext.defaultParallelism, 2 * turns // limit)
        dealt = small.select("class", "key", "parent_key", "parent_least", "path", "words", "n", "least", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
        built.append(materialise(dealt.groupBy("bucket").applyInPandas(_tries(level), NODE)))
        if not found:
            break
        inside = join_by_hot_key(rest, large, "key", "c")
        ending = F.max(F.when(F.size("path") == level, F.col("class")))
        tops = inside.groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.min("least").alias("conv_id"), F.first("parent_least").alias("parent_conv_id"), F.sum("n").alias("n_convs"), F.first(F.get("words", F.lit(level - 1))).alias("tokens"), ending.alias("class"), F.count("*").alias("c"))
        opened.append(materialise(tops))
        deeper = join_by_hot_key(rest.where(F.size("path") > level).drop("parent_key", "parent_least"), opened[-1].select("key", "conv_id", "c"), "key", "c")
        rest = materialise(deeper.select(F.md5(F.concat("key", F.get("path", F.lit(level)))).alias("key"), F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_least"), *CONVERSATION))
    columns = [f.split()[0] for f in NODE.split(", ")]
    done = built[-1]
    below = done.where("parent_key is not null")
    for level in reversed(range(len(opened))):
        sums = below.groupBy("parent_key").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).withColumnRenamed("parent_key", "key")
        own = (F.col("n_convs") - 1) * F.col("tokens")
        finished = opened[level].join(sums, "key", "left").withColumn("depth", F.lit(level).cast("long")).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        finished = finished.withColumn("n_leaves", F.coalesce("n_leaves", F.lit(1))).withColumn("saved_tokens", own + F.coalesce("saved_tokens", F.lit(0))).select(*columns)
        finished = materialise(finished)
        done = done.unionByName(finished)
        if level:
            more = built[level - 1]
            done = done.unionByName(more)
            below = more.where("parent_key is not null").unionByName(finished)
    return done


def trie(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to a row for each node of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    walked = materialise(paths(rebuilt(conversations_of(turns))))
    classes = materialise(walked.groupBy("class").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least")))
    found = nodes(classes)
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ending = found.where("class is not null").join(list_digests(walked), "class").select(*shown, "ends_sha256")
    return ending.unionByName(found.where("class is null").select(*shown, F.sha2(F.lit(""), 256).alias("ends_sha256")))
