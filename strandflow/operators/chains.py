"""Chains of picks in which the next pick is a function of the last one alone, followed in blocks.

A cut that depends on the cut before it, or a batch that begins where the last one was full, looks sequential. But from every
item the next pick is known without knowing the chain, and it lies within a bounded reach. So the items of a key are dealt
into blocks of a measure that grows along them, each with the items of the next block that are within reach beside it. A block
finds, for each item at which a chain could enter it, where that chain enters the next block: a small table. The one chain that
begins at a key's first item is then found by doubling: a table that leads 2**k blocks on, joined to itself, leads 2**(k + 1)
blocks on, so a key of n blocks takes log n rounds. Each block at last follows the chain from where it enters. Keys that lie
in one block need no rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.operators.batches import whole_groups
from strandflow.scratch import materialise

#: Reaches in the width of a block.
WIDTH = 64
#: Where a chain ends: it enters the block after it at no item. Only the last block of a key can have items but no pick.
END = (1 << 63) - 1

Following = Callable[[dict[str, np.ndarray]], np.ndarray]


def _numpy(batch: pa.RecordBatch, names: Sequence[str]) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}


def _maps(keys: int, columns: Sequence[str], following: Following, reach: int, width: int):
    """For each item at which a chain can enter a block: where it leaves it, and its number of picks there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, borders in whole_groups(batches, keys + 1):
            rows, entries, exits, picks = [], [], [], []
            every = _numpy(batch, columns)
            for a, b in zip(borders, borders[1:], strict=False):
                x = {c: v[a:b] for c, v in every.items()}
                after, own = following(x).tolist(), int(x["__own"].sum())
                order, at = x["__order"], x["__at"]
                out, n = [0] * own, [0] * own
                for i in range(own - 1, -1, -1):
                    j = after[i]
                    out[i], n[i] = (out[j], n[j] + 1) if j < own else (j, 1)
                entered = np.flatnonzero(at[:own] < max((at[0] // width) * width + reach, at[0] + 1))
                rows += [int(a)] * len(entered)
                entries += order[entered].tolist()
                exits += [int(order[out[i]]) if out[i] < b - a else END for i in entered]
                picks += [n[i] for i in entered]
            own_keys = batch.select(list(range(keys + 1))).take(pa.array(rows, pa.int64()))
            made = [pa.array(v, pa.int64()) for v in (entries, exits, picks)]
            yield pa.RecordBatch.from_arrays([*own_keys.columns, *made], names=[*own_keys.schema.names, "__entry", "__exit", "__picks"])

    return run


def _walk(keys: int, columns: Sequence[str], kept: Sequence[str], following: Following):
    """Own items of each block with whether they are picked and the number of picks up to them. The first row of a block, of
    kind 0, says where the chain enters it and after how many picks; a block without one has no items of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, borders in whole_groups(batches, keys + 1):
            every = _numpy(batch, columns)
            shown, picked, number = [np.empty(0, np.int64)], [np.empty(0, bool)], [np.empty(0, np.int64)]
            for a, b in zip(borders, borders[1:], strict=False):
                if every["__kind"][a]:
                    continue
                x = {c: v[a + 1 : b] for c, v in every.items()}
                own = int(x["__own"].sum())
                after, here = following(x), np.zeros(own, bool)
                i = int(np.searchsorted(x["__order"][:own], every["__order"][a]))
                while i < own:
                    here[i] = True
                    i = int(after[i])
                shown.append(np.arange(a + 1, a + 1 + own))
                picked.append(here)
                number.append(every["__before"][a] + np.cumsum(here))
            rows = batch.select(list(kept)).take(pa.array(np.concatenate(shown), pa.int64()))
            made = [pa.array(np.concatenate(picked)), pa.array(np.concatenate(number).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *made], names=[*kept, "picked", "picks"])

    return run


def followed(items: DataFrame, keys: Sequence[str], order: str, at: str, reach: int, following: Following, values: Sequence[str], width: int | None = None) -> DataFrame:
    """Items with `picked`, whether the chain from their key's first item meets them, and `picks`, the number of picks up to
    and with them.

    order: a whole number, unique in its key; at: a whole number that never falls along the order, and by which a pick is at
    most `reach` beyond the one before it. following: from arrays of the columns `values` of consecutive items of a key to the
    place of the next pick of each item, their number if there is none among them. The number of blocks is read eagerly.
    """
    width = width or WIDTH * reach
    if width < reach:
        raise ValueError("a block is at least one reach wide")
    block = F.floor(F.col(at) / width)
    named = items.withColumn("__order", F.col(order).cast("long")).withColumn("__at", F.col(at).cast("long"))
    halo = F.when(F.col("__at") < block * width + reach, F.array(block, block - 1)).otherwise(F.array(block))
    dealt = named.withColumn("__b", F.explode(halo)).withColumn("__own", (F.col("__b") == block).cast("int")).withColumnRenamed("__b", "__block")
    by = [*keys, "__block"]
    columns = ["__order", "__at", "__own", *values]
    firsts = named.groupBy(*keys).agg(F.min(F.struct("__order", block.alias("b"))).alias("f"), F.max(block).alias("__last"))
    firsts = firsts.select(*keys, F.col("f.b").alias("__block"), F.col("f.__order").alias("__entry"), F.lit(0).cast("long").alias("__before"), "__last")
    far = firsts.agg(F.coalesce(F.max(F.col("__last") - F.col("__block")), F.lit(0))).first()[0]
    entered = firsts.drop("__last")
    if far:
        long_ = firsts.where(F.col("__last") > F.col("__block")).select(*keys)
        some = dealt.join(long_, list(keys), "left_semi").select(*by, *columns)
        fields = [T.StructField(c, T.LongType()) for c in ("__entry", "__exit", "__picks")]
        maps = some.repartition(*by).sortWithinPartitions(*by, "__order").mapInArrow(_maps(len(keys), columns, following, reach, width), T.StructType([*[some.schema[c] for c in by], *fields]))
        maps, step = materialise(maps), 1
        entered = materialise(entered)
        while step <= far:
            led = entered.join(maps, [*by, "__entry"]).select(*keys, (F.col("__block") + step).alias("__block"), F.col("__exit").alias("__entry"), (F.col("__before") + F.col("__picks")).alias("__before"))
            entered = materialise(entered.unionByName(led))
            on = maps.select(*keys, (F.col("__block") - step).alias("__block"), F.col("__entry").alias("__exit"), F.col("__exit").alias("__next"), F.col("__picks").alias("__more"))
            if 2 * step <= far:
                maps = materialise(maps.join(on, [*by, "__exit"]).select(*by, "__entry", F.col("__next").alias("__exit"), (F.col("__picks") + F.col("__more")).alias("__picks")))
            step *= 2
    # Numbers are not null in any row, so that arrays of them stay whole numbers.
    known = dealt.select(*by, *[c for c in dict.fromkeys([*columns, *items.columns]) if c not in by], F.lit(0).cast("long").alias("__before"), F.lit(1).alias("__kind"))
    told = {"__order": F.col("__entry"), "__before": F.col("__before"), "__kind": F.lit(0)} | {c: F.col(c) for c in by}
    nothing = lambda f: F.lit(0 if f.name in columns else None).cast(f.dataType)
    markers = entered.select(*[told.get(f.name, nothing(f)).alias(f.name) for f in known.schema.fields])
    ordered = known.unionByName(markers).repartition(*by).sortWithinPartitions(*by, "__kind", "__order")
    fields = [*items.schema.fields, T.StructField("picked", T.BooleanType()), T.StructField("picks", T.LongType())]
    return ordered.mapInArrow(_walk(len(keys), [*columns, "__before", "__kind"], items.columns, following), T.StructType(fields))
