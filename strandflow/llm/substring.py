"""Exact substring dedup by level-wise doubling.

Levels double a length (5, 10 and 20 words for the contract's windows). At each level only what was repeated at the level
before is looked at: of the short windows inside a full window the one with the smallest hash is its sample, so equal full
windows have equal samples at every level, and a full window whose sample occurs once is done with. The first level shuffles
one position in eight or so, the next ones only positions around samples that were repeated at half their length. The last
level compares the full windows that are left by their hash and finds the earliest of each. A repeat of more words consists of
repeated full windows, so longer levels could not change which words go.

Skew: each task first decides among its own rows. Of equal windows within a task only the earliest stays undecided, so a
passage that a third of all documents share costs one row for each task, not one for each document. What a task has decided
travels by a hash of its document, apart from the windows it was decided by. Texts are shuffled by document, never by
content, and compressed. Windows are told apart by 95 bits of hash; of windows that agree in 63 bits alone, those unlike the earliest stay.

Semantics: every word goes that is covered by a window whose word sequence also starts earlier, in a smaller doc_id or
in the same document. Defined results: null or empty texts have no words; null ids count like 2^63 - 1, the largest id, and
rows of one id are told apart by 64 bits of hash of their texts; rows that share id and place of a window are equally early,
so neither loses it; rows equal in id and text give equal rows; an empty table gives an empty table; only id and text are
used, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.llm.common import bounded_batches

WINDOW = 20
#: The first level has at least as many words (but at most half a window).
LEAST = 5
#: Rows that a task gathers before it decides among them.
FLUSH = 2_000_000
MEMO = 500_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_EVEN = ~np.uint64(1)
_UNPACK = zstandard.ZstdDecompressor()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def split(text: str | bytes) -> list[bytes]:
    """Words of a text, or of one that _packed() made; bytes split at exactly the contract's separators."""
    return (_UNPACK.decompress(text) if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).split()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, id, tag, text) with compressed texts, which make up most of what is shuffled."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in batch.column(3).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts], names=batch.schema.names)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def doubled(h: np.ndarray, length: int, lane: int) -> np.ndarray:
    """Hashes of windows of twice the length from those of windows of one length."""
    return _mixed(h[: len(h) - length] * _ODD[2 * lane] + h[length:] * _ODD[2 * lane + 1])


def short_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of a length from the hashes of the words."""
    n = len(words) - length + 1
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h = h * _ODD[0] + words[k : k + n]
    return _mixed(h)


def _sliding(h: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each `width` neighbours, in log(width) passes."""
    take, have = (np.minimum if least else np.maximum), 1
    while have < width:
        step = min(have, width - have)
        h = take(h[:-step], h[step:])
        have += step
    return h


def samples(h: np.ndarray, span: int, alive: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the smallest of each `span` neighbouring hashes, the distinct places that are smallest in one that is alive)."""
    least = _sliding(h, span, True)
    shown = least if alive is None else np.where(alive, least, np.uint64(0))
    edge = np.zeros(span - 1, np.uint64)
    return least, np.flatnonzero(_sliding(np.concatenate([edge, shown, edge]), span, False) == h)


def levels(window: int) -> list[int]:
    """Lengths from the first level's to the window's."""
    first = window // 2
    while first % 2 == 0 and first // 2 >= LEAST:
        first //= 2
    found = [first]
    while found[-1] < window:
        found.append(2 * found[-1])
    if found[-1] != window:
        raise ValueError("the window must be a number of at least two words, doubled from half of it")
    return found


def _hashes(words: list[bytes], memo: _WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _grown(h: np.ndarray, first: int, length: int) -> np.ndarray:
    """Hashes of windows of `length` words from those of the first level."""
    while first < length:
        h, first = doubled(h, first, 0), 2 * first
    return h


def _among(h: np.ndarray, known: pa.Scalar) -> np.ndarray:
    return np.isin(h, known.values.to_numpy(zero_copy_only=False).view(np.uint64))


def _spread(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """An odd number for each document: hashes of windows are even."""
    return _mixed(ids.view(np.uint64) * _ODD[2] + tags.view(np.uint64) * _ODD[3]) | ~_EVEN


def _listed(values: np.ndarray, ids: np.ndarray, tags: np.ndarray, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct values by document: (ids, tags, lists)."""
    order = np.lexsort((values, tags, ids))
    values, ids, tags = values[order], ids[order], tags[order]
    other = np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])
    keep = other.copy()
    keep[1:] |= values[1:] != values[:-1]
    values, ids, tags, other = values[keep], ids[keep], tags[keep], other[keep]
    at = np.flatnonzero(np.concatenate([other, [True]]))
    return ids[at[:-1]], tags[at[:-1]], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str | bytes, pa.Scalar | None]]:
    """(id, tag, text, repeated or None) of each row."""
    ids, tags, texts = (batch.column(name).to_pylist() for name in ("id", "tag", "text"))
    yield from zip(ids, tags, texts, batch.column("repeated") if "repeated" in batch.schema.names else [None] * len(ids), strict=True)


def _sampled(window: int, first: int, length: int):
    """(id, tag, text, repeated samples of half the length, but for the first level) to samples: (g, id, tag, again, known).

    One row of each hash (even) and task speaks for the task, `again` if the task has the hash twice. Other rows have, for
    a document, all hashes known to be there twice; their g (odd) only spreads them.
    """
    names = ["g", "id", "tag", "again", "known"]

    def settle(held: list) -> Iterator[pa.RecordBatch]:
        g, ids, tags = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        # In order of hashes to decide, back in order of documents to pass on, which compresses better.
        order = np.argsort(g, kind="stable")
        new = np.concatenate([[True], g[order[1:]] != g[order[:-1]]])
        twice = ~new
        twice[:-1] |= ~new[1:]
        again = np.empty(len(g), bool)
        again[order] = twice
        lead = np.sort(order[new])
        yield pa.RecordBatch.from_arrays([pa.array(g[lead].view(np.int64)), pa.array(ids[lead]), pa.array(tags[lead]), pa.array(again[lead]), pa.nulls(len(lead), pa.list_(pa.int64()))], names=names)
        if again.any():
            ids, tags, known = _listed(g[again].view(np.int64), ids[again], tags[again], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(_spread(ids, tags).view(np.int64)), pa.array(ids), pa.array(tags), pa.array(np.ones(len(ids), bool)), known], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, waiting = _WordHashes(), [], 0
        for batch in batches:
            for i, tag, text, repeated in _texts(batch):
                words = _hashes(split(text), memo)
                if len(words) < window:
                    continue
                h, alive = short_hashes(words, first), None
                if repeated is not None:
                    half = _grown(h, first, length // 2)
                    alive = _among(_sliding(half & _EVEN, window - length // 2 + 1, True), repeated)
                    h = doubled(half, length // 2, 0)
                h = h & _EVEN
                g = h[samples(h, window - length + 1, alive)[1]]
                held.append((g, np.full(len(g), i, np.int64), np.full(len(g), tag, np.int64)))
                waiting += len(g)
                if waiting >= FLUSH:
                    waiting = 0
                    yield from settle(held)
        if waiting:
            yield from settle(held)

    return run


def _compared(window: int, first: int):
    """(id, tag, text, repeated samples of half a window) to full windows: (h, k, id, tag, start, late).

    Rows with a start are the earliest in the task with their hash: h (even) and k. Other rows have, for a document, in `late`
    the places of windows that start earlier elsewhere; their h (odd) only spreads them.
    """
    half, names = window // 2, ["h", "k", "id", "tag", "start", "late"]

    def settle(held: list) -> Iterator[pa.RecordBatch]:
        h, k, ids, tags, starts = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((tags, starts, ids, k, h))
        differs = lambda *of: np.concatenate([[True], np.any([x[order[1:]] != x[order[:-1]] for x in of], axis=0)])
        new = differs(h, k)
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        is_late = (ids[order] != ids[lead]) | (starts[order] != starts[lead])
        # The earliest, once for rows equal in id and text, in order of documents, which compresses better.
        open_ = np.sort(order[~is_late & (new | differs(tags))])
        late = np.zeros(len(h), bool)
        late[order] = is_late
        none = pa.nulls(len(open_), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(h[open_].view(np.int64)), *[pa.array(x[open_]) for x in (k, ids, tags, starts)], none], names=names)
        if late.any():
            ids, tags, places = _listed(starts[late], ids[late], tags[late], pa.int32())
            none = pa.nulls(len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(_spread(ids, tags).view(np.int64)), none, pa.array(ids), pa.array(tags), none, places], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, waiting = _WordHashes(), [], 0
        for batch in batches:
            for i, tag, text, repeated in _texts(batch):
                words = _hashes(split(text), memo)
                if len(words) < window:
                    continue
                short = _grown(short_hashes(words, first), first, half)
                at = np.flatnonzero(_among(_sliding(short & _EVEN, window - half + 1, True), repeated))
                if not len(at):
                    continue
                h = doubled(short, half, 0)[at] & _EVEN
                k = (doubled(short, half, 1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                held.append((h, k, np.full(len(at), i, np.int64), np.full(len(at), tag, np.int64), at.astype(np.int32)))
                waiting += len(at)
                if waiting >= FLUSH:
                    waiting = 0
                    yield from settle(held)
        if waiting:
            yield from settle(held)

    return run


def _cut(window: int):
    """(doc_id, text, places) to what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n, removed, kept = [], [], []
                for text, places in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    words = split(text)
                    n.append(len(words))
                    if places.is_valid:
                        starts = np.unique(places.values.to_numpy())
                        starts = starts[starts + window <= len(words)]  # all are, unless two texts of one id agree in 64 bits of hash
                        ends = np.zeros(len(words) + 1, np.int32)
                        ends[starts] += 1
                        ends[starts + window] -= 1
                        covered = np.cumsum(ends[:-1]) > 0
                        words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    removed.append(n[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _gathered(one: Column, many: str) -> Column:
    """Values of rows that have one, and of rows that have a list (and whose single value only spreads them)."""
    return F.concat(F.collect_list(F.when(F.col(many).isNull(), one)), F.flatten(F.collect_list(many)))


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text), text not null, to (doc_id, n_words, n_removed, kept_text)."""
    first, *more = levels(window)
    bounded_batches(docs.sparkSession)
    # The tag tells rows apart that share an id. All joins shuffle the same columns by the same key, so that Spark does it once.
    key = ["id", "tag"]
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("tag"), "text")
    left = docs.select(*key, "text")
    docs = docs.mapInArrow(_packed, T.StructType([docs.schema["doc_id"], *[T.StructField(*f, False) for f in (("id", T.LongType()), ("tag", T.LongType()), ("text", T.BinaryType()))]]))
    for length in (first, *more[:-1]):
        sampled = left.mapInArrow(_sampled(window, first, length), "g long, id long, tag long, again boolean, known array<long>")
        repeats = F.count("*").over(Window.partitionBy("g")) > 1
        repeated = sampled.withColumn("repeats", repeats).where("repeats or again").groupBy(*key).agg(_gathered(F.col("g"), "known").alias("repeated"))
        left = docs.join(repeated, key).select("doc_id", *key, "text", "repeated")

    windows = left.mapInArrow(_compared(window, first), "h long, k int, id long, tag long, start int, late array<int>")
    order = Window.partitionBy("h").orderBy("id", "start")
    later = (F.rank().over(order) > 1) & (F.col("k") == F.first("k").over(order))
    late = windows.withColumn("later", later).where("later or late is not null")
    places = late.groupBy(*key).agg(_gathered(F.col("start"), "late").alias("places"))
    return docs.join(places, key, "left").select("doc_id", "text", "places").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")
