"""Near-duplicates by Jaccard similarity of word shingles: SimHash by segment-popcount embedding, then an exact prefix join for
what is beyond its reach; pairs of both are verified on whole sets.

First, the fingerprints of the sets are linked in the grid of their embeddings (`simhash.links`), and what is similar to a linked
text that is certain to stay goes. Certain to stay is a text that comes first in all of its cells, see below. SimHash links
near copies of two bits, so pairs down to the least similarity are left; all of them are found in a second way.

A text's shingles are brought into one order of all shingles, and of n of them the first n - ceil(t n) + 1 are kept: two
sets with a similarity of t or more share one of those, so pairs that share a cell (a kept shingle) are a superset of the
pairs sought. Of candidates, first their sketches are compared: a sketch has the parities of the numbers of shingles in
n to 2n hash buckets, and each shingle that only one of two sets has flips one parity, so the number of unlike parities is
a lower bound of the sets' difference. What is within reach by that bound is compared by its whole sets, so no pair within
reach is lost and none beyond it is linked. Which order is used changes the cost only: shingles that are frequent in a
sample come last, so cells stay small.

One text of each set of shingles takes part. What is dropped is defined by pairs and not by chains: no two kept texts are
similar, and each dropped one is similar to a kept one. Ties go by a hash of the set, so the rounds are few.

Skew: cells are not paired. A text that comes first in all of its cells is kept and compared with their members, one row for
each; what is similar goes. Then, in rounds, the cells of one first text are a group, of which about CELL texts, chosen by a hash,
are held against its members, in tasks and in blocks of bounded size; of the chosen ones that are similar the first is kept.
When a round clears less than a tenth of the rows in larger groups (many texts that share a shingle without being similar), or
few are left, all are held against each other in the same way. Only what sketches leave open leaves a task.

Defined results: words are separated like in op7 and compared without the case of ASCII letters; a text of fewer words
than a shingle is one shingle; texts without words are equal; null ids come last; repeated rows leave one; an empty table
gives an empty table; only id and text are used, so further columns cannot clash. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm import simhash
from strandflow.llm.common import BROADCAST_PAIRS, bounded_batches, broadcast_if_small, join_by_copies, join_by_hot_key, materialise, release, tagged, with_pairs
from strandflow.operators.batches import whole_groups

SHINGLE = 5
#: The least similarity, as a fraction of whole numbers.
SIMILARITY = (4, 5)
#: Members of a group that others of it are held against in a round.
CELL = 32
#: Members of a block, of which two meet in a task.
BLOCK = 500
#: Texts whose sets a task holds at once.
SLICE = 100
#: Documents of the sample in which frequent shingles are counted, and how many of those are told apart.
SAMPLE, FREQUENT = 10_000, 100_000


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted, distinct 64-bit hashes of a text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    of = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    h = np.full(n, min(shingle, len(words)), np.uint64)
    for k in range(min(shingle, len(words))):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + of[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def _mapped(docs: DataFrame, make, schema: str) -> DataFrame:
    """(.., text last) to rows of make(texts), beside the columns before text."""
    bounded_batches(docs.sparkSession)
    names = [*docs.columns[:-1], *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):  # few texts and their sets at a time
                part = batch.slice(at, SLICE)
                before = part.columns[:-1]
                yield pa.RecordBatch.from_arrays([*before, *make(part.column(len(before)).to_pylist())], names=names)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, ", ".join(x for x in (types, schema) if x))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(.., text) to (.., grams)."""
    return _mapped(docs, lambda texts: [pa.array([shingles(t, shingle).view(np.int64) for t in texts], pa.list_(pa.int64()))], "grams array<bigint>")


def _frequent(docs: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles that several documents of a sample have."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE))) == 0)
    counted = _sets(some.select("text"), shingle).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 2")
    return np.sort(np.array([r["gram"] for r in counted.orderBy(F.desc("n"), "gram").limit(FREQUENT).collect()], np.int64).view(np.uint64))


def _among(grams: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which grams are in a sorted array; it is searched and not sorted anew, as it is long beside a text's grams."""
    if not len(known):
        return np.zeros(len(grams), bool)
    return known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams


def sketch(grams: np.ndarray, times: int = 1) -> np.ndarray:
    """Parities of the numbers of grams in hash buckets, the least power of two of them that is at least `times` n and 64, as words of 64."""
    words = 1
    while 64 * words < times * len(grams):
        words *= 2
    bucket = (grams >> np.uint64(20)) & np.uint64(64 * words - 1)
    odd = np.bincount(bucket.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _difference(x: Column, y: Column) -> Column:
    """Unlike parities of two sketches, of which the longer is folded to the other's length (their sets are of like size)."""
    xor = lambda a, b: F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))
    half = lambda a: (F.size(a) / 2).cast("int")
    folded = lambda a, b: F.when(F.size(a) > F.size(b), xor(F.slice(a, 1, half(a)), F.slice(a, half(a) + 1, half(a)))).otherwise(a)
    return F.aggregate(xor(folded(x, y), folded(y, x)), F.lit(0), lambda n, w: n + F.bit_count(w))


def _prefixes(docs: DataFrame, shingle: int, frequent: np.ndarray, similarity: tuple[int, int]) -> DataFrame:
    """(.., text) to (.., key, n, fingerprint, prefix, sketch): a hash of the set, its size, its SimHash, its shingles that lead to
    cells, its sketch."""
    over, under = similarity
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def make(texts: list[str]) -> list[pa.Array]:
        keys, sizes, prints, prefixes, sketches = [], [], [], [], []
        for text in texts:
            grams = shingles(text, shingle)
            n = len(grams)
            keys.append(xxhash.xxh64_intdigest(grams.tobytes()))
            sizes.append(n)
            prints.append(simhash.majority(grams))
            late = _among(grams, shared.value)
            first = n - -(-over * n // under) + 1 if n else 0
            prefixes.append(np.concatenate([grams[~late], grams[late]])[:first].view(np.int64))
            sketches.append(sketch(grams))
        lists = pa.list_(pa.int64())
        return [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(prefixes, lists), pa.array(sketches, lists)]

    return _mapped(docs, make, "key bigint, n bigint, fingerprint bigint, prefix array<bigint>, sketch array<bigint>")


def may_be_similar(n: Column, x: Column, m: Column, y: Column, similarity: tuple[int, int]) -> Column:
    """Whether sets of n and m shingles with sketches x and y may be similar."""
    over, under = similarity
    near = (over * n <= under * m) & (over * m <= under * n)
    return near & F.when(near, (over + under) * _difference(x, y) <= (under - over) * (n + m))


def _led(pairs: DataFrame, classes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of keys that their sketches leave open, as a written table; b may be hot."""
    pairs = materialise(pairs)
    side = lambda name, size, bits: classes.select(F.col("key").alias(name), F.col("n").alias(size), F.col("sketch").alias(bits))
    uses = materialise(side("b", "m", "y").join(pairs.groupBy("b").agg(F.count("*").alias("uses")), "b"))
    both = join_by_hot_key(pairs.join(side("a", "n", "x"), "a"), uses, "b", "uses", narrow=False)
    open_ = materialise(both.where(may_be_similar(F.col("n"), F.col("x"), F.col("m"), F.col("y"), similarity)).select("a", "b"))
    release(pairs)
    release(uses)
    return open_


def _similar(open_: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of keys whose sets are similar, as a written table; b may be hot. Texts are read only for these pairs."""
    over, under = similarity
    keys = open_.select(F.col("a").alias("key")).unionByName(open_.select(F.col("b").alias("key"))).distinct()
    some = materialise(keys.join(classes, "key").select("key", F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")))
    some = broadcast_if_small(some, some.count(), BROADCAST_PAIRS)
    again = texts.join(some, texts["doc_id"].eqNullSafe(F.col("__id")) & (texts["tag"] == F.col("__tag"))).select("key", "text")
    sets = materialise(_sets(again, shingle).dropDuplicates(["key"]))
    uses = materialise(open_.groupBy("b").agg(F.count("*").alias("uses")))
    number = open_.count()
    one = sets.select(F.col("key").alias("a"), F.col("grams").alias("x")).join(broadcast_if_small(open_, number, BROADCAST_PAIRS), "a")
    other = sets.select(F.col("key").alias("b"), F.col("grams").alias("y")).join(broadcast_if_small(uses, number, BROADCAST_PAIRS), "b")
    both = join_by_copies(one, other, "b", "uses", F.col("a"))
    common = F.size(F.array_intersect("x", "y"))
    found = materialise(both.where((over + under) * common >= over * (F.size("x") + F.size("y"))).select("a", "b"))
    release(sets)
    release(uses)
    return found


def _near_prints(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys whose fingerprints are equal or linked; b is certain to stay, a is not. One b stands for a fingerprint,
    so texts of one fingerprint cost a row each."""
    leads = materialise(cells.groupBy("cell").agg(F.min("key").alias("lead"), F.count("*").alias("members")))
    first = join_by_hot_key(cells, leads, "cell", "members").groupBy("key").agg(F.min(F.col("key") == F.col("lead")).alias("stays"))
    known = materialise(first.join(classes.select("key", "fingerprint"), "key"))
    release(leads)
    stays = materialise(known.where("stays").groupBy("fingerprint").agg(F.min("key").alias("b")))
    links = materialise(simhash.links(known.select("fingerprint").distinct()))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("fingerprint"), F.col("b").alias("other"))
    near = both.join(stays.withColumnRenamed("fingerprint", "other"), "other").select("fingerprint", "b").unionByName(stays.select("fingerprint", "b"))
    open_ = known.where("not stays").select(F.col("key").alias("a"), "fingerprint")
    counts = open_.groupBy("fingerprint").agg(F.count("*").alias("uses"))
    at = materialise(near.join(counts, "fingerprint").groupBy("fingerprint").agg(F.collect_set("b").alias("bs"), F.first("uses").alias("uses")))
    pairs = join_by_hot_key(open_, at, "fingerprint", "uses", narrow=False)
    return pairs.select("a", F.explode("bs").alias("b"))


def _one_row_each(found: DataFrame) -> DataFrame:
    """The rows of found, a written table, without those whose set is that of a row before. Only keys are shuffled, and a set
    that very many rows have is no task's alone."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "row")
    firsts = materialise(found.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("key", F.col("first.row").alias("first"), "copies"))
    more = materialise(join_by_hot_key(found.select("key", "row"), firsts, "key", "copies").where("row <> first").select("row"))
    return found.join(broadcast_if_small(more, more.count(), BROADCAST_PAIRS), "row", "left_anti")


def _without(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """Cells, as a written table, of other keys than these."""
    keys = materialise(keys.distinct())
    left = materialise(cells.join(broadcast_if_small(keys, keys.count(), BROADCAST_PAIRS), "key", "left_anti"))
    release(keys)
    return left


def _first(rows: DataFrame, classes: DataFrame, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Of (key, cell, lead): keys that come first in all of their cells, and the pairs (a, b) to compare of what shares a cell with
    one of these (b)."""
    chosen = materialise(rows.groupBy("key").agg(F.min(F.col("key") == F.col("lead")).alias("all")).where("all").select("key"))
    led = rows.where("key <> lead").select("key", "lead").distinct()
    uses = materialise(led.groupBy("lead").agg(F.count("*").alias("uses")).join(chosen.withColumnRenamed("key", "lead"), "lead"))
    pairs = join_by_hot_key(led, uses, "lead", "uses").select(F.col("key").alias("a"), F.col("lead").alias("b"))
    return chosen, _led(pairs, classes, similarity)


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _by_size(batch: pa.RecordBatch, at: np.ndarray, size: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Rows `at` of a batch by the length of their sketches: (words, rows, sketches)."""
    column = batch.column("sketch")
    flat, starts = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    groups = ((int(w), at[size[at] == w]) for w in np.unique(size[at]))
    return [(w, rows, flat[starts[rows][:, None] + np.arange(w)]) for w, rows in groups]


def _open_pairs(similarity: tuple[int, int]):
    """Pairs (a, b) that sizes and sketches leave open, of blocks of rows sorted by (lead, i, j): b is an index row, a another row."""
    over, under = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, borders in whole_groups(batches, 3):
            index, probe, key, n, chosen = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("index", "probe", "key", "n", "chosen"))
            size = np.diff(batch.column("sketch").offsets.to_numpy())
            found: set[tuple[int, int]] = set()
            for lo, hi in zip(borders, borders[1:], strict=False):
                first, other = (lo + np.flatnonzero(role[lo:hi]) for role in (index, probe))
                if not len(first) or not len(other):
                    continue
                others = _by_size(batch, other, size)
                for w, xs, own in _by_size(batch, first, size):
                    for v, ys, theirs in others:
                        if w > 2 * v or v > 2 * w:  # over twice as many shingles
                            continue
                        x_words, y_words = _folded(own, min(w, v)), _folded(theirs, min(w, v))
                        for x, words in zip(xs, x_words, strict=True):
                            m = n[ys]
                            near = (over * n[x] <= under * m) & (over * m <= under * n[x]) & (~chosen[ys] | (key[ys] > key[x]))
                            at = np.flatnonzero(near)
                            if not len(at):
                                continue
                            unlike = np.bitwise_count(y_words[at] ^ words).sum(1, dtype=np.int64)
                            at = at[(over + under) * unlike <= (under - over) * (n[x] + m[at])]
                            found.update((int(k), int(key[x])) for k in key[ys[at]])
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _chosen(rows: DataFrame, classes: DataFrame, similarity: tuple[int, int], turn: int, before: int) -> tuple[DataFrame, DataFrame, int]:
    """Of (key, cell, lead): keys of which a group has about CELL at most, the pairs (a, b) to compare of what shares a group with
    one of these (b), and the number of members of larger groups. A group is the cells of one lead, as similar texts share many
    cells. If that number is hardly less than `before`, or all their pairs are few beside it, all keys are taken. Pairs are compared in the
    tasks, in blocks."""
    members = materialise(rows.select("lead", "key").distinct())
    sizes = materialise(members.groupBy("lead").agg(F.count("*").alias("members")))
    m = F.col("members")
    dense, pairs = (x or 0 for x in sizes.where(m > CELL).agg(F.sum(m), F.sum(m * m)).first())
    every = not dense or (before and (dense > 0.9 * before or pairs <= BLOCK * before))
    sized = materialise(join_by_hot_key(members, sizes, "lead", "members"))
    share = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(1 << 32)) * F.col("members") < F.lit(CELL << 32)
    taken = F.lit(True) if every else F.min(share | (F.col("members") <= CELL))
    keys = materialise(sized.groupBy("key").agg(taken.alias("chosen")))
    narrow = broadcast_if_small(keys, keys.count(), BROADCAST_PAIRS)
    flagged = materialise(members.join(narrow, "key"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    counts = flagged.groupBy("lead").agg(blocks(F.count_if("chosen")).alias("is"), blocks(F.count("*")).alias("js"), F.count("*").alias("members"))
    counts = materialise(counts.where("is > 0"))
    dealt = join_by_hot_key(flagged, counts, "lead", "members")
    at = lambda size: F.pmod(F.xxhash64("key", F.lit(-1)), F.col(size)).cast("int")
    each = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    single = (F.col("is") == 1) & (F.col("js") == 1)  # one row is both
    both = dealt.where(single).select("lead", F.lit(0).alias("i"), F.lit(0).alias("j"), "key", "chosen", F.col("chosen").alias("index"), F.lit(True).alias("probe"))
    index = dealt.where(~single & F.col("chosen")).select("lead", at("is").alias("i"), each("js").alias("j"), "key", "chosen", F.lit(True).alias("index"), F.lit(False).alias("probe"))
    probe = dealt.where(~single).select("lead", each("is").alias("i"), at("js").alias("j"), "key", "chosen", F.lit(False).alias("index"), F.lit(True).alias("probe"))
    own = classes.select("key", "n", "sketch").join(narrow.select("key"), "key")
    bounded_batches(rows.sparkSession)
    meet = own.join(both.unionByName(index).unionByName(probe), "key").select("lead", "i", "j", "index", "probe", "key", "n", "chosen", "sketch")
    open_ = meet.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j").mapInArrow(_open_pairs(similarity), "a long, b long")
    open_ = materialise(open_.distinct())
    for done in (members, sizes, sized, flagged, counts):
        release(done)
    return keys.where("chosen").select("key"), open_, dense


def _settled(near: DataFrame, chosen: DataFrame) -> list[DataFrame]:
    """Tables (a, b) of what is dropped for a kept one, of similar pairs (a, b) with b chosen; a comes later if it is chosen, too."""
    edges = materialise(near.join(chosen.withColumnRenamed("key", "a"), "a", "left_semi"))
    others = near.join(chosen.withColumnRenamed("key", "a"), "a", "left_anti")
    gone: list[DataFrame] = []
    while edges.take(1):  # a is after b in order; what is never after another is kept
        first = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
        gone.append(materialise(edges.join(first, "b").groupBy("a").agg(F.min("b").alias("b"))))
        out = gone[-1].select("a")
        left = materialise(edges.join(out, "a", "left_anti").join(out.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"))
        release(edges)
        edges = left
    for more in list(gone):
        others = others.join(more.select(F.col("a").alias("b")), "b", "left_anti")
    gone.append(materialise(others.groupBy("a").agg(F.min("b").alias("b"))))
    return gone


def dropped(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text), text not null, to every row (doc_id, tag, key of its set), one row of each set (key, none, doc_id, tag),
    and the keys (a) that are dropped for a kept one (b)."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    made = _prefixes(texts, shingle, _frequent(docs, shingle), similarity)
    found = materialise(made.withColumn("row", F.monotonically_increasing_id()))
    once = _one_row_each(found)
    classes = materialise(once.select("key", F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "n", "fingerprint", "sketch"))
    # Cells are counted where their marks lie, so marks, most of which are of one set alone, are dealt out once.
    marks = once.select("key", F.explode("prefix").alias("cell")).withColumn("members", F.count("*").over(Window.partitionBy("cell")))
    cells = materialise(marks.where("members > 1").select("key", "cell"))

    gone: list[DataFrame] = [_similar(_led(_near_prints(cells, classes), classes, similarity), classes, texts, shingle, similarity)]
    cells = _without(cells, gone[0].select(F.col("a").alias("key")))
    before, turn = 0, 0
    while cells.take(1):
        leads = materialise(cells.groupBy("cell").agg(F.min("key").alias("lead"), F.count("*").alias("members")).where("members > 1"))
        rows = materialise(join_by_hot_key(cells, leads, "cell", "members").select("key", "cell", "lead"))
        release(cells)
        release(leads)
        if turn:
            chosen, open_, dense = _chosen(rows, classes, similarity, turn, before)
            before = dense
        else:
            chosen, open_ = _first(rows, classes, similarity)
        near = _similar(open_, classes, texts, shingle, similarity)
        settled = _settled(near, chosen)
        gone += settled
        decided = chosen
        for more in settled:
            decided = decided.unionByName(more.select(F.col("a").alias("key")))
        cells, turn = _without(rows.select("key", "cell"), decided), turn + 1
        release(rows)
        release(open_)
        release(near)
    edges = gone[0].select("a", "b")
    for more in gone[1:]:
        edges = edges.unionByName(more)
    return found.select("doc_id", "tag", "key"), classes.select("key", "none", "doc_id", "tag"), edges


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs, in the same columns, without those that are similar to a kept one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found, classes, gone = dropped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), shingle, similarity)
    # What goes: rows whose set is dropped or represented by another row. What repeats a kept row leaves one.
    first = classes.join(gone.select(F.col("a").alias("key")), "key", "left_anti").select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"))
    rows = found.groupBy("doc_id", "tag").agg(F.count("*").alias("n"))
    rows = materialise(rows.join(first.withColumn("first", F.lit(True)), rows["doc_id"].eqNullSafe(F.col("__id")) & (rows["tag"] == F.col("__tag")), "left").select("doc_id", "tag", "n", F.coalesce("first", F.lit(False)).alias("first")))
    kept = with_pairs(tagged(docs, text), rows.where("not first"), "left_anti")
    twice = rows.where("first and n > 1")
    if twice.take(1):
        kept = with_pairs(kept, twice, "left_anti").unionByName(with_pairs(kept, twice, "left_semi").dropDuplicates(["doc_id", "__tag"]))
    return kept.drop("__tag")
