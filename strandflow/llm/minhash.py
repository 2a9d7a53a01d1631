"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has t coordinates. In each of up to t rounds every shingle of a text is hashed to a bin and a value, and a bin keeps
the least value of the first round in which anything fell into it; a bin that t rounds leave empty takes the least of a hash
of its own over all shingles, so every coordinate is filled. Two texts agree on a coordinate with the probability of their
Jaccard similarity, and the share they agree on is concentrated around it as for t independent hashes, but about t log t
hashes a text suffice for all t coordinates. Coordinates are put together in bands: texts that agree on a whole band share a
cell. 40 bands of 5 lose a pair at a similarity of just 0.8 with a probability of 1.3e-7, and one at 0.85 with 3e-11.

Candidates become links only after their whole sets of shingles, made of both texts again, are compared. What is sought is the
components, so pairs that are joined already need not be compared. Texts with equal sets are one node. First, every
node of a cell is compared with one lead of it only, in rounds with other leads as long as that joins much. Pairs of a cell
that are then still in different components are compared: in a cell of up to CELL nodes all of them; the nodes of larger
cells meet by an exact prefix join instead (nodes that are similar share one of their rarest shingles, the smaller one within
the first 1 / 9 of its set and the larger one within 1 / 5), so no pairs are made of a large cell as such, and none is lost.
Before sets are compared, sketches of parities (see resemblance) rule out what is certainly not similar.

Skew: copies are one node; a hot cell or lead is joined by copies of its row, dealt out; lists of nodes are never gathered.

Defined results: words are separated by space and U+0009 to U+000D, and ASCII letters are compared without case. A text of
fewer words than a shingle is one shingle. Texts without words, and null ones, have an empty set and are linked with nothing,
not even with each other. Null ids get their group's least id, or null if it has none; repeated rows share a component; kept
compares ids null-safely; an empty table gives an empty table; only id and text are used, so further columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import BROADCAST_PAIRS, bounded_batches, broadcast_if_small, join_by_copies, join_by_hot_key, materialise
from strandflow.llm.components import components
from strandflow.llm.resemblance import may_be_similar, shingles, sketch
from strandflow.operators.batches import whole_groups

SHINGLE = 2
#: The least similarity, as a fraction of whole numbers.
SIMILARITY = (4, 5)
BANDS, ROWS = 40, 5
#: Nodes of a cell that are still paired.
CELL = 32
#: Rounds of leads go on while they take at least this share from what is still apart.
JOINED = 0.1
#: Nodes of a salted block of a frequent shingle.
BLOCK = 1000

_SEEDS = np.array([xxhash.xxh64_intdigest(b"", k) for k in range(2 * BANDS * ROWS)], np.uint64)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def fast_sketch(grams: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The coordinates of a non-empty set of hashes: round and least value, in one number."""
    found, low, at = np.full(size, _EMPTY), np.uint64(0xFFFFFFFF), 0
    while at < size and (found == _EMPTY).any():
        rounds = np.arange(at, min(size, at + max(1, int(size * np.log(size)) // len(grams))))
        h = _mixed(grams[None, :] ^ _SEEDS[rounds, None])
        bins = ((h & low) * np.uint64(size)) >> np.uint64(32)
        np.minimum.at(found, bins.ravel().astype(np.int64), ((rounds.astype(np.uint64)[:, None] << np.uint64(32)) | (h >> np.uint64(32))).ravel())
        at += len(rounds)
    left = np.flatnonzero(found == _EMPTY)
    if len(left):
        h = _mixed(grams[None, :] ^ _SEEDS[size + left, None])
        found[left] = ((size + left).astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)).min(1)
    return found


def bands(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band and its number."""
    parts = coordinates.reshape(-1, rows)
    return reduce(lambda h, k: _mixed(h ^ parts[:, k]), range(rows), _SEEDS[: len(parts)].copy())


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text), text not null, to (doc_id, tag, key, n, bands, parities): a hash of the text, one of its set, the set's size."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle) for t in batch.column(2).to_pylist()]
            columns = [
                *batch.columns[:2],
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bands(fast_sketch(s)).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "key", "n", "bands", "parities"])

    return docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(run, "doc_id long, tag long, key binary, n long, bands array<bigint>, parities array<bigint>")


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, blob), a written table: the compressed text of one document of each node, once its set was found to be the node's."""
    nodes = materialise(nodes.distinct())
    known = classes.select("node", "key", F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"))
    some = materialise(known.join(broadcast_if_small(nodes, nodes.count(), BROADCAST_PAIRS), "node"))
    some = broadcast_if_small(some, some.count(), BROADCAST_PAIRS)
    texts = docs.withColumn("tag", F.xxhash64("text"))
    again = texts.join(some, texts["doc_id"].eqNullSafe(F.col("__id")) & (texts["tag"] == F.col("__tag"))).select("node", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys, texts = (c.to_pylist() for c in batch.columns)
            own = [(i, zlib.compress(t.encode("utf-8", "surrogatepass"), 1)) for i, k, t in zip(nodes, keys, texts, strict=True) if xxhash.xxh3_128_digest(shingles(t, shingle).tobytes()) == k]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([b for _, b in own], pa.binary())], names=["node", "blob"])

    return materialise(again.mapInArrow(run, "node long, blob binary").dropDuplicates(["node"]))


def _shingle_set(blob: bytes, shingle: int) -> set[bytes]:
    words = zlib.decompress(blob).lower().split()
    return {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of nodes that are similar, as a written table: first by sizes and parities, then by the whole sets."""
    over, under = similarity

    def meeting(pairs: DataFrame, rows: DataFrame, left: dict[str, str], right: dict[str, str]) -> DataFrame:
        """Pairs, a written table, with columns of both nodes' rows."""
        number, uses = pairs.count(), materialise(pairs.groupBy("b").agg(F.count("*").alias("__uses")))
        named = lambda node, names: rows.select(F.col("node").alias(node), *[F.col(c).alias(n) for c, n in names.items()])
        one = named("a", left).join(broadcast_if_small(pairs, number, BROADCAST_PAIRS), "a")
        other = named("b", right).join(broadcast_if_small(uses, number, BROADCAST_PAIRS), "b")
        return join_by_copies(one, other, "b", "__uses", F.col("a"))

    near = meeting(materialise(pairs), classes, {"n": "n", "parities": "x"}, {"n": "m", "parities": "y"})
    open_ = materialise(near.where(may_be_similar(F.col("n"), F.col("x"), F.col("m"), F.col("y"), similarity)).select("a", "b"))
    both = meeting(open_, _texts(open_.select(F.explode(F.array("a", "b")).alias("node")), classes, docs, shingle), {"blob": "x"}, {"blob": "y"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            found = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last[0] != b:
                    last = b, _shingle_set(y, shingle)
                one, other = _shingle_set(x, shingle), last[1]
                common = len(one & other)
                if (under + over) * common >= over * (len(one) + len(other)):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return materialise(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _folded(parities: np.ndarray, words: int) -> np.ndarray:
    while parities.shape[1] > words:
        half = parities.shape[1] // 2
        parities = parities[:, :half] ^ parities[:, half:]
    return parities


def _open_pairs(similarity: tuple[int, int]):
    """Pairs (a, b) of blocks of nodes, sorted by (gram, i, j), that sizes and parities leave open: early nodes with larger ones."""
    over, under = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, borders in whole_groups(batches, 3):
            early, node, root, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("early", "node", "root", "n"))
            found: set[tuple[int, int]] = set()
            for lo, hi in zip(borders, borders[1:], strict=False):
                first, other = (lo + np.flatnonzero(early[lo:hi] == k) for k in (True, False))
                if not len(first) or not len(other):
                    continue
                flat = batch.column("parities").slice(lo, hi - lo)
                size = np.diff(flat.offsets.to_numpy())
                by_size = {w: np.stack([flat[int(k) - lo].values.to_numpy().view(np.uint64) for k in np.concatenate([first, other]) if size[k - lo] == w]) for w in np.unique(size)}
                row = {int(k): i for w in by_size for i, k in enumerate(k for k in np.concatenate([first, other]) if size[k - lo] == w)}
                groups = {w: other[size[other - lo] == w] for w in by_size}
                for x in first:
                    own = by_size[size[x - lo]][row[int(x)]][None, :]
                    for w, ys in groups.items():
                        m = n[ys]
                        ys = ys[((n[x] < m) | ((n[x] == m) & (node[x] < node[ys]))) & (n[x] * under >= m * over) & (root[x] != root[ys])]
                        if not len(ys):
                            continue
                        words = min(w, own.shape[1])
                        unlike = np.bitwise_count(_folded(own, words) ^ _folded(by_size[w][[row[int(y)] for y in ys]], words)).sum(1, dtype=np.int64)
                        near = ys[(over + under) * unlike <= (under - over) * (n[x] + n[ys])]
                        found.update((int(min(node[x], node[y])), int(max(node[x], node[y]))) for y in near)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def prefix_pairs(members: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """(node, root) to a superset of the similar pairs (a, b) of different roots: pairs that share one of their rarest shingles,
    and whose sizes and parities leave them open. Nodes that share a frequent one meet in blocks of bounded size."""
    over, under = similarity
    blobs = _texts(members.select("node"), classes, docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(zlib.decompress(b).decode("utf-8", "surrogatepass"), shingle) for b in batch.column(1).to_pylist()]
            lists = [pa.array([x.view(np.int64) for x in column], pa.list_(pa.int64())) for column in (sets, [sketch(x, 2) for x in sets])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["node", "grams", "parities"])

    sets = materialise(blobs.mapInArrow(run, "node long, grams array<bigint>, parities array<bigint>"))
    grams = sets.select("node", F.explode("grams").alias("gram"))
    shared = materialise(grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"))
    known = join_by_hot_key(grams, shared, "gram", "df").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    # Shingles of one node alone come first in order, so the shared ones begin after them.
    rows = known.join(classes.select("node", "n"), "node").join(members, "node").join(sets.select("node", "parities"), "node")
    n, own = F.col("n"), F.col("n") - F.size("grams")
    late = F.greatest(F.lit(0), n - F.ceil(n * over / under) + 1 - own).cast("int")
    marks = rows.select("node", "root", "n", "parities", own.alias("own"), F.posexplode(F.slice("grams", F.lit(1), late)).alias("nth", "g"))
    early = F.col("own") + F.col("nth") <= n - F.ceil(n * 2 * over / (over + under))
    marks = materialise(marks.select("node", "root", "n", "parities", F.col("g.gram").alias("gram"), early.alias("early")))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    counts = marks.groupBy("gram").agg(blocks(F.count_if("early")).alias("is"), blocks(F.count("*")).alias("js"), F.count("*").alias("members"))
    dealt = join_by_hot_key(marks, materialise(counts.where("is > 0 and members > 1")), "gram", "members")
    at = lambda size: F.pmod(F.xxhash64("node"), F.col(size)).cast("int")
    each = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    index = dealt.where("early").withColumn("i", at("is")).withColumn("j", each("js"))
    probe = dealt.withColumn("early", F.lit(False)).withColumn("j", at("js")).withColumn("i", each("is"))
    meet = index.unionByName(probe).select("gram", "i", "j", "early", "node", "root", "n", "parities")
    return meet.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j").mapInArrow(_open_pairs(similarity), "a long, b long").distinct()


def links(classes: DataFrame, docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of nodes, all similar, whose components are those of all similar pairs that share a band."""
    marks = classes.select("node", F.explode("bands").alias("cell"))
    shared = materialise(marks.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1"))
    cells = materialise(join_by_hot_key(marks, shared, "cell", "members").select("cell", "node", F.col("node").alias("root")))
    edges, apart = None, 0
    for turn in count():
        lead = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "root")).alias("lead")
        leads = cells.groupBy("cell").agg(lead, F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        leads = materialise(leads.select("cell", "members", F.col("lead.node").alias("lead"), F.col("lead.root").alias("lead_root")))
        before, apart = apart, leads.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
        if not apart or (turn and apart > (1 - JOINED) * before):
            break
        led = materialise(join_by_hot_key(cells, leads, "cell", "members"))  # cells in which all are joined go
        pairs = led.where("root <> lead_root").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        found = verified(pairs, classes, docs, shingle, similarity)
        edges = edges.unionByName(found) if edges else found
        roots = materialise(components(edges)).select(F.col("node").alias("__node"), F.col("root").alias("__root"))
        roots = broadcast_if_small(roots, roots.count(), BROADCAST_PAIRS)
        cells = materialise(led.join(roots, F.col("node") == F.col("__node"), "left").select("cell", "node", F.coalesce("__root", "root").alias("root")))
    if edges is None:
        return classes.sparkSession.createDataFrame([], "a long, b long")
    if not apart:
        return edges
    left = materialise(join_by_hot_key(cells, leads.select("cell", "members"), "cell", "members"))
    small = left.where(F.col("members") <= CELL).select("cell", "node", "root")
    other = small.select("cell", F.col("node").alias("other"), F.col("root").alias("other_root"))
    pairs = small.join(other, "cell").where("node < other and root <> other_root").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    large = materialise(left.where(F.col("members") > CELL).select("node", "root").distinct())
    if large.take(1):
        pairs = pairs.unionByName(prefix_pairs(large, classes, docs, shingle, similarity)).distinct()
    return edges.unionByName(verified(pairs, classes, docs, shingle, similarity))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, text), text not null, to (doc_id, tag, n_shingles, component_id, kept)."""
    found = materialise(sketches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    sets = found.where("n > 0").groupBy("key").agg(F.min(row).alias("r"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "bands", "parities")])
    classes = materialise(sets.select(F.monotonically_increasing_id().alias("node"), "key", "copies", "r.doc_id", "r.tag", "n", "bands", "parities"))
    roots = materialise(components(links(classes, docs, shingle, similarity)))
    rooted = classes.select("node", "key", "copies", "doc_id").join(roots, "node")
    groups = materialise(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members")))
    linked = join_by_hot_key(rooted, groups, "root", "members").select("key", "component_id", "copies")
    alone = classes.join(roots, "node", "left_anti").select("key", F.col("doc_id").alias("component_id"), "copies")
    lookup = materialise(linked.unionByName(alone))
    shown = ["doc_id", "tag", F.col("n").alias("n_shingles"), "component_id"]
    many = join_by_hot_key(found.where("n > 0").select("doc_id", "tag", "key", "n"), lookup, "key", "copies").select(*shown)
    none = found.where("n = 0").withColumn("component_id", F.col("doc_id")).select(*shown)
    return many.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

