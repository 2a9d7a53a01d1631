"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask keeps some token positions and ignores the others, so two passages still share a seed where ignored words, or words
beside the mask, were replaced. Every position of every document is hashed under the masks of the benchmark's items and
joined to their seeds; around each hit, document and benchmark are compared word by word along the hit's diagonal. An overlap
stands if LEAST_MATCH of OVERLAP words (or of all of a shorter item) agree, in any window that holds the hit, or a run of
VERBATIM words does.

No overlap is without a hit: a family of masks serves an item if, whichever words of its window are replaced, as many as the
rule allows, one of the masks fits somewhere between them. That is found by going through all ways to replace them (4,845 for
20 words); the most selective family that serves is taken: two masks of five words for 20.

A seed that more than HOT places of the benchmark share (questions that begin alike) is no hit by itself, or each document
with the phrase would be compared with each item. Of such a seed only one row is joined. A place that has it is joined again by
the seed and one more word at its distance, for each distance at which a window with the seed can have words, and among these
second seeds only those of few places count. That loses nothing: an overlap holds more agreeing words than the seed, and only
if nearly all of them could be ones that many items share at that distance is the seed's own row of the item kept as well.

A row of a hit holds the words around it and never its text, and positions are gone through in blocks, so a task holds the words of
one text and the hits of one block. Rows of the benchmark with the same words are one item; its ids join what was summed up.

The benchmark's seeds are counted. Within SEED_ROWS they are broadcast: then hashing and probing run in one pass over the
scan without a shuffle, and only verified overlaps, reduced by document and item in the task, are shuffled. Beyond that
seeds and hashes of places are joined by a shuffle (without texts; adaptive execution splits what is skewed), and only the
documents with hits, which are counted and broadcast if few, are read and tokenised again.

Defined results: null or empty texts have no overlaps; rows that share a doc_id are reported together, null ids too;
benchmark rows that repeat an item_id are separate passages of it; items of under five words count where they appear
whole; items without words have no overlaps; decontaminate() drops a row for its own text only; empty tables give an empty
table; only id and text columns are used, so further columns cannot clash.
"""

from __future__ import annotations

import math
from functools import cache, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import BROADCAST_PAIRS, broadcast_if_small, materialise, tagged, with_pairs

#: Words of the benchmark that are compared around a hit, and the share of them that must agree.
OVERLAP = 20
LEAST_MATCH = 0.8
#: Words in a row that are an overlap by themselves.
VERBATIM = 10
#: Seeds (three numbers each) that may be broadcast; items and documents with hits have bounds of their own.
SEED_ROWS = 1_000_000
#: Words of all items together that may be broadcast with them.
ITEM_WORDS = 1_000_000
#: Places of the benchmark that may share a seed.
HOT = 8
#: Positions of a text (or of an item) that are a row of their own, and the words around a position that go on with a hit.
BLOCK = 1_000
AROUND = 2 * OVERLAP + VERBATIM

#: Families of masks (positions that are kept), the most selective first; an item of few words has one mask of all of them.
FAMILIES = (((0, 1, 2, 4, 5), (0, 1, 2, 3, 5)), ((0, 1, 2, 4),), ((0, 1, 3),), ((0, 2),))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def agreeing(n: int) -> int:
    """Words that agree in every overlap of n words."""
    return math.ceil(LEAST_MATCH * n - 1e-9)


def serves(family: tuple[tuple[int, ...], ...], n: int) -> bool:
    """Whether a mask of the family fits between the replaced words of n, however they lie."""
    fits = [sum(1 << (at + k) for k in mask) for mask in family for at in range(n - mask[-1])]
    return all(any(not where & fit for fit in fits) for lost in combinations(range(n), n - agreeing(n)) for where in [sum(1 << k for k in lost)])


@cache
def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of n words."""
    n = min(n, OVERLAP)
    return next((f for f in FAMILIES if serves(f, n)), (tuple(range(n)),))


def _seeds(rows: DataFrame, masks: list[tuple[int, ...]], kept: list[str], place: str) -> DataFrame:
    """rows (with `tokens`) to one row for each position and mask that fits: kept columns, n (tokens in all), low, tokens (of a block,
    which begins with token `low`), place (counted from low), mask, span, seed.

    The rows that compiled code makes of one row are held at once, so each block of positions is a row of its own, with the words
    around it. Blocks are made by a function of arrays, which Spark does not compile together with what follows.
    """
    least, many = min(m[-1] for m in masks) + 1, len(masks)
    low = lambda b: F.greatest(F.lit(0), b * BLOCK - OVERLAP)
    block = lambda b: F.struct((b * BLOCK).alias("__from"), low(b).alias("low"), F.slice("tokens", low(b) + 1, F.lit(BLOCK + AROUND)).alias("tokens"))
    last = F.greatest(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int"))
    rows = rows.select(*kept, F.size("tokens").alias("n"), "tokens")
    blocks = rows.select(*kept, "n", F.inline_outer(F.transform(F.sequence(F.lit(0), last), block)))
    count = F.least(F.lit(BLOCK), F.col("n") - F.col("__from") - least + 1)
    # Masks are numbered along with the positions: one generator, and no row is built for a seed before it is joined.
    at = blocks.where(count > 0).select(*kept, "n", "low", "tokens", "__from", F.explode(F.sequence(F.lit(0), count * many - 1)).alias("__k"))
    at = at.select(*kept, "n", "low", "tokens", (F.col("__from") - F.col("low") + F.floor(F.col("__k") / many).cast("int")).alias(place), (F.col("__k") % many).alias("mask"))
    of_mask = lambda of: reduce(lambda x, m: F.when(F.col("mask") == m[0], of(*m)).otherwise(x), list(enumerate(masks))[1:], of(0, masks[0]))
    span = of_mask(lambda _, mask: F.lit(mask[-1] + 1))
    seed = of_mask(lambda nth, mask: F.xxhash64(F.lit(nth), *[F.get("tokens", F.col(place) + k) for k in mask]))
    return at.select(*kept, "n", "low", "tokens", place, "mask", span.alias("span"), seed.alias("seed")).where(F.col(place) + F.col("span") <= F.size("tokens"))


def _around(place: str) -> tuple[Column, Column, Column]:
    """Of a place in tokens that begin with token `low`: the place in the whole, the words around it (near), and where these begin (low)."""
    here = F.greatest(F.lit(0), F.col(place) - OVERLAP)
    return (F.col("low") + F.col(place)).alias(place), F.slice("tokens", here + 1, F.lit(AROUND)).alias("near"), (F.col("low") + here).alias("low")


def _second(place: str) -> Column:
    """(distance, key) for the words around a place with a seed: all that a window or run which holds the seed can hold."""
    around, at = F.sequence(F.col("span") - OVERLAP, F.lit(OVERLAP - 1)), F.col(place) - F.col("low")
    key = lambda d: F.when((at + d >= 0) & (at + d < F.size("near")), F.xxhash64("seed", d, F.get("near", at + d)))
    return F.array_compact(F.transform(around, key))


def _found(docs: DataFrame, benchmark: DataFrame, seed_rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) and (item_id, text) to (doc_id, tag, item, i, j, first_word, last_word, match) of every hit that stands, and
    (item, item_id), a written table; item stands for all rows of the benchmark with the same words."""
    named = benchmark.select("item_id", tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    named = materialise(named.select(F.xxhash64("tokens").alias("item"), "item_id", "tokens"))
    ids = materialise(named.select("item", "item_id").distinct())
    items = materialise(named.select("item", "tokens").dropDuplicates(["item"]).withColumn("size", F.least(F.size("tokens"), F.lit(OVERLAP))))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [OVERLAP]  # at most OVERLAP numbers
    masks = sorted({m for n in sizes for m in masks_of(n)})
    own = F.element_at(F.create_map(*[x for n in sizes for x in (F.lit(n), F.array(*[F.lit(masks.index(m)) for m in masks_of(n)]))]), F.col("size"))
    seeds = _seeds(items, masks, ["item", "size"], "j").where(F.array_contains(own, F.col("mask"))).select("item", "size", "span", "seed", *_around("j"))
    counts = seeds.groupBy("seed").agg(F.count("*").alias("places")).where(F.col("places") > HOT)
    seeds = materialise(seeds.join(counts, "seed", "left"))
    hot = seeds.where("places is not null").select("seed", "item", "j", "size", F.explode(_second("j")).alias("key"))
    crowded = hot.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    hot = materialise(hot.join(crowded, "key", "left").select("key", "seed", "item", "j", "size", F.col("n").isNotNull().alias("crowded")))
    second = materialise(hot.where("not crowded").select("key", F.col("item").alias("item2"), F.col("j").alias("j2")))
    # An item that could agree in words alone which many share keeps its own row of the seed. The mask's words are among them.
    enough = F.least(F.lit(VERBATIM), F.element_at(F.array(*[F.lit(agreeing(n)) for n in range(1, OVERLAP + 1)]), F.col("size")))
    shared = hot.groupBy("seed", "item", "j").agg(F.count_if("crowded").alias("n"), F.first("size").alias("size")).where(F.col("n") >= enough)
    places = seeds.where("places is null").select("seed", "item", "j").unionByName(shared.select("seed", "item", "j"))
    places = materialise(places.unionByName(seeds.where("places is not null").select("seed", F.lit(None).cast("long").alias("item"), F.lit(None).cast("int").alias("j")).distinct()))

    known = items.select("item", F.col("tokens").alias("passage"))
    known = broadcast_if_small(known, known.agg(F.sum(F.size("passage"))).first()[0] or 0, ITEM_WORDS)
    texts = docs.select("doc_id", F.xxhash64("text").alias("tag"), tokens(F.col("text")).alias("tokens"))
    few = places.count() + second.count() <= seed_rows
    own_key = F.when(F.col("item").isNull(), _second("i")).otherwise(F.array(F.lit(None).cast("long")))
    # Of a hit's text only the words around it go on: a row is never as long as its text, whose hits may be many.
    columns = ["doc_id", "tag", "n", "i", "low", "near", "span", "item", "j"]
    at_seed = _seeds(texts, masks, ["doc_id", "tag"], "i")
    if few:
        hits = at_seed.join(F.broadcast(places), "seed").select("doc_id", "tag", "n", "span", "seed", "item", "j", *_around("i"))
        hits = hits.select(*columns, F.explode(own_key).alias("key")).join(F.broadcast(second), "key", "left")
    else:
        thin = at_seed.select("doc_id", "tag", (F.col("low") + F.col("i")).alias("i"), "span", "seed").join(places, "seed")
        thin = materialise(thin)
        pairs = materialise(thin.select("doc_id", "tag").distinct())
        again = with_pairs(tagged(docs, F.col("text")), pairs, "left_semi").dropDuplicates(["doc_id", "__tag"])
        again = again.select(F.col("doc_id").alias("__doc"), "__tag", tokens(F.col("text")).alias("tokens"), F.lit(0).alias("low"))
        hits = thin.join(again, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("tag") == F.col("__tag")))
        hits = hits.select("doc_id", "tag", F.size("tokens").alias("n"), "span", "seed", "item", "j", *_around("i"))
        hits = hits.select(*columns, F.explode(own_key).alias("key"))
        plain = hits.where("key is null").withColumns({"item2": F.lit(None).cast("long"), "j2": F.lit(None).cast("int")})
        hits = plain.unionByName(hits.where("key is not null").join(second, "key"))
    hits = hits.select("doc_id", "tag", F.coalesce("item", "item2").alias("item"), "i", F.coalesce("j", "j2").alias("j"), F.col("span").alias("width"), "low", "near", "n")
    # Hits are written before they are compared, so that the pass over all positions stays one short piece of compiled code.
    return _verified(materialise(hits.where("item is not null")).join(known, "item")), ids


def overlaps(docs: DataFrame, benchmark: DataFrame, seed_rows: int = SEED_ROWS) -> DataFrame:
    """(doc_id, text) and (item_id, text) to (doc_id, item_id, n_hits, first_word, last_word, match)."""
    found, ids = _found(docs, benchmark, seed_rows)
    words = [F.min("first_word").cast("long").alias("first_word"), F.max("last_word").cast("long").alias("last_word"), F.max("match").alias("match")]
    summed = lambda hits, item: hits.groupBy("doc_id", item).agg(F.count_distinct("tag", "i", "j").alias("n_hits"), *words)
    named = lambda rows, names: rows.join(broadcast_if_small(names.select("item", "item_id"), names.count(), BROADCAST_PAIRS), "item").drop("item")
    # An item's overlaps are summed up once for all ids that have just this passage; ids of several passages need the hits themselves.
    several = materialise(ids.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("item_id").alias("__id")))
    if not several.take(1):
        return named(summed(found, "item"), ids).select("doc_id", "item_id", "n_hits", "first_word", "last_word", "match")
    found, same = materialise(found), F.col("item_id").eqNullSafe(F.col("__id"))
    one, more = (materialise(ids.join(several, same, how)) for how in ("left_anti", "left_semi"))
    return named(summed(found, "item"), one).select("doc_id", "item_id", "n_hits", "first_word", "last_word", "match").unionByName(summed(named(found, more), "item_id"))


def _verified(hits: DataFrame) -> DataFrame:
    """Hits whose surroundings agree: the best OVERLAP words of the passage with the seed, or all of a shorter passage."""
    length, n, shift = F.size("passage"), F.col("n"), F.col("i") - F.col("j")
    short = length < OVERLAP
    width = F.col("width")
    base = F.when(short, F.lit(0)).otherwise(F.col("j") + width - OVERLAP)
    hits = hits.select("doc_id", "tag", "item", "i", "near", "low", "n", "passage", length.alias("length"), "j", "width", shift.alias("shift"), base.alias("base"))
    # Bit k tells whether word base + k agrees.
    same = lambda p: (p >= 0) & (F.col("shift") + p >= 0) & F.coalesce(F.get("near", F.col("shift") + p - F.col("low")) == F.get("passage", p), F.lit(False))
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(2 * OVERLAP - 1) - width),
        F.lit(0).cast("long"),
        lambda x, k: F.shiftleft(x, 1).bitwiseOR(F.when(same(F.col("base") + (2 * OVERLAP - 1) - F.col("width") - k), F.lit(1)).otherwise(F.lit(0)).cast("long")),
    )
    run = F.forall(F.sequence(F.col("j"), F.col("j") + (VERBATIM - 1)), same)
    # A generator of one row keeps Spark from writing the comparison out anew for each of its uses below.
    hits = hits.select("*", F.inline(F.array(F.struct(bits.alias("bits"), run.alias("run"))))).drop("near", "passage")
    length, short = F.col("length"), F.col("length") < OVERLAP
    within = lambda s: F.bit_count(F.shiftrightunsigned("bits", s).bitwiseAND(F.lit((1 << OVERLAP) - 1)))
    best = F.greatest(*[F.when(s <= OVERLAP - width, F.struct(within(s).alias("agree"), F.lit(-s).alias("s"))) for s in range(OVERLAP)])
    best = F.when(short, F.struct(within(0).alias("agree"), F.lit(0).alias("s"))).otherwise(best)
    hits = hits.select("*", best.alias("best"), F.least(length, F.lit(OVERLAP)).alias("size"))
    match = F.col("best.agree") / F.col("size")
    hits = hits.withColumn("match", match).where((F.col("match") >= LEAST_MATCH) | F.col("run"))
    start = F.greatest(F.lit(0), F.least(F.col("base") - F.col("best.s"), length - F.col("size")))
    first = F.greatest(F.lit(0), F.col("shift") + start)
    return hits.select("doc_id", "tag", "item", "i", "j", first.alias("first_word"), (F.least(n, F.col("shift") + start + F.col("size")) - 1).alias("last_word"), "match")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, in the same columns, without those that overlap with the benchmark."""
    found, _ = _found(docs.select("doc_id", "text"), benchmark, SEED_ROWS)
    hit = materialise(found.select("doc_id", "tag").distinct())
    return with_pairs(tagged(docs, F.col("text")), hit, "left_anti").drop("__tag")
