"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: each slot is a bitmask over languages, and the AND of an
n-gram's slots gives every language that contains it. A text's hits are counted per language, each count is corrected for
that language's rate of false positives, and the largest corrected count decides.

Fitting is a Spark job: n-grams are counted by document in the tasks, summed by a shuffle, and set into the slots by
bit_or. What reaches the driver is the filter, whose size is a parameter. The classifier is fitted on a bounded sample:
at most about `docs_per_language` labelled documents of each language, chosen by a hash of id and text, so that null ids
are like any other; all of them where there are fewer. Rows equal in id and text count once. Prediction is map-only.

Defined results: a text that is null or without a letter is `und` with score 0; without any labelled document every text
is; ties go to the language with more labelled documents, then to the first by name; repeated rows are predicted alike;
an empty table gives an empty table; columns named like an output column are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.llm.common import bounded_batches

N = 4
SLOT_BITS = 20
HASHES = 3
DOCS_PER_LANGUAGE = 4000
#: An n-gram belongs to a language if this share of its sampled documents, and two at least, have it.
LEAST_SHARE = 0.005
#: Characters of a text that are hashed at once.
SLICE = 1_000_000
#: Distinct (n-gram, language) counts that a task gathers before it passes them on.
FLUSH = 2_000_000
UNDETERMINED = "und"

_LETTERS = np.zeros(0, bool)


def letters() -> np.ndarray:
    """Which code points are letters; built once in a worker."""
    global _LETTERS
    if not len(_LETTERS):
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def gram_slices(text: str) -> Iterator[np.ndarray]:
    """Hashes (uint64) of the n-grams of letters of a text in lower case, each run of other characters being one gap; for
    SLICE characters at a time, so that a long text takes no more memory than its own and a slice's arrays."""
    text, any_letter = text.lower(), False
    codes, after_letter = np.zeros(1, np.uint64), True
    for at in range(0, len(text), SLICE):
        new = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = letters()[new]
        any_letter |= bool(is_letter.any())
        new = np.where(is_letter, new, 0)[is_letter | np.concatenate([[after_letter], is_letter[:-1]])]
        after_letter = bool(is_letter[-1])
        codes = np.concatenate([codes, new.astype(np.uint64)])
        if len(codes) >= N and at + SLICE < len(text):
            yield _hashed(codes)
            codes = codes[len(codes) - N + 1 :]
    if any_letter:
        yield _hashed(np.concatenate([codes, np.zeros(max(1, N - len(codes)), np.uint64)]))


def _hashed(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes) - N + 1, np.uint64)
    for k in range(N):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - N + 1 + k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def ngrams(text: str) -> np.ndarray:
    """Distinct hashes of a text's n-grams, in order."""
    found = np.empty(0, np.uint64)
    for part in gram_slices(text):
        found = np.union1d(found, part)
    return found


def slots(grams: np.ndarray) -> list[np.ndarray]:
    return [(grams >> np.uint64(SLOT_BITS * k)).astype(np.int64) & ((1 << SLOT_BITS) - 1) for k in range(HASHES)]


@dataclass
class LanguageFilter:
    languages: list[str]  # more labelled documents first
    table: np.ndarray  # (slots, bytes) of bits by language
    false_rate: np.ndarray  # by language: chance that an n-gram it lacks seems to be in it

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        """Number of n-grams, and the corrected number in each language."""
        n, hits = 0, np.zeros(8 * self.table.shape[1], np.int64)
        for grams in gram_slices(text):
            at = slots(grams)
            masks = self.table[at[0]]
            for more in at[1:]:
                masks = masks & self.table[more]
            n += len(grams)
            hits += np.unpackbits(masks, axis=1, bitorder="little").sum(0, dtype=np.int64)
        hits = hits[: len(self.languages)]
        return n, np.clip((hits - n * self.false_rate) / (1 - self.false_rate), 0, n)

    def predict(self, text: str | None) -> tuple[str, float]:
        n, counts = self.counts(text) if text and self.languages else (0, None)
        if not n:
            return UNDETERMINED, 0.0
        best = int(counts.argmax())
        return self.languages[best], float(counts[best] / n)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, text) to (gram, language, number of documents), added up within the task as far as FLUSH allows."""
    held: dict[int, list[np.ndarray]] = {}
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def settle() -> int:
        for language, parts in held.items():
            old = sums.get(language)
            grams = np.concatenate([*parts, *([old[0]] if old else [])])
            weights = np.concatenate([np.ones(sum(map(len, parts)), np.int64), *([old[1]] if old else [])])
            distinct, inverse = np.unique(grams, return_inverse=True)
            sums[language] = distinct, np.bincount(inverse, weights, len(distinct)).astype(np.int64)
        held.clear()
        return sum(len(g) for g, _ in sums.values())

    def out() -> Iterator[pa.RecordBatch]:
        for language, (grams, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), language, np.int32)), pa.array(n)], names=["gram", "language", "n"])
        sums.clear()

    waiting = 0
    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            grams = ngrams(text)
            held.setdefault(language, []).append(grams)
            waiting += len(grams)
            if waiting > FLUSH:
                waiting = 0
                if settle() > FLUSH:
                    yield from out()
    settle()
    yield from out()


def fit(docs: DataFrame, language: str = "lang", key: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE) -> LanguageFilter:
    """Learn from all rows given, of which language and text are not null."""
    spark = docs.sparkSession
    bounded_batches(spark)
    labelled = docs.where(F.col(language).isNotNull() & F.col("text").isNotNull()).select(F.col(language).alias("language"), F.col(key).alias("key"), "text")
    sizes = {r["language"]: r["n"] for r in labelled.groupBy("language").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    width = max(1, -(-len(languages) // 8))
    table = np.zeros((1 << SLOT_BITS, width), np.uint8)
    if not languages:
        return LanguageFilter([], table, np.zeros(0))
    ranks = spark.createDataFrame([(x, i, min(1.0, docs_per_language / sizes[x]), max(2, int(LEAST_SHARE * min(sizes[x], docs_per_language)))) for i, x in enumerate(languages)], "language string, rank int, share double, least long")
    drawn = labelled.join(F.broadcast(ranks), "language").withColumn("draw", F.xxhash64("key", "text"))
    sampled = drawn.where(F.pmod("draw", F.lit(1_000_000)) < F.col("share") * 1_000_000).groupBy("rank", "draw").agg(F.first("text").alias("text"))
    counts = sampled.select("rank", "text").mapInArrow(_counted, "gram long, language int, n long").groupBy("gram", "language").agg(F.sum("n").alias("n"))
    known = counts.join(F.broadcast(ranks.select(F.col("rank").alias("language"), "least")), "language").where("n >= least")
    at = [F.shiftrightunsigned("gram", SLOT_BITS * k).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) for k in range(HASHES)]
    bits = known.select(F.explode(F.array(*at)).alias("slot"), F.floor(F.col("language") / 8).cast("int").alias("byte"), F.expr("shiftleft(1, language % 8)").alias("bit"))
    filled = bits.groupBy("slot", "byte").agg(F.bit_or("bit").alias("bits")).toPandas()  # as many rows as the filter has bytes, at most
    table[filled["slot"].to_numpy(np.int64), filled["byte"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.uint8)
    share = np.unpackbits(table, axis=1, bitorder="little").mean(0)[: len(languages)]
    return LanguageFilter(languages, table, np.minimum(share**HASHES, 0.999))


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and a score from 0 to 1: the corrected share of n-grams in that language."""
    kept = docs.select(*[docs[c] for c in docs.columns if c.lower() not in (lang.lower(), score.lower())])
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [shared.value.predict(t) for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*batch.schema.names, lang, score])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))
