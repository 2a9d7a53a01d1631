"""Operators on whole data sets: filters, masks, alignment, ensembles, samples and splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.functions.sequence import CODES, canonical
from strandflow.operators import ranks, selection
from strandflow.operators.overlap import classes_of, mean_vector

#: K-mers that a task holds before it sums them up.
PIECE = 1 << 22
#: Letters of the longest k-mer that is counted by a code of 64 bits.
MOST_MER = 16

#: What each mode adds to the columns of a chunk.
MODES = {"X": ["x"], "y": ["y", "phases", "sample_weights", "gene_lengths"], "anno_meta": ["err_sample", "fully_intergenic", "is_annotated"], "transitions": ["transitions"]}


def project_modes(chunks: DataFrame, modes: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The key columns and those of the modes; columns that are not there are left out. Nothing else is read."""
    wanted = [c for m in modes for c in MODES[m]]
    return chunks.select(*keys, *[c for c in wanted if c in chunks.columns])


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows; an error if a key occurs twice."""
    n = F.count("*").over(Window.partitionBy(*keys))
    ok = F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("duplicate"), *[F.col(k).cast("string") for k in keys])).cast("boolean"))
    return df.withColumn("__n", n).where(ok).drop("__n")


def require_one(df: DataFrame, what: str) -> DataFrame:
    """A row with n = 1; an error unless there is exactly one row."""
    return df.agg(F.count("*").alias("n")).where(F.when(F.col("n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.col("n").cast("string"))).cast("boolean")))


def keep_valid(chunks: DataFrame, valid: str = "err_sample", annotated: str = "is_annotated") -> DataFrame:
    """Chunks with a valid base and with annotation."""
    return chunks.where(F.col(valid) & F.col(annotated))


def keep_only(df: DataFrame, species: Sequence[str] | None = None, seqids: Sequence | None = None) -> DataFrame:
    """Rows of the species or of the sequences listed; exactly one of the two."""
    if (species is None) == (seqids is None):
        raise ValueError("give species or seqids, and not both")
    return df.where(F.col("species").isin(list(species))) if species is not None else df.where(F.col("seqid").isin(list(seqids)))


def mask_by(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in another data set."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def without(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def align(data: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Data and predictions side by side, by key and never by order."""
    return data.join(predictions, list(keys))


def ensemble(predictions: Sequence[DataFrame], keys: Sequence[str], p: str = "p") -> DataFrame:
    """Mean vector over models for each key, the number of models and their names."""
    if len(predictions) < 2:
        raise ValueError("an ensemble has two members at least")
    rows = predictions[0]
    for more in predictions[1:]:
        rows = rows.unionByName(more)
    mean = mean_vector(p, classes_of(predictions[0], p))
    return rows.groupBy(*keys).agg(mean.alias(p), F.count("*").alias("n_models"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


#: Rows of a sample that one task may sort.
SMALL_SAMPLE = 1000


def sample(df: DataFrame, keys: Sequence[str], n: int, seed: str = "") -> DataFrame:
    """n rows (all, if there are fewer), those first in an order that a hash of the key fixes: the same sample from any
    partitioning. For a larger n the n-th hash is found by counting, and rows are then taken where they are."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    rows = df.withColumn("__digest", digest)
    if n <= SMALL_SAMPLE:
        return rows.orderBy("__digest").limit(n).drop("__digest")
    rows = rows.withColumn("__key", F.conv(F.substring("__digest", 1, 13), 16, 10).cast("double"))  # 52 bits: whole in a double
    last = selection.nth_values(rows, [], "__key", {"at": F.least(F.lit(n), F.col("n")) - 1}).first()
    if last is None:
        return df
    below = rows.where(F.col("__key") < last["at"])
    ties = rows.where(F.col("__key") == last["at"]).orderBy("__digest").limit(max(0, n - below.count()))
    return below.unionByName(ties).drop("__digest", "__key")


def epoch_order(df: DataFrame, keys: Sequence[str], seed: int, epoch: int) -> DataFrame:
    """All rows with all their columns in an order that seed, epoch and key fix; every epoch has another. The rows are
    partitioned by ranges of a hash, so no task sees them all; rows of equal keys stay together."""
    mixed = F.xxhash64(F.lit(seed), F.lit(epoch), *keys)
    return df.orderBy(mixed, *keys)


def first_rows(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_n(df: DataFrame, by: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def lexsorted(chunks: DataFrame) -> DataFrame:
    """Species, sequence, plus before minus, then coordinates."""
    return chunks.orderBy("species", "seqid", F.col("start") > F.col("end"), "start", "end")


def first_of_group(df: DataFrame, group: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows at which the group changes; never the very first row."""
    before = F.lag(group).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("__before", before).where(F.col("__before") != F.col(group)).drop("__before")


def n90_split(sequences: DataFrame, by: Sequence[str], share: float = 0.9, validation: int = 5) -> DataFrame:
    """Whole sequences to `train` or `val`, apart for those that make up `share` of the bases (longest first) and the rest:
    every `validation`-th of either stratum, in order of length, is for validation."""
    order = Window.partitionBy(*by).orderBy(F.desc("length"), "seqid")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    strata = sequences.withColumn("large", before < share * F.sum("length").over(Window.partitionBy(*by)))
    nth = F.row_number().over(Window.partitionBy(*by, "large").orderBy(F.desc("length"), "seqid"))
    return strata.withColumn("split", F.when(nth % validation == 0, "val").otherwise("train"))


def most_certain(chunks: DataFrame, keep: float, stratum: Column, error: str = "error", tie: str = "chunk") -> DataFrame:
    """The share of chunks with the least error within each stratum; chunks of a few strata are ranked by many tasks."""
    return ranks.first_share(chunks.withColumn("stratum", stratum), ["stratum"], [error, tie], keep)


def mer_rows(sequences: DataFrame, keys: Sequence[str], k: int, seq: str = "seq") -> DataFrame:
    """(keys, mer): one row for each k-mer. Joining bases of a generated position stays in compiled code."""
    bases = sequences.where(F.length(seq) >= k).select(*keys, F.split(seq, "").alias("__bases"), F.length(seq).alias("__n"))
    at = bases.select(*keys, "__bases", F.explode(F.sequence(F.lit(0), F.col("__n") - k)).alias("__i"))
    return at.select(*keys, F.concat(*[F.get("__bases", F.col("__i") + j) for j in range(k)]).alias("mer"))


def mer_codes(k: int) -> Callable[[str], Iterator[np.ndarray]]:
    """Codes, of four bits a letter, of the k-mers of a text, in slices of bounded length."""
    letters = np.frombuffer(CODES.encode(), np.uint8)
    code = np.full(256, CODES.index("N"), np.uint64)
    code[letters] = code[np.char.lower(letters.view("S1")).view(np.uint8)] = np.arange(len(letters))

    def codes(text: str) -> Iterator[np.ndarray]:
        raw = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
        for at in range(0, len(raw) - k + 1, PIECE):
            c = code[raw[at : at + PIECE + k - 1]]
            h = np.zeros(len(c) - k + 1, np.uint64)
            for j in range(k):
                h = (h << np.uint64(4)) | c[j : j + len(h)]
            yield h

    return codes


def mer_texts(mers: np.ndarray, k: int) -> pa.Array:
    letters, shifts = np.frombuffer(CODES.encode(), np.uint8), np.arange(4 * (k - 1), -1, -4, dtype=np.uint64)
    text = letters[((mers[:, None] >> shifts) & np.uint64(15)).astype(np.int64)].tobytes().decode()
    return pa.array([text[i : i + k] for i in range(0, len(text), k)], pa.string())


def count_mers(sequences: DataFrame, keys: Sequence[str], k: int, seq: str = "seq") -> DataFrame:
    """(keys, mer, n) of all k-mers, in upper case, of at most MOST_MER letters.

    A task counts codes of four bits a letter, batch by batch, so a row leaves it for each k-mer and batch and not for each
    base. Letters that are no code count as N.
    """
    if not 1 <= k <= MOST_MER:
        raise ValueError(f"k-mers have 1 to {MOST_MER} letters")
    kept = sequences.select(*keys, seq)
    codes, piece = mer_codes(k), PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: dict[tuple, int] = {}
            held: dict[tuple, list] = {}
            sums: dict[tuple, tuple] = {}
            waiting = 0

            def settle() -> None:
                for key, parts in held.items():
                    mers, n = sums.get(key, (np.empty(0, np.uint64), np.empty(0, np.int64)))
                    weights = np.concatenate([n, np.ones(sum(map(len, parts)), np.int64)])
                    distinct, inverse = np.unique(np.concatenate([mers, *parts]), return_inverse=True)
                    sums[key] = distinct, np.bincount(inverse, weights, len(distinct)).astype(np.int64)
                held.clear()

            columns = [batch.column(c).to_pylist() for c in range(len(keys))]
            for row, text in enumerate(batch.column(len(keys)).to_pylist()):
                key = tuple(c[row] for c in columns)
                at.setdefault(key, row)
                for h in codes(text or ""):
                    held.setdefault(key, []).append(h)
                    waiting += len(h)
                    if waiting > piece:
                        settle()
                        waiting = 0
            settle()
            for key, (mers, n) in sums.items():
                own = [batch.column(c).take(pa.array([at[key]] * len(mers))) for c in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, mer_texts(mers, k), pa.array(n)], names=[*keys, "mer", "n"])

    schema = T.StructType([*[kept.schema[c] for c in keys], T.StructField("mer", T.StringType()), T.StructField("n", T.LongType())])
    return kept.mapInArrow(run, schema).groupBy(*keys, "mer").agg(F.sum("n").alias("n"))


def mers_and_holders(pieces: DataFrame, keys: Sequence[str], k: int, block: int = 1000) -> DataFrame:
    """(mer, n, n_sequences): all k-mers, and how many sequences (with keys that are not null) have them.

    pieces: keys, piece, n_pieces (of the sequence), bases (with an edge of k - 1). They are shuffled by sequence and block of
    pieces. A task sums up the sequences of one block, so what leaves it for them is a row for each k-mer; only of longer
    sequences does a row leave for each k-mer and block, to be told apart by sequence.
    """
    if not 1 <= k <= MOST_MER:
        raise ValueError(f"k-mers have 1 to {MOST_MER} letters")
    codes, width = mer_codes(k), len(keys)
    dealt = pieces.select(*keys, F.floor(F.col("piece") / block).alias("__block"), (F.col("n_pieces") > block).alias("__long"), "bases")
    dealt = dealt.repartition(*keys, "__block").sortWithinPartitions(*keys, "__block")
    schema = T.StructType([*[T.StructField(c, pieces.schema[c].dataType) for c in keys], T.StructField("split", T.BooleanType()), T.StructField("mer", T.StringType()), T.StructField("n", T.LongType()), T.StructField("holders", T.LongType())])

    def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        distinct, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return distinct, *[np.bincount(inverse, np.concatenate([p[j] for p in parts]), len(distinct)).astype(np.int64) for j in (1, 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple[np.ndarray, ...]] = []  # of sequences of one block: mers, counts, holders
        own: list[tuple[np.ndarray, ...]] = []  # of the sequence and block at hand
        now, split, held, waiting, kinds = None, False, 0, 0, None

        def rows(of: tuple[np.ndarray, ...], key: tuple, split: bool) -> pa.RecordBatch:
            sides = [pa.array([x] * len(of[0]), kind) for x, kind in zip(key, kinds, strict=True)]
            values = [pa.array([split] * len(of[0]), pa.bool_()), mer_texts(of[0], k), pa.array(of[1]), pa.array(of[2])]
            return pa.RecordBatch.from_arrays([*sides, *values], names=schema.names)

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal own, whole, waiting
            if not own:
                return
            mers, n, _ = summed(own)
            own = []
            found = mers, n, np.full(len(mers), int(all(x is not None for x in now[:width])), np.int64)
            if split:
                yield rows(found, now[:width], True)
            else:
                whole.append(found)
                waiting += len(mers)
                if waiting > PIECE // 4:
                    whole, waiting = [summed(whole)], 0

        for batch in batches:
            kinds = [batch.column(c).type for c in range(width)]
            columns = [batch.column(c).to_pylist() for c in range(width + 3)]
            for *key, long, bases in zip(*columns, strict=True):
                if tuple(key) != now:
                    yield from done()
                    now, split, held = tuple(key), False, 0
                split = split or long
                for h in codes(bases):
                    own.append((h, np.ones(len(h), np.int64), np.zeros(len(h), np.int64)))
                    held += len(h)
                    if held > PIECE:
                        own, held = [summed(own)], 0
        yield from done()
        if whole:
            yield rows(summed(whole), (None,) * width, False)

    counted = dealt.mapInArrow(run, schema).groupBy("split", *keys, "mer").agg(F.sum("n").alias("n"), F.when(F.col("split"), F.max("holders")).otherwise(F.sum("holders")).alias("holders"))
    return counted.groupBy("mer").agg(F.sum("n").alias("n"), F.sum("holders").alias("n_sequences"))


def canonical_mers(mers: DataFrame, by: Sequence[str], mer: str = "mer", n: str = "n") -> DataFrame:
    """Counts of k-mers and their reverse complements taken as one."""
    return mers.groupBy(*by, canonical(F.col(mer)).alias("mer")).agg(F.sum(n).cast("long").alias("n"))


def fraction_of_total(df: DataFrame, by: Sequence[str], n: str) -> DataFrame:
    return df.withColumn("fraction", F.col(n) / F.sum(n).over(Window.partitionBy(*by)))


def summary(df: DataFrame, by: Sequence[str], value: str, filters: dict[str, Column]) -> DataFrame:
    """Median, mean and population deviation of a score, for each named filter, in one pass."""
    out = []
    for name, keep in filters.items():
        v = F.when(keep, F.col(value))
        out += [F.median(v).alias(f"{name}_median"), F.avg(v).alias(f"{name}_mean"), F.stddev_pop(v).alias(f"{name}_std")]
    return df.groupBy(*by).agg(*out)


def large_summary(df: DataFrame, by: Sequence[str], value: str, filters: dict[str, Column]) -> DataFrame:
    """The same for groups whose values no task should hold: medians are selected by histograms that are refined."""
    tagged = F.array_compact(F.array(*[F.when(keep, F.lit(name)) for name, keep in filters.items()]))
    rows = df.select(*by, F.col(value).alias("__x"), F.explode(tagged).alias("__filter"))
    moments = df.groupBy(*by).agg(*[a(F.when(keep, F.col(value))).alias(f"{name}_{what}") for name, keep in filters.items() for what, a in (("mean", F.avg), ("std", F.stddev_pop))])
    middle = selection.medians(rows, [*by, "__filter"], "__x")
    wide = middle.groupBy(*by).agg(*[F.max(F.when(F.col("__filter") == name, F.col("median"))).alias(f"{name}_median") for name in filters])
    return moments.join(wide, list(by), "left")
