"""Vector code compression: vectors as indexes into a codebook for each of their parts, the nearest entry found in a tree.

Components become whole numbers, floor(scale * x), and vectors are cut into equal consecutive parts. A codebook starts as
the parts of the first vectors by id. A round assigns every part to the nearest entry (squared Euclidean distance, ties to
the lower index) and replaces each entry by the floor of its parts' mean; entries without parts stay.

The nearest entry is found in a vantage-point tree of the entries of a part position: a node is an entry with the others
split at the median distance to it, and each half knows the least and greatest of its distances. By the triangle inequality
a half is out of reach if the query's own distance to the vantage point differs from that range by more than the best so
far. Bounds are rounded so that a half is never left out wrongly, and it is visited if its bound only equals the best, so
that a tie with a lower index is seen. What is visited is compared in whole numbers, so results are exact. All rows of a
batch descend together, in arrays.

Scale: each round is one pass over the vectors, in which a task sums its own parts and gives one row for each component of
a codebook; only those sums (entries x dimension numbers) reach the driver, whatever the number of vectors. Vectors are
never shuffled, so neither a common vector nor a common id gathers in a task. Sums by label are joined back by a lookup that
is broadcast only if counted small.

Defined results: rows whose vector is null or holds a null or non-finite component go. The vector of the least id whose
length is a multiple of the number of parts sets the dimension; rows of another length go as well. Null ids come after all
others, and rows of one id go by their vectors. Fewer vectors than entries make a smaller codebook; an empty table gives an
empty table. Scaled components beyond 2**62 are cut to that, and errors beyond a long are the greatest long. Null labels are
one label. Only the columns named are used, so further ones cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import BROADCAST_PAIRS, join_by_hot_key, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries of a leaf.
LEAF = 2
#: Components up to this many bits have distances that 64 bits hold, in parts of up to 128 components.
NARROW_BITS = 26
#: Rows that descend a tree together.
ROWS = 4096
#: More than the relative error of a root or difference of doubles.
SLACK = 2.0**-48
GREATEST = (1 << 63) - 1


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit whole numbers; the scale is a power of two, so the product is exact."""
    most = float(1 << 62)
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -most, most).astype(np.int64)


def _is_wide(numbers: np.ndarray) -> bool:
    return numbers.shape[1] > 128 or bool(int(np.abs(numbers).max(initial=0)) >> NARROW_BITS)


def squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    apart = points - entry
    return (apart * apart).sum(1)


class Tree:
    """Vantage-point tree of the entries (n, width) of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.wide = _is_wide(entries)
        self.top = self._node(list(range(len(entries))), entries.astype(object) if self.wide else entries)

    def _node(self, among: list[int], entries: np.ndarray):
        if len(among) <= LEAF:
            return among
        first, rest = among[0], among[1:]
        apart = np.sqrt(squared(entries[rest], entries[first]).astype(np.float64))
        order = np.argsort(apart, kind="stable")
        half = (len(rest) + 1) // 2
        sides = []
        for side in (order[:half], order[half:]):
            below = self._node([rest[i] for i in side], entries)
            sides.append((below, float(apart[side].min()) * (1 - SLACK), float(apart[side].max()) * (1 + SLACK)))
        return first, float(apart[order[half - 1]]), sides

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, and its squared distance: exact, in Python's numbers where 64 bits would not do."""
        wide = self.wide or _is_wide(points)
        points, entries = (x.astype(object) if wide else x for x in (points, self.entries))
        best, least = np.zeros(len(points), np.int64), squared(points, entries[0])
        self._descend(self.top, entries, points, np.arange(len(points)), best, least)
        return best, least

    def _compare(self, k: int, entries: np.ndarray, points: np.ndarray, rows: np.ndarray, best: np.ndarray, least: np.ndarray) -> np.ndarray:
        apart = squared(points[rows], entries[k])
        nearer = ((apart < least[rows]) | ((apart == least[rows]) & (k < best[rows]))).astype(bool)
        best[rows[nearer]] = k
        least[rows[nearer]] = apart[nearer]
        return apart

    def _descend(self, node, entries: np.ndarray, points: np.ndarray, rows: np.ndarray, best: np.ndarray, least: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, list):
            for k in node:
                self._compare(k, entries, points, rows, best, least)
            return
        first, border, sides = node
        away = np.sqrt(self._compare(first, entries, points, rows, best, least).astype(np.float64))
        inner = away <= border
        for likely in (True, False):  # first the half on the query's side, then the other where it is still in reach
            for (below, low, high), own in zip(sides, (inner == likely, inner != likely), strict=True):
                bound = np.maximum(away - high, low - away) - (away + high) * SLACK
                reach = bound <= np.sqrt(least[rows].astype(np.float64)) * (1 + SLACK)
                self._descend(below, entries, points, rows[own & reach], best, least)


def assign(numbers: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows, dimension) to indexes (rows, parts) and the squared distances of each part."""
    width = numbers.shape[1] // len(trees)
    found = [t.nearest(numbers[:, p * width : (p + 1) * width]) for p, t in enumerate(trees)]
    return np.stack([f[0] for f in found], 1), [f[1] for f in found]


def _usable(vector: Column) -> Column:
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, plain)


def usable(df: DataFrame, id: str = "vec_id", vector: str = "embedding", parts: int = PARTS) -> tuple[DataFrame, int]:  # noqa: A002
    """Rows that take part, (all columns of df), and the dimension (0 if there are none)."""
    fit = df.where(F.coalesce(_usable(F.col(vector)), F.lit(False)) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    first = fit.select(F.size(vector).alias("n"), id, vector).orderBy(F.col(id).asc_nulls_last(), vector).limit(1).collect()
    size = first[0]["n"] if first else 0
    return fit.where(F.size(vector) == size), size


def _numbers(column: pa.ListArray, size: int, scale: int) -> np.ndarray:
    return whole_numbers(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size), scale)


def train(fit: DataFrame, size: int, id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:  # noqa: A002
    """The codebook of each part position, (entries, size / parts) whole numbers, from rows of one dimension."""
    width = size // parts
    start = fit.select(id, F.col(vector).cast("array<double>").alias("v")).orderBy(F.col(id).asc_nulls_last(), "v").limit(entries).select("v").collect()
    first = whole_numbers(np.array([r["v"] for r in start], np.float64).reshape(-1, size), scale)
    books = [first[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            trees = [Tree(b) for b in books]
            sums = [np.zeros(b.shape, object) for b in books]
            counts = np.zeros((parts, len(first)), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    numbers = _numbers(batch.column(0).slice(at, ROWS), size, scale)
                    codes, _ = assign(numbers, trees)
                    for p in range(parts):
                        part = numbers[:, p * width : (p + 1) * width]
                        for k in np.unique(codes[:, p]):
                            own = part[codes[:, p] == k]
                            counts[p, k] += len(own)
                            sums[p][k] += own.astype(object).sum(0) if np.abs(own).max() >> 40 else own.sum(0).astype(object)
            p, k = np.nonzero(counts)
            at = [(a, b, j, sums[a][b][j], counts[a, b]) for a, b in zip(p, k, strict=True) for j in range(width)]
            columns = list(zip(*at, strict=True)) or [[]] * 5
            types = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
            made = [pa.array([Decimal(int(x)) for x in c] if t == pa.decimal128(38, 0) else [int(x) for x in c], t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(made, names=["part", "entry", "position", "total", "n"])

        parted = fit.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "part int, entry int, position int, total decimal(38,0), n long")
        books = [b.copy() for b in books]
        for r in parted.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # entries x dimension rows at most
            books[r["part"]][r["entry"], r["position"]] = int(r["total"]) // r["n"]
    return books


def written(books: list[np.ndarray]) -> str:
    """All components, decimal, by part, entry and position."""
    return ",".join(str(int(x)) for b in books for x in b.ravel())


def digest(books: list[np.ndarray]) -> str:
    return sha256(written(books).encode()).hexdigest()


def encode(fit: DataFrame, size: int, books: list[np.ndarray], vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows without their vectors, with codes (array of indexes) and error (the sum of the squared distances)."""
    kept = [c for c in fit.columns if c != vector]
    schema = ", ".join([*[f"`{c}` {fit.schema[c].dataType.simpleString()}" for c in kept], "codes array<int>, error long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                codes, apart = assign(_numbers(batch.column(len(kept)), size, scale), trees)
                error = [min(sum(map(int, x)), GREATEST) for x in zip(*apart, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], lists, pa.array(error, pa.int64())], names=[*kept, "codes", "error"])

    return fit.select(*kept, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, schema)


def decoded(codes: np.ndarray, books: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The vectors that codes (rows, parts) stand for."""
    return np.concatenate([b[codes[:, p]] for p, b in enumerate(books)], 1) / scale


def hexadecimal(codes: Column) -> Column:
    """Two lowercase hex digits for each index."""
    return F.lower(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 2, "0")), ""))


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded, a written table, with the sum of error over rows of the same label, nulls together."""
    key = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(GREATEST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(key.alias("__label")).agg(total.alias("label_error"), F.count("*").alias("__n"))
    lookup = materialise(sums)
    return join_by_hot_key(coded.withColumn("__label", key), lookup, "__label", "__n", narrow=lookup.count() <= BROADCAST_PAIRS).drop("__label", "__n")


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:  # noqa: A002
    """(id, label, codes, error, label_error) of the rows that take part, and the codebooks."""
    rows = df.select(id, vector, label)
    fit, size = usable(rows, id, vector)
    books = train(fit, size, id, vector) if size else []
    if not size:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("codes", "array<int>"), ("error", "long"), ("label_error", "long"))]
        return rows.where(F.lit(False)).select(id, label, *nothing), books
    return with_label_error(materialise(encode(fit, size, books, vector)), label), books
