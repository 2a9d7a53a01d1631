"""Vector codes against plain loops in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from strandflow.llm import vectorcodes
from strandflow.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, error string, codes int, v int, __n int"


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, embedding, label), ids and labels not null, to the contract's rows."""
    kept = sorted((i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    cut = [[tuple(math.floor(4096 * float(x)) for x in v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[z[p] for z in cut[:entries]] for p in range(parts)]
    nearest = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for z in cut:
                own.setdefault(nearest(z[p], book)[1], []).append(z[p])
            books[p] = [tuple(sum(c) // len(own[k]) for c in zip(*own[k], strict=True)) if k in own else e for k, e in enumerate(book)]
    found = [[nearest(z[p], books[p]) for p in range(parts)] for z in cut]
    error = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        labels[label] = labels.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in f), e, labels[label], sha) for (i, _, label), f, e in zip(kept, found, error, strict=True))


def vectors(n, dim, kind):
    rng = random.Random(f"{n}{dim}{kind}")
    draw = {
        "smooth": lambda: rng.gauss(0, 0.3),
        "ties": lambda: rng.choice([-1, 0, 0, 1]) / 4096,  # many equal distances, and negative means
        "large": lambda: rng.choice([1e30, -3e38, 5e4, 0.25, rng.gauss(0, 1e6)]),
    }[kind]
    return [(i, [float(np.float32(draw())) for _ in range(dim)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize(("n", "dim", "kind"), [(300, 16, "smooth"), (400, 16, "ties"), (200, 8, "ties"), (9, 24, "smooth"), (1, 8, "smooth")])
def test_codes_are_those_of_plain_loops(spark, tmp_path, n, dim, kind):
    rows = vectors(n, dim, kind)
    rows += [(1000 + i, v, label) for i, v, label in rows[: n // 3]] + [(2000, None, 1), (2001, [0.0] * (dim - 1) + [float("nan")], 1), (2002, [None] + [0.0] * (dim - 1), 1), (2003, [float("-inf")] * dim, 2)]
    random.Random(2).shuffle(rows)
    spark.createDataFrame([(*r, "x", 1, None, 2) for r in rows], SCHEMA).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = QUERIES["op13_vector_codes"](spark, str(tmp_path))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_trees_find_what_a_full_search_finds():
    rng = np.random.default_rng(4)
    for width, entries, spread in [(1, 16, 3), (2, 16, 2), (8, 16, 400), (8, 5, 1), (3, 300, 40), (4, 16, 1 << 40)]:
        book = rng.integers(-spread, spread + 1, (entries, width))
        points = np.concatenate([rng.integers(-spread, spread + 1, (500, width)), book, book + 1])
        code, least = vectorcodes.Tree(book).nearest(points)
        every = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in book] for p in points], object)
        assert code.tolist() == every.argmin(1).tolist() and least.tolist() == every.min(1).tolist()


def test_odd_tables(spark):
    cases = [(None, [1.0] * 8, None), (None, [2.0] * 8, None), (3, [0.5] * 8, None), (3, [0.5] * 8, None), (3, [0.25] * 8, 7), (4, [1.0] * 16, 7), (5, [], 7), (6, [1.0] * 7, 7), (7, [1e30] * 8, 7), (8, None, None)]
    docs = spark.createDataFrame([(*c, "x", 1, None, 2) for c in cases], SCHEMA)
    coded, books = vectorcodes.compress(docs)
    rows = coded.collect()
    assert sorted((r["vec_id"] or -1, r["label"] or -1) for r in rows) == [(-1, -1), (-1, -1), (3, -1), (3, -1), (3, 7), (7, 7)]
    assert [len(b) for b in books] == [6] * 8 and books[0][0] == 1024  # the row of the least id, and of its rows the least vector
    assert {r["label_error"] for r in rows if r["label"] is None} == {sum(r["error"] for r in rows if r["label"] is None)}
    for nothing in (docs.limit(0), docs.where("vec_id = 8")):
        coded, books = vectorcodes.compress(nothing)
        assert coded.count() == 0 and books == [] and coded.columns == ["vec_id", "label", "codes", "error", "label_error"]
    large = vectors(60, 16, "large")
    coded, books = vectorcodes.compress(spark.createDataFrame([(*r, "x", 1, None, 2) for r in large], SCHEMA))
    numbers = vectorcodes.whole_numbers(np.array([v for _, v, _ in large]))
    for r in coded.collect():
        apart = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(numbers[r["vec_id"], 2 * p : 2 * p + 2], e, strict=True)), k) for k, e in enumerate(book)) for p, book in enumerate(books)]
        assert r["codes"] == [k for _, k in apart] and r["error"] == min(sum(d for d, _ in apart), vectorcodes.GREATEST)


def test_decoded_vectors_are_near(spark):
    rows = vectors(200, 16, "smooth")
    coded, books = vectorcodes.compress(spark.createDataFrame([(*r, "x", 1, None, 2) for r in rows], SCHEMA))
    for r in coded.collect():
        v = vectorcodes.decoded(np.array([r["codes"]]), books)[0]
        assert abs(((v - np.array(rows[r["vec_id"]][1])) ** 2).sum() - r["error"] / 4096**2) < 0.01
