"""Cases that an operator once left out."""

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strandflow.llm import decontaminate, licenses, resemblance, substring
from strandflow.llm.common import id_and_text
from tests.llm.conftest import prose


def plain_shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("cell", [2, 32])
def test_near_duplicates_of_the_pipeline(spark, docs_of, odd_rows, rng, monkeypatch, tmp_path, cell):
    monkeypatch.setattr(resemblance, "CELL", cell)
    base, rows = prose(rng, 200).split(), list(odd_rows)
    for i in range(60):  # near copies at similarities on both sides of 0.8
        share = rng.choice([0.005, 0.02, 0.04])
        rows.append((100 + i, " ".join(w if rng.random() > share else f"other{i}" for w in base)))
    rows += [(200 + i, f"{prose(rng, 5)} {' '.join(base[:40])} {prose(rng, 60)}") for i in range(40)] + [(300, rows[-1][1].upper()), (301, "a b c d e f g h"), (302, "a b c d e f g h i")]
    docs = docs_of(rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    left = [plain_shingles(r["text"]) for r in kept.collect()]
    assert not any(similar(a, b) for a, b in combinations(left, 2))
    assert all(any(similar(plain_shingles(t), k) for k in left) for _, t in rows)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_duplicates_go_through_fingerprints_first(spark, docs_of, rng, monkeypatch, tmp_path):
    linked, found = [], []
    links, similar_pairs = resemblance.simhash.links, resemblance._similar
    monkeypatch.setattr(resemblance.simhash, "links", lambda *a: linked.append(links(*a)) or linked[-1])
    monkeypatch.setattr(resemblance, "_similar", lambda *a: found.append(similar_pairs(*a).collect()) or similar_pairs(*a))
    rows = []
    for i in range(30):
        words = prose(rng, 800).split()
        rows += [(4 * i + k, " ".join([*words, f"x{i}y{k}"])) for k in range(4)]
    assert corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), str(tmp_path)).count() == 30
    sets = [resemblance.shingles(t) for _, t in rows]
    prints = {int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64)): resemblance.simhash.majority(s) for s in sets}
    links = {(r["a"], r["b"]) for r in linked[0].collect()}
    first = [(prints[r["a"]], prints[r["b"]]) for r in found[0]]
    assert len(first) > 60 and all(a == b or (a, b) in links or (b, a) in links for a, b in first)


def test_near_copies_that_are_not_all_similar_are_no_square_of_pairs(spark, docs_of, rng, monkeypatch, tmp_path):
    compared = []
    similar_pairs = resemblance._similar
    monkeypatch.setattr(resemblance, "_similar", lambda open_, *a: compared.append(open_.count()) or similar_pairs(open_, *a))
    monkeypatch.setattr(resemblance, "BLOCK", 20, raising=False)
    base, rows = prose(rng, 120).split(), []
    for i in range(300):  # similarities between 0.6 and 0.9
        other = set(rng.sample(range(5, 115), rng.choice([1, 1, 2, 2, 3])))
        rows.append((i, " ".join(f"other{i}" if k in other else w for k, w in enumerate(base))))
    left = [plain_shingles(r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), str(tmp_path)).collect()]
    assert not any(similar(a, b) for a, b in combinations(left, 2))
    assert all(any(similar(plain_shingles(t), k) for k in left) for _, t in rows)
    assert sum(compared) < 20 * len(rows)


def wrapped(text, mark, width=9):
    words = text.split()
    return "\n".join(f"{mark} {' '.join(words[k : k + width])}" for k in range(0, len(words), width))


def test_licences_in_running_text_and_comments():
    templates = licenses.Templates()
    found = lambda text: [(name, line, n) for name, _, line, n in licenses.matches(text, templates)]
    assert found("Copyright 2020 Foo Corp. All rights reserved. Licensed under the MIT License. See LICENSE for details.") == [("MIT", 0, 1)]
    assert found("x\nIt was Licensed under\nCC BY 4.0. And that: Released under the MIT License. Also licensed under the MIT license.\n") == [("CC-BY-4.0", 1, 2), ("MIT", 2, 1), ("MIT", 2, 1)]
    for mark in (" *", "#", "//", "REM", ""):
        for name, text in licenses.TEMPLATES[24:]:
            lines = wrapped(f"Copyright 2020 Foo. {text}", mark)
            assert [x for x, *_ in found(f"{mark}\n{lines}\n{mark}\nint main() {{}}")] == [name]
    assert found("A licence is a thing of the law. " * 500) == []


def test_every_window_that_matches_is_covered(rng):
    templates = licenses.Templates(licenses.TEMPLATES[:1] + licenses.TEMPLATES[4:5] + licenses.TEMPLATES[7:8])
    pool = "licensed released under the mit apache license version 2 0 gnu gpl v3 x".split()
    for _ in range(150):
        words = rng.choices(pool, k=rng.randrange(30))
        any_window = any(templates.best(" ".join(words[a:b])) for a in range(len(words)) for b in range(a + 1, len(words) + 1))
        assert bool(licenses.matches(" ".join(words), templates)) == any_window


@pytest.mark.parametrize("seeds", [decontaminate.SEED_ROWS, 0])
def test_overlaps_with_any_words_replaced(spark, docs_of, rng, seeds):
    items, rows, expected = [], [], set()
    for n in [*range(1, 25), 40]:
        items.append((n, " ".join(f"w{n}x{p}" for p in range(n))))
        size = min(n, 20)
        for k in range(12):
            e = size // 5 + k % 2  # within the rule, and one beyond
            at = rng.randrange(n - size + 1)
            out = set(rng.sample(range(at, at + size), e)) | (set(range(n)) - set(range(at, at + size)))
            text = [w if p not in out else "other" for p, w in enumerate(items[-1][1].split())]
            run = max(map(len, re.findall("1+", "".join("0" if p in out else "1" for p in range(n)))), default=0)
            i = 1000 * n + k
            rows.append((i, f"{prose(rng, rng.randrange(3))} {' '.join(text)} {prose(rng, rng.randrange(3))}"))
            if k % 2 == 0 or run >= decontaminate.VERBATIM:
                expected.add((i, n))
        if n >= 10:
            words = items[-1][1].split()
            rows.append((1000 * n + 500, f"a {' '.join(words[n - 10 :])} b"))
            expected.add((1000 * n + 500, n))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.overlaps(id_and_text(docs_of(rows)), benchmark, seeds)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected


def test_masks_serve_every_way_to_lose_words():
    for n in range(1, 21):
        masks, agree = decontaminate.masks_of(n), decontaminate.agreeing(n)
        fits = [{at + k for k in m} for m in masks for at in range(n - m[-1])]
        assert all(any(fit <= set(kept) for fit in fits) for kept in combinations(range(n), agree))
        assert n < 3 or all(len(m) < m[-1] + 1 for m in masks)  # positions inside are ignored
        assert n < 10 or all(m[-1] < decontaminate.VERBATIM for m in masks)


@pytest.mark.parametrize("seeds", [decontaminate.SEED_ROWS, 0])
def test_items_that_share_words(spark, docs_of, rng, seeds):
    """Seeds of many items: phrases of 7 and of 14 words that 30 items begin with, items that are nearly alike, short items."""
    long, short = [f"p{k}" for k in range(14)], [f"q{k}" for k in range(7)]
    passages = [[*long, *prose(rng, 16).split()] for _ in range(30)] + [[*short, *prose(rng, 20).split()] for _ in range(30)]
    alike = prose(rng, 22).split()
    passages += [[*alike[:k], "other", *alike[k + 1 :]] for k in range(20)] + [[f"t{k % 2}", "u", "v"] for k in range(20)]
    texts = [p[:] for p in passages]
    for p in texts[:60]:
        for k in rng.sample(range(4, len(p)), rng.randrange(12)):
            p[k] = "x"
    texts += [[*long[:k], "y", *long[k + 1 :]] for k in range(14)] + [long, short, alike, ["t0", "u", "v", "t1", "u"]] + [[*short, *prose(rng, 20).split()] for _ in range(200)]
    rows = [(i, " ".join([*prose(rng, 3).split(), *p, *prose(rng, rng.randrange(3)).split()])) for i, p in enumerate(texts)]

    def overlap(words, passage):
        n = min(len(passage), 20)
        for shift in range(-len(words), len(passage)):
            same = [0 <= k - shift < len(words) and words[k - shift] == w for k, w in enumerate(passage)]
            if any(sum(same[a : a + n]) >= decontaminate.agreeing(n) for a in range(len(passage) - n + 1)) or any(all(same[a : a + 10]) for a in range(len(passage) - 9)):
                return True
        return False

    expected = {(i, j) for i, text in rows for j, p in enumerate(passages) if overlap(text.split(), p)}
    benchmark = spark.createDataFrame([(j, " ".join(p)) for j, p in enumerate(passages)], "item_id long, text string")
    found = decontaminate.overlaps(id_and_text(docs_of(rows)), benchmark, seeds).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected and len(expected) > 500


@pytest.mark.parametrize("seeds", [decontaminate.SEED_ROWS, 0])
def test_long_text_of_passages(spark, docs_of, seeds):
    """A text of 24,000 words, all of them of the benchmark: its 40,000 hits are held without the text."""
    items = [(p, " ".join(f"w{p}x{k}" for k in range(30))) for p in range(20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.overlaps(id_and_text(docs_of([(1, " ".join(t for _, t in items * 40)), (2, "clean words")])), benchmark, seeds)
    assert sorted(tuple(r) for r in found.collect()) == [(1, p, 25 * 40, 30 * p, 30 * (20 * 39 + p) + 29, 1.0) for p in range(20)]


@pytest.mark.parametrize("block", [1, 7, 50])
def test_overlaps_over_the_borders_of_blocks(spark, docs_of, rng, monkeypatch, block):
    items = [(n, prose(rng, n)) for n in (3, 12, 20, 33, 60)]
    rows = [(k, " ".join(prose(rng, rng.randrange(9)) + f" {w} " for _, t in items for w in [t.replace(t.split()[1], "x") if k % 2 else t])) for k in range(6)]
    of = lambda: sorted(tuple(r) for r in decontaminate.overlaps(id_and_text(docs_of(rows)), spark.createDataFrame(items, "item_id long, text string")).collect())
    whole = of()
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    assert of() == whole and len(whole) >= 3 * len(items)


def test_ids_of_one_passage(spark, docs_of, rng, monkeypatch):
    """A passage that 40 ids have is looked for once; an id of several passages has the hits of all of them."""
    passages = [prose(rng, 30) for _ in range(5)]
    rows = [(k, f"{prose(rng, k)} {passages[k % 5]} {prose(rng, 3)} {passages[(k + 1) % 5]}") for k in range(20)]
    hits: list[int] = []

    def written(df, write=decontaminate.materialise):
        table = write(df)
        hits.extend([table.count()] if "near" in df.columns and "tag" in df.columns else [])
        return table

    monkeypatch.setattr(decontaminate, "materialise", written)
    of = lambda ids: decontaminate.overlaps(id_and_text(docs_of(rows)), spark.createDataFrame(ids, "item_id string, text string"))
    single = {(r["doc_id"], int(r["item_id"])): tuple(r)[2:] for r in of([(str(p), t) for p, t in enumerate(passages)]).collect()}
    several = [("both", passages[0]), ("both", passages[1]), (None, passages[2]), (None, passages[3])]
    got = of([(f"{p} {k}", t) for p, t in enumerate(passages) for k in range(40)] + several).collect()
    expected = [(i, f"{p} {k}", *x) for (i, p), x in single.items() for k in range(40)]
    for name, pair in (("both", (0, 1)), (None, (2, 3))):
        for i, _ in rows:
            if x := [single[i, p] for p in pair if (i, p) in single]:
                expected.append((i, name, sum(a[0] for a in x), min(a[1] for a in x), max(a[2] for a in x), max(a[3] for a in x)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected)) and hits[0] == hits[1]


def test_only_the_overlapping_row_goes(spark, docs_of, rng):
    item = prose(rng, 25)
    rows = [(None, item), (None, "clean words"), (7, item), (7, "clean words"), (None, None)]
    kept = decontaminate.decontaminate(docs_of(rows), spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (0, "clean words"), (7, "clean words")]


def test_pipeline_of_odd_rows(spark, docs_of, odd_rows, rng, tmp_path):
    item, clean = prose(rng, 30), prose(rng, 60)
    rows = [*odd_rows, (None, clean), (None, clean), (None, f"{prose(rng, 9)} {item}"), (7, f"{item} {prose(rng, 9)}"), (8, prose(rng, 50)), (8, prose(rng, 50)), (9, "mail a@b.org " + prose(rng, 40))]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item), (1, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = [r["text"] for r in final]
    assert texts.count(clean) == 1 and not any(item in t for t in texts) and all(t and t.strip() for t in texts)
    assert sum(r["doc_id"] == 8 for r in final) == 2 and any(t.startswith("mail [EMAIL]") for t in texts)
    empty = tmp_path / "empty"
    docs_of(rows).limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_rows_that_share_an_id_and_32_bits_of_hash(spark, docs_of):
    """Two texts without id, a long one whose end repeats a passage and a short one of its own, that F.hash() does not tell apart."""
    passage = " ".join(f"p{k}" for k in range(20))
    own = lambda letter, n: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.concat(F.lit(letter), F.col("id"), F.lit("x"), k)), " ")
    ids = spark.range(150_000)
    short = ids.select(own("s", 22).alias("short")).withColumn("h", F.hash("short"))
    long = ids.select(F.concat(own("l", 25), F.lit(f" {passage}")).alias("long")).withColumn("h", F.hash("long"))
    pair = short.join(long, "h").first()
    found = {r["kept_text"]: (r["n_words"], r["n_removed"]) for r in substring.dedup(id_and_text(docs_of([(1, passage), (None, pair["long"]), (None, pair["short"])]))).collect()}
    assert found == {passage: (20, 0), pair["short"]: (22, 0), pair["long"].removesuffix(f" {passage}"): (45, 20)}
