"""Near-duplicates, substring dedup, sharding, languages, decontamination and the pipeline against brute force."""

import os
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strandflow.llm import decontaminate, langid, sharding, simhash, substring
from strandflow.llm.common import id_and_text
from strandflow.llm.components import components
from tests.llm.conftest import prose


def groups_of(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def same_partition(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True)))


def test_components(spark, rng):
    n = 300
    pairs = [(i, i + 1) for i in range(100)] + [(rng.randrange(100, n), rng.randrange(100, n)) for _ in range(150)] + [(200, k) for k in range(210, 260)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert same_partition([roots.get(i, -1 - i) for i in range(n)], groups_of(n, pairs))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_near_duplicates(spark, docs_of, odd_rows, rng):
    base = prose(rng, 600).split()
    near = [(100 + i, " ".join(w if rng.random() > 0.004 else "changed" for w in base)) for i in range(25)]
    rows = odd_rows + near + [(200, near[0][1]), (300, "A b"), (301, "a B"), (302, "A"), (303, "a")]
    found = simhash.near_duplicates(id_and_text(docs_of(rows)))
    got = sorted((r["doc_id"] or 0, r["f"], r["component_id"] or 0) for r in found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("f"), "component_id").collect())
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = groups_of(len(rows), [(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {g: min((rows[i][0] for i in range(len(rows)) if groups[i] == g and rows[i][0] is not None), default=0) for g in set(groups)}
    assert got == sorted((i or 0, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, groups, strict=True))
    assert simhash.near_duplicates(id_and_text(docs_of(rows).limit(0))).count() == 0
    kept = simhash.keep_one(docs_of(rows))
    assert kept.columns == docs_of(rows).columns and kept.count() == len(set(groups))


@pytest.mark.parametrize("cell", [4, 64])
def test_links_of_dense_balls(spark, rng, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    center, prints = rng.getrandbits(64), {rng.getrandbits(64) for _ in range(100)}
    for _ in range(400):
        x = center
        for _ in range(rng.randrange(1, 5)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = list(prints)
    signed = [simhash._signed(x) for x in prints]
    linked = simhash.links(spark.createDataFrame([(x,) for x in signed], "fingerprint long")).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2 for r in linked)
    at = {x: i for i, x in enumerate(signed)}
    mine = groups_of(len(prints), [(at[r["a"]], at[r["b"]]) for r in linked])
    assert same_partition(mine, groups_of(len(prints), [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]))


def test_manhattan_is_a_lower_bound(spark, rng):
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randrange(0, 6)):
            b ^= 1 << rng.randrange(64)
        rows.append((simhash._signed(a), simhash._signed(b)))
    df = spark.createDataFrame(rows, "a long, b long")
    m = simhash.manhattan(simhash.embedding(F.col("a")), simhash.embedding(F.col("b")))
    assert df.where(m > F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).count() == 0
    counts = lambda x: [(x >> (2 * k) & 3).bit_count() for k in range(32)]
    for r in df.select("a", "b", m.alias("m")).collect():
        assert r["m"] == sum(abs(x - y) for x, y in zip(counts(r["a"] & (2**64 - 1)), counts(r["b"] & (2**64 - 1)), strict=True))


def removed(rows, window):
    first = {}
    docs = [(i if i is not None else 1 << 63, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    for i, words in docs:
        for s in range(len(words) - window + 1):
            k = tuple(words[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, words in docs:
        covered = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (i, s):
                covered |= set(range(s, s + window))
        out.append((i if i < 1 << 63 else 0, len(words), len(covered), " ".join(w for k, w in enumerate(words) if k not in covered)))
    return sorted(out)


@pytest.mark.parametrize("flush", [50, 2_000_000])
def test_substring_dedup(spark, docs_of, odd_rows, rng, monkeypatch, flush):
    monkeypatch.setattr(substring, "FLUSH", flush)
    passage, plain = prose(rng, 55), [r for r in odd_rows if r[0] != 4]
    rows = plain + [(100 + i, f"{prose(rng, rng.randrange(30))} {passage} {prose(rng, 5)}" if i % 3 else " ".join(rng.choices("ab", k=rng.randrange(60)))) for i in range(60)] + [(300, passage), (300, passage), (None, passage), (301, "x " * 70)]
    rows += [(None, f"{passage} {i // 2}") for i in range(20)] + [(400, f"{i} {passage}") for i in range(3)] + [(None, rows[60][1])] * 30
    for window in (20, 4, 2):
        found = substring.dedup(id_and_text(docs_of(rows).repartition(5)), window)
        assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()) == removed(rows, window)
    assert substring.dedup(id_and_text(docs_of(rows).limit(0))).count() == 0


def test_differencing(rng):
    sizes = np.array([rng.randrange(1, 1000) for _ in range(500)])
    sums = np.zeros((500, 8), np.int64)
    sums[:, 0] = sizes
    place, total = sharding.difference(sums)
    assert total.sum() == sizes.sum() and total.max() - total.min() <= 8
    assert [int(sizes[place[:, 0] == k].sum()) for k in range(8)] == total.tolist()
    assert all(sorted(p) == list(range(8)) for p in place.tolist())


def test_shards(spark, docs_of, odd_rows, rng, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 20)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 40)
    rows = [r for r in odd_rows if r[0] != 4] + [(100 + i, prose(rng, rng.randrange(1, 40))) for i in range(300)] + [(1000 + i, "the same text again and again") for i in range(40)]
    found = sharding.assign(id_and_text(docs_of(rows)), 8).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in found) == sorted((i or 0, len((t or "").encode()) + 1) for i, t in rows)
    total = [sum(r["size"] for r in found if r["shard"] == k) for k in range(8)]
    assert max(total) - min(total) <= 0.001 * sum(total)
    for k in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(sum(r["shard"] == k for r in found)))
    of = {}
    for r in found:
        of.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in of.values())


@pytest.mark.parametrize("units", [20, 20_000])
def test_a_group_beyond_a_shard_stays_whole(spark, docs_of, monkeypatch, units):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", units)
    rows = [(None if i < 200 else i, "the very same long text in every row") for i in range(600)] + [(1000 + i, f"text {i} {'x' * (i % 7)}") for i in range(500)]
    found = sharding.assign(id_and_text(docs_of(rows)), 8).collect()
    of = {}
    for r in found:
        of.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert len(found) == len(rows) and all(len(s) == 1 for s in of.values())
    total = sorted(sum(r["size"] for r in found if r["shard"] == k) for k in range(8))
    assert total[-1] == 600 * 37 and total[-2] - total[0] <= 20  # the others are as near equal as their texts allow
    for k in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(sum(r["shard"] == k for r in found)))
    assert sharding.assign(id_and_text(docs_of(rows).limit(0)), 8).count() == 0


LANGUAGES = {"xx": "lorem ipsum dolor sit amet consetetur sadipscing", "yy": "the quick brown fox jumps over lazy dogs", "zz": "ein kleiner vogel sitzt auf dem grünen baum"}


def test_languages(spark, docs_of, odd_rows, rng):
    rows = [(i, lang, " ".join(rng.choices(text.split(), k=30))) for i, (lang, text) in enumerate(list(LANGUAGES.items()) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(docs.where(~langid.is_held_out(F.col("doc_id"))))
    found = langid.predict(docs.drop("lang").join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id"), model).collect()
    assert all(r["lang_pred"] == r["truth"] and 0.9 < r["score"] <= 1 for r in found)
    odd = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in langid.predict(docs_of([*odd_rows, (50, "12 34!")]), model).collect()}
    assert odd[1, None] == odd[2, ""] == odd[50, "12 34!"] == ("und", 0.0) and odd[5, "one two three"][0] in LANGUAGES
    none = langid.fit(docs.limit(0))
    assert langid.predict(docs, none).where("lang_pred = 'und'").count() == len(rows)


def test_null_ids_are_sampled_like_others(spark, rng):
    texts = [f"{prose(rng, 20)} word{i}" for i in range(2000)]
    docs = spark.createDataFrame([(None, "xx", t) for t in texts] + [(None, "xx", texts[0])] * 2000, "doc_id long, lang string, text string")
    some, every = langid.fit(docs, docs_per_language=200), langid.fit(docs, docs_per_language=10**6)
    assert 0 < np.count_nonzero(some.table) < np.count_nonzero(every.table)


def test_held_out_accuracy_on_the_tables(spark):
    from strandflow.llm.queries import QUERIES

    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    judged = QUERIES["op6_language"](spark, sf_dir).join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = judged.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 20 and right / n >= 0.95


def test_slices_of_a_text_give_the_same_ngrams(monkeypatch, rng):
    texts = ["", "a", "ab", "abc", "12", "1a", " é ß", "ΑΣ ΣΑ", *["".join(rng.choices("ab c.1é", k=k)) for k in range(1, 40)]]
    whole = [sorted(np.concatenate([*langid.gram_slices(t), np.empty(0, np.uint64)]).tolist()) for t in texts]
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "SLICE", size)
        assert [sorted(np.concatenate([*langid.gram_slices(t), np.empty(0, np.uint64)]).tolist()) for t in texts] == whole


def test_filter_returns_every_language_that_has_an_ngram(rng):
    table = np.zeros((1 << langid.SLOT_BITS, 2), np.uint8)
    grams = {k: langid.ngrams(" ".join(rng.choices(WORDS_OF[k % 3].split(), k=50))) for k in range(10)}
    for k, g in grams.items():
        for at in langid.slots(g):
            np.bitwise_or.at(table[:, k // 8], at, np.uint8(1 << (k % 8)))
    model = langid.LanguageFilter([str(k) for k in range(10)], table, np.zeros(10))
    n, counts = model.counts(LANGUAGES["yy"])
    mine = langid.ngrams(LANGUAGES["yy"])
    assert n == len(mine) and all(counts[k] >= np.isin(mine, grams[k]).sum() for k in range(10))


WORDS_OF = list(LANGUAGES.values())


def overlapping(docs, items):
    """Pairs with 20 words of a passage (or all of a shorter one) of which 16 (or 80 per cent) agree at one shift."""
    out = set()
    for i, d in docs:
        for j, b in items:
            for shift in range(-len(b), len(d)):
                agree = [0 <= shift + p < len(d) and d[shift + p] == b[p] for p in range(len(b))]
                n = min(len(b), decontaminate.OVERLAP)
                if any(sum(agree[s : s + n]) >= decontaminate.LEAST_MATCH * n for s in range(len(b) - n + 1)):
                    out.add((i, j))
                    break
    return out


@pytest.mark.parametrize("seeds", [decontaminate.SEED_ROWS, 0])
def test_decontamination(spark, docs_of, odd_rows, rng, seeds):
    items = [(k, prose(rng, n)) for k, n in enumerate([30, 45, 15, 12, 8, 5, 60])] + [(50, None), (51, "two words"), (0, prose(rng, 25))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = list(odd_rows)
    for k, (_, text) in enumerate(items[:7]):
        words = text.split()
        rows += [(100 + k, f"{prose(rng, 20)} {text.upper()}! {prose(rng, 20)}"), (300 + k, prose(rng, 40))]
        if len(words) >= 15:  # one word in ten replaced
            rows.append((200 + k, " ".join([prose(rng, 9), *(w if p % 10 != 7 else "other" for p, w in enumerate(words)), prose(rng, 9)])))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(id_and_text(docs_of(rows)), benchmark, seeds).collect()}
    assert found == {(100 + k, k) for k in range(7)} | {(200 + k, k) for k in (0, 1, 2, 6)}
    tokens = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    some = [(i, tokens(t)) for i, t in rows if i is not None and i >= 100]
    assert found <= overlapping(some, [(j, tokens(t)) for j, t in items if t and len(tokens(t)) >= 4])
    kept = decontaminate.decontaminate(docs_of(rows), benchmark)
    assert kept.columns == docs_of(rows).columns and kept.count() == len(rows) - 11
    assert decontaminate.overlaps(id_and_text(docs_of(rows)), benchmark.limit(0), seeds).count() == 0
    assert decontaminate.overlaps(id_and_text(docs_of(rows).limit(0)), benchmark, seeds).count() == 0


def test_pipeline(spark, tmp_path, rng):
    text = prose(rng, 80)
    item = prose(rng, 30)
    rows = [(1, text, "en"), (2, text, "en"), (3, "12 34 56", "en"), (4, None, None), (5, f"{prose(rng, 30)} {item} {prose(rng, 30)}", "en"), (6, f"{prose(rng, 50)} mail a@b.org", "en")] + [(10 + k, prose(rng, 60), "en") for k in range(20)]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / f"out_{name}")
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    everyone = {i for i, _, _ in rows}
    assert left == [everyone - {3, 4}, everyone - {2, 3, 4}, everyone - {2, 3, 4, 5}, everyone - {2, 3, 4, 5}, everyone - {2, 3, 4, 5}]
    six = docs.where("doc_id = 6").first()
    assert six["text"].endswith("mail [EMAIL]") and six["n_tokens"] == len(six["ids"]) > 0
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in final.select("doc_id").collect()} == left[-1]
