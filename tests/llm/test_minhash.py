"""MinHash near-duplicates against all pairs, and the sketch against its guarantees."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from strandflow.llm import minhash, resemblance
from strandflow.llm.common import id_and_text
from strandflow.llm.queries import QUERIES
from tests.llm.conftest import prose
from tests.llm.test_corpus import groups_of


def plain_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def plain(rows):
    """(doc_id, text) to (doc_id, n_shingles, component_id, kept), sorted."""
    sets = [plain_set(t) for _, t in rows]
    pairs = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = groups_of(len(rows), pairs)
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min((x for x in (i, least.get(g)) if x is not None), default=None)
    return sorted(((i, len(s), least[g], i == least[g]) for (i, _), s, g in zip(rows, sets, group, strict=True)), key=repr)


def near_copies(rng, n, words, share, first):
    base = prose(rng, words).split()
    return [(first + i, " ".join(w if rng.random() > share else f"other{i}" for w in base)) for i in range(n)]


def test_components_are_those_of_all_pairs(spark, docs_of, odd_rows, rng, monkeypatch, tmp_path):
    monkeypatch.setattr(minhash, "CELL", 2)  # the next test has the usual limits
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rows = list(odd_rows) + near_copies(rng, 60, 200, 0.04, 100) + near_copies(rng, 60, 60, 0.06, 200) + near_copies(rng, 40, 300, 0.01, 300)
    rows += [(400 + i, f"{prose(rng, 4)} {' '.join(rows[12][1].split()[:60])} {prose(rng, 4)}") for i in range(60)]  # of one template
    rows += [(500, rows[30][1].upper()), (501, "word"), (502, "WORD"), (503, "word word"), (504, "word word word"), (505, "a b c d e f"), (506, "a b c d e f g"), (507, "a b c d e")]
    rows += [(None, rows[40][1]), (None, rows[40][1]), (9, rows[41][1] + " end")]
    docs_of(rows).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op11_minhash"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)
    assert minhash.near_duplicates(id_and_text(docs_of(rows).limit(0))).count() == 0


def test_groups_of_a_template_and_of_near_copies(spark, docs_of, rng):
    """Cells far over CELL: texts of one template that are not similar, and copies at both sides of the threshold."""
    template = prose(rng, 40)
    rows = [(i, f"{template} {' '.join(f'own{i}x{k}' for k in range(7))}") for i in range(1500)] + near_copies(rng, 700, 80, 0.045, 5000)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(id_and_text(docs_of(rows))).collect()}
    assert all(found[i] == i for i in range(1500))
    few = rows[1500:]
    assert [(i, found[i]) for i, _ in few] == [(i, c) for i, _, c, _ in plain(few)]


def test_every_coordinate_is_filled_and_agrees_by_similarity():
    rng = np.random.default_rng(1)
    size = minhash.BANDS * minhash.ROWS
    for n in (1, 2, 3, 10, 100, 1000, 50_000):
        found = minhash.fast_sketch(np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)))
        assert len(found) == size and (found != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    for n in (10, 100, 2000):
        agree = []
        for _ in range(60):
            both, a, b = (np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n * 8 // 10, n // 10, n // 10))
            x, y = (minhash.fast_sketch(np.sort(np.concatenate([both, own]))) for own in (a, b))
            agree.append((x == y).mean())
        assert abs(np.mean(agree) - 0.8) < 0.03 and np.std(agree) < (0.05 if n > 10 else 0.1)
    many = minhash.fast_sketch(np.arange(1, 40, dtype=np.uint64))
    assert len(set((many >> np.uint64(32)).tolist())) > 1  # several rounds took part


def test_a_long_text(spark, docs_of, rng):
    long = " ".join(str(rng.randrange(10**9)) for _ in range(300_000)) * 4
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 4]), (4, prose(rng, 9))]
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(id_and_text(docs_of(rows))).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4} and len(long) > 10_000_000
    assert len(resemblance.shingles(long, 2)) > 250_000


def test_blocks_of_open_pairs_lose_none():
    """The comparison in blocks, without Spark: pairs that share a rare shingle and are similar are among those it leaves open."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 120).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(k) > 0.05, base[:k], rng.integers(0, 1 << 63, k).astype(np.uint64))) for k in rng.choice([60, 120], 40)]
    rows = [(7, 0, 0, early, i, i, len(s)) for early in (True, False) for i, s in enumerate(sets)]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
    parities = pa.array([resemblance.sketch(sets[r[4]], 2) for r in rows], pa.list_(pa.int64()))
    batch = pa.record_batch([*columns, parities], names=["gram", "i", "j", "early", "node", "root", "n", "parities"])
    for size in (9, 100):
        got = {x for out in minhash._open_pairs((4, 5))(iter([batch.slice(k, size) for k in range(0, len(rows), size)])) for x in zip(*(c.to_pylist() for c in out.columns), strict=True)}
        common = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i, j in combinations(range(40), 2)}
        similar = {p for p, c in common.items() if 9 * c >= 4 * (len(sets[p[0]]) + len(sets[p[1]]))}
        assert similar <= got and len(got) < 2 * len(similar) < len(common)
