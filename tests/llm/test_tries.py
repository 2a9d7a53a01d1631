"""Conversation tries against plain loops."""

import hashlib
import zlib

import pytest

from strandflow.llm import tries
from strandflow.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, path string, n int, class string, key int"


def plain(rows):
    """(conv_id, turn, role, text) to the contract's rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(o, key=lambda t: t[:3])] for c, o in own.items()}
    members = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = turns.get(c - c % 20, [])[:h] + t[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append((c, d == len(path)))
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    words = lambda p: len(p[-1][1].split()) if p else 0
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = (len(members[p]) - 1) * words(p) + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
    least = {p: min(c for c, _ in m) for p, m in members.items()}
    ends = lambda m: hashlib.sha256(",".join(str(c) for c in sorted(c for c, last in m if last)).encode()).hexdigest()
    return sorted(((least[p], len(p), least[p[:-1]] if p else None, len(m), len(kids[p]), leaves[p], saved[p], ends(m)) for p, m in members.items()), key=repr)


def talk(rng, n):
    """Conversations with shared beginnings, copies, and turns that repeat."""
    rows, say = [], lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "b c", "d  e\tf", None, ""]))
    kinds = [[say() for _ in range(rng.randrange(9))] for _ in range(n // 4)]
    for c in range(n):
        own = rng.choice(kinds[: n // 12 + 1]) if rng.random() < 0.4 else rng.choice(kinds)[: rng.randrange(9)] + [say() for _ in range(rng.randrange(3))]
        rows += [(3 * c if c % 7 else c, k if k else None, *t) for k, t in enumerate(own)]
    return rows


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("limit", [None, 8, 1])
def test_nodes_are_those_of_plain_loops(spark, rng, monkeypatch, tmp_path, limit):
    monkeypatch.setattr(tries, "LIMIT", limit or tries.LIMIT)
    monkeypatch.setattr(tries, "PIECE", 3 if limit else tries.PIECE)
    rows = talk(rng, 120) + [(1000 + k, 0, "user", "same") for k in range(40)] + [(1100 + k, t, "user", "same") for k in range(9) for t in range(12)]
    rows += [(None, 0, "user", "nobody"), (5, 1, "user", "again"), (5, 1, "user", "again"), (2001, 0, "x", "alone"), (2002, 9, None, None)]
    rng.shuffle(rows)
    spark.createDataFrame([(*r, "p", 1, "c", 2) for r in rows], SCHEMA).repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["op12_conversation_trie"](spark, str(tmp_path))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert rows_of(found) == plain(rows)


def test_long_conversations_and_turnless_ones(spark):
    # 41 is rebuilt from an absent conversation 40; with one own turn it has none if its h is above zero
    assert zlib.crc32(b"41") % 4 > 0
    rows = [(41, 0, "user", "x")] + [(c, t, "user", f"turn {t % 7}") for c in (20, 60, 80) for t in range(3000)]
    found = rows_of(tries.trie(spark.createDataFrame([(*r, "p", 1, "c", 2) for r in rows], SCHEMA)))
    by_depth = {r[1]: r for r in found}
    assert len(found) == 3001 and by_depth[0][3:6] == (4, 1, 1) and by_depth[3000][3] == 3
    assert by_depth[0][7] == hashlib.sha256(b"41").hexdigest() and by_depth[3000][7] == hashlib.sha256(b"20,60,80").hexdigest()
    assert by_depth[0][6] == 2 * 2 * 3000
    alone = rows_of(tries.trie(spark.createDataFrame([(41, 0, "u", "x", "p", 1, "c", 2)], SCHEMA)))
    assert alone == [(41, 0, None, 1, 0, 1, 0, hashlib.sha256(b"41").hexdigest())]


def test_an_empty_table_has_no_nodes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tries.trie(empty).count() == 0
    assert tries.trie(spark.createDataFrame([(None, 1, "u", "x", "p", 1, "c", 2)], SCHEMA)).count() == 0
