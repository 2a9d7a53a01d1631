"""BPE against the tokenizers library, and round trips."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandflow.llm import bpe
from strandflow.llm.common import bounded_batches
from strandflow.llm.queries import VOCABULARY

LIBRARY = Tokenizer.from_file(VOCABULARY)
SPECIAL = [":\U0003d000", "\ua7dbX", "\U00010d50", "\U00010d42a", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "'s", "'LL", "Σ", "\x1c", "é", "é", "\n\t", "1２"]
texts = st.lists(st.one_of(st.text(max_size=30), st.sampled_from(SPECIAL)), max_size=6).map("".join)


CONTENT = bpe.vocabulary_of(VOCABULARY)


def ids_of(text):
    return np.frombuffer(bpe.codec(CONTENT).encode(text), "<i4").tolist()


@settings(max_examples=400, deadline=None)
@given(texts)
def test_same_as_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids_of(text) == want
    assert bpe.codec(CONTENT).decode(pa.array([want], pa.list_(pa.int32()))).to_pylist() == [LIBRARY.decode(want, skip_special_tokens=False)]


def test_fragments_are_cut_only_where_no_token_bridges():
    codec = bpe.codec(CONTENT)
    rng = random.Random(2)
    alphabet = list(codec.alphabet.values())
    for _ in range(300):
        piece = "".join(rng.choices(alphabet, k=12))
        parts = codec.fragments(piece)
        assert "".join(parts) == piece
        bridges = {a[-1] + b[0] for a, b in zip(parts, parts[1:], strict=False)}
        assert not any(x in t.removesuffix("</w>") for x in bridges for t in list(codec.vocab)[::17])


def test_operator(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    coded = bpe.transcode(docs, VOCABULARY)
    assert set(coded.columns) == {*docs.columns, "decoded"}
    got = sorted((r["doc_id"] or 0, r["text"] or "", tuple(r["ids"]), r["decoded"]) for r in coded.collect())
    library = lambda t: LIBRARY.encode(t or "", add_special_tokens=False).ids
    assert got == sorted((i or 0, t or "", tuple(library(t)), LIBRARY.decode(library(t), skip_special_tokens=False)) for i, t in odd_rows)
    again = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    assert sorted(r["decoded"] for r in again.collect()) == sorted(r[3] for r in got)
    assert bpe.transcode(docs.limit(0), VOCABULARY).count() == 0


def test_workers_get_long_texts_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    bounded_batches(spark)
    docs = spark.range(0, 800, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 400) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 800
    assert max(r["bytes"] for r in got) < 1_100_000


def test_memos_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    codec = bpe.Codec(CONTENT)
    text = " ".join(f"word{i}" for i in range(50))
    assert np.frombuffer(codec.encode(text), "<i4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(codec._memo) <= 3
    codec.forget()
    assert not codec._memo and not codec._fragments


@pytest.mark.parametrize("least", [0, 200])
def test_long_fragments(monkeypatch, least):
    monkeypatch.setattr(bpe, "LONG_FRAGMENT", least)
    codec, rng = bpe.Codec(CONTENT), random.Random(5)
    words = ["".join(rng.choices(letters, k=n)) for letters in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "aé", "-=", "0123456789") for n in (1, 2, 3, 50, 3000)]
    for word in words:
        assert np.frombuffer(codec.encode(word), "<i4").tolist() == LIBRARY.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", ["a", "the", "aé", "=-", "0", "a.", "' ", "\n", "x" * 199 + " "])
def test_a_megabyte_of(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    got = ids_of(text)
    assert time.perf_counter() - began < 30
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids
