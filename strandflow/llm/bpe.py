"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be bridged by a merge, so a piece of text is cut
there for certain. The fragments are encoded independently (and remembered, since they recur far more often than whole
pieces) and their ids are concatenated. This is a narrow, map-only job: no shuffle, and memory bounded by the slices
below or by one longer text. A fragment takes n log n steps, so one word of a million letters is no trouble either. The
vocabulary file is read by the driver and broadcast (its size is that of the file, a few MB), so workers need no path.

Defined results: a null or empty text, or one of separators only, has no ids and decodes to the empty string; repeated
rows are encoded alike; an empty table gives an empty table; an input column with the name of an output column is
replaced; other columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from strandflow.llm.common import bounded_batches

#: Entries of each memo in a worker. A full memo of pieces becomes the old one, from which pieces in use are taken over, so
#: that frequent ones stay; a full memo of fragments is emptied. All are emptied at the end of a task.
MEMO = 250_000
#: Characters of text that a worker handles at once (a single longer text is handled alone).
SLICE_CHARS = 500_000
#: Stand-ins of a fragment beyond which pairs wait in a heap and not in a list.
LONG_FRAGMENT = 200

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_WHITE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: The same pieces in a text of code points below U+0250 without U+001C to U+001F, which only Python takes for white space.
_LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\s\w]|_)+")
_RARE = re.compile("[\x1c-\x1f\u0250-\U0010ffff]")
_END = "</w>"
_NONE = 1 << 60


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for one vocabulary (the JSON of its file, BPE with word ends); lives in a worker."""

    def __init__(self, content: str):
        self.content = content
        self._library: Tokenizer | None = None
        spec = json.loads(content)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.alphabet = {chr(b): c for b, c in byte_alphabet().items()}
        merges = spec["model"]["merges"]
        self.ranks: dict[tuple[int, int], int] = {(self.vocab[a], self.vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made: list[int] = [self.vocab[a + b] for a, b in merges]
        tokens = self.vocab | self.special
        self.tokens = pa.array([t for t, _ in sorted(tokens.items(), key=lambda x: x[1])], pa.large_string())
        inside = {pair for t in self.vocab for s in (t.removesuffix(_END),) for pair in zip(s, s[1:], strict=False)}
        self.inside = {a + b for a, b in inside}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._fragments: dict[str, bytes] = {}
        self._memo: dict[str, bytes] = {}
        self._memo_before: dict[str, bytes] = {}

    def fragments(self, piece: str) -> list[str]:
        """A piece (in stand-ins) cut at every forced boundary."""
        if self.inside.issuperset(map(str.__add__, piece, piece[1:])):
            return [piece]
        cuts = [i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in self.inside]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)]

    def _merged(self, fragment: str, last: bool) -> bytes:
        """Ids of one fragment: the lowest-ranked pair is merged, leftmost first, until none is left."""
        ids = [self.vocab[c] for c in fragment]
        if last:
            ids[-1] = self.vocab[fragment[-1] + _END]
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(pair, _NONE) for pair in zip(ids, ids[1:], strict=False)]
        if len(ids) > LONG_FRAGMENT:
            ids, ranks = self._merged_by_heap(ids, ranks), []
        while ranks:
            rank = min(ranks)
            if rank == _NONE:
                break
            at = ranks.index(rank)
            ids[at : at + 2] = [made[rank]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], ids[at]), _NONE)
            if at < len(ranks):
                ranks[at] = rank_of((ids[at], ids[at + 1]), _NONE)
        return struct.pack(f"<{len(ids)}i", *ids)

    def _merged_by_heap(self, ids: list[int], ranks: list[int]) -> list[int]:
        """The same merges in n log n steps: a heap of (rank, place) over a linked list, from which outdated pairs are skipped."""
        rank_of, made, end = self.ranks.get, self.made, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(rank, at) for at, rank in enumerate(ranks) if rank != _NONE]
        heapq.heapify(heap)
        ranks.append(_NONE)
        while heap:
            rank, at = heapq.heappop(heap)
            if ranks[at] != rank:
                continue
            gone = after[at]
            ids[at], ids[gone] = made[rank], -1
            ranks[gone] = _NONE
            after[at] = follows = after[gone]
            if follows < end:
                before[follows] = at
            for a, b in ((before[at], at), (at, follows)):
                if a >= 0:
                    ranks[a] = rank = rank_of((ids[a], ids[b]), _NONE) if b < end else _NONE
                    if rank != _NONE:
                        heapq.heappush(heap, (rank, a))
        return [i for i in ids if i >= 0]

    def _piece(self, piece: str, stands_in: bool = False) -> bytes:
        """Ids (int32) of a piece, from its fragments."""
        if not stands_in and not (piece.isascii() and piece.isprintable()):
            piece = "".join(map(self.alphabet.__getitem__, piece.encode().decode("latin-1")))
        parts, out = self.fragments(piece), []
        if len(parts) == 1:
            return self._merged(piece, True)
        for k, fragment in enumerate(parts, 1 - len(parts)):
            key = fragment if k else fragment + " "  # no stand-in is a space
            ids = self._fragments.get(key)
            if ids is None:
                if len(self._fragments) >= MEMO:
                    self._fragments.clear()
                ids = self._fragments[key] = self._merged(fragment, not k)
            out.append(ids)
        return b"".join(out)

    def _unknown(self, word: str) -> bytes | None:
        """Ids of a word with characters that this Python does not know yet, by the library's own rules for pieces."""
        if all(unicodedata.category(c) != "Cn" for c in word):
            return None
        if self._library is None:
            self._library = Tokenizer.from_str(self.content)
        return b"".join(self._piece(p, True) for p, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(word)))

    def _known(self, pieces: list[str]) -> bytes:
        memo = self._memo
        out = list(map(memo.get, pieces))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    piece = pieces[i]
                    if len(memo) >= MEMO:
                        self._memo_before, self._memo = memo, {}
                        memo = self._memo
                    ids = memo.get(piece) or self._memo_before.get(piece) or self._piece(piece)
                    out[i] = memo[piece] = ids
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text)
        text = (text.replace("Σ", "σ") if "Σ" in text else text).lower()
        if not _RARE.search(text):
            return self._known(_LATIN_PIECES.findall(text))
        out = []
        for word in _WHITE.split(text):
            if word:
                ids = self._unknown(word) if _RARE.search(word) else None
                out.append(self._known(_PIECES.findall(word)) if ids is None else ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as int32 bytes; special tokens that the text spells out get their own ids."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[s].to_bytes(4, "little") if s in self.special else self._plain(s) for s in self.at_special.split(text))

    def forget(self) -> None:
        """Empty the memos: workers outlive tasks, and others need the memory."""
        self._memo, self._memo_before, self._fragments = {}, {}, {}

    def decode(self, ids: pa.Array | pa.ChunkedArray) -> pa.Array:
        """Texts of lists of ids: their tokens joined by spaces. A null list is an empty text."""
        lists = pc.fill_null(ids.cast(pa.large_list(pa.int32())), pa.scalar([], pa.large_list(pa.int32())))
        flat = pa.LargeListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), self.tokens.take(lists.flatten()))
        return pc.binary_join(flat, pa.scalar(" ", pa.large_string())).cast(pa.string())


_CODECS: dict[str, Codec] = {}


def codec(content: str) -> Codec:
    key = hashlib.md5(content.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(content)
    return _CODECS[key]


def vocabulary_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)) if pa.types.is_string(batch.schema.field(column).type) or pa.types.is_large_string(batch.schema.field(column).type) else pc.list_value_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _without(df: DataFrame, *names: str) -> DataFrame:
    drop = {n.lower() for n in names}
    return df.select(*[df[c] for c in df.columns if c.lower() not in drop])


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the token ids of the whole text as array<int>."""
    return _coded(docs, vocabulary, text, ids, None)


def transcode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode() and decode() of its ids, in one pass."""
    return _coded(docs, vocabulary, text, ids, decoded)


def _coded(docs: DataFrame, vocabulary: str, text: str, ids: str, decoded: str | None) -> DataFrame:
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary))
    kept = _without(docs, ids, *([decoded] if decoded else []))
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(shared.value)
        for whole in batches:
            for batch in _slices(whole, text, SLICE_CHARS):
                coded = [use.encode(t) if t else b"" for t in batch.column(text).to_pylist()]
                offsets = [0]
                for c in coded:
                    offsets.append(offsets[-1] + len(c) // 4)
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(coded))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                more = [lists] + ([use.decode(lists)] if decoded else [])
                names = [f.name for f in fields]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])
        use.forget()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text of its token ids, special tokens included."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary))
    kept = _without(df, decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(shared.value)
        for whole in batches:
            for batch in _slices(whole, ids, SLICE_CHARS):
                yield pa.RecordBatch.from_arrays([*batch.columns, use.decode(batch.column(ids))], names=[*batch.schema.names, decoded])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(decoded, T.StringType(), False)]))
