"""Alignments in BAM files: blocks of deflated bytes that hold records one after another."""

from __future__ import annotations

import glob
import os
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from strandflow.sources.readers import PAIRED, QCFAIL, REVERSE, SECOND, SECONDARY, UNMAPPED

SCHEMA = "qname string, seqid string, pos bigint, is_plus boolean, cigar string, paired boolean, second boolean, unmapped boolean, secondary boolean, qcfail boolean"
ARROW = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])
#: Operations of a CIGAR by their number, those that move along the reference, sizes of tag values,
#: the number that marks an index's bin without chunks, the width of a window of its linear part, how a block begins and its size.
OPS, MOVING = "MIDNSHP=X", frozenset("MDN=X")
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
NO_CHUNKS, WINDOW_BITS = 37450, 14
BLOCK_MAGIC, LARGEST_BLOCK = b"\x1f\x8b\x08\x04", 1 << 16
ROWS_PER_BATCH = 10_000
#: Blocks, and records, that must follow one another before a guessed beginning is believed, and bytes of a record at most.
PROOF_BLOCKS, PROOF_RECORDS, LARGEST_RECORD = 3, 10, 1 << 28
#: Compressed bytes of a partition, unless the option `split` says otherwise.
SPLIT = 64 << 20


class Blocks:
    """Inflated bytes from a virtual offset on: place of a block in the file (upper 48 bits) and place within it."""

    def __init__(self, path: str, offset: int = 0):
        self.file = open(path, "rb")  # noqa: SIM115
        self.file.seek(offset >> 16)
        self.start, self.data, self.at = offset >> 16, b"", 0
        self._next()
        self.at = offset & 0xFFFF

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _next(self) -> bool:
        """Load the next block that is not empty; False at the end of the file."""
        while True:
            self.start = self.file.tell()
            head = self.file.read(12)
            if not head:
                self.data, self.at = b"", 0
                return False
            if len(head) < 12 or head[:4] != BLOCK_MAGIC:
                raise ValueError(f"no block of deflated bytes at {self.start}")
            extra = self.file.read(struct.unpack("<H", head[10:12])[0])
            size, k = None, 0
            while k + 4 <= len(extra):
                name, n = extra[k : k + 2], struct.unpack_from("<H", extra, k + 2)[0]
                if name == b"BC":
                    size = struct.unpack_from("<H", extra, k + 4)[0] + 1
                k += 4 + n
            if size is None:
                raise ValueError(f"a block without its size at {self.start}")
            body = self.file.read(size - 12 - len(extra))
            self.data, self.at = zlib.decompress(body[:-8], wbits=-15), 0
            if self.data:
                return True

    def more(self) -> bool:
        return self.at < len(self.data) or self._next()

    def tell(self) -> int:
        return self.start << 16 | self.at

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if not self.more():
                raise ValueError("the file ends within a record")
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def number(self) -> int:
        return struct.unpack("<i", self.read(4))[0]


def header(path: str) -> tuple[list[tuple[str, int]], int]:
    """Sequences with their lengths, and the virtual offset of the first record."""
    with Blocks(path) as b:
        if b.read(4) != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        b.read(b.number())
        found = []
        for _ in range(b.number()):
            name = b.read(b.number())[:-1].decode()
            found.append((name, b.number()))
        b.more()
        return found, b.tell()


class Guess:
    """Where blocks and records begin in a file without an index, guessed from the bytes and proved by what follows."""

    def __init__(self, path: str, lengths: list[int]):
        self.path, self.lengths, self.size = path, lengths, os.path.getsize(path)

    def _block_end(self, file, at: int) -> int | None:
        """End of the block that begins at a place, if the bytes there look like a block's."""
        file.seek(at)
        head = file.read(18)
        if len(head) < 18 or head[:4] != BLOCK_MAGIC or head[12:16] != b"BC\x02\0":
            return None
        return at + struct.unpack_from("<H", head, 16)[0] + 1

    def block(self, offset: int) -> int | None:
        """The first place from an offset on at which a chain of blocks begins; None if there is none."""
        with open(self.path, "rb") as file:
            while offset < self.size:
                file.seek(offset)
                window = file.read(2 * LARGEST_BLOCK)
                k = window.find(BLOCK_MAGIC)
                while k >= 0:
                    at, proved = offset + k, 0
                    while at is not None and at < self.size and proved < PROOF_BLOCKS:
                        at, proved = self._block_end(file, at), proved + 1
                    if at is not None and at <= self.size:
                        return offset + k
                    k = window.find(BLOCK_MAGIC, k + 1)
                offset += max(1, len(window) - len(BLOCK_MAGIC) + 1)
        return None

    def _record_end(self, data: bytearray, at: int) -> int | None:
        """End of the record that begins at a place, if the bytes there look like a record's; the fixed part must be there."""
        size, ref, pos, n_name, _, _, n_ops, _, n_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
        n = len(self.lengths)
        if not (32 < size <= LARGEST_RECORD and -1 <= ref < n and -1 <= mate < n and n_name and n_seq >= 0 and -1 <= mate_pos):
            return None
        if not (-1 <= pos < (self.lengths[ref] if ref >= 0 else 1 << 31)) or 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq > size:
            return None
        return at + 4 + size

    def _reads_like_one(self, data: bytearray, at: int) -> bool:
        """Whether name and operations, which must be there, are a record's."""
        n_name, n_ops = data[at + 12], struct.unpack_from("<H", data, at + 16)[0]
        name = data[at + 36 : at + 36 + n_name]
        ops = struct.unpack_from(f"<{n_ops}I", data, at + 36 + n_name)
        return name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) and all(o & 15 < len(OPS) for o in ops)

    def record(self, offset: int, below: int) -> int | None:
        """Virtual offset of the first record that begins in a block between two places of the file; None if none does."""
        first = self.block(offset)
        if first is None or first >= below:
            return None
        data, places, ended = bytearray(), [], False
        with Blocks(self.path, first << 16) as b:

            def grown(to: int) -> bool:
                nonlocal ended
                while len(data) < to and not ended:
                    if b.more():
                        places.append((len(data), b.start))
                        data.extend(b.data[b.at :])
                        b.at = len(b.data)
                    else:
                        ended = True
                return len(data) >= to

            def proved(at: int) -> bool:
                for _ in range(PROOF_RECORDS):
                    if not grown(at + 36):
                        return ended and at == len(data)
                    end = self._record_end(data, at)
                    if end is None or not grown(end) or not self._reads_like_one(data, at):
                        return False
                    at = end
                return True

            at = 0
            while grown(at + 36):
                begun, start = next(x for x in reversed(places) if x[0] <= at)
                if start >= below:
                    return None
                if self._record_end(data, at) is not None and proved(at):
                    return start << 16 | at - begun
                at += 1
        return None


class Index:
    """Virtual offsets at which records begin, by sequence, from an index beside the file: name.bam.bai, name.bai or name.bam.csi.

    The second kind has bins of a width of its own, so sequences may be longer than 2**29, and its bins carry the offset of the
    first record over them instead of a table of windows.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.csi = data[:4] == BLOCK_MAGIC
        if self.csi:
            with Blocks(path) as b:
                data = b"".join(iter(lambda: b.read(len(b.data) - b.at) if b.more() else b"", b""))
        if data[:4] != (b"CSI\1" if self.csi else b"BAI\1"):
            raise ValueError(f"{path} is no index")
        self.starts: list[list[int]] = []
        self.ends: list[int] = []
        self.windows: list[tuple[int, ...]] = []
        self.bins: list[dict[int, tuple[int, int]]] = []
        k, self.shift, self.depth = 4, WINDOW_BITS, 5
        if self.csi:
            self.shift, self.depth, extra = struct.unpack_from("<3i", data, k)
            k += 12 + extra
        without_chunks = ((1 << 3 * (self.depth + 1)) - 1) // 7 + 1
        n, k = struct.unpack_from("<i", data, k)[0], k + 4
        for _ in range(n):
            starts, end, own = set(), 0, {}
            bins, k = struct.unpack_from("<i", data, k)[0], k + 4
            for _ in range(bins):
                number, first, chunks = struct.unpack_from("<IQi", data, k) if self.csi else (*struct.unpack_from("<I", data, k), 0, *struct.unpack_from("<i", data, k + 4))
                k += 16 if self.csi else 8
                pairs = struct.unpack_from(f"<{2 * chunks}Q", data, k)
                k += 16 * chunks
                if number != without_chunks:
                    starts.update(pairs[::2])
                    end = max(end, *pairs[1::2]) if chunks else end
                    if chunks:
                        own[number] = (first, min(pairs[::2]))
            if not self.csi:
                size = struct.unpack_from("<i", data, k)[0]
                self.windows.append(struct.unpack_from(f"<{size}Q", data, k + 4))
                k += 4 + 8 * size
                starts |= {w for w in self.windows[-1] if w}
            self.bins.append(own)
            self.starts.append(sorted(starts))
            self.ends.append(end)

    @classmethod
    def beside(cls, path: str) -> Index | None:
        names = [path + ".bai", os.path.splitext(path)[0] + ".bai", path + ".csi"]
        return next((cls(n) for n in names if os.path.exists(n)), None)

    def _bins_over(self, low: int) -> Iterator[int]:
        """Numbers of the bins that hold a position, the narrowest first."""
        for level in range(self.depth, -1, -1):
            yield ((1 << 3 * level) - 1) // 7 + (low >> self.shift + 3 * (self.depth - level))

    def _first_from(self, ref: int, low: int) -> int | None:
        """A place at or before the first record that reaches beyond a position; None if all bins end before it."""
        own = self.bins[ref]
        found = [own[n][0] for n in self._bins_over(low) if n in own]

        def end(number: int) -> int:
            level = next(x for x in range(self.depth + 1) if number < ((1 << 3 * (x + 1)) - 1) // 7)
            return (number - ((1 << 3 * level) - 1) // 7 + 1) << self.shift + 3 * (self.depth - level)

        later = [first for n, (_, first) in own.items() if end(n) > low]
        return max([min(later), *found]) if later else None

    def span(self, ref: int, low: int) -> tuple[int, int]:
        """Offsets between which all records of a sequence lie that reach beyond position `low`."""
        if not self.starts[ref]:
            return 0, 0
        if self.csi:
            first = self._first_from(ref, low)
            return (0, 0) if first is None else (first, self.ends[ref])
        first = next((w for w in self.windows[ref][low >> WINDOW_BITS :] if w), None)
        if first is None and low >> WINDOW_BITS >= len(self.windows[ref]):
            return 0, 0
        return first or self.starts[ref][0], self.ends[ref]


def _long_cigar(tags: bytes) -> tuple[int, ...] | None:
    """Operations from a record's CG tag, where there are too many of them for their usual place."""
    k = 0
    while k + 3 <= len(tags):
        name, kind, k = tags[k : k + 2], chr(tags[k + 2]), k + 3
        if kind in "ZH":
            k = tags.index(0, k) + 1
        elif kind == "B":
            sub, n = chr(tags[k]), struct.unpack_from("<i", tags, k + 1)[0]
            if name == b"CG" and sub in "iI":
                return struct.unpack_from(f"<{n}I", tags, k + 5)
            k += 5 + n * TAG_BYTES[sub]
        else:
            k += TAG_BYTES[kind]
    return None


def record(data: bytes, names: list[str]) -> tuple:
    """The columns of an alignment, and where it ends on the reference."""
    ref, pos, n_name, _, _, n_ops, flag, n_seq = struct.unpack_from("<iiBBHHHi", data)
    at = 32 + n_name
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    if n_ops == 2 and ops[0] == n_seq << 4 | 4 and ops[1] & 15 == 3:
        ops = _long_cigar(data[at + 8 + (n_seq + 1) // 2 + n_seq :]) or ops
    pairs = [(o >> 4, OPS[o & 15]) for o in ops]
    end = pos + max(1, sum(n for n, op in pairs if op in MOVING))
    bit = lambda b: bool(flag & b)
    row = (
        data[32 : at - 1].decode(),
        names[ref] if ref >= 0 else "*",
        pos,
        not bit(REVERSE),
        "".join(f"{n}{op}" for n, op in pairs) or "*",
        bit(PAIRED),
        bit(SECOND),
        bit(UNMAPPED),
        bit(SECONDARY),
        bit(QCFAIL),
    )
    return row, end


def region_of(text: str, names: list[str]) -> tuple[int, int, int]:
    """Number of a sequence and an interval from 0 of "name" or "name:first-last" (from 1, inclusive)."""
    name, low, high = text, 0, 1 << 40
    if text not in names and ":" in text:
        name, _, span = text.rpartition(":")
        first, _, last = span.replace(",", "").partition("-")
        low, high = int(first) - 1, int(last) if last else high
    if names.count(name) != 1:
        raise ValueError(f"{names.count(name)} sequences are named {name}")
    return names.index(name), max(0, low), high


class BamFiles(DataSource):
    """Alignments of BAM files. Options: path (a pattern; every executor must be able to open the files), region, split.

    With an index, a file is cut at records every `split` compressed bytes, and a region reads only the blocks that can
    hold its records. Without one, a file is cut at bytes, and each task finds the first record after its cut by itself. Conditions
    on seqid and pos narrow what is read where the session pushes filters to such sources (spark.sql.python.filterPushdown.enabled,
    which `bam` passes on as the option `filters`); Spark applies them once more. Columns and positions are those of `readers.sam`.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_NarrowedBamReader if self.options.get("filters") == "true" else _BamReader)(dict(self.options))


class _BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = sorted(glob.glob(options["path"]))
        if not self.paths:
            raise ValueError(f"no file at {options['path']}")
        self.region, self.split = options.get("region"), int(options.get("split", SPLIT))
        self.names: set[str] | None = None
        self.low, self.high = -1, 1 << 40

    def partitions(self) -> list[InputPartition]:
        found = [InputPartition((path, *span)) for path in self.paths for span in self._spans(path)]
        return found or [InputPartition((self.paths[0], 0, 0, False))]

    def _wanted(self, names: list[str]) -> list[tuple[int, int]] | None:
        """(sequence, first position) of what the region and the conditions ask for; None if that is everything."""
        if self.region:
            ref, low, _ = region_of(self.region, names)
            return [(ref, max(low, self.low))] if self.names is None or names[ref] in self.names else []
        if self.names is None or "*" in self.names:
            return None
        return [(ref, max(0, self.low)) for ref, name in enumerate(names) if name in self.names]

    def _spans(self, path: str) -> list[tuple[int, int | None, bool]]:
        """Virtual offsets from and to which a task reads, and whether the first is a guess."""
        sequences, first = header(path)
        index = Index.beside(path)
        wanted = self._wanted([n for n, _ in sequences])
        if index is None:
            cuts = range((first >> 16) + self.split, os.path.getsize(path), self.split)
            starts = [(first, False), *[(c << 16, True) for c in cuts]]
            return [(a, b, guess) for (a, guess), b in zip(starts, [*[c << 16 for c in cuts], None], strict=True)]
        if wanted is None:
            spans = [(first, None, sorted({s for of in index.starts for s in of}))]
        else:
            spans = [(low, high, index.starts[ref]) for ref, at in wanted for low, high in [index.span(ref, at)]]
        found = []
        for low, high, starts in spans:
            cuts = [low]
            for s in starts[bisect_left(starts, low) : bisect_left(starts, high) if high is not None else None]:
                if (s >> 16) - (cuts[-1] >> 16) >= self.split:
                    cuts.append(s)
            found += [(a, b, False) for a, b in zip(cuts, [*cuts[1:], high], strict=True) if b is None or a < b]
        return found

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, low, high, guess = partition.value
        sequences, _ = header(path)
        names = [n for n, _ in sequences]
        region = region_of(self.region, names) if self.region else None
        if guess:
            low = Guess(path, [n for _, n in sequences]).record(low >> 16, high >> 16 if high is not None else 1 << 62)
            if low is None:
                return
        rows: list[tuple] = []
        with Blocks(path, low) as b:
            while b.more() and (high is None or b.tell() < high):
                row, end = record(b.read(b.number()), names)
                inside = region is None or (row[1] == names[region[0]] and row[2] < region[2] and end > region[1])
                if inside and (self.names is None or row[1] in self.names) and self.low <= row[2] < self.high:
                    rows.append(row)
                if len(rows) == ROWS_PER_BATCH:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class _NarrowedBamReader(_BamReader):
    """The same where the session pushes filters; Spark refuses a reader that takes filters where it does not."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """All conditions stay Spark's; those on seqid and pos also say which blocks need not be read."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("seqid",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = named if self.names is None else self.names & named
            elif isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == ("pos",):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            yield f


def bam(spark: SparkSession, path: str, region: str | None = None, split: int = SPLIT) -> DataFrame:
    """Alignments of the files that match a path, of all sequences or of one region."""
    spark.dataSource.register(BamFiles)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("bam").options(path=path, split=str(split), filters=pushed)
    return (reader.option("region", region) if region else reader).load()


def bam_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, length) from a file's header."""
    return spark.createDataFrame(header(path)[0], "seqid string, length bigint")
