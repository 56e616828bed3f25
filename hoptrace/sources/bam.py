"""BAM files as a Spark data source, read in splits.

A BAM file is a row of gzip blocks that each tell their size. A split begins at a byte offset: its task looks for the
next block, then for the first record in it, by the shape that several records in a row must have. It reads the records
that begin in its blocks, and a little of the next split's to finish the last one. Files lie wherever a URI leads
that all executors can open; of each, a task fetches the ranges that it reads. A folder stands for its .bam files.

    spark.dataSource.register(BamSource)
    spark.read.format("bam").load(path)          # or read_bam(spark, path)
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import opened, parts

SCHEMA = "ordinal long, name string, flag int, ref_index int, ref_name string, ref_length int, ref_start int, cigar string, ref_end int, seq string, qual string, nm int"
# Fixed values of the format: the codes of bases and CIGAR operations, and the sizes of tag values.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
INTEGERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
BLOCK, CHAIN = 1 << 16, 4


def block_size(head: bytes) -> int:
    """Bytes of the block that begins with ``head``; 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    extra, at = struct.unpack("<H", head[10:12])[0], 12
    while at + 4 <= min(12 + extra, len(head)):
        kind, n = head[at : at + 2], struct.unpack("<H", head[at + 2 : at + 4])[0]
        if kind == b"BC" and n == 2:
            return struct.unpack("<H", head[at + 4 : at + 6])[0] + 1
        at += 4 + n
    return 0


class Blocks:
    """The unpacked bytes of a file from some block on, block by block."""

    def __init__(self, path: str, start: int):
        (self.file, self.size), self.at = opened(path), start

    def next(self) -> tuple[int, bytes] | None:
        """(offset, bytes) of the next block; None at the end."""
        while self.at < self.size:
            self.file.seek(self.at)
            n = block_size(self.file.read(64))
            if not n:
                raise ValueError(f"no block at {self.at}")
            self.file.seek(self.at)
            data = zlib.decompress(self.file.read(n), 31)
            offset, self.at = self.at, self.at + n
            if data:
                return offset, data
        return None

    def find(self) -> bool:
        """Go to the first block at or behind the current offset that another block or the end follows."""
        self.file.seek(self.at)
        window = self.file.read(2 * BLOCK + 64)
        at = window.find(b"\x1f\x8b\x08\x04")
        while at >= 0:
            n = block_size(window[at : at + 64])
            if n and (self.at + at + n == self.size or block_size(window[at + n : at + n + 64])):
                self.at += at
                return True
            at = window.find(b"\x1f\x8b\x08\x04", at + 1)
        return False


def header(path: str) -> tuple[list[tuple[str, int]], int, int]:
    """Contigs (name, length), and where the first record begins: its block and its place in it."""
    blocks, data, marks = Blocks(path, 0), b"", []

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            offset, more = blocks.next() or (0, None)
            if more is None:
                raise ValueError("the header is cut off")
            marks.append((len(data), offset))
            data += more

    need(12)
    if data[:4] != b"BAM\1":
        raise ValueError(f"{path} is no BAM file")
    at = 8 + struct.unpack("<i", data[4:8])[0]
    need(at + 4)
    count, at, refs = struct.unpack("<i", data[at : at + 4])[0], at + 4, []
    for _ in range(count):
        need(at + 4)
        n = struct.unpack("<i", data[at : at + 4])[0]
        need(at + 8 + n)
        refs.append((data[at + 4 : at + 3 + n].decode(), struct.unpack("<i", data[at + 4 + n : at + 8 + n])[0]))
        at += 8 + n
    begin, offset = max((m for m in marks if m[0] <= at), default=(0, 0))
    return refs, offset, at - begin


def plausible(data: bytes, at: int, n_refs: int) -> int:
    """Where the record at ``at`` ends if it can be one; 0 if not; -1 if the data end first."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack("<iiiBBHHHiiii", data[at : at + 36])
    if not (32 <= size < 1 << 26 and -1 <= ref < n_refs and -1 <= next_ref < n_refs and pos >= -1 and next_pos >= -1 and l_name >= 2 and 0 <= l_seq < 1 << 25):
        return 0
    if 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size:
        return 0
    if at + 36 + l_name > len(data):
        return -1
    name = data[at + 36 : at + 35 + l_name]
    if data[at + 35 + l_name] or not all(33 <= c <= 126 for c in name):
        return 0
    return at + 4 + size


def first_record(data: bytes, n_refs: int) -> int:
    """Place of the first record: the first from which ``CHAIN`` records follow each other, or reach the data's end."""
    for at in range(len(data)):
        end = at
        for _ in range(CHAIN):
            end = plausible(data, end, n_refs)
            if end <= 0 or end >= len(data):
                break
        if end != 0 and not (end == -1 and plausible(data, at, n_refs) == -1 and len(data) - at < 36 and at):
            return at
    return len(data)


def record(data: bytes, refs: list[tuple[str, int]], ordinal: int) -> tuple:
    """A row of ``SCHEMA`` from a record's bytes without its size."""
    ref, pos, l_name, _, _, n_cigar, flag, l_seq = struct.unpack("<iiBBHHHi", data[:20])
    at = 32 + l_name
    name = data[32 : at - 1].decode()
    ops = struct.unpack(f"<{n_cigar}I", data[at : at + 4 * n_cigar])
    at += 4 * n_cigar
    packed = data[at : at + (l_seq + 1) // 2]
    seq = "".join([BASES[b >> 4] + BASES[b & 15] for b in packed])[:l_seq] or "*"
    at += len(packed)
    quality = data[at : at + l_seq]
    qual = None if not l_seq or quality[0] == 255 else bytes(q + 33 for q in quality).decode()
    at, nm = at + l_seq, None
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if tag == b"NM" and kind in INTEGERS:
            nm = struct.unpack(INTEGERS[kind], data[at : at + SIZES[kind]])[0]
        if kind in "ZH":
            at = data.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + SIZES[chr(data[at])] * struct.unpack("<i", data[at + 1 : at + 5])[0]
        else:
            at += SIZES[kind]
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops) or None
    span = sum(x >> 4 for x in ops if OPERATIONS[x & 15] in "MDN=X")
    known, start = 0 <= ref < len(refs), pos if pos >= 0 else None
    return (ordinal, name, flag, ref if known else None, refs[ref][0] if known else None, refs[ref][1] if known else None, start, cigar, start + span if cigar and start is not None else None, seq, qual, nm)


class Split(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        super().__init__((path, low, high))
        self.path, self.low, self.high = path, low, high


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [part for p in options["path"].split(",") for part in parts(p, ".bam")]
        self.split_bytes = int(options.get("splitbytes", 64 << 20))

    def partitions(self) -> list[Split]:
        out = []
        for p in self.paths:
            size = opened(p)[1]
            out += [Split(p, a, min(a + self.split_bytes, size)) for a in range(0, size, self.split_bytes)]
        return out

    def read(self, split: Split) -> Iterator[tuple]:
        refs, first_block, inside = header(split.path)
        blocks = Blocks(split.path, max(split.low, first_block))
        if split.low > first_block and not blocks.find():
            return
        started = split.low > first_block
        data, marks, ended = b"", [], False  # marks: where each block's bytes begin in data, and its offset
        at = 0 if started else inside

        def more() -> bool:
            nonlocal data, ended
            found = blocks.next()
            if found is None:
                ended = True
                return False
            marks.append((len(data), found[0]))
            data += found[1]
            return True

        if started:
            while len(data) < 4 * BLOCK and more():
                pass
            at = first_record(data, len(refs))
        while True:
            while len(data) < at + 4 and more():
                pass
            if len(data) < at + 4:
                return
            while len(marks) > 1 and marks[1][0] <= at:
                marks.pop(0)
            if marks[0][1] >= split.high:
                return
            size = struct.unpack("<i", data[at : at + 4])[0]
            while len(data) < at + 4 + size and more():
                pass
            if len(data) < at + 4 + size:
                raise ValueError(f"{split.path} is cut off")
            yield record(data[at + 4 : at + 4 + size], refs, (marks[0][1] << 16) + at - marks[0][0])
            at += 4 + size
            if at > 8 * BLOCK:
                data, marks, at = data[at:], [(m - at, o) for m, o in marks], 0


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Canonical alignment records; the ordinal is the record's place in the file."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("splitbytes", split_bytes).load(path)
