"""BAM files as a Spark sink: one complete file a task, in order of contig and place over the files.

Tasks write below a folder of their job's own; what they wrote is moved into place when all have ended, and the folder
is deleted then or when the job fails, so a failed or repeated task leaves nothing.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..sources.bam import BASES, OPERATIONS
from ..sources.files import located

# Fixed values of the format: the empty last block, bytes of a block at most, the quality of mapping where none is known.
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK, MAPPING_QUALITY = 0xFF00, 60
WANTED = ("name", "flag", "ref_index", "ref_start", "cigar", "ref_end", "seq", "qual", "nm")


def block(data: bytes) -> bytes:
    """One gzip block that tells its size."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def interval_bin(low: int, high: int) -> int:
    """Number of the smallest of the format's bins (of 2^14 bases and eight, 64, .. times as many) that holds low..high - 1."""
    first = 4681  # bins of larger sizes
    for shift in (14, 17, 20, 23, 26):
        if low >> shift == high - 1 >> shift:
            return first + (low >> shift)
        first = (first - 1) // 8
    return 0


def record(row) -> bytes:
    name, cigar = (row["name"] or "*").encode() + b"\0", row["cigar"] or ""
    ops = [(int(n) << 4) | OPERATIONS.index(op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    codes = [max(BASES.find(c), 0) if c in BASES else 15 for c in seq.upper()]
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], [*codes[1::2], 0]))
    qual = bytes(ord(c) - 33 for c in row["qual"]) if row["qual"] and len(row["qual"]) == len(seq) else b"\xff" * len(seq)
    ref, start = (-1 if row[c] is None else row[c] for c in ("ref_index", "ref_start"))
    end = row["ref_end"] if row["ref_end"] is not None else start + 1
    flag = row["flag"] if row["flag"] is not None else 4
    tags = b"" if row["nm"] is None else b"NMi" + struct.pack("<i", row["nm"])
    head = struct.pack("<iiBBHHHiiii", ref, start, len(name), MAPPING_QUALITY, interval_bin(max(start, 0), max(end, start + 1, 1)), len(ops), flag, len(seq), -1, -1, 0)
    body = head + name + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def header(contigs: list[tuple[str, int]]) -> bytes:
    text = ("@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in contigs)).encode()
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    return out + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)


@dataclass
class Written(WriterCommitMessage):
    file: str
    partition: int


class BamWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.contigs, self.overwrite = options["path"].rstrip("/"), json.loads(options["contigs"]), overwrite
        self.own = f"{self.path}/_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        task = TaskContext.get()
        system, folder = located(self.own)
        system.create_dir(folder, recursive=True)
        file = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}.bam"
        with system.open_output_stream(file) as out:
            waiting = header([tuple(c) for c in self.contigs])
            for row in iterator:
                waiting += record(row)
                while len(waiting) >= BLOCK:
                    out.write(block(waiting[:BLOCK]))
                    waiting = waiting[BLOCK:]
            while waiting:
                out.write(block(waiting[:BLOCK]))
                waiting = waiting[BLOCK:]
            out.write(LAST_BLOCK)
        return Written(file, task.partitionId())

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(folder)):
                if f.type == fs.FileType.File and f.base_name.endswith(".bam"):
                    system.delete_file(f.path)
        for m in messages:
            system.move(m.file, f"{folder}/part-{m.partition:05d}.bam")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, folder = located(self.own)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class BamSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam_sink"

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options, overwrite)


def write_bam(rows: DataFrame, contigs: DataFrame, path: str) -> None:
    """Canonical alignments as BAM files below ``path``, unmapped ones last. ``contigs``: ref_index, ref_name, ref_length, all of which each file's header names."""
    spark = rows.sparkSession
    spark.dataSource.register(BamSink)
    names = [(r["ref_name"], r["ref_length"]) for r in contigs.orderBy("ref_index").collect()]
    order = [rows["ref_index"].asc_nulls_last(), rows["ref_start"].asc_nulls_last(), rows["ordinal"].asc()]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*WANTED)
    placed.write.format("bam_sink").option("contigs", json.dumps(names)).mode("overwrite").save(path)
