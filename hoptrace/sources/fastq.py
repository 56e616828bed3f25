"""FASTQ records from the splits of plain files, without a shuffle.

Which of a record's four lines a split begins with follows from the number of lines before it, so a first pass counts
each split's lines and keeps its first three; the driver adds them up, a row a split. The second pass leaves out the
lines that belong to the record before, and ends its last record with the lines that follow. A gzipped file is one split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from .fasta import _lines


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, block, lines): the lines of a batch, apart by split."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        files, blocks = batch.column(1), batch.column(2).to_numpy()
        new = np.ones(n, bool)
        new[1:] = (blocks[1:] != blocks[:-1]) | pc.not_equal(files.slice(1), files.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], n]):
            yield files[a].as_py(), int(blocks[a]), batch.column(0).slice(a, b - a)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, n, head): a split's lines and the first three of them."""
    rows: list[list] = []
    for file, block, lines in _stretches(batches):
        if not rows or (rows[-1][0], rows[-1][1]) != (file, block):
            rows.append([file, block, 0, []])
        now = rows[-1]
        now[3] += lines.slice(0, 3 - len(now[3])).to_pylist()
        now[2] += len(lines)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["file", "block", "n", "head"])


def _carried(rows: list) -> dict[tuple[str, int], tuple[int, list[str]]]:
    """Per split: the lines of its file before it, and the three after it (fewer at the end)."""
    out: dict[tuple[str, int], tuple[int, list[str]]] = {}
    before, file = 0, None
    order = sorted(rows, key=lambda r: (r["file"], r["block"]))
    for r in order:
        before = before if r["file"] == file else 0
        file = r["file"]
        out[file, r["block"]] = before, []
        before += r["n"]
    after: list[str] = []
    for r in reversed(order):
        after = after if r["file"] == file else []
        file = r["file"]
        out[file, r["block"]] = out[file, r["block"]][0], after
        after = [*r["head"], *after][:3]
    return out


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, record, header, seq, qual): each four lines; the last record of a file may lack some, which are null then."""
    counts = staged(_lines(spark, path).mapInArrow(_counted, "file string, block long, n long, head array<string>"), "fastq-splits")
    shared = spark.sparkContext.broadcast(_carried(counts.collect()))  # a row a split: its head, for its 128 MB

    def batch(file: str, record: int, lines: pa.Array) -> pa.RecordBatch:
        n = len(lines) // 4
        at = np.arange(n) * 4
        columns = [pa.array([file] * n, pa.string()), pa.array(np.arange(record, record + n), pa.int64()), *[lines.take(pa.array(at + i)) for i in (0, 1, 3)]]
        return pa.RecordBatch.from_arrays(columns, ["file", "record", "header", "seq", "qual"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, record, skip, held, after = None, 0, 0, pa.array([], pa.string()), []

        def rest() -> Iterator[pa.RecordBatch]:
            if len(held):
                lines = [*held.to_pylist(), *after][:4]
                yield batch(split[0], record, pa.array([*lines, *[None] * (4 - len(lines))], pa.string()))

        for file, block, lines in _stretches(batches):
            if (file, block) != split:
                yield from rest()
                split = file, block
                before, after = shared.value[split]
                skip = -before % 4
                record, held = (before + skip) // 4, pa.array([], pa.string())
            gone = min(skip, len(lines))
            skip -= gone
            whole = pa.concat_arrays([held, lines.slice(gone).cast(pa.string())])
            full = len(whole) // 4 * 4
            if full:
                yield batch(file, record, whole.slice(0, full))
            record, held = record + full // 4, whole.slice(full)
        yield from rest()

    return _lines(spark, path).mapInArrow(run, "file string, record long, header string, seq string, qual string")


def read_fastq(spark: SparkSession, path: str | list[str], mate: int | None = None) -> DataFrame:
    """(id, name, seq, qual, mate) of four-line records, plain or gzipped; an absent quality becomes as many ``I``."""
    rows = read_records(spark, path).filter(F.col("header").startswith("@"))
    name = F.regexp_extract(F.substr("header", F.lit(2)), r"^([^\s]*)", 1)
    qual = F.when(F.coalesce("qual", F.lit("")) == "", F.repeat(F.lit("I"), F.length("seq"))).otherwise(F.col("qual"))
    return rows.select(F.xxhash64("file", "record").alias("id"), name.alias("name"), "seq", qual.alias("qual"), F.lit(mate).cast("int").alias("mate"))
