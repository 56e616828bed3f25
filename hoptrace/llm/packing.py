"""Best-two-fit packing of token sequences.

The choice of what goes with what depends on lengths alone, and lengths are integers of at most ``capacity``. So the
packing is solved exactly on the counts of each length (a table of at most ``capacity`` rows, whatever the corpus):
``plan_bins`` fills a bin greedily with the longest pieces that fit, then replaces its smallest piece by the two
unpacked pieces that fit the widened gap more tightly, and repeats the found pattern as often as the counts allow.
The pieces themselves never leave the executors: each gets its rank among the pieces of its length by a distributed
running count, and joins the plan's run of ranks that holds it.

Defined results: null and empty texts are one piece, the end id. Rows that repeat a doc_id are separate documents and
each is packed. An empty table gives no piece. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import range_offsets, staged
from .token_ids import encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def encode_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """A row per piece. Only documents over ``capacity`` are cut; the first piece takes what is left over.

    ``keep_ids`` adds the ids (array of int), for building the sequences with :func:`sequences`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], dtype="<u4")
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            whole = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                ids = np.concatenate([ids.astype("<u4"), end])
                start, stop, k = 0, len(ids) % capacity or capacity, 0
                while start < len(ids):
                    part = ids[start:stop]
                    for c, v in zip(cols, (doc_id, k, start, len(part), zlib.crc32(part))):
                        c.append(v)
                    start, stop, k = stop, stop + capacity, k + 1
                whole.append(ids)
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds)]
            if keep_ids:  # pieces stand in the order of their document's ids
                ends = np.concatenate([[0], np.cumsum(cols[3])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "<u4"), *whole]).view(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return whole.mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """[(bins, lengths in each)] that pack all pieces; ``counts``: pieces of each length.

    The patterns are found by best-two-fit. As the next bin's pattern is the same while every length used is still
    there, a pattern is repeated at once, so the steps depend on the number of lengths and not of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while left.any():
        used = np.zeros(capacity + 1, np.int64)
        have = left.copy()
        gap, bin_ = capacity, []
        while True:
            fits = np.flatnonzero(have[1 : gap + 1])
            if not len(fits):
                break
            x = int(fits[-1]) + 1
            bin_.append(x)
            have[x] -= 1
            gap -= x
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            room, best = gap + smallest, None
            there = np.flatnonzero(have[1:room]) + 1  # lengths still unpacked and under the widened gap
            for a in there[::-1].tolist():
                b_most = min(a, room - a)
                b = there[: np.searchsorted(there, b_most, "right")]
                b = b[b != a] if have[a] < 2 else b
                if len(b) and (best is None or a + int(b[-1]) > best[0]):
                    best = (a + int(b[-1]), a, int(b[-1]))
                    if best[0] == room:
                        break
            if best and best[0] > smallest:
                bin_[-1:] = [best[1], best[2]]
        for x in bin_:
            used[x] += 1
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        plan.append((times, bin_))
    return plan


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (any columns, with doc_id, piece, start, ``length``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    ranged = staged(pieces.withColumn("_range", F.spark_partition_id()), "pieces")
    counts = {r["length"]: r["n"] for r in ranged.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs, taken, first = [], dict.fromkeys(counts, 0), 0
    for times, lengths in plan_bins(counts, capacity):
        offset = 0
        for length in lengths:
            runs.append((length, taken[length], taken[length] + times, first, offset))
            taken[length] += times
            offset += length
        first += times
    # The plan's size is bounded by the number of lengths, not of pieces, and so is what is broadcast.
    plan = spark.createDataFrame(runs, "length int, low long, high long, first long, offset long")
    plan = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "first", "offset"))).alias("runs"))
    rank = Window.partitionBy("length", "_range").orderBy(F.col("doc_id").asc_nulls_last(), "piece", "start")
    ranks = ranged.join(range_offsets(ranged, F.lit(1), ["length"]), ["length", "_range"])
    ranks = ranks.withColumn("_rank", F.col("_before") + F.row_number().over(rank) - 1)
    found = ranks.join(F.broadcast(plan), "length").withColumn("_run", F.filter("runs", lambda r: (r.low <= F.col("_rank")) & (F.col("_rank") < r.high))[0])
    return found.select(*pieces.columns, (F.col("_run.first") + F.col("_rank") - F.col("_run.low")).cast("long").alias("sequence_id"), F.col("_run.offset").cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences' ids in place, from :func:`pack` of pieces with ids: sequence_id, ids. Each is at most one capacity."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """A row per piece with its sequence and place, and with ``keep_ids`` its ids."""
    packed = pack(encode_pieces(docs, vocabulary, end_id, capacity, keep_ids), capacity)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
