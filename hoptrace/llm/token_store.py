"""Content-addressed store of token ids.

``write_store`` encodes whole texts, cuts each id stream where a rolling hash over its last ids says so, and writes

* ``chunks``: every distinct chunk once, under the SHA-256 of its bytes, with the number of its uses; the bytes are ids
  as little-endian unsigned integers, in one zstd frame, so that they move packed;
* ``recipes``: per document, in ascending doc_id order (parts by number, rows inside a part), the digests of its chunks in order, its ids' count, the number
  of ids of all documents before it, its rank, and the Merkle root over its chunk digests;
* ``manifest``: a Merkle tree over all documents' roots by rank, ``FANOUT`` nodes to a parent, with documents and ids under each node.

A cut depends on the ids around it alone, so a passage that many documents share gives the same chunks in each.
``read_store`` joins recipes with chunks, puts every document's ids together again, hashes each chunk and takes the
checksum of the whole; the Merkle roots are made again from what was read and held against the manifest's.

Defined results: null and empty texts hold the end id alone. Rows are documents: rows that repeat a doc_id each count,
in a fixed order among themselves (by text digest). A null doc_id comes last. An empty table gives an empty store.
Columns other than ``doc_id`` and ``text`` are ignored, whatever their names. A changed or missing chunk, and a changed
recipe, make their documents' ``verified`` false; a missing recipe makes it false for all documents under its node of
the manifest, and reading fails if all of a node's recipes are missing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, join_hot, new_path, range_offsets, ranked_partitions, staged, written
from .token_ids import encoder

#: Children of a node of the manifest at most.
FANOUT = 1024
#: Ids that a cut decision looks at (a power of two), bits of its hash that must be zero (an average chunk is 2**CUT_BITS ids), bounds.
WINDOW, CUT_BITS, LEAST, MOST = 16, 9, 128, 4096

#: An odd multiplier for the polynomial rolling hash (a fixed value: 2**32 / golden ratio).
MULTIPLIER = np.uint32(0x9E3779B1)


def _wanted(ids: np.ndarray) -> np.ndarray:
    """Ends that a rolling hash of the last ``WINDOW`` ids asks for."""
    x = (ids.astype(np.uint32) + np.uint32(1)) * MULTIPLIER
    x ^= x >> np.uint32(15)
    h, power, span = x, MULTIPLIER, 1
    with np.errstate(over="ignore"):
        while span < WINDOW:  # a hash of twice as many ids from two of half as many; the first ids' hashes cover fewer
            h = np.concatenate([h[:span], h[span:] + h[:-span] * power])
            power, span = power * power, span * 2
    return np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + 1


def _ends(wanted: list[int], n: int) -> list[int]:
    ends, last = [], 0
    for p in [*wanted, n]:
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST or (p == n and p > last):
            last = p
            ends.append(last)
    return ends


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream: those of the hash, within the two bounds."""
    return _ends(_wanted(ids).tolist() if len(ids) > LEAST else [], len(ids))


def all_cut_points(streams: list[np.ndarray]) -> list[list[int]]:
    """:func:`cut_points` of each, hashed in one pass: hashes over a stream's start lie before its ``LEAST``-th id, where no cut is."""
    ends = np.cumsum([len(x) for x in streams], dtype=np.int64)
    wanted = _wanted(np.concatenate(streams)) if streams else np.zeros(0, np.int64)
    until = np.searchsorted(wanted, ends, "right").tolist()
    return [_ends((wanted[a:b] - (end - len(x))).tolist(), len(x)) for x, a, b, end in zip(streams, [0, *until], until, ends.tolist())]


def merkle_root(leaves: list[bytes]) -> bytes:
    """SHA-256 tree with marked leaves and nodes; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"\0").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


# --- writing ------------------------------------------------------------------------------------------------------
_ENCODED = "doc_id long, n_tokens long, root binary, text_digest binary, chunks array<struct<digest:binary,n:int,data:binary>>"


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """One row per document with its chunks; the bytes are packed ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = encoder(vocabulary), zstandard.ZstdCompressor(level=1).compress
        end = np.array([end_id], dtype=enc.dtype)
        for batch in batches:
            texts, counts, roots, offsets = batch.column(1).to_pylist(), [], [], [0]
            digests, sizes, data = [], [], []
            streams = [np.concatenate([ids, end]) for ids in enc.encode(texts)]
            for ids, cuts in zip(streams, all_cut_points(streams)):
                last, first = 0, len(digests)
                for p in cuts:
                    raw = ids[last:p].tobytes()
                    data.append(pack(raw))
                    digests.append(hashlib.sha256(raw).digest())
                    sizes.append(p - last)
                    last = p
                counts.append(len(ids))
                roots.append(merkle_root(digests[first:]))
                offsets.append(len(digests))
            named = [hashlib.sha256((t or "").encode()).digest() for t in texts]
            parts = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], ["digest", "n", "data"])
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(roots, pa.binary()), pa.array(named, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "root", "text_digest", "chunks"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ENCODED)


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> str:
    """Write chunks, recipes and manifest below ``path``; gives ``path``."""
    spark = docs.sparkSession
    encoded = staged(encode_documents(docs, vocabulary, end_id), "ids")
    chunks = encoded.select(F.explode("chunks").alias("c")).select("c.digest", "c.n", "c.data")
    written(chunks.groupBy("digest").agg(F.first("n").alias("n"), F.first("data").alias("data"), F.count("*").alias("uses")), f"{path}/chunks")
    short = encoded.select("doc_id", "n_tokens", "root", "text_digest", F.col("chunks.digest").alias("digests"))
    recipes = ranked_partitions(short, ["doc_id", "text_digest"], "recipes")
    discard(encoded)
    order = Window.partitionBy("_range").orderBy(F.col("doc_id").asc_nulls_last(), "text_digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = range_offsets(recipes, F.lit(1)).withColumnRenamed("_before", "_rows")
    placed = (
        recipes.join(range_offsets(recipes, F.col("n_tokens")), "_range").join(rows, "_range")
        .withColumn("start", (F.col("_before") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).cast("long"))
        .withColumn("rank", (F.col("_rows") + F.row_number().over(order) - 1).cast("long"))
        .select(F.col("_range").alias("part"), "doc_id", "text_digest", "start", "rank", "n_tokens", "root", "digests")
    )
    written(placed, f"{path}/recipes", "part")
    discard(recipes)
    nodes = _recipes(spark, path).select("rank", F.col("n_tokens").alias("ids"), F.lit(1).cast("long").alias("documents"), "root")
    level = 0
    while True:  # a level has a FANOUT-th of the rows of the one below
        level += 1
        written(_parents(nodes), f"{path}/manifest/level={level}")
        nodes = _manifest(spark, path).filter(F.col("level") == level).drop("level")
        if nodes.count() <= 1:
            return path


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    kinds = "doc_id long, text_digest binary, start long, rank long, n_tokens long, root binary, digests array<binary>, part int"
    return spark.read.schema(kinds).parquet(f"{path}/recipes")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rank long, documents long, ids long, root binary, level int").parquet(f"{path}/manifest")


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level of the tree: (rank, documents, ids, root) over at most ``FANOUT`` nodes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle_root([x["root"] for x in r]) for r in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(roots, pa.binary())], ["rank", "documents", "ids", "root"])

    by = nodes.groupBy(F.expr(f"rank DIV {FANOUT}").alias("rank")).agg(F.sum("documents").alias("documents"), F.sum("ids").alias("ids"), F.array_sort(F.collect_list(F.struct("rank", "root"))).alias("roots"))
    return by.mapInArrow(run, "rank long, documents long, ids long, root binary")


# --- reading ------------------------------------------------------------------------------------------------------
def _rebuilt(spark: SparkSession, path: str, keep_ids: bool) -> DataFrame:
    """Every document put together from its recipe and chunks: doc_id, start, rank, n_tokens, root (made again), ids_crc32, good, and its ids.

    Chunks stream by in a document's order, so no document's chunks are gathered in one row. The join and the ordering
    are written one after the other, so that the shuffle files of both are never there together.
    """
    parts = _recipes(spark, path).select("doc_id", "start", "rank", "n_tokens", "root", F.posexplode("digests").alias("pos", "digest"))
    parts = parts.withColumn("stored", F.when(F.col("pos") == 0, F.col("root"))).drop("root")  # once a document
    chunks = spark.read.schema("digest binary, n int, data binary, uses long").parquet(f"{path}/chunks")
    found = staged(join_hot(parts, chunks, "digest", "uses", "left"), "found")
    ordered = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "start").sortWithinPartitions("start", "pos")
    names = ["doc_id", "start", "rank", "n_tokens", "root", "ids_crc32", "good"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()] + [pa.list_(pa.int64())] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, unpack = None, [], zstandard.ZstdDecompressor().decompress

        def close():
            doc_id, start, rank, n_tokens, stored, crc, n, good, digests, ids = now
            root = merkle_root(digests)
            out.append((doc_id, start, rank, n_tokens, root, crc, good and n == n_tokens and root == stored) + ((np.concatenate(ids),) if keep_ids else ()))

        for batch in batches:
            for doc_id, start, rank, n_tokens, stored, digest, n, data in zip(*[batch.column(i).to_pylist() for i in range(8)]):
                if now is None or now[1] != start:
                    if now is not None:
                        close()
                    now = [doc_id, start, rank, n_tokens, stored, 0, 0, True, [], []]
                try:
                    raw = unpack(data, max_output_size=8 * MOST) if data else b""
                except zstandard.ZstdError:
                    raw = b""
                now[7] &= bool(raw) and hashlib.sha256(raw).digest() == digest
                now[8].append(digest)
                if raw and len(raw) % n == 0 and len(raw) // n in (2, 4):
                    ids = np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype("<u4")
                    now[5] = zlib.crc32(ids, now[5])
                    now[6] += len(ids)
                    if keep_ids:
                        now[9].append(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] or [pa.array([], k) for k in kinds], names)
            out.clear()
        if now is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "doc_id long, start long, rank long, n_tokens long, root binary, ids_crc32 long, good boolean" + (", ids array<long>" if keep_ids else "")
    out = staged(ordered.select("doc_id", "start", "rank", "n_tokens", "stored", "digest", "n", "data").mapInArrow(run, schema), "rebuilt")
    discard(found)
    return out


def read_store(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ``verified`` of each document, and with ``keep_ids`` its ids (array of long).

    All is taken from the ids as they were put together again. ``verified``: the chunks' digests hold, so does the
    Merkle root of the recipe, and so does its node of the manifest over the documents that were read.
    """
    rows = _rebuilt(spark, path, keep_ids)
    made = _parents(rows.select("rank", F.col("n_tokens").alias("ids"), F.lit(1).cast("long").alias("documents"), "root"))
    stored = _manifest(spark, path).filter(F.col("level") == 1).select(F.col("rank").alias("node"), *[F.col(c).alias(f"s_{c}") for c in ("documents", "ids", "root")])
    held = staged(stored.join(made.withColumnRenamed("rank", "node"), "node", "full"), "nodes")
    lost = held.filter(F.col("documents").isNull()).count()
    if lost:
        raise ValueError(f"all recipes under {lost} nodes of the manifest are missing")
    same = held.select("node", F.coalesce((F.col("documents") == F.col("s_documents")) & (F.col("ids") == F.col("s_ids")) & (F.col("root") == F.col("s_root")), F.lit(False)).alias("whole"))
    joined = rows.withColumn("node", F.expr(f"rank DIV {FANOUT}")).join(same, "node")
    return joined.select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("good") & F.col("whole")).alias("verified"), *["ids"] * keep_ids)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = write_store(docs, new_path(spark, "token-store"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_store(spark, path)
