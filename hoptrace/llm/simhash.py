"""Near-duplicate documents by SimHash, found with a byte-position inverted index and count filtering.

A 64-bit fingerprint is eight bytes, each at its position. Two fingerprints that differ in at most two bits differ in
at most two bytes, so they share at least six positional bytes: the guaranteed minimum.

1. Index: lists over single positional bytes would each hold a 256th of the corpus, so positions are taken in four
   groups of two, and an entry's key is the bytes of two groups. Two different bytes touch two groups at most, so two
   groups are always whole: every linked pair is in one of the six lists of its members.
2. Count filter: the shared positional bytes of each pair of a list are tallied, and pairs under the minimum go.
   A list of over ``DIRECT`` entries is first split by two more of its positional bytes, all six choices: of the four
   other bytes the guarantee leaves two at least. Such lists hold 65,536 entries at most, whatever the corpus, and all
   their pairs have the minimum.
3. Verification: the differing bits of what is left are counted.

Equal fingerprints are one entry. Lists of one entry are dropped before any Python runs. Of a list no pairs are put
out, but a spanning forest of its verified links, which keeps every component of the whole link graph.

Defined results: null, empty and word-less texts have fingerprint zero and link like any other. Rows that repeat a
doc_id are in one component with it if their fingerprints link. A null doc_id never names a component unless all of
its members' are null. An empty table gives no row. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_hot, staged
from .components import components

SHINGLE = 3
SEED = 42
#: The two groups of two positional bytes (group g holds bytes 2g and 2g + 1) that a list's key has, for each kind of list.
GROUPS = list(combinations(range(4), 2))
#: Entries of a list that are tallied pair by pair; larger lists are split first.
DIRECT = 256
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a whole text, in order; a text of fewer words is one shingle, one of none has none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z alone are lower-cased, six ASCII spaces split
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
    shingles = [joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist())]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(8):  # eight bits at once, as byte lanes, which hold up to 255
        lanes = (h >> np.uint64(k)) & _LANES
        for at in range(0, len(lanes), 255):
            counts[k::8] += np.frombuffer(lanes[at : at + 255].sum(dtype=np.uint64).tobytes(), np.uint8)
    bits = counts * 2 > len(h)
    return int(sum(1 << i for i in np.flatnonzero(bits).tolist()))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned SimHash of one whole text."""
    return majority(shingle_hashes(text, size))


def with_fingerprint(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- the index ------------------------------------------------------------------------------------------------------
def _bits(fp: Column, position: int, n: int) -> Column:
    """``n`` bytes of a fingerprint from a byte position on."""
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit((1 << 8 * n) - 1))


def _keys(fp: Column) -> Column:
    """The six keys of a fingerprint: the kind of list, then its two groups of bytes."""
    return F.array(*[F.lit(k << 32).bitwiseOR(F.shiftleft(_bits(fp, 2 * b, 2), 16)).bitwiseOR(_bits(fp, 2 * a, 2)) for k, (a, b) in enumerate(GROUPS)])


def _split_keys(key: Column, fp: Column) -> Column:
    """The six keys of a split list: its own, the choice of two of the four other bytes, and these bytes."""
    out = F.lit(None).cast("array<long>")
    for k, groups in enumerate(GROUPS):
        others = [p for p in range(8) if p // 2 not in groups]
        choices = [
            key.bitwiseOR(F.lit(c << 35)).bitwiseOR(F.shiftleft(_bits(fp, a, 1), 38)).bitwiseOR(F.shiftleft(_bits(fp, b, 1), 46))
            for c, (a, b) in enumerate(combinations(others, 2))
        ]
        out = F.when(F.shiftright(key, 32) == k, F.array(*choices)).otherwise(out)
    return out


def _walk(n: int, neighbours: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of a graph of ``n`` nodes."""
    seen, out = np.zeros(n, bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root], open_ = True, [root]
        while open_:
            i = open_.pop()
            near = neighbours(i)
            near = near[~seen[near]]
            seen[near] = True
            out += [(i, j) for j in near.tolist()]
            open_ += near.tolist()
    return out


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positional bytes that fingerprints share, pair by pair."""
    return (np.ascontiguousarray(a ^ b).view(np.uint8).reshape(*np.broadcast_shapes(a.shape, b.shape), 8) == 0).sum(-1)


def linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter, then verification."""
    return (tally(a, b) >= 8 - max_bits) & (np.bitwise_count(a ^ b) <= max_bits)


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links of one list of distinct fingerprints.

    Over ``DIRECT`` entries the list is a split one: its members share six bytes, so a member's neighbours are looked
    up by flipping bits of the two others.
    """
    if len(fps) <= DIRECT:
        near = linked(fps[:, None], fps[None, :], max_bits)
        return _walk(len(fps), lambda i: np.flatnonzero(near[i]))
    apart = np.bitwise_or.reduce(fps ^ fps[0])
    places = [b for b in range(64) if int(apart) >> b & 1]
    flips = np.array([sum(1 << b for b in c) for n in range(1, max_bits + 1) for c in combinations(places, n)], np.uint64)
    order = np.argsort(fps)
    ordered = fps[order]

    def neighbours(i: int) -> np.ndarray:
        wanted = fps[i] ^ flips
        at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
        return order[at[ordered[at] == wanted]]

    return _walk(len(fps), neighbours)


def links_between(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(u, v): links between distinct fingerprints (column ``fp``) that keep all components; ``max_bits`` up to two."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the index guarantees six shared bytes, for at most two bits")
    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = fps.select("fp").repartition(parts, "fp").select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    sizes = staged(index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n")), "lists")
    shared = staged(join_hot(index, sizes, "key", "n"), "index")
    direct = shared.filter(F.col("size") <= DIRECT).select("key", "fp")
    split = shared.filter(F.col("size") > DIRECT).select(F.explode(_split_keys(F.col("key"), F.col("fp"))).alias("key"), "fp")
    lists = direct.unionByName(split).groupBy("key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ends = batch.column(0).flatten().to_numpy().view(np.uint64), batch.column(0).offsets.to_numpy() - batch.column(0).offsets[0].as_py()
            starts, sizes = ends[:-1], np.diff(ends)
            two = starts[sizes == 2]  # most lists
            near = linked(fps[two], fps[two + 1], max_bits)
            us, vs = [fps[two][near]], [fps[two + 1][near]]
            for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = fps[at : at + n]
                pairs = np.array(forest(own, max_bits), np.int64).reshape(-1, 2)
                us.append(own[pairs[:, 0]])
                vs.append(own[pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["u", "v"])

    out = staged(lists.select("fps").mapInArrow(run, "u long, v long").distinct(), "links")
    discard(sizes, shared)
    return out


def near_duplicates(docs: DataFrame, max_bits: int = 2, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long), component_id: least doc_id reachable over links."""
    rows = staged(with_fingerprint(docs, size), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    linked_ = staged(components(links_between(nodes, max_bits)), "components")
    rooted = staged(nodes.join(linked_, F.col("fp") == F.col("node"), "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(rooted.join(names, "root").select("fp", "copies", "component_id"), "named")
    discard(nodes, linked_, rooted)
    return join_hot(rows, named, "fp", "copies").select("doc_id", "fp", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
