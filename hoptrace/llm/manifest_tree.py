"""Merkle manifest of a dataset, by exchange of subtrees.

Leaves of a source stand in order of doc_id, and runs of ``FAN`` nodes become their hash until one, the subroot, is
left; the subroots of all sources become the root in the same way. No task holds a source:

1. ``numbered`` gives each leaf its place in its source, over sorted ranges whose counts are added up before.
2. ``climbed`` folds superblocks of ``FAN`` ** ``DEPTH`` consecutive nodes into one node each, again and again, until
   every source is one node; each round writes a table that is a superblock's size smaller.
3. ``exchanged`` goes down again: the nodes of a superblock and the nodes outside it that its proofs need (``outer``,
   one row a superblock) are cogrouped in ``applyInPandas``, which finishes the levels inside the superblock and joins
   both halves of each node's path. On the lowest table the same step, :func:`proofs`, folds the leaves at hand along
   their paths and holds the result against the root, so that no path is ever written for a document.

A path is the texts to the left and to the right of a node on each level, up to the root.

Defined results: leaves of equal doc_id stand in the order of their hashes, null doc_ids come last, a null source is a
source of its own. Rows that repeat each other are leaves of their own. A null doc_id is not tampered with. Texts of any
length are hashed whole. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, range_offsets, ranked_partitions, staged, table

#: Nodes of a run, and levels of runs that one superblock holds.
FAN, DEPTH = 16, 2
BLOCK = FAN**DEPTH
#: Every so many documents by their CRC-32 is tampered with.
TAMPERED = 5


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(*values: Column) -> Column:
    """SHA-256 of the values, each with its length in bytes; a null is a dash."""
    strings = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in strings]), 256)


def document_leaves(docs: DataFrame) -> DataFrame:
    """key (the source; null first in order), doc_id, node (the leaf) and hand (the leaf as it is found: of every fifth
    document that of a text in lower case)."""
    c = F.col
    lower = F.translate(c("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.coalesce(F.crc32(c("doc_id").cast("long").cast("string")) % TAMPERED == 0, F.lit(False))
    fields = [c("doc_id").cast("long"), c("source"), c("lang"), c("n_chars").cast("long")]
    node = leaf_hash(*fields, c("text"))
    key = F.coalesce(F.concat(F.lit("1"), c("source").cast("string")), F.lit("0"))
    return docs.select(key.alias("key"), c("doc_id").cast("long").alias("doc_id"), node.alias("node"), F.when(changed, leaf_hash(*fields, lower)).otherwise(node).alias("hand"))


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` (key, ...) with ``at``, the place in the key's order ``by``, and ``total``, the key's rows."""
    ranged = ranked_partitions(rows, ["key", *by], name)
    sums = range_offsets(ranged, F.lit(1), ["key"])
    totals = ranged.groupBy("key").agg(F.count("*").alias("total"))
    borders = staged(sums.join(totals, "key"), f"{name}-borders")
    inside = Window.partitionBy("_range", "key").orderBy(*[F.col(c).asc_nulls_last() for c in by])
    placed = ranged.withColumn("_n", F.row_number().over(inside)).join(borders, ["key", "_range"])
    out = staged(placed.withColumn("at", (F.col("_before") + F.col("_n") - 1).cast("long")).drop("_range", "_n", "_before"), f"{name}-placed")
    discard(ranged, borders)
    return out


def levels_of(total: int) -> int:
    """Levels from ``total`` nodes to one."""
    out = 0
    while total > 1:
        total, out = -(-total // FAN), out + 1
    return out


def folded(nodes: list[str], levels: int) -> list[list[str]]:
    """``nodes`` and the ``levels`` levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest("".join(out[-1][i : i + FAN])) for i in range(0, len(out[-1]), FAN)])
    return out


def climbed(base: DataFrame, name: str) -> list[DataFrame]:
    """``base`` (key, at, node, total) and the tables of superblocks' tops above it, the last with one row a key."""

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        total = int(rows["total"].iloc[0])
        node = folded(rows["node"].tolist(), min(DEPTH, levels_of(total)))[-1][0]
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "at": [int(rows["at"].iloc[0]) // BLOCK], "node": [node], "total": [-(-total // BLOCK)]})

    out = [base]
    while len(out) == 1 or (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        blocks = out[-1].select("key", "at", "node", "total").groupBy("key", F.floor(F.col("at") / BLOCK).alias("_block"))
        out.append(staged(blocks.applyInPandas(lambda rows: top(rows), "key string, at long, node string, total long"), f"{name}-tops"))
    return out


def _paths(rows: pd.DataFrame, outer: pd.DataFrame) -> tuple[pd.DataFrame, list[list[str]]]:
    """A superblock's nodes in order, and each one's path to the root: left, right, left, right, ..."""
    rows = rows.sort_values("at").reset_index(drop=True)
    levels = folded(rows["node"].tolist(), min(DEPTH, levels_of(int(rows["total"].iloc[0]))))
    rest = list(outer["path"].iloc[0])
    paths = []
    for at in range(len(rows)):
        path: list[str] = []
        for nodes in levels[:-1]:
            first = at - at % FAN
            path += ["".join(nodes[first:at]), "".join(nodes[at + 1 : first + FAN])]
            at //= FAN
        paths.append(path + rest)
    return rows, paths


def _by_block(nodes: DataFrame, outer: DataFrame):
    block = nodes.withColumn("_block", F.floor(F.col("at") / BLOCK)).groupBy("key", "_block")
    return block.cogroup(outer.withColumnRenamed("at", "_block").groupBy("key", "_block"))


def exchanged(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """(key, at, path, subroot, root) of every node of a table of :func:`climbed`, from those of its superblocks' tops."""

    def run(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, paths = _paths(rows, above)
        return pd.DataFrame({"key": rows["key"], "at": rows["at"], "path": paths, "subroot": above["subroot"].iloc[0], "root": above["root"].iloc[0]})

    kinds = "key string, at long, path array<string>, subroot string, root string"
    return staged(_by_block(nodes.select("key", "at", "node", "total"), outer).applyInPandas(run, kinds), "outer")


def proofs(leaves: DataFrame, outer: DataFrame) -> DataFrame:
    """Leaves with their source's subroot, the root, the digest of their proof, and the root that the leaf at hand gives."""

    def run(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, paths = _paths(rows, above)
        root, proof, seen = above["root"].iloc[0], [], []
        for hand, path in zip(rows["hand"], paths):
            proof.append(digest("".join(path)))
            for left, right in zip(path[::2], path[1::2]):
                hand = digest(left + hand + right)
            seen.append(hand)
        out = pd.DataFrame({"doc_id": rows["doc_id"], "leaf": rows["node"], "subroot": above["subroot"].iloc[0], "root": root, "proof_sha256": proof, "folded_root": seen})
        return out.assign(verified=out["folded_root"] == root)

    # ids go through pandas as texts, where a null would make them inexact
    own = leaves.withColumn("doc_id", F.col("doc_id").cast("string"))
    kinds = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _by_block(own, outer).applyInPandas(run, kinds).withColumn("doc_id", F.col("doc_id").cast("long"))


def manifest(leaves: DataFrame) -> DataFrame:
    """The manifest of ``leaves`` (key, doc_id, node, hand), each held against the root by its proof."""
    tree = climbed(numbered(leaves, ["doc_id", "node", "hand"], "leaves"), "leaves")
    subroots = tree[-1].select(F.lit("").alias("key"), F.col("key").alias("source"), "node")
    forest = climbed(numbered(subroots, ["source"], "subroots"), "subroots")
    none = F.array().cast("array<string>")
    outer = forest[-1].select("key", "at", none.alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    for level in reversed(forest[:-1]):
        outer = exchanged(level, outer)
    own = forest[0].select("at", "source", "node")
    outer = outer.join(own, "at").select(F.col("source").alias("key"), F.lit(0).cast("long").alias("at"), "path", F.col("node").alias("subroot"), "root")
    for level in reversed(tree[1:-1]):
        outer = exchanged(level, outer)
    return proofs(tree[0], outer)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(document_leaves(table(spark, sf_dir, "documents")))
