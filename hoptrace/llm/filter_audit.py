"""Filter interaction audit by count-weighted decision diagrams.

``failure_rows`` gives each document the mask of the filters it fails, ``mask_weights`` counts documents by part and
mask, and ``audit`` builds one diagram a part over its at most 2^5 masks: a node asks one filter, its low edge is
"passes", its high edge "fails", equal parts below are one node, and every node knows the documents (all, good, toxic)
below it. Swapping two adjacent levels turns the diagram of one order of the filters into that of another; swaps that
visit all orders leave 120 diagrams, and in each the path on which all filters pass gives the steps: what a node's high
edge holds is removed there, what its low edge holds is kept.

Rows meet by the digest of their text only to find copies: the least doc_id of each digest is found with partial sums
and copied to every task for digests that many rows share, so a group of copies is never gathered.

Defined results: a null text is empty, a null source the part ``""``, together with an empty source. A row is a copy if
its doc_id is greater than that of a row with the same text; rows that repeat both are no copies of each other, and a
null doc_id neither is a copy nor makes one. Several labels of one doc_id count once, and as 1 if one of them is 1.
Texts of any length are whole rows of a batch. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_hot, staged, table

#: The filters, in the order of their bits; the last is found by a join.
FILTERS = "ABCDE"
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: A diagram's node below which no document lies, on any level.
EMPTY = 0


def text_mask(text: str) -> int:
    """Bits of the first four filters that a text fails. Bytes split at the six ASCII spaces, as the words do."""
    raw = text.encode()
    words = raw.split()
    few, repeating = len(words) < 50, 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 5 * len(text)
    marked = len(raw.translate(None, SYMBOLS)) < len(raw)
    return few | repeating << 1 | loud << 2 | marked << 3


def failure_rows(docs: DataFrame) -> DataFrame:
    """doc_id, part and the mask of all five filters, a row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            masks = pa.array([text_mask(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), masks, digests], ["doc_id", "part", "mask", "digest"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = staged(whole.mapInArrow(run, "doc_id long, part string, mask int, digest binary"), "masks")
    copies = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "copies")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    out = staged(join_hot(rows, copies, "digest", "n", "left").select("doc_id", "part", F.col("mask").bitwiseOR(16 * again).alias("mask")), "failures")
    discard(rows, copies)
    return out


def mask_weights(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and its documents: all, those labelled good, those labelled toxic. At most 32 rows a part."""
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return rows.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("docs"), total("good"), total("toxic"))


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places to swap with their next ones, so that n things come in each of their orders once: the last of them sweeps
    through each order of the others."""
    if n < 2:
        return
    sweep, inner = range(n - 2, -1, -1), list(adjacent_swaps(n - 1))
    for k, place in enumerate([*inner, None]):
        yield from sweep if k % 2 == 0 else reversed(sweep)
        if place is not None:
            yield place + (k % 2 == 0)


class Diagram:
    """The decision diagram of failure masks, with one level a filter. Weights are (documents, good, toxic)."""

    def __init__(self, filters: str, weights: dict[int, tuple[int, int, int]]):
        self.order = list(filters)
        self.weight = [(0, 0, 0)]
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in filters]
        leaves: dict[tuple, int] = {(0, 0, 0): EMPTY}
        below = []
        for mask in range(1 << len(filters)):
            weight = weights.get(mask, (0, 0, 0))
            if weight not in leaves:
                leaves[weight] = self._new(weight)
            below.append(leaves[weight])
        # the mask's highest bit is asked on the lowest level
        for level in reversed(range(len(filters))):
            unique: dict[tuple[int, int], int] = {}
            half = 1 << level
            below = [self._node(level, unique, below[m], below[m | half]) for m in range(half)]
        self.root = below[0]

    def _new(self, weight: tuple[int, ...]) -> int:
        self.weight.append(weight)
        return len(self.weight) - 1

    def _node(self, level: int, unique: dict, low: int, high: int) -> int:
        if low == high == EMPTY:
            return EMPTY
        if (low, high) not in unique:
            unique[low, high] = self._new(tuple(a + b for a, b in zip(self.weight[low], self.weight[high])))
            self.levels[level][unique[low, high]] = low, high
        return unique[low, high]

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next. Nodes above stay: what they point to means the same as before."""
        old, self.levels[level + 1] = self.levels[level + 1], {}
        unique: dict[tuple[int, int], int] = {}
        none = EMPTY, EMPTY
        for key, (low, high) in self.levels[level].items():
            (ll, lh), (hl, hh) = old.get(low, none), old.get(high, none)
            self.levels[level][key] = self._node(level + 1, unique, ll, hl), self._node(level + 1, unique, lh, hh)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass(self) -> Iterator[tuple[str, tuple, tuple]]:
        """Filter, kept and removed weights of each step."""
        node = self.root
        for name, level in zip(self.order, self.levels):
            node, fails = level.get(node, (EMPTY, EMPTY))
            yield name, self.weight[node], self.weight[fails]


def audited(part: str, weights: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """All steps of all orders of one part."""
    diagram = Diagram(filters, weights)
    fails = {f: sum(w[0] for m, w in weights.items() if m >> i & 1) for i, f in enumerate(filters)}
    alone = {f: weights.get(1 << i, (0,))[0] for i, f in enumerate(filters)}
    steps = []
    for place in [None, *adjacent_swaps(len(filters))]:
        if place is not None:
            diagram.swap(place)
        steps += [("".join(diagram.order), k, f, kept, gone) for k, (f, kept, gone) in enumerate(diagram.all_pass(), 1)]
    shapley = dict.fromkeys(filters, 0)
    for _, _, f, _, gone in steps:
        shapley[f] += gone[0]
    return [(part, order, k, kept[0], gone[0], fails[f] - gone[0], alone[f], gone[1], gone[2], shapley[f]) for order, k, f, kept, gone in steps]


def audit(weights: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from the table of :func:`mask_weights`."""
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = {int(m): (int(d), int(g), int(t)) for m, d, g, t in zip(rows["mask"], rows["docs"], rows["good"], rows["toxic"])}
        return pd.DataFrame(audited(rows["part"].iloc[0], found), columns=names)

    return weights.groupBy("part").applyInPandas(run, OUT)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_weights(failure_rows(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))
