"""Near copies: SimHash near-duplicates of five-word shingles, with an exact end: links are pairs of whole texts whose
sets of shingles have a Jaccard similarity of 0.8 or more, and none is lost.

Two texts that are 0.8 similar differ in some ten bits of a 64-bit SimHash, in every byte as a rule, so no count of
shared positional bytes is guaranteed to them. The SimHash index (:mod:`.simhash`) therefore finds the closest pairs,
and an index of rare shingles, whose guarantee holds for Jaccard, finds the others:

1. A text is the set of 64-bit hashes of its shingles; equal sets are one node. Each node keeps the SimHash of its set,
   a parity bitmap of 512 bits, and its prefix: in one common order of all shingles, sets of a similarity of 0.8 meet
   in their first ``n - ceil(0.8 n) + 1``. Shingles that a sample of the texts has often come last in the order, which
   makes lists short; whatever the sample, no pair is lost. A prefix reaches ``n // SPARE`` shingles further, in which
   similar sets meet as many times more, so a set that meets others too seldom in all has no partner and leaves the
   index: texts that share a few shingles by chance, which grow with the square of the corpus, make no pairs.
2. First pairs: links of the SimHash index, and each member of a list of the prefix index with three of the list.
   That links large groups of copies without their pairs.
3. Members of one list that are still in different components are paired, those outside the list's largest component
   with all others that their size and their places in the list allow: lists are parted by bands of sizes, of which a
   member meets three, and long lists by members too, so no list is one task. Where both have the same list before
   this one, they have met there, so a pair of many common shingles is made for few of them.
4. A pair goes on if its sizes and bitmaps allow the similarity (differing parity bits are a lower bound of the sets'
   symmetric difference), and is then decided on the two whole sets, which are made again from the texts of such pairs
   alone.

Bytes are lower-cased from A to Z and split at six ASCII spaces; a text of one to four words is one shingle.

Defined results: null, empty and word-less texts are one node. Rows that repeat a doc_id are in its component if their
texts link. A null doc_id never names a component unless all of its members' are null. An empty table gives no row.
Columns other than ``doc_id`` and ``text`` are ignored; :func:`deduplicated` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_by_size, join_hot, new_name, staged
from .components import components
from .simhash import links_between, majority, shingle_hashes

SHINGLE = 5
#: Texts of the sample that orders shingles, occurrences from which on one is frequent, and how many of these are kept.
SAMPLE, OFTEN, MOST_OFTEN = 20_000, 3, 100_000
#: A prefix is longer than needed to meet once by a set's size divided by this, to meet as often more.
SPARE = 10
#: Pairs of one text that meet in one task, and shingles of sets that a task keeps for its next pairs (8 bytes each).
TOGETHER, KEPT_SHINGLES = 1000, 200_000
#: Members of a list that a task pairs with others; ratio of sizes that a band spans (a little over that of similar sets, so they are in the same or in adjoining bands).
MEMBERS, BAND = 1000, 1.26
WORDS = 8
BITMAP = [f"w{i}" for i in range(WORDS)]


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(text, SHINGLE))


def parity_bitmap(shingles: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of how many shingles fall on it, as eight longs."""
    odd = np.bincount((shingles % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and its hash."""
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("text_hash"))


def _often(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, ascending, with their counts."""
    every = max(1, texts.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text).view(np.int64))], ["gram"])

    some = texts.filter(F.pmod("text_hash", F.lit(every)) == 0).groupBy("text_hash").agg(F.first("text").alias("text"))
    found = staged(some.mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN), "often")
    most = found.orderBy(F.desc("n"), "gram").limit(MOST_OFTEN).toArrow()
    discard(found)
    gram, n = most.column("gram").to_numpy().view(np.uint64), most.column("n").to_numpy()
    order = np.argsort(gram)
    return gram[order], n[order]


def prefix(shingles: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, frequent ones last: as many as are sure to meet those of a similar set
    ``1 + n // SPARE`` times, ``n`` being the lesser size."""
    gram, count = often
    weight = np.zeros(len(shingles), np.int64)
    if len(gram):
        at = np.minimum(np.searchsorted(gram, shingles), len(gram) - 1)
        weight = np.where(gram[at] == shingles, count[at], 0)
    n = len(shingles) - (4 * len(shingles) + 4) // 5 + 1 + len(shingles) // SPARE if len(shingles) else 0
    return shingles[np.lexsort((shingles, weight))[:n]]


def _with_nodes(texts: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, text_hash, ``node`` (hash of the set), its size n, SimHash, bitmap and prefix."""
    shared = texts.sparkSession.sparkContext.broadcast(often)  # MOST_OFTEN shingles at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            nodes = np.array([xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            bits = np.array([parity_bitmap(s) for s in sets], np.int64).reshape(-1, WORDS)
            firsts = [prefix(s, shared.value).view(np.int64) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
            columns = [batch.column(0), batch.column(2), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))]
            columns += [pa.array(bits[:, i]) for i in range(WORDS)] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "n", "fp", *BITMAP, "prefix"])

    return texts.mapInArrow(run, "doc_id long, text_hash long, node long, n long, fp long, " + ", ".join(f"{w} long" for w in BITMAP) + ", prefix array<long>")


# --- pairs -----------------------------------------------------------------------------------------------------------
def _may_link(a: str, b: str) -> Column:
    """Whether sizes and bitmaps of two sides (prefixes of their columns) allow a similarity of 0.8."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in BITMAP), F.lit(0))
    # a similarity of 0.8 leaves at most a ninth of both sizes to the symmetric difference
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * apart <= n + m)


def _enough_left(a: str, b: str) -> Column:
    """Whether sets that share a shingle at these places of the common order can be 0.8 similar.

    What stands before it can be shared with what stands before it alone, and what stands behind it likewise.
    """
    n, m, i, j = (F.col(f"{s}{c}") for c in ("n", "pos") for s in (a, b))
    return 9 * (F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)) >= 4 * (n + m)


def _candidates(shared: DataFrame) -> DataFrame:
    """(gram, node, n, pos): of ``shared`` (written), what lies in the part of a prefix that meets at least once, for
    nodes that meet others often enough in their whole prefix. A partner has four fifths of a node's size or more."""
    least = F.expr("(4 * n + 4) div 5")
    enough = shared.groupBy("node", "n").agg(F.count("*").alias("met")).filter(F.col("met") > F.floor(least / SPARE)).select("node")
    return staged(shared.filter(F.col("pos") <= F.col("n") - least).join(enough, "node", "left_semi"), "index")


def _stars(index: DataFrame, lists: DataFrame) -> DataFrame:
    """(u, v): members of a list with three of it, where sizes and places allow the similarity."""
    beside = join_hot(index, lists, "gram", "k").select("node", "n", "pos", F.explode(F.array_distinct(F.array("c0", "c1", "c2"))).alias("c"))
    beside = beside.select("node", "n", "pos", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("node", "n", "pos")]).filter(F.col("c_node") != F.col("node"))
    return beside.filter((5 * F.least("n", "c_n") >= 4 * F.greatest("n", "c_n")) & _enough_left("", "c_")).select(*_ordered("c_node", "node"))


def _parted(mixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides of ``mixed`` to be joined by ``gram``, ``band`` and ``part``: each pair of a list meets once if their bands adjoin."""
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.log(F.lit(BAND))).cast("int")
    parts = F.ceil(F.col("k") / MEMBERS).cast("int")
    near = mixed.filter(F.col("root") != F.col("most")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    near = near.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    return near, mixed.withColumns({"part": F.pmod(F.xxhash64("node"), parts).cast("int"), "band": band})


def _ordered(u: str, v: str) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _likely(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) that may be similar; a node of many pairs is not gathered."""
    pairs, temporary = staged(pairs.distinct(), "pairs"), []
    out = pairs
    for side in ("u", "v"):
        own = facts.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", *BITMAP)])
        counted = staged(pairs.groupBy(side).agg(F.count("*").alias("k")).join(own, side), "facts")
        out = join_hot(out, counted, side, "k")
        temporary.append(counted)
    out = staged(out.filter(_may_link("u_", "v_")).select("u", "v"), "likely")
    discard(pairs, *temporary)
    return out


def _spread(pairs: DataFrame, own: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(u, v, s, t): ``pairs`` with both nodes' texts, and tables to discard. A node of many pairs meets them in several tasks."""
    temporary, sides = [], {}
    for side, other in (("u", "v"), ("v", "u")):
        counts = pairs.groupBy(side).agg(F.count("*").alias("k")).withColumn(f"{side}_tasks", F.ceil(F.col("k") / TOGETHER).cast("int"))
        sides[side] = staged(counts, "counts")
        temporary.append(sides[side])
    narrow = pairs
    for side, other in (("u", "v"), ("v", "u")):
        narrow = join_hot(narrow, sides[side], side, "k").withColumn(f"{side}_part", F.pmod(F.xxhash64(other), F.col(f"{side}_tasks")).cast("int")).drop(f"{side}_tasks")
    out = staged(narrow, "spread")
    temporary.append(out)
    for side, name in (("u", "s"), ("v", "t")):
        texts = own.withColumnsRenamed({"node": side, "text": name}).join(sides[side], side)
        texts = texts.select(side, name, F.explode(F.sequence(F.lit(0), F.col(f"{side}_tasks") - 1)).alias(f"{side}_part"))
        out = out.join(texts, [side, f"{side}_part"])
    return out.select("u", "v", "s", "t"), temporary


def _verified(pairs: DataFrame, texts: DataFrame, facts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (written; u, v) whose whole sets are 0.8 similar.

    A pair meets its two texts, which are shorter than their sets, and the sets are made where it is decided.
    """
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    hashes = staged(facts.select("node", "text_hash").join(wanted, "node"), "wanted")
    found = join_by_size(texts.select("text_hash", "text"), hashes.select("text_hash"), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    own = staged(found.join(hashes, "text_hash").select("node", "text"), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}

        def set_of(node: int, text: str) -> np.ndarray:
            if node not in made:
                if sum(map(len, made.values())) > KEPT_SHINGLES:
                    made.clear()
                made[node] = shingle_set(text)
            return made[node]

        for batch in batches:
            keep = []
            for u, v, s, t in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                a, b = set_of(u, s), set_of(v, t)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(5 * both >= 4 * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    with_texts, temporary = _spread(pairs, own)
    out = staged(with_texts.mapInArrow(run, "u long, v long"), "links")
    discard(hashes, own, *temporary)
    return out


def _close_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v) of nodes whose SimHashes are linked or equal, through the least node of each SimHash; a forest of them."""
    heads = staged(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("k")), "heads")
    same = join_hot(nodes.select("fp", "node"), heads, "fp", "k").filter(F.col("node") != F.col("head")).select(*_ordered("head", "node"))
    links = links_between(heads.select("fp"))
    at = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    near = links.join(at("u"), "u").join(at("v"), "v").select(*_ordered("u_head", "v_head"))
    out = staged(same.unionByName(near), "close")
    discard(heads, links)
    return out


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of every node, and nothing else."""
    return staged(nodes.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, component_id, ``kept`` and ``rows`` for each distinct doc_id and text.

    ``component_id`` is the least doc_id reachable over links; ``kept`` is true for one of each component: the least
    doc_id (nulls last), then the least hash. ``rows``: how many rows are equal in both.
    """
    texts = _texts(docs)
    rows = staged(_with_nodes(texts, _often(texts)), "shingles")
    whole = rows.groupBy("node").agg(F.min("text_hash").alias("text_hash"), *[F.first(c).alias(c) for c in ("n", "fp", *BITMAP, "prefix")])
    nodes = staged(whole, "nodes")
    keys = staged(rows.groupBy("doc_id", "text_hash", "node").agg(F.count("*").alias("rows")), "keys")
    discard(rows)
    entries = nodes.select(F.posexplode("prefix").alias("pos", "gram"), "node", "n")
    grams = staged(entries.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1"), "grams")  # most are of one node
    shared = staged(join_hot(entries, grams, "gram", "k"), "shared")
    facts = staged(nodes.drop("prefix"), "facts")
    discard(grams, nodes)
    index = _candidates(shared)
    discard(shared)
    member = F.struct("node", "n", "pos")
    centres = F.min(member).alias("c0"), F.max(member).alias("c1"), F.min_by(member, F.xxhash64("node")).alias("c2")
    lists = staged(index.groupBy("gram").agg(*centres, F.count("*").alias("k")).filter("k > 1"), "lists")
    stars = _stars(index, lists)
    close = _close_pairs(facts)
    first = _likely(stars.unionByName(close), facts)
    discard(lists, close)
    links = _verified(first, texts, facts)
    roots = _rooted(facts, links)
    # members of one list that are in different components: those outside a list's largest component against the list
    placed = staged(index.join(roots, "node"), "placed")
    discard(index)
    sizes = placed.groupBy("gram", "root").agg(F.count("*").alias("k"))
    largest = staged(sizes.groupBy("gram").agg(F.max_by("root", F.struct("k", "root")).alias("most"), F.sum("k").alias("k"), F.count("*").alias("roots")).filter("roots > 1").drop("roots").withColumn("members", F.col("k")), "largest")
    mixed = join_hot(placed, largest, "gram", "members").withColumn("before", F.lag("gram").over(Window.partitionBy("node").orderBy("pos")))
    mixed = staged(mixed.join(facts.select("node", *BITMAP), "node"), "mixed")
    discard(placed, largest)
    a, b = (side.alias(name) for side, name in zip(_parted(mixed), "ab"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("gram", "band", "part")]
    once = (F.col("b.root") == F.col("b.most")) | (F.col("a.node") < F.col("b.node"))
    once &= F.col("a.before").isNull() | F.col("b.before").isNull() | (F.col("a.before") != F.col("b.before"))
    meet = same[0] & same[1] & same[2] & (F.col("a.root") != F.col("b.root")) & once & _enough_left("a.", "b.") & _may_link("a.", "b.")
    rest = a.join(b, meet).select(*_ordered("a.node", "b.node")).distinct()
    rest = staged(rest.join(first, ["u", "v"], "left_anti"), "rest")
    discard(mixed, first)
    if not rest.isEmpty():
        more = _verified(rest, texts, facts)
        discard(roots)
        roots = _rooted(facts, links.unionByName(more))
        discard(more)
    discard(links, rest, facts)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    of_node = keys.groupBy("node").agg(F.min(order).alias("least"), F.count("*").alias("k"))
    rooted = staged(of_node.join(roots, "node"), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("name"))
    named = staged(rooted.join(names, "root").select("node", "k", "name"), "named")
    out = join_hot(keys, named, "node", "k").select("doc_id", "text_hash", F.col("name.doc_id").alias("component_id"), (order == F.col("name")).alias("kept"), "rows")
    out = staged(out, "near-copies")
    discard(keys, roots, rooted, named)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those that repeat or nearly repeat another: one row of each component stays.

    Only keys are compared and joined; whole texts are moved where the removed keys are too many to copy, or where the
    very row that stays occurs several times.
    """
    found = near_copies(docs)
    doc, hash_ = new_name(docs, "_doc"), new_name(docs, "_hash")
    keyed = docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(hash_, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    right = found.select(F.coalesce("doc_id", F.lit(0)).alias("k0"), F.col("doc_id").isNull().alias("k1"), F.col("text_hash").alias("k2"), "kept", "rows")
    same = lambda r: (F.coalesce(keyed[doc], F.lit(0)) == r["k0"]) & (keyed[doc].isNull() == r["k1"]) & (keyed[hash_] == r["k2"])
    gone = staged(right.filter(~F.col("kept")).select("k0", "k1", "k2"), "removed")
    stay = join_by_size(keyed, gone, same(gone), "left_anti")
    again = staged(right.filter(F.col("kept") & (F.col("rows") > 1)).select("k0", "k1", "k2"), "repeated")
    discard(found)
    if not again.isEmpty():
        once = join_by_size(keyed, again, same(again), "left_semi").dropDuplicates([doc, hash_])
        stay = join_by_size(stay, again, same(again), "left_anti").unionByName(once)
    return stay.drop(doc, hash_)
