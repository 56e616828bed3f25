"""SpotSigs: fingerprints of documents by the words that follow common words, and near duplicates by their sets.

1. ``common_words`` counts, per language, in how many documents each word stands, over all documents; those in at
   least ``SHARE`` of a language's documents (and in two), in languages of at least ``LEAST_PART`` of all, are anchors.
2. A spot signature is an anchor and the ``CHAIN`` content words that follow it, anchors skipped. A text is the set of
   its signatures' 64-bit hashes; its fingerprint is the 128-bit hash of that set. Where a stretch of ``GAP`` words has
   no anchor, as in a language of few documents or a list of names, each further word is its own anchor, so that every
   part of a text counts. A text too short for one whole chain has one signature, all of its words.
3. ``edited`` sorts documents by doc_id in ranges, each with a copy of the first document of the next range, so that
   every document meets the one after it in one pass; it also compares the sets that this pass has at hand.
4. ``near_duplicates`` finds all pairs of sets with a Jaccard similarity of ``LEAST`` or more. Sets are partitioned by
   their length, so that a partner lies in the same partition or the next one. Signatures are ordered by their exact
   counts, rarest first; two similar sets share one of their first ``n - ceil(LEAST * n) + 1``. Sets of such lists
   whose least hashes under two functions are equal, as those of similar sets mostly are, are compared with one of
   them, for ``BANDS`` such pairs of functions; this only saves pairs later. In
   rounds, the members of a list are compared with one of them, the one with the fewest signatures of its own, which
   then leaves the list; so large groups link without their pairs. Members that are still in different components are paired at the end. A
   pair is pruned by its lengths, by what can follow the places of its shared signature and by parity bitmaps of both
   sets, and decided on the whole sets.

The query takes the contract's columns from 3 and gives the class of near duplicates from 4 beside them.

Bytes are lower-cased from A to Z and split at six ASCII spaces. Defined results: a null text is empty; texts without
words have no signature, are one class, are alike among themselves (1) and unlike all others (0). Documents of equal
doc_id follow each other in the order of a hash of their texts, null doc_ids come last. The one document of a table follows
itself. Rows that repeat each other keep their number. A null doc_id names a class only if no other is in it. Texts of
any length are whole. An empty table gives no row. Other columns are ignored; a null language is one of its own.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, join_hot, settings, staged, table
from .components import merged
from .near_copies import _spread

#: Content words of a signature; words without an anchor from which on each is its own.
CHAIN, GAP = 3, 64
#: Part of a language's documents that an anchor stands in, and of all documents that a language has: so there are at
#: most 100 languages, each with at most 4/3 of its mean number of different words in a document as anchors.
SHARE, LEAST_PART = 0.75, 0.01
#: The least similarity of near duplicates, as a fraction.
LEAST = (4, 5)
#: Words that a task counts before it gives them on.
COUNTED_AT_ONCE = 200_000
ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n long, sigs array<long>"
#: Bits of a set's bitmap, in longs; each is the parity of how many signatures fall on it.
BITMAP = ("b0", "b1", "b2", "b3")
ROW += "".join(f", {b} long" for b in BITMAP)
#: Lists are compared with one member at a time while their pairs would be more than this many a member, so often at most.
FEW_PAIRS, ROUNDS = 2, 3
#: How often sets are compared by two equal least hashes before that.
BANDS = 8


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


# --- anchors ---------------------------------------------------------------------------------------------------------
def common_words(docs: DataFrame) -> frozenset[bytes]:
    """The anchors of a corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            langs, words = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((lang, w) for w in {*words_of(text), b""})  # the empty word stands for the document
                if len(found) > COUNTED_AT_ONCE:
                    yield out()
                    found.clear()
        yield out()

    lang, text = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = docs.select(lang.alias("lang"), text.alias("text")).mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = staged(counts.filter("n > 1 OR word = X''"), "word-counts")
    sizes = counts.filter("word = X''").select("lang", F.col("n").alias("docs"))
    most = sizes.agg(F.sum("docs")).first()[0] or 0
    large = sizes.filter(F.col("docs") >= LEAST_PART * most)
    often = counts.filter("word != X''").join(F.broadcast(large), "lang").filter(F.col("n") >= SHARE * F.col("docs"))
    anchors = frozenset(bytes(r["word"]) for r in often.select("word").distinct().collect())
    discard(counts)
    return anchors


def signature_set(text: str, anchors: frozenset[bytes]) -> np.ndarray:
    """Ascending distinct hashes of a text's spot signatures."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    common = [w in anchors for w in words]
    bare_start = not any(common[:GAP])
    content, spots, last = [], [], -1
    for i, (word, is_common) in enumerate(zip(words, common)):
        if is_common:
            spots.append((word, len(content)))
            last = i
            continue
        content.append(word)
        if bare_start if i < GAP else last < i - GAP:
            spots.append((word, len(content)))
    whole = [xxh64_intdigest(b" ".join((w, *content[at : at + CHAIN]))) for w, at in spots if at + CHAIN <= len(content)]
    if words and not whole:
        whole = [xxh64_intdigest(b" ".join(words))]
    return np.unique(np.array(whole, np.uint64))


def fingerprint(signatures: np.ndarray) -> str:
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(signatures.tobytes())


def parity_bitmap(signatures: np.ndarray) -> np.ndarray:
    odd = np.bincount(signatures.view(np.uint64) % np.uint64(64 * len(BITMAP)), minlength=64 * len(BITMAP)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


# --- each document with the one after it -----------------------------------------------------------------------------
def _ranges(docs: DataFrame) -> tuple[list[int], dict[int, tuple[int, ...]]]:
    """Borders of ranges of doc_id, descending, and the ranges that also need the documents of a doc_id (their first).

    The driver gets one row a range.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = ids.repartitionByRange(n, F.desc("doc_id")).groupBy(F.spark_partition_id().alias("r")).agg(F.max("doc_id").alias("top"))
    tops = sorted((r["top"] for r in parts.collect()), reverse=True)
    needed: dict[int, tuple[int, ...]] = {}
    for k, top in enumerate(tops):
        needed[top] = (*needed.get(top, ()), (k - 1) % len(tops))
    return tops, needed


def edited(docs: DataFrame, anchors: frozenset[bytes], floor: int = 3) -> DataFrame:
    """A row a document: its length, its fingerprint, those of its edited text, its likeness to that and to the next
    document, its set's size and its set. The edited text has its last ``1 / floor`` from the next document."""
    spark = docs.sparkSession
    tops, needed = _ranges(docs)
    starts = np.array(tops[::-1], np.int64)  # ascending
    shared = spark.sparkContext.broadcast(anchors)  # bounded, see SHARE

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document, packed, for its range and once more for each range that needs a copy; null ids are at the end."""
        from xxhash import xxh3_128_digest
        from zstandard import ZstdCompressor

        pack, last = ZstdCompressor(), max(len(starts) - 1, 0)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                to = (last - int(np.searchsorted(starts, doc_id)), *needed.get(doc_id, ())) if doc_id is not None else (last,) if len(starts) else (0, 0)
                rows += [(range_, k > 0, doc_id, xxh3_128_digest(raw), packed) for packed in [pack.compress(raw)] for k, range_ in enumerate(to)]
            kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["range", "copy", "doc_id", "tie", "packed"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = whole.mapInArrow(spread, "range int, copy boolean, doc_id long, tie binary, packed binary")
    ranged = dealt.repartitionById(max(len(tops), 1), F.col("range")).sortWithinPartitions("range", "copy", F.desc_nulls_last("doc_id"), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor()
        last = None  # the document that waits for its next one
        names = [x.split()[0] for x in ROW.split(", ")]
        for batch in batches:
            rows, sets = [], []
            for doc_id, packed, copy in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if copy and last is None:
                    continue
                text = unpack.decompress(packed).decode()
                own = signature_set(text, shared.value)
                if last is not None:
                    before, mine, signatures = last
                    cut = len(mine) // floor
                    changed = mine[: len(mine) - cut] + text[:cut]
                    other = signature_set(changed, shared.value)
                    rows.append((before, len(mine), hashlib.sha256(changed.encode()).hexdigest(), fingerprint(signatures), fingerprint(other), jaccard(signatures, other), jaccard(signatures, own), len(signatures)))
                    sets.append(signatures.view(np.int64))
                last = None if copy else (doc_id, text, own)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))))
            bits = np.array([parity_bitmap(s) for s in sets], np.int64).reshape(-1, len(BITMAP))
            yield pa.RecordBatch.from_arrays(columns + [pa.array(bits[:, i]) for i in range(len(BITMAP))], names)

    return ranged.select("doc_id", "packed", "copy").mapInArrow(run, ROW)


# --- near duplicates -------------------------------------------------------------------------------------------------
def length_borders(longest: int) -> list[int]:
    """The least length of each partition: a set and a longer one that is similar enough are in one or in neighbours."""
    num, den = LEAST
    out = [1]
    while out[-1] <= longest:
        out.append(out[-1] * den // num + 1)
    return out


def _may_link(a: str, b: str) -> Column:
    """Whether lengths and places (of a shared signature in both orders) allow the similarity."""
    num, den = LEAST
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    rest = 1 + F.least(n - F.col(f"{a}pos") - 1, m - F.col(f"{b}pos") - 1)
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & (rest * (num + den) >= num * (n + m))


def _may_be_equal(a: str, b: str) -> Column:
    """Whether the bitmaps allow the similarity: differing parities are as many as the symmetric difference at most."""
    num, den = LEAST
    apart = sum((F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in BITMAP), F.lit(0))
    return apart * (num + den) <= (den - num) * (F.col(f"{a}n") + F.col(f"{b}n"))


def _index(sets: DataFrame) -> DataFrame:
    """(list, guest, node, n, alone, pos): the prefixes of all sets, in lists by signature and partition: that of their length and, as guests, the next one."""
    num, den = LEAST
    entries = sets.select("node", F.explode("sigs").alias("sig"))
    shared = staged(entries.groupBy("sig").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    kept = join_hot(entries, shared.withColumn("k", F.col("df")), "sig", "k")
    # signatures of one set alone come first in its order, and meet nobody
    ordered = kept.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("own")).join(sets.select("node", "n"), "node")
    alone = F.col("n") - F.size("own")
    size = F.greatest(F.col("n") - F.ceil(F.col("n") * num / den) + 1 - alone, F.lit(0)).cast("int")
    longest = sets.agg(F.max("n")).first()[0] or 0
    borders = F.array(*[F.lit(b) for b in length_borders(longest)])
    part = F.size(F.filter(borders, lambda b: b <= F.col("n")))
    # what is exploded must not stand in the rows that come of it
    firsts = ordered.filter(size > 0).select("node", "n", alone.alias("alone"), part.alias("part"), F.slice("own", 1, size).alias("firsts"))
    prefix = firsts.select("node", "n", "alone", "part", F.posexplode("firsts").alias("at", "x"))
    roles = F.inline(F.array(*[F.struct((F.col("part") + i).alias("p"), F.lit(bool(i)).alias("guest")) for i in (0, 1)]))
    out = prefix.select("node", "n", "alone", (F.col("alone") + F.col("at")).alias("pos"), F.col("x.sig").alias("sig"), roles)
    out = staged(out.select(F.struct("sig", "p").alias("list"), "guest", "node", "n", "alone", "pos"), "prefixes")
    discard(shared)
    # lists of one member, or of guests alone, give no pair
    lists = staged(out.groupBy("list").agg(F.count("*").alias("k"), F.bool_and("guest").alias("none")).filter("k > 1 AND NOT none").drop("none"), "lists")
    index = staged(join_hot(out, lists, "list", "k"), "index")
    discard(out, lists)
    return index


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (written; u, v) whose whole sets are similar enough."""
    num, den = LEAST
    wanted = staged(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "wanted")
    own = staged(sets.join(wanted, "node").select("node", F.col("sigs").alias("text")), "own")
    with_sets, temporary = _spread(pairs, own)
    both = F.size(F.array_intersect("s", "t"))
    out = staged(with_sets.filter(den * both >= num * (F.size("s") + F.size("t") - both)).select("u", "v"), "links")
    discard(wanted, own, *temporary)
    return out


def _stars(members: DataFrame, centre_of: Column, met: Column) -> tuple[DataFrame, DataFrame]:
    """((u, v) of each list's centre and the members that it may link with, (list, node) of the centres). ``members``: written."""
    centres = staged(members.groupBy("list").agg(F.min(centre_of).alias("c"), F.count("*").alias("k")).filter("c IS NOT NULL"), "centres")
    beside = join_hot(members, centres, "list", "k").select("node", "n", "pos", "guest", "root", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("node", "n", "pos", "guest", "root")])
    pairs = beside.filter((F.col("node") != F.col("c_node")) & met & ~(F.col("guest") & F.col("c_guest")) & _may_link("", "c_"))
    out = staged(pairs.select(*_ordered("node", "c_node")).distinct(), "stars")
    gone = staged(centres.select("list", F.col("c.node").alias("node")), "gone")
    discard(centres)
    return out, gone


def _alike(sets: DataFrame, open_: DataFrame) -> DataFrame:
    """(u, v): members of lists with one member of equal least hashes; as many pairs as members and ``BANDS`` at most. No pair depends on it."""
    some = sets.join(open_.select("node").distinct(), "node", "left_semi").filter("n > 0")
    least = lambda i: F.array_min(F.transform("sigs", lambda x: F.xxhash64(F.lit(i), x)))
    keys = some.select("node", "n", F.array(*[F.xxhash64(F.lit(i), least(2 * i), least(2 * i + 1)) for i in range(BANDS)]).alias("keys"))
    members = staged(keys, "least-hashes")
    entries = members.select("node", "n", F.explode("keys").alias("key"))
    centres = staged(entries.groupBy("key").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", "key")).alias("c"), F.count("*").alias("k")).filter("k > 1"), "bucket-centres")
    num, den = LEAST
    beside = join_hot(entries, centres, "key", "k").select("node", "n", F.col("c.node").alias("c_node"), F.col("c.n").alias("c_n"))
    pairs = beside.filter((F.col("node") != F.col("c_node")) & (den * F.least("n", "c_n") >= num * F.greatest("n", "c_n")))
    out = staged(pairs.select(*_ordered("node", "c_node")).distinct(), "alike")
    discard(members, centres)
    return out


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def classes_of(sets: DataFrame) -> DataFrame:
    """(node, root): the component of each of ``sets`` (written; node, n, sigs, bitmap) under all similar pairs, by its least node."""
    open_ = _index(sets)
    met = _alike(sets, open_)  # pairs that are decided
    more = _verified(met, sets)
    roots = staged(sets.select("node", F.col("node").alias("root")), "nodes")
    for k in range(ROUNDS + 1):
        # what was linked before is in the roots
        before, roots = roots, merged(roots, more)
        placed = staged(open_.drop("root").join(roots, "node"), "placed")
        discard(open_, before, more)
        # only lists with members in several components are open
        sizes = placed.groupBy("list", "root").agg(F.count("*").alias("k"))
        mixed = sizes.groupBy("list").agg(F.max_by("root", F.struct("k", "root")).alias("most"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("inside"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
        mixed = staged(mixed, "mixed")
        pairs, members = mixed.agg(F.coalesce(F.sum(F.expr("(k * k - inside) / 2")), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
        open_ = staged(join_hot(placed, mixed.drop("inside"), "list", "k"), "open")
        discard(placed, mixed)
        if k == ROUNDS or pairs <= FEW_PAIRS * members:
            break
        # that of the fewest signatures of its own first; once there are components, one outside the largest
        centre = F.when(F.lit(k == 0) | (F.col("root") != F.col("most")), F.struct("alone", "n", "node", "pos", "guest", "root"))
        stars, gone = _stars(open_, centre, F.col("root") != F.col("c_root"))
        new = staged(stars.join(met, ["u", "v"], "left_anti"), "new")
        more = _verified(new, sets)
        rest = staged(open_.drop("most").join(gone, ["list", "node"], "left_anti"), "rest")
        later = staged(met.unionByName(new), "met")
        discard(open_, stars, gone, new, met)
        open_, met = rest, later
    before = F.lag("list.sig").over(Window.partitionBy("node", "list.p").orderBy("pos"))
    facts = staged(open_.withColumn("before", before).join(sets.select("node", *BITMAP), "node"), "facts")
    a, b = facts.filter(F.col("root") != F.col("most")).alias("a"), facts.alias("b")
    once = (F.col("b.root") == F.col("b.most")) | (F.col("a.node") < F.col("b.node"))
    # those that have the same list before this one have met there
    once &= F.col("a.before").isNull() | F.col("b.before").isNull() | (F.col("a.before") != F.col("b.before"))
    meet = (F.col("a.list") == F.col("b.list")) & (F.col("a.root") != F.col("b.root")) & once & ~(F.col("a.guest") & F.col("b.guest")) & _may_link("a.", "b.") & _may_be_equal("a.", "b.")
    last = staged(a.join(b, meet).select(*_ordered("a.node", "b.node")).distinct().join(met, ["u", "v"], "left_anti"), "last")
    discard(open_, facts, met)
    more = _verified(last, sets)
    out = merged(roots, more)
    discard(last, more, roots)
    return out


def near_duplicates(rows: DataFrame, made: Callable[[], None] | None = None) -> DataFrame:
    """:func:`_classes`, whose many small steps leave no shuffle files behind them."""
    with settings(rows.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        return _classes(rows, made)


def _classes(rows: DataFrame, made: Callable[[], None] | None) -> DataFrame:
    """(fingerprint, class_id, k) of each fingerprint of ``rows`` (doc_id, fingerprint, n, sigs) and its number of rows; the
    class is named by its least doc_id. ``made`` is called when ``rows`` are no longer needed."""
    sets = rows.groupBy("fingerprint").agg(F.first("n").alias("n"), F.first("sigs").alias("sigs"), *[F.first(b).alias(b) for b in BITMAP], F.min("doc_id").alias("doc_id"), F.count("*").alias("k"))
    sets = staged(sets.withColumn("node", F.monotonically_increasing_id()), "sets")  # written, so that numbers stay
    if made:
        made()
    found = classes_of(sets.select("node", "n", "sigs", *BITMAP))
    rooted = staged(sets.select("node", "fingerprint", "doc_id", "k").join(found, "node"), "rooted")
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    out = staged(rooted.join(names, "root").select("fingerprint", "class_id", "k"), "classes")
    discard(sets, found, rooted)
    return out


def op11_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = staged(edited(docs, common_words(docs)), "edited")
    out = staged(rows.drop("n", "sigs", *BITMAP), "fingerprints")
    classes = near_duplicates(rows, lambda: discard(rows))
    return join_hot(out, classes, "fingerprint", "k").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id")
