"""Insertion calls from clustered reads: pairing, votes, support, filters and target-site duplications."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..counters import counted
from ..functions import strip_junction_tag, te_orientation, tsd_interval, tsd_text
from ..functions.names import is_junction
from ..params import DEFAULT, Params
from ..sources.fasta import Reference, cut
from ..staging import discard, settled, staged
from .cluster import clusters, junctions, support
from .islands import pair_long_islands
from .mates import te_family

# Texts of calls.
NOTE_NONREF = "Non-reference, not found in reference"
NOTE_SUPPORT = "Non-reference, supporting reads only"
NOTE_SHARED = "Shared, found in reference"
TSD_UNKNOWN, TSD_SUPPORT, TSD_SHARED, NO_ELEMENT = "UNK", "supporting_reads", "shared", "NA"

CLUSTER = ("chrom", "cluster_id")
#: Columns of a call, for all operators that give calls.
CALL = ("chrom", "cluster_id", "start", "end", "te_name", "strand", "tsd", "left_junction", "right_junction", "left_support", "right_support", "note")


def breakpoint_counts(junction_reads: DataFrame, keys: tuple[str, ...] = CLUSTER) -> DataFrame:
    return junction_reads.groupBy(*keys, "side", "position").agg(F.count("*").alias("n_reads"))


def _pairs(events: Column, window: int) -> Column:
    """Array of (left, right): each left, ascending, takes the nearest right that is left over, the smaller of two; null where none is near.

    ``events``: (at, is_left, place), sorted; a right comes up ``window`` before its place, a left at its own. So a left
    finds all rights near it among those open, and rights too far behind it are closed: never more than two windows' places are open.
    """
    pair = lambda l, r: F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))
    none = F.lit(None).cast("long")
    start = F.struct(F.array().cast("array<bigint>").alias("open"), F.array().cast("array<struct<l:bigint,r:bigint>>").alias("out"))
    lone = lambda rights: F.transform(rights, lambda r: pair(none, r))

    def step(acc: Column, e: Column) -> Column:
        left = e["place"]
        gone = F.filter(acc["open"], lambda r: r < left - window)
        near = F.filter(acc["open"], lambda r: r >= left - window)
        took = F.array_min(F.transform(near, lambda r: F.struct(F.abs(r - left).alias("d"), r.alias("r"))))["r"]
        done = F.struct(F.when(took.isNull(), near).otherwise(F.array_remove(near, took)).alias("open"), F.concat(acc["out"], lone(gone), F.array(pair(left, took))).alias("out"))
        return F.when(e["is_left"] == 1, done).otherwise(F.struct(F.concat(acc["open"], F.array(e["place"])).alias("open"), acc["out"].alias("out")))

    return F.aggregate(events, start, step, lambda acc: F.concat(acc["out"], lone(acc["open"])))


def pair_breakpoints(junction_reads: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = CLUSTER) -> DataFrame:
    """(keys, left_pos, right_pos): the greedy pairing of a cluster's breakpoints.

    Nothing pairs over a gap of more than ``pair_window``, so distinct positions are first cut into islands at such
    gaps, and each island is paired by itself; a cluster may span a contig. Islands of more than ``long_island`` positions
    are paired over bins, with the same result.
    """
    return settled(junction_reads.sparkSession, lambda: _paired(junction_reads, p, keys), "pairs")


def _paired(junction_reads: DataFrame, p: Params, keys: tuple[str, ...]) -> DataFrame:
    places = junction_reads.select(*keys, "side", F.col("position").cast("long").alias("gstart"), F.col("position").cast("long").alias("gend")).distinct()
    places = staged(places, "places")
    islands = clusters(places, replace(p, range_allowance=p.pair_window), keys, "_island")
    at = F.when(F.col("side") == "left", F.col("gstart")).otherwise(F.col("gstart") - p.pair_window)
    event = F.struct(at.alias("at"), (F.col("side") == "left").cast("int").alias("is_left"), F.col("gstart").alias("place"))
    islands = staged(islands.select(*keys, "_island", F.inline(F.array(event))), "islands")
    discard(places)
    own = [*keys, "_island"]
    long = staged(islands.groupBy(*own).agg(F.count("*").alias("_n")).filter(F.col("_n") > p.long_island).select(*own, F.to_json(F.struct(*own)).alias("island")), "long-islands")
    sides = islands.join(long.select(*own), own, "left_anti").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("at", "is_left", "place"))).alias("events"))
    pairs = sides.select(*keys, F.inline(_pairs(F.col("events"), p.pair_window)))
    if not long.isEmpty():
        far = pair_long_islands(islands.join(long, own).select("island", "at", "is_left", "place"), p.pair_window, p.island_bin)
        pairs = pairs.unionByName(far.join(long, "island").select(*keys, "l", "r"))
    return pairs.select(*keys, F.col("l").alias("left_pos"), F.col("r").alias("right_pos"))


def family_mode(te_name: Column) -> Column:
    """The most frequent element, ``NA`` apart; of several the first by name."""
    return F.coalesce(F.mode(F.when(te_name != NO_ELEMENT, te_name), deterministic=True), F.lit(NO_ELEMENT))


def strand_vote(side: Column, te_end: Column) -> Column:
    """Majority of the junctions' orientations, forward if even."""
    forward = F.sum(F.when(te_orientation(side, te_end) == "+", 1).otherwise(-1))
    return F.when(forward >= 0, "+").otherwise("-")


def call_insertions(junction_reads: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = CLUSTER) -> DataFrame:
    """One call per breakpoint pair, with its two positions; its support is not counted yet, and its duplication's bases not fetched (dots)."""
    pairs = pair_breakpoints(junction_reads, p, keys)
    ends = pairs.select(*keys, "left_pos", "right_pos", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left_pos").alias("position")), F.struct(F.lit("right").alias("side"), F.col("right_pos").alias("position")))).alias("e"))
    ends = ends.select(*keys, "left_pos", "right_pos", "e.side", "e.position").filter(F.col("position").isNotNull())
    reads = junction_reads.select(*keys, "side", F.col("position").cast("long").alias("position"), "te_name", "te_end").join(ends, [*keys, "side", "position"])
    called = reads.groupBy(*keys, "left_pos", "right_pos").agg(
        F.count_if(F.col("side") == "left").alias("left_junction"), F.count_if(F.col("side") == "right").alias("right_junction"),
        family_mode(F.col("te_name")).alias("te_name"), strand_vote(F.col("side"), F.col("te_end")).alias("strand"),
    )
    called = called.withColumn("_i", tsd_interval(F.col("left_pos"), F.col("right_pos"), p))
    start, end = F.col("_i.start"), F.col("_i.end")
    tsd = F.when(F.col("_i.known"), F.repeat(F.lit("."), (end - start + 1).cast("int"))).otherwise(TSD_UNKNOWN)
    zero = F.lit(0).cast("long")
    return called.select(
        *keys, start.alias("start"), end.alias("end"), "te_name", "strand", tsd.alias("tsd"), "left_junction", "right_junction",
        zero.alias("left_support"), zero.alias("right_support"), F.lit(NOTE_NONREF).alias("note"), "left_pos", "right_pos",
    )


def count_support(calls: DataFrame, support_reads: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = CLUSTER) -> DataFrame:
    """Supporting reads of a call's cluster: forward ones that end at or before its start, reverse ones that start at or behind its end.

    Reads and calls are merged along the cluster and summed in one run each way, so they are never paired. The runs are
    cut into bins, over which the sums are carried, as a cluster may span a contig.
    """
    borders = calls.select(*keys, "start", "end").distinct()

    def along(strand: str, at: str, border: str, ascending: bool) -> DataFrame:
        reads = support_reads.filter(F.col("strand") == strand).select(*keys, F.col(at).cast("long").alias("p"), F.lit(0).alias("call"), F.lit(1).alias("w"))
        ends = borders.select(*keys, F.col(border).cast("long").alias("p")).distinct().select(*keys, "p", F.lit(1).alias("call"), F.lit(0).alias("w"))
        # equal positions count once with their number, so that a run has a row a place
        both = reads.groupBy(*keys, "p", "call").agg(F.sum("w").alias("w")).unionByName(ends).withColumn("_bin", F.floor(F.col("p") / p.cluster_bin))
        way = lambda c: F.col(c) if ascending else F.desc(c)
        earlier = Window.partitionBy(*keys).orderBy(way("_bin")).rowsBetween(Window.unboundedPreceding, -1)
        before = both.groupBy(*keys, "_bin").agg(F.sum("w").alias("_sum")).select(*keys, "_bin", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
        run = Window.partitionBy(*keys, "_bin").orderBy(way("p"), "call").rowsBetween(Window.unboundedPreceding, 0)
        summed = both.join(before, [*keys, "_bin"]).withColumn("n", F.col("_before") + F.sum("w").over(run))
        return summed.filter(F.col("call") == 1).select(*keys, F.col("p").alias(border), "n")

    left, right = along("+", "gend", "start", True).withColumnRenamed("n", "_l"), along("-", "gstart", "end", False).withColumnRenamed("n", "_r")
    counted = calls.join(left, [*keys, "start"], "left").join(right, [*keys, "end"], "left")
    return counted.withColumns({"left_support": F.coalesce("_l", F.lit(0)).cast("long"), "right_support": F.coalesce("_r", F.lit(0)).cast("long")}).select(*calls.columns)


def support_only_calls(support_reads: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = CLUSTER) -> DataFrame:
    """A call per cluster whose forward and reverse supporting reads bracket a place."""
    ahead, behind = F.col("strand") == "+", F.col("strand") == "-"
    sides = support_reads.groupBy(*keys).agg(
        F.max(F.when(ahead, F.col("gend"))).cast("long").alias("start"), F.min(F.when(behind, F.col("gstart"))).cast("long").alias("end"),
        F.count_if(ahead).alias("left_support"), F.count_if(behind).alias("right_support"),
    )
    good = sides.filter((F.col("left_support") >= p.min_support_only) & (F.col("right_support") >= p.min_support_only) & (F.col("start") <= F.col("end")))
    zero = F.lit(0).cast("long")
    return good.select(
        *keys, "start", "end", F.lit(NO_ELEMENT).alias("te_name"), F.lit("+").alias("strand"), F.lit(TSD_SUPPORT).alias("tsd"), zero.alias("left_junction"), zero.alias("right_junction"),
        "left_support", "right_support", F.lit(NOTE_SUPPORT).alias("note"),
    )


def required_junctions(calls: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return calls.filter((F.col("left_junction") >= p.required_junction_reads) | (F.col("right_junction") >= p.required_junction_reads))


def false_junctions(calls: DataFrame, junction_reads: DataFrame, fullreads: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = CLUSTER) -> DataFrame:
    """Calls of whose reads at least ``false_fraction`` on both sides map through the breakpoint untrimmed.

    ``calls`` have the positions of their pair. ``junction_reads``: keys, side, position, name. ``fullreads``: read_name,
    chrom, gstart, gend. Left reads are probed at the call's end, right ones at its start. Reads meet their call by its
    breakpoints and their full alignments by name, one row each; no call gathers its reads. Only reads of two-sided calls
    meet their alignments, and what is counted then is summed before it is shuffled.
    """
    own = [k for k in keys if k != "cluster_id"]
    ids, place = [*keys, "start", "end", "te_name", "strand"], [*keys, "side", "position"]
    side = lambda s, at, bp: F.struct(F.lit(s).alias("side"), F.col(at).alias("position"), F.col(bp).alias("bp"))
    two_sided = calls.filter(F.col("left_pos").isNotNull() & F.col("right_pos").isNotNull())
    ends = two_sided.select(*keys, F.inline(F.array(side("left", "left_pos", "end"), side("right", "right_pos", "start")))).distinct()
    reads = junction_reads.select(*keys, "side", F.col("position").cast("long").alias("position"), strip_junction_tag(F.col("name")).alias("read_name"))
    probes = reads.join(ends, place)
    spans = fullreads.select(*[F.col(k).alias(f"_{k}") for k in own], F.col("read_name").alias("_name"), F.col("gstart").alias("s"), F.col("gend").alias("e"))
    through = (F.col("read_name") == F.col("_name")) & (F.col("s") <= F.col("bp") - p.fullread_extend) & (F.col("e") >= F.col("bp") + p.fullread_extend)
    for k in own:
        through = through & (F.col(k) == F.col(f"_{k}"))
    hits = probes.join(spans, through, "left_semi").groupBy(*place, "bp").agg(F.count("*").alias("h"))
    judged = hits.join(reads.groupBy(*place).agg(F.count("*").alias("n")), place).filter(F.col("h") >= p.false_fraction * F.col("n"))
    judged = staged(judged.select(*place, "bp"), "judged")
    for s, at, bp in (("left", "left_pos", "end"), ("right", "right_pos", "start")):
        bad = judged.filter(F.col("side") == s).select(*keys, F.col("position").alias(at), F.col("bp").alias(bp))
        two_sided = two_sided.join(bad, [*keys, at, bp], "left_semi")
    return two_sided.select(*ids)


def genome_tiles(genome: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(chrom, tile, offset, seq): overlapping parts of the contigs in ``genome`` (chrom, seq), for lookups of short stretches.

    Each contig is walked once. Contigs that are lines of a file come from :func:`reference_tiles`, without such rows.
    """
    parts = cut(F.col("seq"), p.tile)
    ahead = -(-p.tile_overlap // p.tile)
    with_next = F.transform(parts, lambda x, i: F.concat(x, F.substr(F.array_join(F.slice(parts, i + 2, ahead), ""), F.lit(1), F.lit(p.tile_overlap))))
    rows = genome.select("chrom", F.posexplode(with_next).alias("tile", "seq"))
    return rows.select("chrom", F.col("tile").cast("long").alias("tile"), (F.col("tile") * p.tile).cast("long").alias("offset"), "seq")


def reference_tiles(genome: Reference, p: Params = DEFAULT) -> DataFrame:
    """The same of a :class:`Reference`, whose tiles must be of ``p.tile`` bases."""
    if genome.tile != p.tile:
        raise ValueError(f"tiles of {genome.tile} bases where {p.tile} are looked up")
    names = genome.contigs.select("ref_index", F.col("ref_name").alias("chrom"))
    return genome.overlapping(p.tile_overlap).join(names, "ref_index").select("chrom", "tile", "offset", "seq")


def fetch_tsd(calls: DataFrame, tiles: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Calls of known duplication with its bases from the genome; other calls are unchanged."""
    known = calls.withColumn("_tile", F.floor((F.col("start") - 1) / p.tile)).withColumn("_known", F.col("tsd").rlike("^[.]+$"))
    part = tiles.select(F.col("chrom").alias("_chrom"), F.col("tile").alias("_t"), "offset", F.col("seq").alias("_seq"))
    found = known.join(part, (F.col("chrom") == F.col("_chrom")) & (F.col("_tile") == F.col("_t")), "left")
    text = tsd_text(F.col("_seq"), F.col("start"), F.col("end"), F.coalesce("offset", F.lit(0)))
    return found.withColumn("tsd", F.when(F.col("_known"), text).otherwise(F.col("tsd"))).select(*calls.columns)


def find_insertions(
    reads: DataFrame, repeat: DataFrame | None = None, fullreads: DataFrame | None = None, tiles: DataFrame | None = None,
    p: Params = DEFAULT, include_support_only: bool = True, keys: tuple[str, ...] = ("chrom",),
) -> DataFrame:
    """All calls on mapped reads (keys, name, strand, gstart, gend).

    Clusters left without a junction call, whether they had none or lost it to a filter, may give a call from support.
    """
    return settled(reads.sparkSession, lambda: _found(reads, repeat, fullreads, tiles, p, include_support_only, keys), "insertions")


def _found(reads: DataFrame, repeat: DataFrame | None, fullreads: DataFrame | None, tiles: DataFrame | None, p: Params, include_support_only: bool, keys: tuple[str, ...]) -> DataFrame:
    """Columns that no later step reads are left behind at once, and tables are deleted once all their readers are written."""
    cluster = (*keys, "cluster_id")
    name = F.when(is_junction(F.col("name")), F.col("name")).alias("name")  # those of other reads are not looked up
    narrow = reads.select(*keys, name, "strand", "gstart", "gend", *(["te_name"] if repeat is None else []))
    grouped = staged(clusters(narrow, p, keys), "clustered")
    sustained = staged(support(grouped).select(*cluster, "strand", "gstart", "gend"), "support")
    junction_reads = junctions(grouped).select(*cluster, "name", "side", "position", "te_end", *(["te_name"] if repeat is None else []))
    if repeat is not None:
        junction_reads = te_family(junction_reads, repeat.filter(is_junction(F.col("name"))), (*[k for k in keys if k != "chrom"], "name"))
    junction_reads = staged(junction_reads, "junctions")
    discard(grouped)
    called = counted(required_junctions(call_insertions(junction_reads, p, cluster), p), "junction-calls", calls=F.count("*"))
    if fullreads is not None:
        false = counted(false_junctions(called, junction_reads, fullreads, p, cluster), "false-junctions", calls=F.count("*"))
        discard(junction_reads)
        called = counted(called.join(false, [*cluster, "start", "end", "te_name", "strand"], "left_anti"), "true-calls", calls=F.count("*"))
    called = count_support(called.drop("left_pos", "right_pos"), sustained, p, cluster)
    if tiles is not None:
        called = fetch_tsd(called, tiles, p)
    called = staged(called, "supported")
    if include_support_only:
        lone = sustained.join(called.select(*cluster).distinct(), list(cluster), "left_anti")
        called = called.unionByName(support_only_calls(lone, p, cluster))
    return called


def in_order(calls: DataFrame) -> DataFrame:
    return calls.orderBy("chrom", "start", "end", "te_name", "tsd")
