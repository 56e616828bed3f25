"""One registered query per operator, over the whole derived relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as H
from ..functions.names import is_junction
from ..operators import align, calls, cluster, genotype, mates, reference, seeds, trim
from ..operators.rangejoin import overlapping
from ..params import DEFAULT
from ..sinks import gff_line
from ..sources.fasta import reference_of
from ..sources.sam import genome_reads, records
from ..sources.text import parse_insertions
from ..staging import settled, staged
from ..streaming import session_clusters as sessions
from .fixtures import Relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
c = F.col
CALL = ("chrom", "cluster_id", "start", "end", "te_name", "strand", "tsd", "left_junction", "right_junction")
COUNTED = (*CALL, "left_support", "right_support", "note")


def query(f: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
    return f


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: c(n).cast("long") for n in names})


def _known_elements(r: Relations) -> DataFrame:
    """Reads whose element is known, for lookups by name."""
    return trim.read_repeat(r.genome_aln.filter(c("nm") == 0), ["te_name"])


def _junctions(r: Relations) -> DataFrame:
    """Clustered junction reads, some of unknown element."""
    kept = is_junction(c("name"))  # other reads count for the clusters alone
    element = F.when(kept, F.when(c("nm") == 0, c("te_name")).otherwise(calls.NO_ELEMENT)).alias("te_name")
    named = r.genome_aln.select("chrom", F.when(kept, c("name")).alias("name"), "strand", "gstart", "gend", element)
    return staged(cluster.junctions(cluster.clusters(named)), "junctions")


def _found(r: Relations) -> DataFrame:
    return calls.find_insertions(r.genome_aln.drop("te_name"), _known_elements(r), r.fullreads)


# --- records and scalar rules ---------------------------------------------------------------------------------------
@query
def scan_alignments(r: Relations) -> DataFrame:
    flag = F.when(c("strand") == "-", 16).otherwise(0) + F.when((c("nm") == 1) & c("cigar").endswith("S"), 4).otherwise(0)
    line = F.concat_ws("\t", "name", flag.cast("string"), "chrom", c("gstart").cast("string"), F.lit("60"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.concat(F.lit("NM:i:"), c("nm").cast("string")))
    rows = genome_reads(records(r.genome_aln.select(line.alias("value"), F.lit(0).cast("long").alias("ordinal"))))
    return _longs(rows, "nm").select("chrom", "name", "strand", "gstart", "gend", "nm", "cigar")


@query
def reverse_complement(r: Relations) -> DataFrame:
    return r.te_aln.select("read_name", "ord", H.reverse_complement(c("seq")).alias("revcomp"))


@query
def boundary_score(r: Relations) -> DataFrame:
    return r.te_aln.select("read_name", "ord", H.boundary_score(c("qstart"), c("qend"), c("qlen"), c("tstart"), c("tend"), c("te_len")).cast("long").alias("score"))


@query
def cigar_sums(r: Relations) -> DataFrame:
    whole = F.concat(F.lit("4M2I"), (c("nm") + 1).cast("string"), F.lit("D"), "cigar")
    rows = r.genome_aln.select("name", "chrom", "gstart", whole.alias("cigar"), (c("nm") + 5).alias("nm"))
    counts = H.match_counts(c("cigar"), c("nm"))
    return rows.select("name", "chrom", "gstart", *[H.cigar_length(c("cigar"), op).alias(f"n_{op.lower()}") for op in "MID"], counts["match"].alias("match"), counts["mismatch"].alias("mismatch"))


@query
def strip_tag(r: Relations) -> DataFrame:
    names = r.genome_aln.select("name", "gstart").unionByName(r.repeat_rows.select("name", F.lit(0).cast("long").alias("gstart")))
    return names.select("name", "gstart", H.strip_tag(c("name")).alias("stripped"), H.strip_junction_tag(c("name")).alias("without_junction"))


@query
def split_mate(r: Relations) -> DataFrame:
    return r.genome_aln.select("name", "gstart", H.split_mate(c("name")).alias("m")).select("name", "gstart", "m.base", "m.mate")


@query
def junction_info(r: Relations) -> DataFrame:
    rows = r.genome_aln.select("name", "strand", "gstart", H.junction_info(c("name"), c("strand"), c("gstart"), c("gend")).alias("j"))
    return rows.select("name", "strand", "gstart", "j.side", "j.position", "j.te_end")


@query
def te_orientation(r: Relations) -> DataFrame:
    rows = cluster.junctions(r.genome_aln)
    return rows.select("name", "gstart", "side", "te_end", H.te_orientation(c("side"), c("te_end")).alias("orientation"))


@query
def tsd_rule(r: Relations) -> DataFrame:
    pairs = calls.pair_breakpoints(_junctions(r)).withColumn("i", H.tsd_interval(c("left_pos"), c("right_pos")))
    return pairs.select("chrom", "cluster_id", "left_pos", "right_pos", "i.start", "i.end", "i.known")


@query
def fetch_tsd(r: Relations) -> DataFrame:
    start = c("doc_id") % 60
    sites = r.genome.select(F.concat(F.lit("c"), c("doc_id").cast("string")).alias("chrom"), start.alias("start"), (start + c("doc_id") % 20).alias("end"), F.lit(".").alias("tsd"))
    tiles = calls.genome_tiles(r.genome.select(F.concat(F.lit("c"), c("doc_id").cast("string")).alias("chrom"), "seq"))
    return calls.fetch_tsd(sites, tiles)


@query
def classify_status(r: Relations) -> DataFrame:
    rows = r.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", H.avg_flankers(c("l_linenumber").cast("long") * 3, c("l_quantity").cast("long")).alias("flankers"), (c("l_suppkey") % 60).alias("spanners"))
    return rows.withColumn("status", H.classify_status(c("flankers"), c("spanners")))


# --- reads and elements -----------------------------------------------------------------------------------------------
@query
def best_te_alignment(r: Relations) -> DataFrame:
    return _longs(trim.best_alignment(r.te_aln, ["read_name"]), "boundary", "match").select("read_name", "ord", "boundary", "match", "te_name")


@query
def qlen_carry(r: Relations) -> DataFrame:
    rows = r.te_aln.select("te_name", "ord", "read_name", F.when(c("mismatch") == 1, 0).otherwise(c("te_len") + c("tstart")).alias("qlen"))
    return _longs(trim.carry_query_length(rows, ["te_name"], ["ord", "read_name"]), "carried").select("te_name", "ord", "read_name", "carried")


@query
def trim_classify(r: Relations) -> DataFrame:
    rows = r.te_aln.withColumn("qual", F.lit(""))
    return trim.trimmed_reads(rows, replace(DEFAULT, mismatch_allowance=1), ("ord",)).select("name", "ord", "seq", "te_name", "strand", "junction_type", "te_portion")


@query
def flank_counts(r: Relations) -> DataFrame:
    rows = trim.trimmed_reads(r.te_aln.withColumn("qual", F.lit("")), replace(DEFAULT, mismatch_allowance=1))
    return trim.flank_counts(rows, ["te_name", "junction_type", "strand"])


@query
def read_repeat_dedup(r: Relations) -> DataFrame:
    return trim.read_repeat(r.repeat_rows, ["ord", "te_name", "strand"])


@query
def te_family_lookup(r: Relations) -> DataFrame:
    rows = cluster.junctions(r.genome_aln).select("name", "gstart")
    return mates.te_family(rows, _known_elements(r)).select("name", "gstart", "te_name")


@query
def recover_support_mates(r: Relations) -> DataFrame:
    return mates.support_mates(r.repeat_rows, r.reads).select("name", "seq")


@query
def collect_fullreads(r: Relations) -> DataFrame:
    return mates.junction_fullreads(r.repeat_rows, r.reads).select("name", "seq")


# --- clusters and calls -----------------------------------------------------------------------------------------------
@query
def cluster_reads(r: Relations) -> DataFrame:
    return cluster.clusters(r.genome_aln).select("chrom", "name", "gstart", "gend", "cluster_id")


@query
def session_clusters(r: Relations) -> DataFrame:
    return sessions(r.genome_aln)


@query
def breakpoint_counts(r: Relations) -> DataFrame:
    return calls.breakpoint_counts(_junctions(r))


@query
def pair_breakpoints(r: Relations) -> DataFrame:
    return calls.pair_breakpoints(_junctions(r))


@query
def te_family_mode(r: Relations) -> DataFrame:
    return _junctions(r).groupBy("chrom", "cluster_id").agg(calls.family_mode(c("te_name")).alias("te_name"))


@query
def strand_vote(r: Relations) -> DataFrame:
    return _junctions(r).groupBy("chrom", "cluster_id", "position").agg(calls.strand_vote(c("side"), c("te_end")).alias("strand"))


@query
def call_insertions(r: Relations) -> DataFrame:
    return calls.call_insertions(_junctions(r)).select(*CALL)


@query
def count_support(r: Relations) -> DataFrame:
    grouped = staged(cluster.clusters(r.genome_aln), "clustered")
    called = staged(calls.call_insertions(staged(cluster.junctions(grouped), "junctions")), "calls")
    return calls.count_support(called, cluster.support(grouped)).select("chrom", "cluster_id", "start", "end", "left_junction", "right_junction", "left_support", "right_support")


@query
def support_only_calls(r: Relations) -> DataFrame:
    return calls.support_only_calls(cluster.support(cluster.clusters(r.genome_aln))).select("chrom", "cluster_id", "start", "end", "te_name", "strand", "tsd", "left_support", "right_support")


@query
def required_junction_filter(r: Relations) -> DataFrame:
    return calls.required_junctions(calls.call_insertions(_junctions(r)), replace(DEFAULT, required_junction_reads=4)).select(*CALL)


@query
def false_junction(r: Relations) -> DataFrame:
    def false() -> DataFrame:
        reads = _junctions(r)
        return calls.false_junctions(staged(calls.call_insertions(reads), "calls"), reads, r.fullreads)

    return settled(r.spark, false, "false").select("chrom", "cluster_id", "start", "end", "te_name", "strand")


@query
def find_insertions(r: Relations) -> DataFrame:
    return _found(r).select(*COUNTED)


# --- reference elements and genotypes ---------------------------------------------------------------------------------
@query
def parse_repeatmasker(r: Relations) -> DataFrame:
    plus = c("strand") == "+"
    line = F.concat_ws(
        " ", F.lit("  239  1.2 0.0 0.0 "), "chrom", c("te_start").cast("string"), c("te_end").cast("string"), F.lit("(99)"), F.when(plus, "+").otherwise("C"), "te_name", F.lit("DNA/x"),
        F.when(plus, F.when(c("intact"), "1").otherwise("7")).otherwise(F.when(c("intact"), "(0)").otherwise("(5)")), F.lit("40"),
        F.when(plus, F.when(c("te_end") % 3 == 0, "(4)").otherwise("(0)")).otherwise(F.when(c("te_end") % 3 == 0, "2").otherwise("1")), c("ord").cast("string"),
    )
    return reference.parse_repeatmasker(r.ref_te.select(line.alias("value"), "ord"))


@query
def reference_match(r: Relations) -> DataFrame:
    return reference.match_reference(_junctions(r), r.ref_te).select("chrom", "cluster_id", "name", "gstart", "position", "ref_te_name", "ref_te_start", "ref_te_end", "ref_ord")


@query
def shared_insertions(r: Relations) -> DataFrame:
    return reference.shared_insertions(reference.match_reference(_junctions(r), r.ref_te)).select(*CALL, "note")


@query
def filter_reference_overlaps(r: Relations) -> DataFrame:
    return reference.filter_reference_overlaps(_found(r), r.ref_te).select(*COUNTED)


@query
def window_overlap(r: Relations) -> DataFrame:
    """Reads within ten bases of an element of any name."""
    reads = r.genome_aln.select("chrom", "name", c("gstart").alias("start"), c("gend").alias("end"))
    known = r.ref_te.select("chrom", c("te_start").alias("start"), c("te_end").alias("end"))
    return overlapping(reads, known, ["chrom"], 10, DEFAULT.range_bin, "left_semi").select("chrom", "name", "start", "end")


@query
def count_spanners(r: Relations) -> DataFrame:
    return genotype.count_spanners(r.ref_te.select("chrom", c("te_start").alias("pos")), r.genome_aln)


@query
def genotype_calls(r: Relations) -> DataFrame:
    return genotype.genotype(_found(r), r.genome_aln).select(*CALL, "avg_flankers", "spanners", "status")


@query
def gff_roundtrip(r: Relations) -> DataFrame:
    return parse_insertions(_found(r).select(gff_line("sample").alias("value")))


@query
def evaluate_calls(r: Relations) -> DataFrame:
    truth = r.ref_te.select("chrom", c("te_start").alias("start"), (c("te_start") + 1).alias("end"))
    return genotype.evaluate(_found(r), truth)


@query
def seed_join(r: Relations) -> DataFrame:
    """Library passages that stand verbatim in texts."""
    found = align.verbatim(r.documents.select(c("doc_id").alias("read_id"), c("text").alias("seq")), r.benchmark.select(c("item_id").alias("ref_id"), c("text").alias("seq")))
    return found.select(c("read_id").alias("doc_id"), c("ref_id").alias("item_id"))


@query
def seed_candidates(r: Relations) -> DataFrame:
    """The diagonal with most votes of a stretch of each text's letters, every other one reversed, among all texts' letters."""
    stretch = F.substr("seq", (1 + c("doc_id") % 40).cast("int"), F.lit(100))
    reads = r.genome.select(c("doc_id").alias("id"), F.when(c("doc_id") % 2 == 0, stretch).otherwise(H.reverse_complement(stretch)).alias("seq"))
    library = r.genome.select(F.concat(F.lit("d"), c("doc_id").cast("string")).alias("ref_name"), F.lit(0).cast("long").alias("offset"), "seq")
    return align.seed_candidates(reads, library, k=13, step=3, most_seed_hits=20, least_seeds=2, keep=1)


@query
def minimizers(r: Relations) -> DataFrame:
    """The seeds of all texts' letters, read in tiles, for the usual k-mers and windows of genome mapping."""
    library = r.genome.select(c("doc_id").cast("int").alias("ref_index"), c("doc_id").cast("string").alias("ref_name"), F.length("seq").alias("ref_length"), "seq")
    return seeds.computed_seeds(reference_of(library, 1024), k=13, w=6).select(c("ref_index").cast("long").alias("doc_id"), c("at").alias("place"), "seed", "reverse")


QUERIES["genotype"] = QUERIES.pop("genotype_calls")
