"""The whole job for a sample: reads, element library and genome in, calls out."""

from __future__ import annotations

import logging
import platform
import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__, sinks
from ..counters import counted, counting
from ..functions.names import is_junction
from ..operators import align, calls, genotype, mates, pairs, reference, trim
from ..params import DEFAULT, Params
from ..sources import regions
from ..sources.fasta import Reference, read_reference
from ..sources.library import ReadLibrary
from ..sources.sam import genome_reads
from ..sources.text import read_repeatmasker
from ..staging import new_path, scratch, staged

log = logging.getLogger("hoptrace")


def provenance(spark: SparkSession, **inputs: str) -> dict[str, str]:
    """Versions and inputs of a run, also logged."""
    found = {"hoptrace": __version__, "spark": spark.version, "python": platform.python_version(), **{k: str(v) for k, v in inputs.items()}}
    for k, v in found.items():
        log.info("%s: %s", k, v)
    return found


@dataclass
class Trimmed:
    reads: DataFrame  # name, seq, qual, te_name, strand, junction_type, te_portion, direction
    repeat: DataFrame  # name, te_name, strand


def trim_step(reads: DataFrame, library: Reference, p: Params = DEFAULT) -> Trimmed:
    """Map reads to the element library, keep each one's best alignment, trim it. Mates are mapped apart."""
    if library.contigs.isEmpty():
        raise FileNotFoundError("the element library has no sequence")
    parts = []
    for direction in (1, 2):
        own = reads.filter(F.col("mate") == direction).select("id", "name", "seq", "qual")
        parts.append(align.align(own, library, k=11, w=5, secondary=4, tried=20, p=p).withColumn("direction", F.lit(direction)))
    mapped = staged(parts[0].unionByName(parts[1]), "te-alignments")
    best = trim.best_alignment(trim.element_alignments(mapped, ["direction"]), ["direction", "read_name"])
    kinds = {k: F.count_if(F.col("junction_type") == v) for k, v in (("five_prime", "5"), ("three_prime", "3"))}
    trimmed = counted(trim.trimmed_reads(best, p, ("direction",)), "trimmed", reads=F.count("*"), **kinds)
    repeat = staged(trim.read_repeat(trimmed, ["direction", "name"]), "read-repeat")
    return Trimmed(trimmed, repeat)


def align_step(reads: DataFrame, trimmed: Trimmed, genome: Reference, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(alignments of flanks and recovered mates, alignments of full junction reads), canonical columns.

    Of ``trimmed.reads`` the names, sequences, qualities and directions are used.
    """
    paired = not reads.filter(F.col("mate") == 2).isEmpty()
    own = trimmed.reads.select(F.xxhash64("direction", "name").alias("id"), "name", "seq", "qual")
    if paired:
        own = own.unionByName(mates.support_mates(trimmed.repeat, reads).select("id", "name", "seq", "qual"))
    flanks = staged(align.align(own, genome, k=13, w=6, p=p), "genome-alignments")
    full = mates.junction_fullreads(trimmed.repeat, reads).select("id", "name", "seq", "qual")
    return flanks, staged(align.align(full, genome, k=13, w=6, p=p), "full-alignments")


def call_step(flanks: DataFrame, repeat: DataFrame, genome: Reference, full: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    spans = None if full is None else genome_reads(full).select(F.col("name").alias("read_name"), "chrom", "gstart", "gend")
    tiles = calls.reference_tiles(genome, p)
    lone = F.count_if(F.col("tsd") == calls.TSD_SUPPORT)
    return counted(calls.find_insertions(genome_reads(flanks), repeat, spans, tiles, p), "insertions", calls=F.count("*"), by_junctions=F.count("*") - lone, by_support_only=lone)


def reference_step(flanks: DataFrame, repeat: DataFrame, elements: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Calls shared with the reference."""
    from ..operators.cluster import clusters, junctions

    rows = mates.te_family(junctions(staged(clusters(genome_reads(flanks), p), "clustered")), repeat)
    matched = counted(reference.match_reference(rows, elements, p), "matched", reads=F.count("*"))
    return counted(reference.shared_insertions(matched), "shared", calls=F.count("*"))


def genotype_step(found: DataFrame, reads: DataFrame, genome: Reference, p: Params = DEFAULT) -> DataFrame:
    paired = not reads.filter(F.col("mate") == 2).isEmpty()
    whole = pairs.align_pairs(reads, genome, p=p) if paired else align.align(reads.select("id", "name", "seq", "qual"), genome, k=15, w=10, p=p)
    spark = reads.sparkSession
    stored = regions.write_regions(whole, new_path(spark, "read-alignments"), p)
    near = regions.region_reads(spark, stored, found.select("chrom", F.col("end").alias("pos")))
    return counted(genotype.genotype(found, genome_reads(near), p), "genotypes", two_sided=F.count("*"))


def run_sample(
    spark: SparkSession, reads: ReadLibrary, te_library: str, genome: str, outdir: str, repeatmasker: str | None = None, with_genotype: bool = False, p: Params = DEFAULT, indexes: str | None = None,
) -> str:
    """Run every step for one sample and write its results; gives the path of the calls' GFF.

    What the steps stage is deleted at the end. Seed indexes are kept below ``indexes`` and taken from there by further
    samples; without it they serve the mappings of this run. The run's counters are ``counters.RUNS[sample]``.
    """
    with scratch(spark) as own, counting(reads.name):
        return _run_sample(spark, reads, te_library, genome, outdir, repeatmasker, with_genotype, p, indexes or own)


def _run_sample(spark: SparkSession, reads: ReadLibrary, te_library: str, genome: str, outdir: str, repeatmasker: str | None, with_genotype: bool, p: Params, indexes: str) -> str:
    began, s = time.monotonic(), reads.name
    provenance(spark, te_library=te_library, genome=genome, sample=s)
    library, contigs = (replace(read_reference(spark, path, p.tile), indexes=indexes) for path in (te_library, genome))
    rows = staged(reads.reads(spark), "reads")
    log.info("trimming reads of %s", s)
    trimmed = trim_step(rows, library, p)
    sinks.write_trimmed(trimmed.reads, outdir, s)
    sinks.write_read_repeat(trimmed.repeat, outdir, s)
    log.info("aligning flanks of %s", s)
    flanks, full = align_step(rows, trimmed, contigs, p)
    sinks.write_alignments(flanks, f"{outdir}/genome_aln/{s}.genome.parquet")
    sinks.write_alignments(full, f"{outdir}/genome_aln/{s}.fullreads.genome.parquet")
    log.info("calling insertions of %s", s)
    found = call_step(flanks, trimmed.repeat, contigs, full, p)
    if repeatmasker:
        elements = staged(read_repeatmasker(spark, repeatmasker), "elements")
        reference.existing_bed(elements).orderBy("ord").coalesce(1).sortWithinPartitions("ord").select("value").write.mode("overwrite").text(f"{outdir}/existingTE.bed")
        found = staged(reference.filter_reference_overlaps(found, elements, p), "novel")
        sinks.write_insertions(reference_step(flanks, trimmed.repeat, elements, p), f"{outdir}/results/{s}.all_ref_insert.gff", f"{outdir}/results/{s}.all_ref_insert.txt", s)
    gff = f"{outdir}/results/{s}.all_nonref_insert.gff"
    sinks.write_insertions(found, gff, f"{outdir}/results/{s}.all_nonref_insert.txt", s)
    if with_genotype:
        typed = genotype_step(found, rows, contigs, p)
        base = f"{outdir}/results/{s}.all_nonref_insert.characTErized"
        sinks.write_genotypes(typed, f"{base}.gff", f"{base}.txt", s)
    log.info("%s done in %.1f s: %s", s, time.monotonic() - began, gff)
    return gff


def run_samples(spark: SparkSession, libraries: Iterable[ReadLibrary], te_library: str, genome: str, outdir: str, at_once: int = 1, **kw) -> list[str | None]:
    """:func:`run_sample` for each library below its own folder; a sample that fails is logged and gives None."""
    libraries = list(libraries)
    names = [x.name for x in libraries]
    if len(set(names)) < len(names):
        raise ValueError("sample names must differ")

    def one(x: ReadLibrary) -> str | None:
        try:
            return run_sample(spark, x, te_library, genome, f"{outdir}/{x.name}", **kw)
        except Exception:
            log.exception("sample %s failed", x.name)
            return None

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        return list(pool.map(one, libraries))


__all__ = ["Trimmed", "align_step", "call_step", "genotype_step", "is_junction", "provenance", "reference_step", "run_sample", "run_samples", "trim_step"]
