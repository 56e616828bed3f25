"""Command line: the steps one by one, and the whole job."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import replace

from . import __version__
from .params import DEFAULT, Params

log = logging.getLogger("hoptrace")

# The names of commands and options below are those of the job's usual command line.


def _reads(p: argparse.ArgumentParser) -> None:
    p.add_argument("-l", "--left", "--r1", required=True, help="FASTQ file of first mates, or of single reads")
    p.add_argument("-r", "--right", "--r2", help="FASTQ file of second mates")


def _common(p: argparse.ArgumentParser) -> None:
    p.add_argument("-o", "--outdir", required=True, help="folder for results")
    p.add_argument("--sample", default="sample", help="name of the sample")


def _threads(p: argparse.ArgumentParser) -> None:
    p.add_argument("-c", "--threads", type=int, help="cores to use where no Spark master is given")


def _trimming(p: argparse.ArgumentParser) -> None:
    p.add_argument("--len-cut-match", type=int, default=DEFAULT.len_cut_match, help="least aligned bases in the element")
    p.add_argument("--len-cut-trim", type=int, default=DEFAULT.len_cut_trim, help="least bases of a flank")
    p.add_argument("--mismatch", type=int, default=DEFAULT.mismatch_allowance, help="most mismatches in the element")


def build_parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="hoptrace", description="Find mobile-element insertions in short reads.", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    top.add_argument("-v", "--verbose", action="store_true", help="log more")
    top.add_argument("-V", "--version", action="version", version=f"hoptrace {__version__}")
    top.add_argument("--master", help="Spark master; by default what the session is started with, or local[*]")
    sub = top.add_subparsers(dest="command")
    add = lambda name, text: sub.add_parser(name, help=text, formatter_class=argparse.ArgumentDefaultsHelpFormatter)

    p = add("trim", "map reads to the element library and trim them")
    _reads(p), _common(p), _trimming(p), _threads(p)
    p.add_argument("-t", "--te", required=True, help="FASTA of elements")
    p.set_defaults(run=_trim)

    p = add("align-genome", "map flanks and recovered mates to the genome")
    _reads(p), _common(p), _threads(p)
    p.add_argument("-g", "--genome", required=True, help="FASTA of the genome")
    p.set_defaults(run=_align)

    p = add("find-insertions", "call insertions that the genome does not have")
    _common(p)
    p.add_argument("-b", "--bam", required=True, help="alignments of flanks and mates (BAM, SAM or Parquet)")
    p.add_argument("-g", "--genome", required=True, help="FASTA of the genome")
    p.add_argument("--fullreads-bam", help="alignments of full junction reads (BAM, SAM or Parquet)")
    p.add_argument("--read-repeat", required=True, help="read-repeat table")
    p.add_argument("--required-junction-reads", type=int, default=DEFAULT.required_junction_reads, help="least junction reads on a side")
    p.set_defaults(run=_find)

    p = add("find-reference", "call insertions that the genome has too")
    _common(p)
    p.add_argument("-b", "--bam", required=True, help="alignments of flanks and mates (BAM, SAM or Parquet)")
    p.add_argument("--repeatmasker", required=True, help="RepeatMasker .out file of the genome")
    p.add_argument("--read-repeat", required=True, help="read-repeat table")
    p.set_defaults(run=_reference)

    p = add("characterize", "genotype called insertions")
    _common(p)
    p.add_argument("-i", "--insertions", required=True, help="GFF of calls")
    p.add_argument("-b", "--reads-bam", required=True, help="alignments of all reads (BAM, SAM or Parquet)")
    p.set_defaults(run=_characterize)

    p = add("run", "all steps")
    _reads(p), _common(p), _trimming(p), _threads(p)
    p.add_argument("-t", "--te", required=True, help="FASTA of elements")
    p.add_argument("-g", "--genome", required=True, help="FASTA of the genome")
    p.add_argument("--repeatmasker", help="RepeatMasker .out file of the genome")
    p.add_argument("--genotype", action="store_true", help="genotype the calls")
    p.add_argument("--index-dir", help="folder where seed indexes are kept for further samples")
    p.set_defaults(run=_run)
    return top


def _spark(args):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.appName("hoptrace").config("spark.sql.session.timeZone", "UTC")
    threads = getattr(args, "threads", None)
    master = args.master or (f"local[{threads}]" if threads else None)
    return (b.master(master) if master else b).getOrCreate()


def _library(args):
    from .sources.library import ReadLibrary

    return ReadLibrary(tuple(x for x in (args.left, args.right) if x), args.sample)


def _params(args) -> Params:
    return replace(DEFAULT, len_cut_match=args.len_cut_match, len_cut_trim=args.len_cut_trim, mismatch_allowance=args.mismatch)


def _alignments(spark, path: str):
    from .sources.bam import read_bam
    from .sources.sam import read_sam

    if path.endswith(".bam"):
        return read_bam(spark, path)
    return read_sam(spark, path) if path.endswith((".sam", ".sam.gz")) else spark.read.parquet(path)


def _trim(args) -> None:
    from . import sinks
    from .plans.sample import trim_step
    from .sources.fasta import read_reference

    spark = _spark(args)
    done = trim_step(_library(args).reads(spark), read_reference(spark, args.te), _params(args))
    sinks.write_trimmed(done.reads, args.outdir, args.sample)
    sinks.write_read_repeat(done.repeat, args.outdir, args.sample)


def _align(args) -> None:
    from . import sinks
    from .plans.sample import Trimmed, align_step
    from .sources.fasta import read_reference
    from .sources.library import flanking_reads
    from .sources.text import read_read_repeat

    spark = _spark(args)
    trimmed = Trimmed(flanking_reads(spark, args.outdir, args.sample), read_read_repeat(spark, f"{args.outdir}/te_containing/{args.sample}.read_repeat_name.txt"))
    flanks, full = align_step(_library(args).reads(spark), trimmed, read_reference(spark, args.genome))
    sinks.write_alignments(flanks, f"{args.outdir}/genome_aln/{args.sample}.genome.parquet")
    sinks.write_alignments(full, f"{args.outdir}/genome_aln/{args.sample}.fullreads.genome.parquet")


def _find(args) -> None:
    from . import sinks
    from .plans.sample import call_step
    from .sources.fasta import read_reference
    from .sources.text import read_read_repeat

    spark = _spark(args)
    full = _alignments(spark, args.fullreads_bam) if args.fullreads_bam else None
    p = replace(DEFAULT, required_junction_reads=args.required_junction_reads)
    found = call_step(_alignments(spark, args.bam), read_read_repeat(spark, args.read_repeat), read_reference(spark, args.genome), full, p)
    base = f"{args.outdir}/results/{args.sample}.all_nonref_insert"
    sinks.write_insertions(found, f"{base}.gff", f"{base}.txt", args.sample)


def _reference(args) -> None:
    from . import sinks
    from .operators.reference import existing_bed
    from .plans.sample import reference_step
    from .sources.text import read_read_repeat, read_repeatmasker

    spark = _spark(args)
    elements = read_repeatmasker(spark, args.repeatmasker)
    existing_bed(elements).coalesce(1).sortWithinPartitions("ord").select("value").write.mode("overwrite").text(f"{args.outdir}/existingTE.bed")
    base = f"{args.outdir}/results/{args.sample}.all_ref_insert"
    sinks.write_insertions(reference_step(_alignments(spark, args.bam), read_read_repeat(spark, args.read_repeat), elements), f"{base}.gff", f"{base}.txt", args.sample)


def _characterize(args) -> None:
    from pyspark.sql import functions as F

    from . import sinks
    from .operators.genotype import genotype
    from .sources.regions import is_regional, region_reads
    from .sources.sam import genome_reads
    from .sources.text import read_insertions

    spark = _spark(args)
    found = read_insertions(spark, args.insertions)
    if is_regional(spark, args.reads_bam):
        reads = region_reads(spark, args.reads_bam, found.select("chrom", F.col("end").alias("pos")))
    else:
        reads = _alignments(spark, args.reads_bam)
    typed = genotype(found, genome_reads(reads))
    base = f"{args.outdir}/results/{args.sample}.all_nonref_insert.characTErized"
    sinks.write_genotypes(typed, f"{base}.gff", f"{base}.txt", args.sample)


def _run(args) -> None:
    from .plans.sample import run_sample

    run_sample(_spark(args), _library(args), args.te, args.genome, args.outdir, args.repeatmasker, args.genotype, _params(args), args.index_dir)


def main(argv: list[str] | None = None) -> int:
    parser = build_parser()
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    if not args.command:
        parser.print_help(sys.stderr)
        return 0
    try:
        from .staging import scratch

        with scratch(_spark(args)):  # what a step stages is deleted at its end
            args.run(args)
    except Exception as e:
        log.error("%s failed: %s", args.command, e, exc_info=args.verbose)
        return 1
    return 0
