"""Writers: rows as lines of their text formats, and the folders they go to.

Parquet is the form the steps hand on. The text forms are sorted exports; ``single`` puts one into a single part file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import avg_flankers, feature_id

SOURCE = "hoptrace"
# The headers of the tables.
CALL_HEADER = "chrom\tstart\tend\tTE\tstrand\tTSD\tright_junction\tleft_junction\tright_support\tleft_support"
GENOTYPE_HEADER = "strain\tTE\tTSD\tchromosome.pos\tstrand\tavg_flankers\tspanners\tstatus"


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def gff_line(sample: str | Column, source: str = SOURCE) -> Column:
    pairs = [("ID", feature_id(F.col("chrom"), F.col("start"), F.col("end"))), ("Name", "te_name"), ("TSD", "tsd"), ("Note", "note"), ("Right_junction_reads", "right_junction"),
             ("Left_junction_reads", "left_junction"), ("Right_support_reads", "right_support"), ("Left_support_reads", "left_support")]
    attributes = F.concat(*[F.concat(F.lit(f"{k}="), _text(v), F.lit(";")) for k, v in pairs])
    return F.concat_ws("\t", "chrom", F.lit(source), F.lit(sample) if isinstance(sample, str) else sample, _text("start"), _text("end"), F.lit("."), "strand", F.lit("."), attributes)


def txt_line() -> Column:
    return F.concat_ws("\t", *map(_text, ("chrom", "start", "end", "te_name", "strand", "tsd", "right_junction", "left_junction", "right_support", "left_support")))


def genotype_gff_line(sample: str) -> Column:
    attributes = F.concat(F.lit("ID="), "chrom", F.lit("."), _text("end"), F.lit(".spanners;avg_flankers="), _text("avg_flankers"), F.lit(";spanners="), _text("spanners"),
                          F.lit(";type="), "status", F.lit(";TE="), "te_name", F.lit(";TSD="), "tsd")
    return F.concat_ws("\t", "chrom", F.lit(sample), F.lit("transposable_element_attribute"), _text("start"), _text("end"), F.lit("."), "strand", F.lit("."), attributes)


def genotype_txt_line(sample: str) -> Column:
    where = F.concat("chrom", F.lit(":"), _text("start"), F.lit(".."), _text("end"))
    return F.concat_ws("\t", F.lit(sample), "te_name", "tsd", where, "strand", _text("avg_flankers"), _text("spanners"), "status")


def write_lines(rows: DataFrame, line: Column, path: str, order: list[str], header: str | None = None, single: bool = True) -> None:
    """Sorted lines of ``rows``. A header is a row that sorts first."""
    lines = rows.select(F.lit(1).alias("_part"), *order, line.alias("value"))
    if header is not None:
        top = rows.sparkSession.range(1).select(F.lit(0).alias("_part"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order], F.lit(header).alias("value"))
        lines = top.unionByName(lines)
    lines = lines.orderBy("_part", *order)
    (lines.coalesce(1).sortWithinPartitions("_part", *order) if single else lines).select("value").write.mode("overwrite").text(path)


ORDER = ["chrom", "start", "end", "te_name", "tsd"]


def write_insertions(calls: DataFrame, gff: str, txt: str, sample: str, single: bool = True) -> None:
    write_lines(calls, gff_line(sample), gff, ORDER, None, single)
    write_lines(calls, txt_line(), txt, ORDER, CALL_HEADER, single)


def write_genotypes(calls: DataFrame, gff: str, txt: str, sample: str, single: bool = True) -> None:
    """Only calls with a status are written."""
    known = calls.filter(F.coalesce("status", F.lit("")) != "").withColumn("avg_flankers", avg_flankers(F.col("left_junction"), F.col("right_junction")))
    write_lines(known, genotype_gff_line(sample), gff, ORDER, "##gff-version 3", single)
    write_lines(known, genotype_txt_line(sample), txt, ORDER, GENOTYPE_HEADER, single)


def write_trimmed(trimmed: DataFrame, outdir: str, sample: str) -> None:
    """Flanks as FASTQ per direction, element portions as FASTA per end, and the read-repeat table."""
    from ..sources.library import flanking_path

    for number in (1, 2):
        own = trimmed.filter(F.col("direction") == number)
        if not own.isEmpty():
            own.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.mode("overwrite").text(flanking_path(outdir, sample, number))
    for kind, label in (("5", "five_prime"), ("3", "three_prime")):
        own = trimmed.filter((F.col("junction_type") == kind) & (F.coalesce("te_portion", F.lit("")) != ""))
        own.select(F.concat(F.lit(">"), "name", F.lit("\n"), "te_portion").alias("value")).write.mode("overwrite").text(f"{outdir}/te_portions/{sample}.{label}.fa")


def write_read_repeat(repeat: DataFrame, outdir: str, sample: str) -> None:
    repeat.select(F.concat_ws("\t", "name", "te_name", "strand").alias("value")).write.mode("overwrite").text(f"{outdir}/te_containing/{sample}.read_repeat_name.txt")


def write_alignments(rows: DataFrame, path: str) -> None:
    """Canonical alignments as Parquet in order of contig and place, files by range: a region is read from few of them."""
    order = ["ref_index", "ref_start", "ordinal"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def sam_line() -> Column:
    """A canonical record as SAM text; mate fields are not kept."""
    return F.concat_ws("\t", "name", _text("flag"), F.coalesce("ref_name", F.lit("*")), _text(F.coalesce(F.col("ref_start") + 1, F.lit(0))), F.lit("60"), F.coalesce("cigar", F.lit("*")), F.lit("*"), F.lit("0"), F.lit("0"),
                       F.coalesce("seq", F.lit("*")), F.coalesce("qual", F.lit("*")), F.concat(F.lit("NM:i:"), _text(F.coalesce("nm", F.lit(0)))))
