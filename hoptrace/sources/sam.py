"""SAM text: header and records in the canonical alignment schema.

sample-free columns: ordinal, name, flag, ref_index, ref_name, ref_length, ref_start (0-based), cigar, ref_end
(0-based, exclusive), seq, qual, nm. Places are longs: text has no bound on them, as BAM has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reference_span


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, ordinal) of text files; the ordinal rises with the place in a file."""
    return spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())


def contigs(lines: DataFrame) -> DataFrame:
    """(ref_index, ref_name, ref_length) from @SQ lines, in file order. One row per contig."""
    sq = lines.filter(F.col("value").startswith("@SQ\t"))
    field = lambda k: F.regexp_extract("value", f"\t{k}:([^\t]*)", 1)
    ordered = sq.agg(F.array_sort(F.collect_list(F.struct("ordinal", field("SN").alias("n"), field("LN").alias("l")))).alias("a"))
    return ordered.select(F.posexplode("a").alias("ref_index", "x")).select("ref_index", F.col("x.n").alias("ref_name"), F.col("x.l").cast("int").alias("ref_length"))


def records(lines: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Canonical records of alignment lines (value, ordinal). Lines with fewer than 11 fields are left out."""
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("@")).withColumn("f", f).filter(F.size("f") >= 11)
    g = lambda i: F.get("f", F.lit(i))
    start = F.when(g(3).cast("long") > 0, g(3).cast("long") - 1)
    nm = F.expr("try_cast(nullif(regexp_extract(value, '\\tNM:i:([0-9]+)', 1), '') AS INT)")
    cigar = F.when(g(5) != "*", g(5))
    rows = rows.select(
        "ordinal", g(0).alias("name"), g(1).cast("int").alias("flag"), F.when(g(2) != "*", g(2)).alias("ref_name"), start.alias("ref_start"), cigar.alias("cigar"),
        F.when(cigar.isNotNull(), start + reference_span(cigar)).alias("ref_end"), g(9).alias("seq"), F.when(g(10) != "*", g(10)).alias("qual"), nm.alias("nm"),
    )
    if refs is None:
        return rows
    return rows.join(refs, "ref_name", "left")


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = numbered_lines(spark, path)
    return records(lines, contigs(lines))


def mapped(rows: DataFrame) -> DataFrame:
    """Records that are mapped: secondary and supplementary ones count as reads of their own."""
    return rows.filter((F.col("flag").bitwiseAND(4) == 0) & F.col("ref_end").isNotNull())


def genome_reads(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mapped reads on contigs with 1-based inclusive places: chrom, name, strand, gstart, gend, nm, cigar."""
    strand = F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+")
    return mapped(rows).select(*keep, F.col("ref_name").alias("chrom"), "name", strand.alias("strand"), (F.col("ref_start") + 1).cast("long").alias("gstart"), F.col("ref_end").cast("long").alias("gend"), "nm", "cigar")
