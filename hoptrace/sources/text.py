"""Whole FASTA records, read-repeat tables, RepeatMasker output and insertion GFF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import gff_attribute
from ..operators.reference import parse_repeatmasker
from .fastq import read_fastq  # noqa: F401
from .sam import numbered_lines


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ref_index, ref_name, ref_length, seq), names up to the first blank. One record is one row."""
    parts = spark.read.option("lineSep", ">").text(path).withColumn("ordinal", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    name = F.regexp_extract("value", r"^([^\s]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    rows = parts.select("ordinal", name.alias("ref_name"), seq.alias("seq"))
    order = F.row_number().over(Window.orderBy("ordinal")) - 1  # over the names of the library's records alone
    index = rows.select("ordinal").withColumn("ref_index", order)
    return rows.join(index, "ordinal").select("ref_index", "ref_name", F.length("seq").cast("int").alias("ref_length"), "seq")


def read_read_repeat(spark: SparkSession, path: str) -> DataFrame:
    """(name, te_name, strand) of a tab-separated table; further fields are ignored, shorter lines left out, the last of a name wins."""
    f = F.split("value", "\t")
    rows = numbered_lines(spark, path).withColumn("f", f).filter(F.size("f") >= 3)
    last = F.max_by(F.struct(F.get("f", F.lit(1)).alias("te_name"), F.rtrim(F.get("f", F.lit(2))).alias("strand")), "ordinal")
    return rows.groupBy(F.get("f", F.lit(0)).alias("name")).agg(last.alias("v")).select("name", "v.te_name", "v.strand")


def read_repeatmasker(spark: SparkSession, path: str) -> DataFrame:
    return parse_repeatmasker(numbered_lines(spark, path).withColumnRenamed("ordinal", "ord"))


def parse_insertions(lines: DataFrame) -> DataFrame:
    """Calls from GFF lines (value): comments, blank lines and lines of fewer than nine fields are left out, absent attributes get defaults."""
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", f).filter(F.size("f") >= 9)
    a = F.get("f", F.lit(8))
    count = lambda key: gff_attribute(a, key, "0").cast("long")
    return rows.select(
        F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(3)).cast("long").alias("start"), F.get("f", F.lit(4)).cast("long").alias("end"), gff_attribute(a, "Name", "NA").alias("te_name"), F.get("f", F.lit(6)).alias("strand"),
        gff_attribute(a, "TSD", "UNK").alias("tsd"), count("Left_junction_reads").alias("left_junction"), count("Right_junction_reads").alias("right_junction"),
        count("Left_support_reads").alias("left_support"), count("Right_support_reads").alias("right_support"), gff_attribute(a, "Note", "").alias("note"),
    )


def read_insertions(spark: SparkSession, path: str) -> DataFrame:
    return parse_insertions(spark.read.text(path))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, family, start, end, strand, tsd) of a GFF of known sites."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).withColumn("f", f).filter(F.size("f") >= 9)
    return rows.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(2)).alias("family"), F.get("f", F.lit(3)).cast("long").alias("start"), F.get("f", F.lit(4)).cast("long").alias("end"), F.get("f", F.lit(6)).alias("strand"), gff_attribute(F.get("f", F.lit(8)), "TSD", "").alias("tsd"))
