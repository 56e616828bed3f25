"""Alignments by region, and the scan of only those regions that sites lie in.

Files are partitioned by contig and by regions of equal size, in which alignments begin. Which regions a set of sites
needs is known when the sites are: the scan takes their partitions through a runtime filter and opens no other file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..params import DEFAULT, Params
from ..staging import staged
from .library import exists


def is_regional(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}-regions")


def write_regions(rows: DataFrame, path: str, p: Params = DEFAULT) -> str:
    """Mapped canonical alignments, in order of place inside each region. How they lie is written beside them."""
    seen = Observation("regions")
    order = ["ref_index", "ref_start", "ordinal"]
    placed = rows.filter("ref_start IS NOT NULL AND ref_end IS NOT NULL").withColumns({"contig": F.col("ref_name"), "region": F.floor(F.col("ref_start") / p.region)})
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).observe(seen, F.max(F.col("ref_end") - F.col("ref_start")).alias("span"))
    placed.write.mode("overwrite").partitionBy("contig", "region").parquet(path)
    spark = rows.sparkSession
    spark.createDataFrame([(p.region, int(seen.get["span"] or 0))], "size long, span long").coalesce(1).write.mode("overwrite").parquet(f"{path}-regions")
    return path


def region_reads(spark: SparkSession, path: str, sites: DataFrame) -> DataFrame:
    """Alignments of :func:`write_regions` that begin in a region from which they may reach one of ``sites`` (chrom, pos; 1-based)."""
    size, span = spark.read.parquet(f"{path}-regions").select("size", "span").first()
    kinds = {"contig": StringType(), "region": LongType()}  # names of contigs may look like numbers
    try:
        found = spark.read.parquet(path).schema
    except Exception as e:
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], "ref_name string, ref_start int, ref_end int, name string, flag int, nm int, cigar string")
    stored = spark.read.schema(StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in found])).parquet(path)
    near = F.sequence(F.floor((F.col("pos") - 1 - span) / size), F.floor(F.col("pos") / size))
    needed = staged(sites.select(F.col("chrom").alias("contig"), F.explode(near).alias("region")).distinct(), "regions")
    # a row a region of the genome at most
    return stored.join(F.broadcast(needed.filter("region >= 0")), ["contig", "region"], "left_semi").drop("contig", "region")
