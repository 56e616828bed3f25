"""Clusters of mapped reads along a contig, as gaps and islands.

A read begins a new cluster if it starts more than ``range_allowance`` bases behind everything before it. A window
over a whole contig would be one task, so the running maximum is taken inside bins of the contig, and a maximum over
the (few) bins before carries it across; cluster numbers are carried over the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import junction_info
from ..params import DEFAULT, Params


def clusters(reads: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = ("chrom",), name: str = "cluster_id") -> DataFrame:
    """``reads`` with ``name``, the cluster's number, counted from 1 along each contig by (gstart, gend)."""
    rows = reads.withColumn("_bin", F.floor(F.col("gstart") / p.cluster_bin))
    per_bin = rows.groupBy(*keys, "_bin").agg(F.max("gend").alias("_max"))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bin.select(*keys, "_bin", F.max("_max").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("gstart", "gend")
    # greatest() leaves nulls out: no read before in the bin, no bin before
    reach = F.greatest(F.max("gend").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    rows = rows.join(carried, [*keys, "_bin"])
    rows = rows.withColumn("_new", F.when(reach.isNull() | (F.col("gstart") > reach + p.range_allowance), 1).otherwise(0))
    begun = rows.groupBy(*keys, "_bin").agg(F.sum("_new").alias("_begun"))
    before = begun.select(*keys, "_bin", F.coalesce(F.sum("_begun").over(earlier), F.lit(0)).alias("_before"))
    inner = F.sum("_new").over(Window.partitionBy(*keys, "_bin").orderBy("gstart", "gend", F.desc("_new")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(before, [*keys, "_bin"]).withColumn(name, (F.col("_before") + inner).cast("long")).drop("_bin", "_carried", "_new", "_before")


def junctions(clustered: DataFrame) -> DataFrame:
    """Junction reads with side, position and te_end."""
    info = junction_info(F.col("name"), F.col("strand"), F.col("gstart"), F.col("gend"))
    return clustered.select("*", F.inline(F.array_compact(F.array(info))))


def support(clustered: DataFrame) -> DataFrame:
    """All other reads."""
    return clustered.filter(junction_info(F.col("name"), F.col("strand"), F.col("gstart"), F.col("gend")).isNull())
