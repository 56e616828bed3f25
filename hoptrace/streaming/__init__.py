"""Clusters of a stream of mapped reads, as session windows over positions.

A read at gstart..gend opens a session that lasts until gend + the allowed gap; reads that start inside prolong it. With
positions read as seconds this is the batch rule of :func:`hoptrace.operators.cluster.clusters`. Streams must come in
order of position, late by at most ``lateness`` bases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def session_clusters(reads: DataFrame, p: Params = DEFAULT, lateness: int | None = None) -> DataFrame:
    """(chrom, first, last, n_reads, n_forward) of each cluster; works on streams (append mode) and on tables."""
    placed = reads.withColumn("_at", F.timestamp_seconds("gstart"))
    if reads.isStreaming:
        placed = placed.withWatermark("_at", f"{lateness or p.range_allowance} seconds")
    gap = F.concat((F.col("gend") - F.col("gstart") + p.range_allowance).cast("string"), F.lit(" seconds"))
    grouped = placed.groupBy("chrom", F.session_window("_at", gap).alias("w"))
    found = grouped.agg(F.min("gstart").alias("first"), F.max("gend").alias("last"), F.count("*").alias("n_reads"), F.count_if(F.col("strand") == "+").alias("n_forward"))
    return found.select("chrom", "first", "last", "n_reads", "n_forward")
