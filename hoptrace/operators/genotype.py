"""Genotypes of two-sided calls from reads that span them, and evaluation against known sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import avg_flankers, classify_status
from ..params import DEFAULT, Params
from ..staging import staged
from .rangejoin import overlapping, points_in_intervals


def spanning_reads(reads: DataFrame) -> DataFrame:
    """Reads that match in one piece without a difference (``nm`` absent counts as none)."""
    return reads.filter(F.col("cigar").rlike("^[0-9]+M$") & (F.coalesce("nm", F.lit(0)) == 0))


def count_spanners(sites: DataFrame, reads: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = ("chrom",), at: str = "pos") -> DataFrame:
    """(keys, ``at``, spanners) for each distinct site: reads from ``span_margin`` before it to as many behind it."""
    places = sites.select(*keys, at).distinct()
    good = spanning_reads(reads).select(*keys, "gstart", "gend")
    found = points_in_intervals(places, F.col(at), good, F.col("gstart") + p.span_margin, F.col("gend") - p.span_margin, list(keys), p.range_bin)
    counted = found.select(*[places[k] for k in keys], places[at]).groupBy(*keys, at).agg(F.count("*").alias("spanners"))
    return places.join(counted, [*keys, at], "left").withColumn("spanners", F.coalesce("spanners", F.lit(0)).cast("long"))


def genotype(calls: DataFrame, reads: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Two-sided calls with avg_flankers, spanners and status."""
    both = staged(calls.filter((F.col("left_junction") >= 1) & (F.col("right_junction") >= 1)), "two-sided")
    spans = count_spanners(both, reads, p, keys, "end")
    flankers = avg_flankers(F.col("left_junction"), F.col("right_junction"))
    return both.join(spans, [*keys, "end"]).withColumn("avg_flankers", flankers).withColumn("status", classify_status(F.col("avg_flankers"), F.col("spanners")))


def evaluate(calls: DataFrame, truth: DataFrame, window: int = 10, size: int = DEFAULT.range_bin) -> DataFrame:
    """One row: n_truth, n_calls, recovered truths and true calls, of intervals within ``window`` bases."""
    truth, calls = truth.select("chrom", "start", "end"), staged(calls.select("chrom", "start", "end"), "sites")
    count = lambda df, n: df.agg(F.count("*").alias(n))
    return (
        count(truth, "n_truth").crossJoin(count(calls, "n_calls"))  # four single rows
        .crossJoin(count(overlapping(truth, calls, ["chrom"], window, size, "left_semi"), "recovered"))
        .crossJoin(count(overlapping(calls, truth, ["chrom"], window, size, "left_semi"), "true_calls"))
    )
