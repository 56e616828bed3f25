"""Interval joins as equal joins on bins, so that they hash and never compare all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bins(low: Column, high: Column, size: int) -> Column:
    """All bins that low..high touches."""
    a, b = F.floor(low / size), F.floor(high / size)
    return F.when(a <= b, F.sequence(a, b))


def points_in_intervals(points: DataFrame, at: Column, intervals: DataFrame, low: Column, high: Column, keys: list[str], size: int, how: str = "inner") -> DataFrame:
    """Points with the intervals (low..high inclusive) of the same keys that hold them. A point lies in one bin, so no pair comes twice."""
    cut = intervals.withColumns({"_low": low, "_high": high, "_bin": F.explode(bins(low, high, size))})
    placed = points.withColumns({"_at": at, "_bin": F.floor(at / size)})
    on = [placed[k] == cut[k] for k in keys] + [placed["_bin"] == cut["_bin"], placed["_at"] >= cut["_low"], placed["_at"] <= cut["_high"]]
    condition = on[0]
    for x in on[1:]:
        condition = condition & x
    return placed.join(cut, condition, how)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], window: int, size: int, how: str) -> DataFrame:
    """Semi or anti join of ``left`` (start, end) with ``right`` (start, end) of equal keys within ``window`` bases.

    Both sides are cut into bins; whether a left row has a partner is decided over all its bins by its row number.
    """
    if how not in ("left_semi", "left_anti"):
        raise ValueError(how)
    names = [*keys, "start", "end"]
    ends = left.select(*names).distinct()
    a = ends.withColumn("_bin", F.explode(bins(F.col("start") - window, F.col("end") + window, size)))
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("start").alias("_s"), F.col("end").alias("_e")).withColumn("_b", F.explode(bins(F.col("_s"), F.col("_e"), size)))
    on = (F.col("_bin") == F.col("_b")) & (F.col("start") - window <= F.col("_e")) & (F.col("end") + window >= F.col("_s"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    found = a.join(b, on, "left_semi").select(*names).distinct()
    return left.join(found, names, how)
