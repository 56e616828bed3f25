"""Greedy pairing of breakpoints in islands of any length, over several tasks.

Along an island, each left breakpoint takes the nearest right one that is still open, and a right one is closed when the
lefts have gone past it. So all that a stretch of an island needs from before it is which rights are open at its start:
no more than two windows of positions. Long islands are cut into bins. Each bin is paired as if nothing were open before
it; then a bin is paired again wherever the rights that the bin before left open are not those it began with, until none
is. A difference dies out within few windows as a rule, so two or three rounds do; in the worst case there are as many
as an island has bins, each with fewer bins to do.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def paired(events: list[tuple[int, int, int]], before: list[int], window: int) -> tuple[list[tuple[int | None, int]], list[int]]:
    """((left, right) of a stretch, rights that it leaves open). ``events``: (at, is_left, place), sorted; ``before``: rights open at its start.

    A left that finds no right comes with None, and so does a right that is closed alone.
    """
    free, out = list(before), []
    for _, is_left, place in events:
        if not is_left:
            insort(free, place)
            continue
        gone = bisect_left(free, place - window)
        out += [(None, r) for r in free[:gone]]
        del free[:gone]
        at = bisect_left(free, place)
        near = [r for r in free[max(at - 1, 0) : at + 1]]
        took = min(near, key=lambda r: (abs(r - place), r), default=None)
        if took is not None:
            free.remove(took)
        out.append((place, took))
    return out, free


def pair_long_islands(events: DataFrame, window: int, bin_size: int) -> DataFrame:
    """(island, l, r) of ``events`` (island: string, at, is_left, place)."""
    rows = staged(events.withColumn("bin", F.floor(F.col("at") / bin_size)), "island-events")
    order = Window.partitionBy("island").orderBy("bin")  # a row a bin
    bins = rows.groupBy("island", "bin").agg(F.count("*").alias("n"))
    bins = staged(bins.select("island", "bin", F.lag("bin").over(order).alias("last"), F.lead("bin").over(order).isNull().alias("ends")), "island-bins")
    none = F.array().cast("array<bigint>")

    def run(some: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        used = [int(x) for x in start["open"].iloc[0]]
        listed = sorted(zip(some["at"].tolist(), some["is_left"].tolist(), some["place"].tolist()))
        pairs, free = paired(listed, used, window)
        if start["ends"].iloc[0]:
            pairs += [(None, r) for r in free]
        out = pd.DataFrame({"l": pd.array([x for x, _ in pairs] + [None], "Int64"), "r": pd.array([x for _, x in pairs] + [None], "Int64")})
        return out.assign(island=some["island"].iloc[0], bin=some["bin"].iloc[0], open=[None] * len(pairs) + [free])[["island", "bin", "l", "r", "open"]]

    todo = staged(bins.select("island", "bin", "ends", none.alias("open")), "island-starts")
    began, result = todo.select("island", "bin", "open"), None
    while not todo.isEmpty():
        own = rows.join(todo.select("island", "bin"), ["island", "bin"], "left_semi")
        done = own.groupBy("island", "bin").cogroup(todo.groupBy("island", "bin")).applyInPandas(run, "island string, bin long, l long, r long, open array<bigint>")
        done = staged(done, "island-pairs")
        # what was paired again replaces what was paired before
        again = todo.select("island", "bin")
        result = done if result is None else staged(result.join(again, ["island", "bin"], "left_anti").unionByName(done), "island-result")
        began = staged(began.join(again, ["island", "bin"], "left_anti").unionByName(todo.select("island", "bin", "open")), "island-began")
        left = result.filter("open IS NOT NULL").select("island", F.col("bin").alias("last"), F.col("open").alias("now"))
        changed = bins.join(left, ["island", "last"]).join(began, ["island", "bin"]).filter(F.col("now") != F.col("open"))
        todo = staged(changed.select("island", "bin", "ends", F.col("now").alias("open")), "island-starts")
    return result.filter("open IS NULL").select("island", "l", "r") if result is not None else rows.select("island", F.col("place").alias("l"), F.col("place").alias("r")).limit(0)
