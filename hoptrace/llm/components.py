"""Connected components of links between 64-bit nodes, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on written tables, so that large groups of either side can be split, and no
step gathers the neighbours of a node. Nothing is sent to the driver but a count and a checksum per round. The rounds
end when a round changes nothing; their number grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _links(df: DataFrame) -> DataFrame:
    """Distinct links from the greater node (u) to the lesser (v)."""
    return df.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node of distinct links has one lesser node and no greater one, or none that is lesser: a step changes nothing then."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("lesser"), F.lit(0).alias("greater"))
    ends = ends.unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("lesser"), F.lit(1).alias("greater")))
    each = ends.groupBy("node").agg(F.sum("lesser").alias("lesser"), F.max("greater").alias("greater"))
    return each.agg(F.count_if((F.col("lesser") > 0) & (F.col("lesser") + F.col("greater") > 1))).first()[0] == 0


def components(links: DataFrame, until_stars: bool = False) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long); root is the least node of its component.

    Empty links give an empty result. Links from a node to itself and repeated links change nothing. ``until_stars``: end
    as soon as all links are stars, with the same result and without the last round, or without any.
    """
    now, before = staged(_links(links), "links"), None
    while not (until_stars and _are_stars(now)):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every greater neighbour moves to the least node of the closed neighbourhood
        large = staged(_links(both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        # small star: a node and its lesser neighbours move to the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(down, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(_links(moved.unionByName(down.select("u", F.col("m").alias("v")))), "links")
        discard(now, large)
        now = after
        if until_stars:
            continue
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.countDistinct("u")).first())
        if mark[0] == mark[2] and mark == before:  # every node has one link, and it stayed
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (written; node and root of every node) after further ``links`` (u, v), whose rounds see the roots they join alone."""
    u, v = roots.select(F.col("node").alias("u"), F.col("root").alias("_u")), roots.select(F.col("node").alias("v"), F.col("root").alias("_v"))
    found = components(links.join(u, "u").join(v, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")), until_stars=True)
    to = found.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return staged(roots.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "roots")
