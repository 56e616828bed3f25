"""Paired mapping: both mates' places are joined under a model of the insert size, and a weak mate is looked for beside the other.

1. Each mate is mapped by itself and keeps several places.
2. Pairs whose mates both have one clear place and face each other give the quartiles of the insert size, in one grouped
   pass; the model is the range around them. With too few such pairs every mate keeps its own best place.
3. Where no two places of a pair face each other in the model, each mate's best place tells where the other should be,
   and the whole stretch is aligned there, on all its diagonals, with no seed needed.
4. Of the places that fit, the pair with the highest sum of scores is taken, unless the mates' best places apart score
   over ``UNPAIRED`` more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reference_span, split_mate
from ..params import DEFAULT, Params
from ..sources.fasta import Reference
from ..staging import staged
from .align import best_places, canonical, extended, places, under

#: Score by which a read's best place must lead its second to be clear, and by which places apart must lead a pair's.
CLEAR, UNPAIRED = 10, 17
#: Clear pairs that a model needs, and how far it goes beyond the quartiles, in their distance (``LEAST_SPREAD`` at least).
LEAST_PAIRS, REACH, LEAST_SPREAD = 20, 3, 10
# Flags of alignments.
PAIRED, PROPER, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, LAST = 0x1, 0x2, 0x8, 0x10, 0x20, 0x40, 0x80
PLACE = ("id", "name", "ref_index", "reverse", "seq", "qual", "score", "ref_start", "cigar", "nm", "ref_end")


def _insert(a: str, b: str) -> Column:
    """Size of the insert of two places that face each other on one sequence; null for others."""
    reverse, start, end = (lambda x, c=c: F.col(f"{x}.{c}") for c in ("reverse", "ref_start", "ref_end"))
    size = F.when(reverse(a), end(a) - start(b)).otherwise(end(b) - start(a))
    return F.when((F.col(f"{a}.ref_index") == F.col(f"{b}.ref_index")) & (reverse(a) != reverse(b)) & (size > 0), size)


def insert_model(found: DataFrame) -> tuple[int, int] | None:
    """Least and greatest insert size, from places (pair, mate, PLACE) of all reads."""
    scores = F.sort_array(F.collect_list("score"), asc=False)  # as many as are kept of a read
    best = found.groupBy("pair", "mate").agg(scores.alias("s"), F.max_by(F.struct(*PLACE), "score").alias("p"))
    clear = best.filter((F.size("s") == 1) | (F.col("s")[0] - F.col("s")[1] >= CLEAR))
    one, two = (clear.filter(F.col("mate") == m).select("pair", F.col("p").alias(x)) for m, x in ((1, "a"), (2, "b")))
    sizes = one.join(two, "pair").select(_insert("a", "b").alias("size")).filter("size IS NOT NULL")
    n, quartiles = sizes.agg(F.count("*"), F.percentile_approx("size", [0.25, 0.75], 1000)).first()
    if n < LEAST_PAIRS:
        return None
    reach = REACH * max(quartiles[1] - quartiles[0], LEAST_SPREAD)
    return max(1, quartiles[0] - reach), quartiles[1] + reach


def proper_pairs(found: DataFrame, model: tuple[int, int]) -> DataFrame:
    """(pair, total, a, b): the best pair of places that face each other in the model."""
    one, two = (found.filter(F.col("mate") == m).select("pair", F.struct(*PLACE).alias(x)) for m, x in ((1, "a"), (2, "b")))
    fitting = one.join(two, "pair").filter(_insert("a", "b").between(*model)).withColumn("total", F.col("a.score") + F.col("b.score"))
    order = F.struct("total", -F.col("a.ref_index"), -F.col("a.ref_start"), -F.col("b.ref_start"), ~F.col("a.reverse"), "a.cigar", "b.cigar")
    return fitting.groupBy("pair").agg(F.max("total").alias("total"), F.max_by(F.struct("a", "b"), order).alias("x")).select("pair", "total", "x.a", "x.b")


def best_singles(found: DataFrame) -> DataFrame:
    """(pair, mate, PLACE): each read's best place."""
    order = F.struct("score", -F.col("ref_index"), -F.col("ref_start"), ~F.col("reverse"), "cigar")
    return found.groupBy("pair", "mate").agg(F.max_by(F.struct(*PLACE), order).alias("p")).select("pair", "mate", "p.*")


def beside(singles: DataFrame, reads: DataFrame, model: tuple[int, int]) -> DataFrame:
    """(id, reverse, ref_index, low, high): the diagonals on which the mate of each best place should lie."""
    low, high = model
    n = F.length("m.seq")
    # the mate of a forward read ends behind it, that of a reverse read begins before it
    first = F.when(F.col("s.reverse"), F.col("s.ref_end") - high).otherwise(F.col("s.ref_start") + low - n).cast("long")
    rows = singles.alias("s").join(reads.alias("m"), (F.col("s.pair") == F.col("m.pair")) & (F.col("s.mate") == 3 - F.col("m.mate")))
    return rows.select(F.col("m.id").alias("id"), (~F.col("s.reverse")).alias("reverse"), F.col("s.ref_index").alias("ref_index"), first.alias("low"), (first + high - low).alias("high")).filter(F.col("high") > 0)


def align_pairs(reads: DataFrame, reference: Reference, k: int = 15, w: int = 10, kept: int = 8, tried: int = 16, p: Params = DEFAULT) -> DataFrame:
    """Canonical alignments of both mates, one place a read, with the flags of pairs.

    ``reads``: id, name, seq, qual, mate (1 or 2). Mates have one name but for a ``/1`` or ``/2`` at its end.
    """
    base = F.coalesce(split_mate(F.col("name"))["base"], F.col("name"))
    named = reads.select("id", "name", "seq", "qual", "mate", base.alias("pair"))
    keyed = lambda rows: rows.withColumn("ref_end", (F.col("ref_start") + reference_span(F.col("cigar"))).cast("int")).join(named.select("id", "pair", "mate"), "id").select("pair", "mate", *PLACE)
    found = staged(keyed(places(named, reference, k, w, kept, tried, p)), "mate-places")
    model = insert_model(found)
    singles = staged(best_singles(found), "singles")
    if model is None:
        return _flagged(singles.withColumn("proper", F.lit(False)), reference)
    pairs = staged(proper_pairs(found, model), "pairs")
    alone = singles.join(pairs.select("pair"), "pair", "left_anti")
    rescue = staged(beside(alone, named, model), "beside")
    wanted = named.join(rescue.select("id").distinct(), "id", "left_semi")
    more = keyed(best_places(extended(under(rescue, wanted, reference, model[1] - model[0]), p.least_score), kept))
    every = staged(found.unionByName(more), "all-places")
    partial = alone.select("pair").distinct()
    pairs = staged(pairs.unionByName(proper_pairs(every.join(partial, "pair", "left_semi"), model)), "all-pairs")
    singles = staged(best_singles(every), "best-singles")
    apart = singles.groupBy("pair").agg(F.sum("score").alias("apart"))
    taken = staged(pairs.join(apart, "pair").filter(F.col("total") >= F.col("apart") - UNPAIRED), "taken")
    both = taken.select("pair", F.explode(F.array(*[F.struct(F.lit(m).alias("mate"), F.col(x).alias("p")) for m, x in ((1, "a"), (2, "b"))])).alias("x")).select("pair", "x.mate", "x.p.*")
    rest = singles.join(taken.select("pair"), "pair", "left_anti")
    return _flagged(both.withColumn("proper", F.lit(True)).unionByName(rest.withColumn("proper", F.lit(False))), reference)


def _flagged(rows: DataFrame, reference: Reference) -> DataFrame:
    rows = staged(rows, "paired")
    others = rows.select("pair", (3 - F.col("mate")).alias("mate"), F.col("reverse").alias("mate_reverse"))
    joined = rows.join(others, ["pair", "mate"], "left")
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    there = F.col("mate_reverse").isNotNull()
    flag = PAIRED + bit(F.col("proper"), PROPER) + bit(~there, MATE_UNMAPPED) + bit(F.col("reverse"), REVERSE) + bit(there & F.col("mate_reverse"), MATE_REVERSE) + F.when(F.col("mate") == 1, FIRST).otherwise(LAST)
    return canonical(joined, reference, flag)
