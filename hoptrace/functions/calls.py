"""Insertion calls: junctions, target-site duplications and genotypes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def junction_info(name: Column, strand: Column, gstart: Column, gend: Column) -> Column:
    """Struct (side, position, te_end) of a mapped junction read; null for other reads."""
    kind, te_end = F.regexp_extract(name, r":(start|end):([53])$", 1), F.regexp_extract(name, r":(start|end):([53])$", 2)
    right = (strand == "+") == (kind == "start")
    info = F.struct(F.when(right, "right").otherwise("left").alias("side"), F.when(right, gstart).otherwise(gend).alias("position"), te_end.alias("te_end"))
    return F.when(kind != "", info)


def te_orientation(side: Column, te_end: Column) -> Column:
    """Strand of the element as one junction shows it; forward where it shows none."""
    reverse = ((te_end == "5") & (side == "right")) | ((te_end == "3") & (side == "left"))
    return F.when(reverse, "-").otherwise("+")


def tsd_interval(left: Column, right: Column, p: Params = DEFAULT) -> Column:
    """Struct (start, end, known) of a call from its left and right breakpoints, either of which may be null."""
    size = left - right + 1
    known = (size > 0) & (size <= p.max_tsd)
    start = F.when(known, right).otherwise(F.least(left, right))
    end = F.when(known, left).otherwise(F.least(left, right))
    return F.struct(start.alias("start"), end.alias("end"), F.coalesce(known, F.lit(False)).alias("known"))


def tsd_text(seq: Column, start: Column, end: Column, offset: Column | int = 0) -> Column:
    """Upper-case bases start..end (1-based, inclusive) of a contig, or of its part that begins after ``offset`` bases; dots where there are none."""
    size = (end - start + 1).cast("int")
    found = F.upper(F.substr(seq, (start - offset).cast("int"), size))
    dots = F.repeat(F.lit("."), F.greatest(size, F.lit(0)))
    return F.when((start < 1) | (F.coalesce(found, F.lit("")) == ""), dots).otherwise(found)


def feature_id(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("_", F.lit("repeat"), chrom, start.cast("string"), end.cast("string"))


def avg_flankers(left: Column, right: Column) -> Column:
    return ((left + right) / 2).cast("double")


def classify_status(flankers: Column, spanners: Column) -> Column:
    """Genotype from the mean of flanking reads and the number of spanning reads; the first rung that fits decides."""
    # The rungs, in their order.
    f, s = flankers, spanners
    gap, total = F.abs(f - s), f + s
    return (
        F.when(s == 0, "homozygous")
        .when((f >= 5) & (s < 5), "homozygous/excision_no_footprint")
        .when((s < f * 0.2) & (s <= 10), "homozygous/excision_no_footprint")
        .when((f <= 2) & (s > 10), "somatic_insertion")
        .when(gap <= 5, "heterozygous")
        .when(gap - total / 2 <= 10, "heterozygous")
        .when((f > 10) & (s > 10), "heterozygous")
        .when((s - f > total / 2) & (f <= 10), "somatic_insertion")
        .otherwise("other")
    )


def window_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column, window: int) -> Column:
    """Whether two intervals come within ``window`` bases of each other."""
    return (a_start - window <= b_end) & (a_end + window >= b_start)
