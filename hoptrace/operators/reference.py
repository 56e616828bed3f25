"""Reference elements: shared calls and the removal of calls at known elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intact_element, strip_parens
from ..params import DEFAULT, Params
from ..staging import staged
from .calls import CLUSTER, NOTE_SHARED, TSD_SHARED
from .rangejoin import overlapping


def parse_repeatmasker(lines: DataFrame) -> DataFrame:
    """Annotated elements from lines (value, ord): chrom, te_start, te_end, te_name, family, strand, intact, ord.

    Lines of up to two characters, with fewer than 15 fields, or whose first field is no number are left out.
    """
    f = F.split(F.regexp_replace(F.rtrim(F.ltrim("value")), r"\s+", " "), " ")
    rows = lines.filter(F.length(F.trim("value")) > 2).withColumn("f", f).filter((F.size("f") >= 15) & F.get("f", F.lit(0)).rlike("^[0-9]+$"))
    strand = F.when(F.get("f", F.lit(8)) == "C", "-").otherwise("+")
    return rows.select(
        F.get("f", F.lit(4)).alias("chrom"), F.get("f", F.lit(5)).cast("long").alias("te_start"), F.get("f", F.lit(6)).cast("long").alias("te_end"), F.get("f", F.lit(9)).alias("te_name"),
        F.get("f", F.lit(10)).alias("family"), strand.alias("strand"), intact_element(strand, F.get("f", F.lit(11)), F.get("f", F.lit(13))).alias("intact"), F.col("ord"),
    )


def existing_bed(elements: DataFrame) -> DataFrame:
    """BED lines of all elements; the start is written as annotated."""
    where = F.concat(F.col("te_name"), F.lit(":"), F.col("te_start").cast("string"), F.lit("-"), F.col("te_end").cast("string"))
    return elements.select("ord", F.concat_ws("\t", "chrom", F.col("te_start").cast("string"), F.col("te_end").cast("string"), where, F.col("intact").cast("int").cast("string"), "strand").alias("value"))


def match_reference(junction_reads: DataFrame, elements: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Junction reads whose breakpoint is within ``boundary_window`` of an intact element's edge, with the first such element in file order.

    Each edge is written out at the few places around it, which makes the join an equal one; the places are then brought
    down to one element each before reads are joined. They are many times the elements, by which Spark would judge
    whether they can be copied to all tasks, so both sides are merged.
    """
    intact = elements.filter("intact").select("chrom", "te_start", "te_end", "te_name", "strand", "ord")
    near = F.sequence(F.lit(-p.boundary_window), F.lit(p.boundary_window))
    places = intact.withColumn("edge", F.explode(F.array("te_start", "te_end"))).withColumn("position", F.explode(F.transform(near, lambda d: F.col("edge") + d)))
    first = places.groupBy("chrom", "position").agg(F.min_by(F.struct("te_start", "te_end", "te_name", "strand", "ord"), "ord").alias("te"))
    return junction_reads.join(first.hint("merge"), ["chrom", "position"]).select(junction_reads["*"], *[F.col(f"te.{c}").alias(f"ref_{c}") for c in ("te_start", "te_end", "te_name", "strand", "ord")])


def shared_insertions(matched: DataFrame, keys: tuple[str, ...] = CLUSTER) -> DataFrame:
    """One call per cluster and matched element, placed and named as the element is."""
    places = matched.groupBy(*keys, F.col("ref_te_start").alias("start"), F.col("ref_te_end").alias("end")).agg(
        F.min_by(F.struct("ref_te_name", "ref_strand"), "ref_ord").alias("te"), F.count_if(F.col("side") == "left").alias("left_junction"), F.count_if(F.col("side") == "right").alias("right_junction"),
    )
    zero = F.lit(0).cast("long")
    return places.select(
        *keys, "start", "end", F.col("te.ref_te_name").alias("te_name"), F.col("te.ref_strand").alias("strand"), F.lit(TSD_SHARED).alias("tsd"), "left_junction", "right_junction",
        zero.alias("left_support"), zero.alias("right_support"), F.lit(NOTE_SHARED).alias("note"),
    )


def filter_reference_overlaps(calls: DataFrame, elements: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Calls that no element of the same name, intact or not, comes within ``boundary_window`` of."""
    known = elements.select("chrom", "te_name", F.col("te_start").alias("start"), F.col("te_end").alias("end"))
    return overlapping(staged(calls, "calls"), known, ["chrom", "te_name"], p.boundary_window, p.range_bin, "left_anti")


__all__ = ["existing_bed", "filter_reference_overlaps", "match_reference", "parse_repeatmasker", "shared_insertions", "strip_parens"]
