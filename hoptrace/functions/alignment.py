"""Alignments: CIGAR sums and border scores."""

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATION = "([0-9]+)([MIDNSHP=X])"


def cigar_length(cigar: Column, operations: str) -> Column:
    """Sum of the lengths of the given operations; 0 for null."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(f"([0-9]+)[{operations}]"), F.lit(1))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def reference_span(cigar: Column) -> Column:
    """Bases of the reference that an alignment covers."""
    return cigar_length(cigar, "MDN=X")


def match_counts(cigar: Column, nm: Column) -> Column:
    """Struct (match, mismatch): mismatches are the edit distance (0 if absent) less inserted and deleted bases; only M counts as aligned."""
    mismatch = F.coalesce(nm.cast("long"), F.lit(0)) - cigar_length(cigar, "I") - cigar_length(cigar, "D")
    return F.struct((cigar_length(cigar, "M") - mismatch).alias("match"), mismatch.alias("mismatch"))


def boundary_score(qstart: Column, qend: Column, qlen: Column, tstart: Column, tend: Column, tlen: Column) -> Column:
    """How many of the four ends (read and element, start and end) an alignment reaches."""
    reached = [qstart <= 2, qend >= qlen - 3, tstart <= 2, tend >= tlen - 3]
    total = F.lit(0)
    for r in reached:
        total = total + r.cast("int")
    return total
