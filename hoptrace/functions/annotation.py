"""Annotation files: attributes and the completeness of reference elements."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def gff_attribute(attributes: Column, key: str, default: str = "") -> Column:
    """First ``key=value`` anywhere in the column (the key may be the end of a longer one)."""
    return F.when(attributes.rlike(f"{key}="), F.regexp_extract(attributes, f"{key}=([^;]*)", 1)).otherwise(F.lit(default))


def strip_parens(value: Column) -> Column:
    return F.translate(value, "()", "")


def intact_element(strand: Column, begin: Column, end_left: Column) -> Column:
    """Whether an annotated element is whole: on + it begins at 1 and has 0 left; on the other strand the two columns change places."""
    zero = lambda v: strip_parens(v).rlike("^[+-]?0+$")
    return F.when(strand == "+", (begin == "1") & zero(end_left)).otherwise((end_left == "1") & zero(begin))
