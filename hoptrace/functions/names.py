"""Read names: junction tags and mate suffixes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

JUNCTION_TAG = r":(start|end):[53]$"
MIDDLE_TAG = r":middle$"


def strip_tag(name: Column) -> Column:
    """The name without a junction or middle tag."""
    return F.regexp_replace(name, rf"({JUNCTION_TAG})|({MIDDLE_TAG})", "")


def strip_junction_tag(name: Column) -> Column:
    """The name without a junction tag; middle tags stay."""
    return F.regexp_replace(name, JUNCTION_TAG, "")


def is_junction(name: Column) -> Column:
    return name.rlike(JUNCTION_TAG)


def split_mate(name: Column) -> Column:
    """Struct (base, mate); mate is empty and base the whole name without a /1 or /2 suffix."""
    mate = F.regexp_extract(name, r"^(.*)/([12])$", 2)
    base = F.when(mate == "", name).otherwise(F.regexp_extract(name, r"^(.*)/([12])$", 1))
    return F.struct(base.alias("base"), mate.alias("mate"))
