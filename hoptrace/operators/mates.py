"""Recovery of mates and full reads by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import split_mate, strip_tag
from ..functions.names import is_junction


def te_family(junctions: DataFrame, repeat: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """``junctions`` with the element of each read, ``NA`` if unknown."""
    found = repeat.select(*keys, F.col("te_name").alias("_te"))
    return junctions.join(found, list(keys), "left").withColumn("te_name", F.coalesce("_te", F.lit("NA"))).drop("_te")


def support_mates(repeat: DataFrame, reads: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Reads whose mate, but not they themselves, matched an element. Names without /1 or /2 have no mate."""
    m = split_mate(strip_tag(F.col("name")))
    matched = repeat.select(*keys, m["base"].alias("base"), m["mate"].alias("mate")).filter(F.col("mate") != "").distinct()
    other = matched.select(*keys, "base", F.when(F.col("mate") == "1", "2").otherwise("1").alias("mate"))
    wanted = other.join(matched, [*keys, "base", "mate"], "left_anti").select(*keys, F.concat_ws("/", "base", "mate").alias("name"))
    return reads.join(wanted, [*keys, "name"], "left_semi")


def junction_fullreads(repeat: DataFrame, reads: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The untrimmed reads of junction reads; middle reads are not wanted, nor names without /1 or /2."""
    name = strip_tag(F.col("name"))
    wanted = repeat.filter(is_junction(F.col("name")) & (split_mate(name)["mate"] != "")).select(*keys, name.alias("name")).distinct()
    return reads.join(wanted, [*keys, "name"], "left_semi")
