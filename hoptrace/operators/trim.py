"""From element alignments to trimmed reads: one best alignment a read, then the trim."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boundary_score, match_counts, reference_span, trim_read
from ..functions.alignment import cigar_length
from ..params import DEFAULT, Params
from ..staging import staged


def carry_query_length(alignments: DataFrame, within: list[str], order: list[str], length: str = "qlen") -> DataFrame:
    """``alignments`` with ``carried``: the own length, or for a record without sequence the last one seen before it (0 at first).

    Records are ordered inside each ``within`` group, as they stand in one file. Groups may be as large as the file, so
    the order is cut into ranges: the last length of each range is carried over the (few) ranges behind it, and inside
    a range from record to record.
    """
    # the range's number is written, hence stable when a task runs again
    ranged = staged(alignments.repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = F.nullif(F.col(length), F.lit(0))
    lasts = ranged.groupBy(*within, "_range").agg(F.max_by(own, F.when(own.isNotNull(), F.struct(*order))).alias("_last"))
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = lasts.select(*within, "_range", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    seen = Window.partitionBy(*within, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.join(before, [*within, "_range"])
    return rows.withColumn("carried", F.coalesce(F.last(own, ignorenulls=True).over(seen), "_before", F.lit(0))).drop("_range", "_before")


def element_alignments(records: DataFrame, within: list[str]) -> DataFrame:
    """Mapped records (canonical alignment columns) as read-to-element alignments with 0-based inclusive ends."""
    mapped = records.filter((F.col("flag").bitwiseAND(4) == 0) & F.col("ref_start").isNotNull())
    own = F.when(F.col("seq") == "*", F.lit(0)).otherwise(F.length("seq"))
    rows = carry_query_length(mapped.withColumn("own_qlen", own), within, ["ordinal"], "own_qlen")
    lead = F.coalesce(F.expr("try_cast(regexp_extract(cigar, '^(?:[0-9]+H)?([0-9]+)S', 1) AS INT)"), F.lit(0))
    aligned = cigar_length(F.col("cigar"), "MI=X").cast("int")
    counts = match_counts(F.col("cigar"), F.col("nm"))
    # a record without sequence adds the carried length to its end, so it always reaches the read's end
    qend = (lead + aligned - 1 + F.when(F.col("own_qlen") == 0, F.col("carried")).otherwise(0)).cast("int")
    return rows.select(
        *within, F.col("name").alias("read_name"), F.col("carried").cast("int").alias("qlen"), lead.alias("qstart"), qend.alias("qend"),
        F.col("ref_name").alias("te_name"), F.col("ref_length").alias("te_len"), F.col("ref_start").alias("tstart"),
        (F.col("ref_start") + reference_span(F.col("cigar")) - 1).cast("int").alias("tend"), counts["match"].cast("int").alias("match"), counts["mismatch"].cast("int").alias("mismatch"),
        F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+").alias("strand"), F.struct("ref_index", "ref_start", "ordinal").alias("ord"),
        F.when(F.col("seq") == "*", "").otherwise(F.col("seq")).alias("seq"), F.when(F.col("qual") == "*", "").otherwise(F.coalesce("qual", F.lit(""))).alias("qual"),
    )


def best_alignment(alignments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: most borders reached, then most matches, then the first in order ``ord``. Combines before the shuffle."""
    c = F.col
    score = boundary_score(c("qstart"), c("qend"), c("qlen"), c("tstart"), c("tend"), c("te_len"))
    rest = [x for x in alignments.columns if x not in keys]
    best = F.min_by(F.struct(score.alias("boundary"), *rest), F.struct(-score, -c("match"), c("ord")))
    return alignments.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def trimmed_reads(alignments: DataFrame, p: Params = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """The flanks that reads keep: name (tagged), seq, qual, te_name, strand, junction_type, te_portion and ``keep``."""
    # as a generator of no or one row, so that the rule is evaluated once and not again for a filter and each field
    kept = alignments.select(*keep, "te_name", "strand", F.inline(F.array_compact(F.array(trim_read(p)))))
    return kept.select(*keep, "name", "seq", "qual", "te_name", "strand", "junction_type", "te_portion")


def flank_counts(trimmed: DataFrame, keys: list[str]) -> DataFrame:
    return trimmed.groupBy(*keys).agg(F.count("*").alias("n_reads"))


def read_repeat(rows: DataFrame, order: list[str], keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """(name, te_name, strand), the last of rows with the same name winning."""
    last = F.max_by(F.struct("te_name", "strand"), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("v")).select(*keys, "v.te_name", "v.strand")
