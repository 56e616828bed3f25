"""Mixing sources to target weights by capped water-filling. DataFrame functions alone.

Every source wants a share of the whole by its weight. A source may be passed over at most ``max_epochs`` times, so
its target is clamped there and the excess is shared again by weight among the others until none is above. With
sources in ascending order of cap / weight the clamped ones are a first part of the order, so the level is found by
one running total over the table of sources.

Sampling takes each document as often as its source has whole repetitions, and the fractional rest from the first
documents in a seeded order, up to the target. Where the rest ends is found in three steps that never order a whole
source: sums per hash bucket, the bucket where the target is passed, and an order inside that one bucket. There the
last document contributes the words still missing, a fractional repetition.

Defined results: null texts have no words and take no part (taken 0). A null source is a source of its own, after all
others. Rows that repeat a doc_id are documents of their own; equal ones share their place in the order, told apart by
size. Sources without words have target 0. An empty table gives no row. Other columns pass through :func:`sample`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, word_count

WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS, SEED, BUCKETS = 1.5, 2, 20_240_501, 4096


def by_code_point(name: Column) -> list[Column]:
    """Ascending order by code point, null last (Spark orders strings by their UTF-8 bytes, which is the same)."""
    return [name.asc_nulls_last()]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) rows. Its windows see one row per source."""
    sums = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(*by_code_point(F.col("source")))) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod(place, F.lit(len(weights)))]
    table = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    every = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), *by_code_point(F.col("source")))
    table = table.withColumn("rest_cap", F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    table = table.withColumn("rest_weight", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = F.col("rest_cap") / F.col("rest_weight")
    # the first source, in this order, that is not clamped fixes the level for all after it
    table = table.withColumn("level", F.min(F.when(F.col("cap") > F.col("weight") * level, F.struct(F.col("cap") / F.col("weight"), level.alias("level")))).over(every)["level"])
    target = F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))
    return table.select("source", "source_size", "weight", target.alias("target"))


def _key(df: DataFrame, seed: int) -> DataFrame:
    """``_hash``: the document's place in the seeded order, the first 60 bits of an MD5 over seed and doc_id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    return df.withColumn("_hash", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))


def plan(docs: DataFrame, seed: int = SEED, buckets: int = BUCKETS, **kw) -> tuple[DataFrame, DataFrame]:
    """The sized documents (doc_id, source, size, _hash), and per source where its fractional repetition ends."""
    sized = staged(_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text").cast("string")).alias("size")), seed), "sizes")
    targets = staged(source_targets(sized, **kw), "targets")
    rest = F.round("target").cast("long") - F.floor(F.try_divide(F.round("target"), "source_size")).cast("long") * F.col("source_size")
    whole = F.coalesce(F.floor(F.try_divide(F.round("target"), "source_size")), F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.coalesce(rest, F.lit(0)))
    bucket = F.pmod(F.shiftright("_hash", 20), F.lit(buckets)).cast("int")
    sums = sized.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    run = Window.partitionBy("source").orderBy("bucket")
    upto = sums.withColumn("upto", F.sum("bucket_size").over(run))
    edge = upto.join(targets, upto["source"].eqNullSafe(targets["source"])).select(targets["*"], "bucket", "bucket_size", "upto").filter((F.col("upto") - F.col("bucket_size") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
    edge = edge.select("source", "bucket", (F.col("rest") - F.col("upto") + F.col("bucket_size")).alias("inside"))
    edge = staged(edge, "edges")
    # inside the one bucket of each source where the rest ends: the document that the rest ends in
    members = sized.withColumn("bucket", bucket)
    near = members.join(edge, members["source"].eqNullSafe(edge["source"]) & (members["bucket"] == edge["bucket"])).select(members["*"], edge["inside"])
    places = near.groupBy("source", "inside", "bucket", "_hash", "doc_id", "size").agg(F.count("*").alias("copies"))
    inner = Window.partitionBy("source").orderBy("_hash", F.col("doc_id").asc_nulls_last(), "size")
    ends = places.withColumn("end", F.sum(F.col("size") * F.col("copies")).over(inner)).filter((F.col("end") - F.col("size") * F.col("copies") <= F.col("inside")) & (F.col("inside") < F.col("end")))
    ends = ends.select("source", F.struct("bucket", "_hash", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "size").alias("edge"),
                       # equal rows share the words that are still missing evenly, rounded down
                       F.floor((F.col("inside") - F.col("end") + F.col("size") * F.col("copies")) / F.col("copies")).cast("long").alias("partial"))
    out = targets.join(ends, targets["source"].eqNullSafe(ends["source"]), "left").select(targets["*"], "edge", F.coalesce("partial", F.lit(0)).alias("partial"))
    return sized.withColumn("bucket", bucket), staged(out, "plan")


def _take(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """``rows`` (with bucket, _hash, doc_id, size, source) joined with its source's plan, and ``extra``: words of the fractional repetition."""
    own = F.struct("bucket", "_hash", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), "size")
    joined = rows.join(by_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    extra = F.when(F.col("edge").isNull(), F.lit(0)).when(own < F.col("edge"), F.col("size")).when(own == F.col("edge"), F.col("partial")).otherwise(F.lit(0))
    return joined.withColumn("extra", extra.cast("long"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source)."""
    sized, by_source = plan(docs, **kw)
    taken = _take(sized, by_source)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def sample(docs: DataFrame, seed: int = SEED, buckets: int = BUCKETS, **kw) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Texts stay whole: a fractional repetition of half or more is one.

    The decision is taken where the text lies, by its source's short plan, so no text is shuffled for it.
    """
    _, by_source = plan(docs, seed=seed, buckets=buckets, **kw)
    own = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text").cast("string")).alias("size"))
    rows = _key(own, seed).withColumn("bucket", F.pmod(F.shiftright("_hash", 20), F.lit(buckets)).cast("int"))
    taken = _take(rows, by_source)
    # a text without words takes part in whole repetitions alone
    times = (F.col("whole") + F.when((F.col("size") > 0) & (F.col("extra") * 2 >= F.col("size")), 1).otherwise(0)).cast("int")
    return taken.withColumn("_times", times).filter(F.col("_times") > 0).select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_time")).select("_row.*")


def op7_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
