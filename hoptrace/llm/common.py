"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, everywhere in this subpackage: a run of characters outside these six ASCII spaces.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
#: Rows and bytes of an Arrow batch of whole texts at most (a longer text is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
#: A key is hot if it has over this part of all rows; so there are at most as many hot keys.
HOT_PART = 1000
#: Rows of a side that may be copied to every executor; a larger one is joined by a merge of both sides.
MOST_COPIED = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.

    Where the setting is absent, a local folder is made and remembered in the session if Spark is in local mode, as in
    tests; on a cluster that is an error, as executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.hoptrace.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-hoptrace-")
        spark.conf.set("spark.hoptrace.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/hoptrace-{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as two underscores) that hold inside the block alone."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, path: str, *by: str) -> str:
    """Write ``df`` as Parquet, with bounded Arrow batches; shuffle files go as soon as it is written."""
    with settings(
        df.sparkSession,
        spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS),
        spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES),
        spark__sql__classic__shuffleDependency__fileCleanup__enabled="true",
    ):
        out = df.write.option("compression", "zstd")
        (out.partitionBy(*by) if by else out).parquet(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = written(df, new_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out._hoptrace_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that this job wrote, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`staged` once all that is read from them is written elsewhere."""
    for df in tables:
        delete(df.sparkSession, df._hoptrace_path)


def small_batches(spark: SparkSession) -> None:
    """The bounds of :func:`written` for a plan that the caller runs: Spark reads them when it runs, so they stay set."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def new_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it; Spark ignores the case of names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_by_size(left: DataFrame, right: DataFrame, on, how: str, most: int = MOST_COPIED, weight: Column | None = None) -> DataFrame:
    """Join with a written ``right`` of few narrow columns: copied to all if it has at most ``most`` rows, else by a merge.

    ``weight``: what a row with arrays counts for, so that their elements are bounded and not the rows alone.
    """
    size = right.limit(most + 1).count() if weight is None else right.agg(F.sum(weight)).first()[0] or 0
    return left.join(F.broadcast(right) if size <= most else right.hint("merge"), on, how)


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (written; one row per ``key``, with ``count``, the key's rows on the left).

    Keys with over a ``HOT_PART``-th of all rows, of which there can be no more than ``HOT_PART``, are copied to every
    task, so their rows on the left stay where they are. All others meet in a shuffle. ``how``: inner or left.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = right.filter(F.col(count) * HOT_PART > total).drop(count)
    cold = right.filter(F.col(count) * HOT_PART <= total).drop(count)
    names = [c for c in hot.columns if c != key]
    near = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    done = near.filter(F.col("_hot").isNotNull()).drop("_hot")
    rest = near.filter(F.col("_hot").isNull()).drop("_hot", *names).join(cold, key, how)
    return done.unionByName(rest.select(*done.columns))


def ranked_partitions(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` range-partitioned by ``by`` and written with the number of its range as column ``_range``.

    Ranges are ascending, so a running total over ranges and then inside each range is a total over the whole order,
    with no step that sees all rows in one task. The number is stored, hence stable when a task runs again.
    """
    out = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in by]).withColumn("_range", F.spark_partition_id())
    return staged(out, name)


def range_offsets(ranged: DataFrame, value: Column, keys: list[str] | None = None) -> DataFrame:
    """Per ``_range`` (and key) the total of ``value`` in all earlier ranges, as ``_before``. As many rows as ranges times keys."""
    from pyspark.sql import Window

    keys = keys or []
    sums = ranged.groupBy(*keys, "_range").agg(F.sum(value).cast("long").alias("_sum"))
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(w), F.lit(0)).cast("long").alias("_before"))
