"""Written intermediate results: they cut the lineage, are read by several steps and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN: ContextVar[str | None] = ContextVar("own_folder", default=None)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which the driver and all executors share.

    Where that is not set, a local folder is made in local mode, as in tests; on a cluster it is an error, as executors
    would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.hoptrace.stage.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-stage-")
        spark.conf.set("spark.hoptrace.stage.dir", root)
    return root.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """All that is staged inside the block goes to a folder of its own, which is deleted at its end."""
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _OWN.set(path)
    try:
        yield path
    finally:
        _OWN.reset(token)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the run's own folder, or the shared one."""
    return f"{_OWN.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a written step go once it is written, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back."""
    return _written(df, new_path(df.sparkSession, name))


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``staged(make(), name)``; all that ``make`` stages on its way is deleted."""
    path = new_path(spark, name)
    with scratch(spark):
        return _written(make(), path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`staged`, all readers of which are written elsewhere."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
