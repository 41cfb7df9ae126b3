"""Session helpers: the shared folder, materialised tables, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Row bound under which a narrow dimension table may be broadcast.
BROADCAST_ROWS = 500_000

# Folder below the application's own, for tables of a bounded life.
_SCOPE: ContextVar[str] = ContextVar("scope", default="")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a fresh temporary one; on a
    cluster executors would not see each other's files there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file:" + tempfile.mkdtemp(prefix="basewise-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """Folder of this application's stored tables."""
    return f"{shared_dir(spark)}/basewise/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's folder."""
    return f"{scratch_dir(spark)}{_SCOPE.get()}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes the tables that this application stored; results must be written elsewhere by then."""
    _delete(spark, scratch_dir(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end: for work whose results are written inside too, such as a micro-batch."""
    token = _SCOPE.set(f"{_SCOPE.get()}/scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        path = scratch_dir(spark) + _SCOPE.get()
        _SCOPE.reset(token)
        _delete(spark, path)


@contextmanager
def bounded_listing(spark: SparkSession) -> Iterator[None]:
    """Tables opened inside are listed by a few tasks a core, however many folders they have, not by one task a folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    spark.conf.set(name, 4 * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialize(df: DataFrame, label: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, in ``spark`` if given.

    Cuts lineage in a way that survives lost executors, fixes values that depend
    on the physical partition, and lets later steps prune columns. A micro-batch belongs
    to its stream's own session, which plans with the stream's number of state stores and
    without adaptive execution: what is read back by the caller's session does not.
    """
    spark = spark or df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows; else leave the join to Spark.

    The count stops at ``max_rows + 1`` rows, so the check itself is bounded.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
