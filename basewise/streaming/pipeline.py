"""Pairs in, aligned records out, while the reader still writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basewise.operators.reference import ReferenceIndex, reference_index
from basewise.operators.routing import drop_eos, eos_records
from basewise.plans.aligner import align_pairs
from basewise.session import materialize, scratch
from basewise.sinks import write_records
from basewise.streaming.commit import exists, folders, publish
from basewise.streaming.state import keyed_state
from basewise.streaming.windows import stream_closed_windows


def align_stream(
    pairs: DataFrame, reference: DataFrame | ReferenceIndex, out: str, checkpoint: str, available_now: bool = False,
    every: str = "30 seconds", k: int = 12, window: int = 0, shards: int = 8, shard: Column | None = None,
    idle_ms: int | None = None, stores: int | None = None,
) -> StreamingQuery:
    """Maps each micro-batch and shows it as ``out/batch=<n>/sample=<s>``.

    Mapping is per read, so it needs no state across batches. A contig table is indexed
    once, with words of ``k`` bases, not once a batch. A batch appears whole and once,
    also when it is replayed after a failure: every pair is written exactly once.

    With a ``window`` pairs are mapped in whole windows of so many (``rapi_win`` of the
    options), which :func:`stream_closed_windows` closes; ``_windows`` in each batch tells
    their sizes. After the records of a sample's last window come its sentinels, one for
    each shard, in a batch of their own (see :func:`~basewise.operators.routing.eos_records`).
    ``stores`` is that of :func:`~basewise.streaming.state.keyed_state`: samples x ``shards``
    are enough.
    """
    index = reference if isinstance(reference, ReferenceIndex) else reference_index(reference, k)
    spark = pairs.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        # Records have even numbers, the sentinels after them odd ones.
        if exists(spark, f"{out}/batch={2 * number + 1}"):
            return
        with scratch(spark):
            # Stored, as the batch is read for its distinct sequences and for the join back;
            # mapped in the caller's session, whose shuffles do not depend on the stream's state.
            stored = materialize(df, "batch", spark)

            def write(folder: str) -> None:
                write_records(align_pairs(stored.drop("shard", "window"), index), folder)
                if window:
                    sizes = drop_eos(stored).groupBy("sample", "shard", "window").agg(F.count("*").alias("pairs"))
                    sizes.coalesce(1).write.parquet(f"{folder}/_windows")

            publish(spark, out, 2 * number, write)
            if window:
                ends = eos_records(stored.where(F.length("name") <= 1).select("sample", F.col("shard").alias("part")))
                publish(spark, out, 2 * number + 1, lambda folder: write_records(ends, folder))

    rows = stream_closed_windows(pairs, window, shards, shard, idle_ms, ends=True) if window else pairs
    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    with keyed_state(spark, stores):
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def window_sizes(spark: SparkSession, out: str) -> DataFrame:
    """(sample, shard, window, pairs) of every window mapped so far."""
    return spark.read.schema("sample string, shard int, window long, pairs long").parquet(*folders(spark, f"{out}/batch=*/_windows"))


def write_stream(rows: DataFrame, out: str, checkpoint: str, available_now: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """Rows with a ``sample`` column to Parquet, a directory per sample, exactly once."""
    writer = rows.writeStream.format("parquet").partitionBy("sample").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
