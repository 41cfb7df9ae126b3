"""The reader while the sequencer still writes: a tile is published when its last file has come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from basewise import schemas
from basewise.operators.routing import eos_rows
from basewise.options import Options
from basewise.plans.reader import contents, load_run, pairs_of, tile_clusters
from basewise.session import scratch
from basewise.sinks import write_pairs
from basewise.sources.calls import stream_arrivals, tile_keys
from basewise.streaming.commit import folders, publish
from basewise.streaming.state import keyed_state

#: Tiles transposed in one job of a micro-batch, so that a backlog does not make one job of a whole run.
TILES_AT_ONCE = 64
#: Number of the batch of sentinels, which is published after all others.
LAST_BATCH = 10**9


class _Tile(StatefulProcessor):
    """Keeps which files of a tile have come, one bit each; the tile leaves once, with the last of them."""

    def __init__(self, cycles: int) -> None:
        self.whole = (1 << (cycles + 1)) - 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "bits string, left boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, left = self.seen.get() if self.seen.exists() else ("0", False)
        bits = int(held, 16)
        for frame in rows:
            for cycle in frame["cycle"].unique():
                bits |= 1 << int(cycle)
        goes = bits == self.whole and not left
        self.seen.update((f"{bits:x}", left or goes))
        if goes:
            yield pd.DataFrame({"lane": [key[0]], "tile": [key[1]]})

    def close(self) -> None:
        pass


def complete_tiles(arrivals: DataFrame, cycles: int) -> DataFrame:
    """(lane, tile) as a stream: each tile once, when its filter (cycle 0) and cycles 1 to ``cycles`` have all arrived.

    Files that come again, and cycles after the last used one, change nothing. A state
    is one bit a file.
    """
    used = arrivals.where(F.col("cycle").between(0, cycles))
    return used.groupBy("lane", "tile").transformWithStateInPandas(_Tile(cycles), "lane int, tile int", "Append", "None")


def stream_run(
    spark: SparkSession, options: Options, out: str, checkpoint: str, available_now: bool = False, every: str = "30 seconds",
    files_per_batch: int = 100_000, eos_partitions: int = 1, locs_format: str = "locs",
) -> StreamingQuery:
    """Pairs of each tile below ``out/pairs/batch=<n>/sample=<s>`` as soon as the tile is whole.

    Contents come first (``out/toc``, key 0). After the last tile of the manifest come the
    sentinels, ``eos_partitions`` for each sample, in a batch of their own. A batch appears whole and once, also
    when it is replayed, and holds its tiles' list, so it is known which are done.
    """
    run = load_run(spark, options)
    whole = set(run.tiles)
    toc = contents(spark, options)
    publish(spark, f"{out}/toc", 0, lambda folder: toc.write.parquet(folder))

    def batch(df: DataFrame, number: int) -> None:
        came = [t for t in tile_keys(df) if t in whole]
        if not came:
            return

        def write(folder: str) -> None:
            for at in range(0, len(came), TILES_AT_ONCE):
                with scratch(spark):
                    clusters = tile_clusters(spark, options, run, came[at : at + TILES_AT_ONCE], locs_format=locs_format)
                    write_pairs(pairs_of(spark, options, clusters), folder, mode="append")
            spark.createDataFrame(came, "lane int, tile int").coalesce(1).write.parquet(f"{folder}/_tiles")

        publish(spark, f"{out}/pairs", number, write)
        if done_tiles(spark, out) >= whole:
            empty = spark.createDataFrame([], schemas.PAIRS)
            ends = eos_rows(empty, toc.select("sample"), eos_partitions)
            publish(spark, f"{out}/pairs", LAST_BATCH, lambda folder: write_pairs(ends, folder))

    tiles = complete_tiles(stream_arrivals(spark, options.bcl_input_dir + options.base_dir, files_per_batch), run.cycles)
    writer = tiles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append")
    # A state is a few bytes and its rows are file names: one store for the tiles of a job.
    with keyed_state(spark, -(-len(whole) // TILES_AT_ONCE)):
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def done_tiles(spark: SparkSession, out: str) -> set[tuple[int, int]]:
    """(lane, tile) of every tile published so far."""
    lists = folders(spark, f"{out}/pairs/batch=*/_tiles")
    return set(tile_keys(spark.read.schema("lane int, tile int").parquet(*lists))) if lists else set()
