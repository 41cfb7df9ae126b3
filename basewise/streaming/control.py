"""Contents as a stream that starts work, and when that work ends."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

from basewise import schemas


class Activity(StreamingQueryListener):
    """When each query last had rows, from the session's own events."""

    def __init__(self) -> None:
        self.last: dict[str, float] = {}
        self.lock = threading.Lock()

    def _seen(self, query: object) -> None:
        with self.lock:
            self.last[str(query)] = time.monotonic()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        self._seen(event.id)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        if event.progress.numInputRows > 0:
            self._seen(event.progress.id)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        with self.lock:
            self.last.pop(str(event.id), None)

    def quiet_for(self) -> float:
        """Seconds since any of the queries had rows."""
        with self.lock:
            return time.monotonic() - max(self.last.values()) if self.last else 0.0


class Controller:
    """Follows a table of contents and starts one query for each new group of samples.

    ``start(group)`` gets the samples of a group, sorted, and gives its queries. A sample is
    started once, however often contents name it. The queries are started by ``step``, in
    the caller's thread. ``timeout`` is the number of quiet seconds after which the work
    counts as over; 0 is never.
    """

    def __init__(
        self, spark: SparkSession, contents: DataFrame, key: int, group_size: int, start: Callable[[list[str]], list[StreamingQuery]], checkpoint: str,
        timeout: float = 0, every: str = "1 second",
    ) -> None:
        self.spark, self.key, self.group_size, self.start, self.timeout = spark, key, group_size, start, timeout
        self.started: set[str] = set()
        self.waiting: queue.SimpleQueue[list[str]] = queue.SimpleQueue()
        self.queries: list[StreamingQuery] = []
        self.activity = Activity()
        spark.streams.addListener(self.activity)
        # The checkpoint is of this run alone: a new run starts its samples anew, each from its own checkpoint.
        self.watcher = contents.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

    def _batch(self, df: DataFrame, number: int) -> None:
        # Contents have one row a sample.
        rows = df.where(F.col("key") == self.key).select("id", "sample").distinct().orderBy("id").collect()
        new = [r["sample"] for r in rows if r["sample"] not in self.started]
        self.started.update(new)
        for at in range(0, len(new), self.group_size):
            self.waiting.put(new[at : at + self.group_size])

    def step(self) -> None:
        """Starts what contents named since the last step; raises what made a query fail."""
        while not self.waiting.empty():
            self.queries += self.start(self.waiting.get())
        for query in [self.watcher, *self.queries]:
            if query.exception() is not None:
                raise query.exception()

    def quiet(self) -> bool:
        return self.timeout > 0 and self.activity.quiet_for() >= self.timeout

    def finish(self) -> None:
        """What is left to do when all input has come."""
        for query in self.queries:
            query.processAllAvailable()

    def stop(self) -> None:
        """Stops the queries; a running batch that is not finished is done again by the next start."""
        for query in [self.watcher, *self.queries]:
            if query.isActive:
                query.stop()
        self.spark.streams.removeListener(self.activity)


def run_live(controllers: list[Controller], done: Callable[[], bool] = lambda: False, poll: float = 0.5) -> bool:
    """Keeps the programs going until ``done`` (True), or until all of them are quiet for their timeouts (False).

    In either case what has come is finished before the queries stop.
    """
    try:
        while True:
            for c in controllers:
                c.step()
            over = done()
            if over or all(c.quiet() for c in controllers):
                for c in controllers:
                    c.finish()
                return over
            time.sleep(poll)
    finally:
        for c in controllers:
            c.stop()


def stream_contents(spark: SparkSession, path: str) -> DataFrame:
    """Contents as a stream of (key, id, sample)."""
    return spark.readStream.schema(schemas.TOC).option("recursiveFileLookup", "true").parquet(path)
