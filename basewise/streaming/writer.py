"""Aligned records to rolling parts, a directory per sample, while the aligner still writes."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Iterable
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basewise import schemas
from basewise.operators.routing import drop_eos
from basewise.sinks import write_records
from basewise.streaming.commit import exists, files_below, folders, manifest, move, publish, remove, show, staged

#: Fixed value: bytes at which a part is closed.
ROLL_BYTES = 8 << 20
# Fixed value: the folder name of rows without a sample.
_NO_SAMPLE = "__HIVE_DEFAULT_PARTITION__"


class PartWriter:
    """Records go to small open batches first; a sample's open files become one closed part when they have
    ``roll_bytes``, or when none came for ``idle`` seconds.

    ``<out>/open/batch=<n>`` and ``<out>/parts/part=<n>`` (below ``group=<g>``, if several
    writers share ``out``) each appear whole and once. A part's
    manifest tells, for every sample, the last batch that is in parts (``upto``), so a crash
    at any point leaves each record in exactly one part or open batch, and a new writer of
    the same folder goes on from there. Batches that are all in parts are deleted.

    A batch is written once more only where it must be: samples that have the bytes of a part in one
    batch, and do not wait in an open one, become a part as they were written. Files then
    hold as many rows as those of the part before, so the first part is always made from open batches.
    """

    def __init__(self, spark: SparkSession, out: str, roll_bytes: int = ROLL_BYTES, idle: float = 10.0, group: str | None = None) -> None:
        self.spark, self.roll_bytes, self.idle = spark, roll_bytes, idle
        inside = "" if group is None else f"/group={quote(group)}"
        self.open, self.parts = f"{out}/open{inside}", f"{out}/parts{inside}"
        self.lock, self.rows_a_file = threading.Lock(), 0

    def batch(self, df: DataFrame, number: int) -> None:
        """One micro-batch; a replayed one is in place already, or in parts."""
        with self.lock:
            upto, last = self._rolled()
            if number > upto.get("", -1) and not exists(self.spark, f"{self.open}/batch={number}"):
                # Of a batch that failed half-way some samples are in a part already.
                there = [unquote(s.partition("=")[2]) for s, n in upto.items() if s and n >= number]
                rows = drop_eos(df, aligned=True).where(~F.coalesce(F.nullif("sample", F.lit("")), F.lit(_NO_SAMPLE)).isin(there))
                if self.rows_a_file:
                    self._straight(rows, number, upto, last)
                else:
                    publish(self.spark, self.open, number, lambda folder: write_records(rows, folder))
            self._roll(*self._rolled(), self.idle)

    def close(self, idle: float = 0.0) -> int:
        """Closes the parts of samples without records for ``idle`` seconds; the number of samples closed."""
        with self.lock:
            return self._roll(*self._rolled(), idle)

    def _rolled(self) -> tuple[dict[str, int], int]:
        """Per sample (under '': of batches as a whole) the last batch that is in parts, and the number of the last part."""
        done = folders(self.spark, f"{self.parts}/part=*")
        if not done:
            return {}, -1
        newest = max(done, key=lambda f: int(f.rsplit("=", 1)[1]))
        told = manifest(self.spark, newest)
        self.rows_a_file = told.get("rows_a_file", 0)
        return told["upto"], told["number"]

    def _open(self, upto: dict[str, int]) -> tuple[dict[str, list[tuple[int, str, int, float]]], dict[int, str]]:
        """Per sample folder its files (batch, path, bytes, time) that are in no part yet, and the open batches."""
        files, batches = defaultdict(list), {}
        for folder in folders(self.spark, f"{self.open}/batch=*"):
            told = manifest(self.spark, folder)
            batches[told["number"]] = folder
            for path, size in told["files"]:
                sample = path.split("/", 1)[0]
                if told["number"] > upto.get(sample, -1):
                    files[sample].append((told["number"], f"{folder}/{path}", size, told["time"]))
        return files, batches

    def _straight(self, rows: DataFrame, number: int, upto: dict[str, int], last: int) -> None:
        """Writes a batch in files of a part's size; samples that are due alone are the next part, the others an open batch."""
        aside, rest = staged(self.open, "batch", number), staged(self.open, "batch", number)
        write_records(rows, aside, max_records=self.rows_a_file)
        sizes, largest = defaultdict(int), 0
        for path, size in files_below(self.spark, aside):
            sizes[path.split("/", 1)[0]] += size
            largest = max(largest, size)
        waiting = self._open(upto)[0]
        due = [s for s, size in sizes.items() if size >= self.roll_bytes and s not in waiting]
        if not due:
            show(self.spark, aside, self.open, number)
            return
        others = sizes.keys() - set(due)
        move(self.spark, aside, rest, others)
        # Rows that have become longer make fewer a file from the next batch on.
        fits = max(1, int(self.rows_a_file * min(1, self.roll_bytes / largest)))
        upto = {**upto, **dict.fromkeys(due, number), **({} if others else {"": number})}
        show(self.spark, aside, self.parts, last + 1, "part", self._facts(upto, due, fits))
        if others:
            show(self.spark, rest, self.open, number)

    def _facts(self, upto: dict[str, int], due: Iterable[str], rows_a_file: int) -> dict:
        return {"upto": upto, "samples": sorted(unquote(s.partition("=")[2]) for s in due), "rows_a_file": rows_a_file}

    def _roll(self, upto: dict[str, int], last: int, idle: float) -> int:
        files, batches = self._open(upto)
        now = time.time()
        due = {
            s: own for s, own in files.items()
            if sum(f[2] for f in own) >= self.roll_bytes or now - max(f[3] for f in own) >= idle
        }
        if due:
            upto = {**upto, **{s: max(f[0] for f in own) for s, own in due.items()}}
            upto[""] = max(upto.get("", -1), max(batches))
            paths = [f[1] for own in due.values() for f in own]
            rows = self.spark.read.schema(f"{schemas.SAM}, batch long").option("basePath", self.open).parquet(*paths).drop("batch")
            # Rows of a part, at the bytes a row takes in the open files.
            each = max(1, sum(f[2] for own in due.values() for f in own)) / max(1, rows.count())
            fits = max(1, int(self.roll_bytes / each))
            publish(self.spark, self.parts, last + 1, lambda folder: write_records(rows, folder, max_records=fits), "part", self._facts(upto, due, fits))
        waiting = {f[0] for s, own in files.items() if s not in due for f in own}
        for number, folder in batches.items():
            # The newest stays, so that a replay of it is seen.
            if number not in waiting and number != max(batches):
                remove(self.spark, folder)
        return len(due)


def write_parts_stream(
    records: DataFrame, writer: PartWriter, checkpoint: str, available_now: bool = False, every: str = "10 seconds"
) -> StreamingQuery:
    """Records to ``writer``, batch by batch. Call ``writer.close`` when the stream is idle or has ended."""
    stream = records.writeStream.foreachBatch(writer.batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream.trigger(processingTime=every)).start()


def read_parts(spark: SparkSession, out: str) -> DataFrame:
    """Records in closed parts, with the number of their part."""
    return spark.read.schema(f"{schemas.SAM}, part long").parquet(f"{out}/parts")


def part_files(spark: SparkSession, out: str) -> DataFrame:
    """(part, sample, files, bytes) of the closed parts, from their manifests."""
    rows = []
    for folder in folders(spark, f"{out}/parts/part=*"):
        told = manifest(spark, folder)
        rows += [(told["number"], unquote(path.split("/", 1)[0].partition("=")[2]), size) for path, size in told["files"]]
    files = spark.createDataFrame(rows, "part long, sample string, bytes long")
    return files.groupBy("part", "sample").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
