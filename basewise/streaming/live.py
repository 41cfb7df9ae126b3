"""The aligner and the writer as live programs: contents start them, sample group by sample group."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basewise import schemas
from basewise.operators.reference import ReferenceIndex, reference_index
from basewise.options import Options
from basewise.plans.aligner import republish_toc
from basewise.streaming.commit import publish, stream_published
from basewise.streaming.complete import completed_samples
from basewise.streaming.control import Controller, stream_contents
from basewise.streaming.pipeline import align_stream
from basewise.streaming.state import keyed_state
from basewise.streaming.writer import ROLL_BYTES, PartWriter, write_parts_stream

#: Samples that one aligner, or one writer, takes care of.
ALIGNER_GROUP, WRITER_GROUP = 3, 4


def live_aligner(
    spark: SparkSession, options: Options, data: str, reference: DataFrame | ReferenceIndex, checkpoint: str, k: int | None = None,
    shards: int = 8, group_size: int = ALIGNER_GROUP, every: str = "30 seconds",
) -> Controller:
    """Maps pairs below ``data/pairs`` in windows of ``rapi_win`` to ``data/records/group=<first sample>``.

    Started by contents with key 0, which it publishes again with key 1. Ends after
    ``aligner_timeout`` quiet seconds (0: never). Started again with the same
    ``checkpoint`` it reads the contents anew and goes on with each group where it was.
    """
    index = reference if isinstance(reference, ReferenceIndex) else reference_index(reference, k or options.seed_length)

    def start(group: list[str]) -> list[StreamingQuery]:
        pairs = stream_published(spark, f"{data}/pairs", schemas.PAIRS).where(F.col("sample").isin(group))
        query = align_stream(
            pairs, index, f"{data}/records/group={quote(group[0])}", f"{checkpoint}/align-{group[0]}", every=every, window=options.rapi_win, shards=shards,
            stores=len(group) * shards,
        )
        rows = spark.createDataFrame([(0, i, s) for i, s in enumerate(group)], schemas.TOC)
        publish(spark, f"{data}/toc/aligned-{group[0]}", 1, lambda folder: republish_toc(rows).write.parquet(folder))
        return [query]

    return Controller(spark, stream_contents(spark, f"{data}/toc"), 0, group_size, start, f"{checkpoint}/contents-{uuid.uuid4().hex}", options.aligner_timeout)


class LiveWriter(Controller):
    """The writer's controller; knows which samples are complete, also after a start anew: it counts all sentinels again."""

    def __init__(
        self, spark: SparkSession, options: Options, data: str, checkpoint: str, shards: int = 8, group_size: int = WRITER_GROUP,
        roll_bytes: int = ROLL_BYTES, idle: float = 10.0, every: str = "10 seconds",
    ) -> None:
        self.options, self.data, self.state, self.shards, self.roll_bytes, self.idle, self.every = options, data, checkpoint, shards, roll_bytes, idle, every
        self.parts: dict[str, PartWriter] = {}
        self.complete: set[str] = set()
        super().__init__(spark, stream_contents(spark, f"{data}/toc"), 1, group_size, self._start, f"{checkpoint}/contents-{uuid.uuid4().hex}", options.writer_timeout)

    def _start(self, group: list[str]) -> list[StreamingQuery]:
        def records() -> DataFrame:
            return stream_published(self.spark, f"{self.data}/records", schemas.SAM, "group string, batch long").where(F.col("sample").isin(group))

        def ended(df: DataFrame, number: int) -> None:
            self.complete.update(r["sample"] for r in df.select("sample").collect())

        self.parts[group[0]] = PartWriter(self.spark, self.options.cram_output_dir, self.roll_bytes, self.idle, group[0])
        # Only sentinels come to this state: one store for all samples of the group.
        with keyed_state(self.spark, 1):
            done = completed_samples(records(), self.shards, F.col("pos"), aligned=True).writeStream.foreachBatch(ended)
            done = done.option("checkpointLocation", f"{self.state}/done-{uuid.uuid4().hex}").trigger(processingTime=self.every).start()
        return [done, write_parts_stream(records(), self.parts[group[0]], f"{self.state}/write-{group[0]}", every=self.every)]

    def finish(self) -> None:
        """Writes all that has come and closes every part."""
        super().finish()
        for part in self.parts.values():
            part.close()
