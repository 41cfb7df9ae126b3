"""End of a sample: its sentinel has come on every partition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from basewise.operators.routing import EOS_NAME


class _Sample(StatefulProcessor):
    """Keeps the partitions on which a sample has ended, one bit each; the sample leaves once, with the last."""

    def __init__(self, partitions: int) -> None:
        self.partitions = partitions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ended = handle.getValueState("ended", "bits string, left boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, left = self.ended.get() if self.ended.exists() else ("0", False)
        bits = int(held, 16)
        for frame in rows:
            for part in frame["part"].unique():
                bits |= 1 << int(part)
        goes = bits.bit_count() >= self.partitions and not left
        self.ended.update((f"{bits:x}", left or goes))
        if goes:
            yield pd.DataFrame({"sample": [key[0]], "partitions": [bits.bit_count()]})

    def close(self) -> None:
        pass


def completed_samples(rows: DataFrame, partitions: int, part: Column, aligned: bool = False) -> DataFrame:
    """(sample, partitions) as a stream: each sample once, when sentinels of ``partitions`` different parts have come.

    ``part`` is the number of the partition that a row came by. A sentinel that comes
    again changes nothing. Only sentinels are shuffled; a state is one bit a partition.
    Start the query inside :func:`~basewise.streaming.state.keyed_state`.
    """
    is_end = F.col("name") == EOS_NAME if aligned else F.length("name") <= 1
    ends = rows.where(is_end).select("sample", part.cast("int").alias("part"))
    return ends.groupBy("sample").transformWithStateInPandas(_Sample(partitions), "sample string, partitions int", "Append", "None")
