"""Count windows over a stream of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

_OUT = "name string, sample string, shard int, window long"
_FIELDS = ["name", "b1", "q1", "b2", "q2"]
_PAYLOAD = ", ".join(f"{c} string" for c in _FIELDS)


def _sharded(pairs: DataFrame, shards: int, shard: Column | None, payload: list[str] | None = None) -> DataFrame:
    """(name, sample, shard, eos) and the payload; a sentinel row is sent to every shard of its sample."""
    eos = F.length("name") <= 1
    own = F.pmod(F.xxhash64("name"), F.lit(shards)) if shard is None else shard
    to = F.when(eos, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(own.cast("int")))
    return pairs.select("name", "sample", *(payload or []), eos.alias("eos"), F.explode(to).alias("shard"))


def stream_count_windows(
    pairs: DataFrame, size: int, shards: int = 8, shard: Column | None = None, idle_ms: int | None = None
) -> DataFrame:
    """(name, sample, shard, window): rows leave in windows of ``size``.

    A short rest waits in the state until later batches fill it, a sentinel row ends
    the stream, or nothing came for ``idle_ms``. Samples are split over ``shards``
    keys, so a hot sample is not one task; a state holds fewer than ``size`` names.

    Set ``idle_ms`` for processing-time triggers only: with ``availableNow`` a pending
    timeout keeps the query running empty batches.
    """

    def windows(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sample, shard_no = key
        number, held = state.get if state.exists else (0, "")
        rest = held.split("\n") if held else []
        ended = idle_ms is not None and state.hasTimedOut

        def out(names: list[str]) -> pd.DataFrame:
            return pd.DataFrame({"name": names, "sample": sample, "shard": shard_no, "window": number})

        for frame in frames:
            ended = ended or bool(frame["eos"].any())
            rest += frame.loc[~frame["eos"], "name"].tolist()
            full = len(rest) - len(rest) % size
            for at in range(0, full, size):
                yield out(rest[at : at + size])
                number += 1
            rest = rest[full:]
        if ended and rest:
            yield out(rest)
            number, rest = number + 1, []
        state.update((number, "\n".join(rest)))
        if rest and idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    return _sharded(pairs, shards, shard).groupBy("sample", "shard").applyInPandasWithState(
        windows, _OUT, "number long, held string", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout"
    )


class _Windows(StatefulProcessor):
    """Holds the pairs of one (sample, shard) that fill no window yet, and calls ``close`` once for each window."""

    def __init__(self, size: int, idle_ms: int | None, close: Callable[[pd.DataFrame], pd.DataFrame], ends: bool) -> None:
        self.size, self.idle_ms, self.of_window, self.ends = size, idle_ms, close, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _PAYLOAD)
        self.count = handle.getValueState("count", "windows long, held int, timer long, ended boolean")

    def _closed(self, key: tuple, number: int, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=_FIELDS)
        return self.of_window(frame.assign(sample=key[0], shard=key[1], window=number))

    def _keep(self, number: int, held: int, timer: int, timers: TimerValues, ended: bool) -> None:
        """Notes the counts; a rest waits for ``idle_ms`` from now."""
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = -1
        if self.idle_ms is not None and held:
            timer = timers.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.count.update((number, held, timer, ended))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        number, held, timer, over = self.count.get() if self.count.exists() else (0, 0, -1, False)
        # ``held`` pairs come before ``rest``; full windows leave with the frame that fills them,
        # so that no more than a frame and a window is in memory, however many pairs a key has.
        rest, ended, changed = [], over, False
        for frame in rows:
            ended = ended or bool(frame["eos"].any())
            rest += frame.loc[~frame["eos"], _FIELDS].itertuples(index=False, name=None)
            if held + len(rest) < self.size:
                continue
            if held:
                rest, held = [*map(tuple, self.held.get()), *rest], 0
            full, changed = len(rest) - len(rest) % self.size, True
            for at in range(0, full, self.size):
                yield self._closed(key, number, rest[at : at + self.size])
                number += 1
            rest = rest[full:]
        if ended and held + len(rest):
            yield self._closed(key, number, [*map(tuple, self.held.get() if held else ()), *rest])
            number, rest, held, changed = number + 1, [], 0, True
        if not changed:
            # The list is only added to; it is read when a window closes.
            if rest:
                self.held.appendList(rest)
        elif rest:
            self.held.put(rest)
        else:
            self.held.clear()
        self._keep(number, held + len(rest), timer, timerValues, ended)
        if self.ends and ended and not over:
            yield pd.DataFrame({**{c: [""] for c in _FIELDS}, "sample": [key[0]], "shard": [key[1]], "window": [number]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        number, held, _, over = self.count.get()
        if held:
            yield self._closed(key, number, list(map(tuple, self.held.get())))
            self.held.clear()
            number += 1
        self.count.update((number, 0, -1, over))

    def close(self) -> None:
        pass


def stream_closed_windows(
    pairs: DataFrame, size: int, shards: int = 8, shard: Column | None = None, idle_ms: int | None = None,
    close: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: str | None = None, ends: bool = False,
) -> DataFrame:
    """Whole pairs in windows of ``size``: (name, b1, q1, b2, q2, sample, shard, window), or what ``close`` makes of them.

    ``close`` gets each window once, as a pandas frame of at most ``size`` rows with those
    columns, and returns rows of ``schema``. Rests and samples are as in
    :func:`stream_count_windows`; a rest that waited ``idle_ms`` closes by a timer of the
    state store. Pairs that come after their sample's sentinel form windows at once. With
    ``ends`` a pair without a name follows the last window of each shard of a sample that
    a sentinel ended. A state holds fewer than ``size`` pairs, so all states together hold
    fewer than ``size`` x ``shards`` a sample. Start the query inside
    :func:`~basewise.streaming.state.keyed_state`.
    """
    keyed = _sharded(pairs, shards, shard, ["b1", "q1", "b2", "q2"])
    processor = _Windows(size, idle_ms, close or (lambda frame: frame), ends)
    schema = schema or _PAYLOAD + ", sample string, shard int, window long"
    mode = "None" if idle_ms is None else "ProcessingTime"
    return keyed.groupBy("sample", "shard").transformWithStateInPandas(processor, schema, "Append", mode)
