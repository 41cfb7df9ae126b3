"""Settings of keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession, stores: int | None = None) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which lists and timers need; it lives on disk, not on the heap.

    Every batch opens each store of a query and a Python worker for it, whether rows come
    or not, so ``stores`` may name how many are enough: no more than there are keys. The
    session's shuffle partitions remain the upper bound. A query that goes on from a
    checkpoint keeps the stores it began with.
    """
    before = {name: spark.conf.get(name, None) for name in (_PROVIDER, _PARTITIONS)}
    spark.conf.set(_PROVIDER, _ROCKS)
    if stores is not None:
        spark.conf.set(_PARTITIONS, max(1, min(stores, int(spark.conf.get(_PARTITIONS)))))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
