"""When a streaming program ends."""

from __future__ import annotations

import time

from pyspark.sql.streaming import StreamingQuery


def run_until_idle(query: StreamingQuery, timeout: float, poll: float = 1.0) -> bool:
    """Stops ``query`` once no rows came for ``timeout`` seconds; 0 waits for ever.

    True if it was idle, False if it ended by itself. A running batch is finished.
    """
    if timeout <= 0:
        query.awaitTermination()
        return False
    quiet_since, seen = time.monotonic(), -1
    while not query.awaitTermination(poll):
        progress = query.lastProgress
        busy = query.status["isTriggerActive"] and query.status["isDataAvailable"]
        if progress is not None and progress["batchId"] != seen:
            seen = progress["batchId"]
            busy = busy or progress["numInputRows"] > 0
        if busy:
            quiet_since = time.monotonic()
        elif time.monotonic() - quiet_since >= timeout:
            query.stop()
            return True
    return False
