"""Run-time lateral: a sub-query built and run once for each message of a stream, one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row

from spanloom.errors import DialectError
from spanloom.streaming.streams import base_dir


def per_message(messages: DataFrame, order: list[str], run: Callable[[Row, int], None], span: tuple[str, str] | None = None, limit: int = 1000) -> None:
    """Call ``run(message, number)`` for the messages in ``order``; their count per batch is bounded by ``limit``.

    With ``span`` (names of start and end) a message whose span overlaps an earlier one's is refused. Control
    messages are few by nature; a batch of more than ``limit`` is refused rather than gathered.
    """
    busy = {"until": float("-inf"), "number": 0}

    def batch(df: DataFrame, _: int) -> None:
        rows = df.orderBy(*order).limit(limit + 1).collect()
        if len(rows) > limit:
            raise DialectError("ROW_COUNT_MISMATCH", f"more than {limit} messages in a batch")
        for r in rows:
            if span:
                if r[span[0]] < busy["until"]:
                    raise DialectError("UNSUPPORTED_SQL", f"an instance from {r[span[0]]} on overlaps one that runs to {busy['until']}")
                busy["until"] = r[span[1]]
            run(r, busy["number"])
            busy["number"] += 1

    if not messages.isStreaming:
        batch(messages, 0)
        return
    q = messages.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base_dir(messages.sparkSession)}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
