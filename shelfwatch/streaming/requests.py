"""Request dedupe on a stream: per (source, request) the time of the last fetched success.

A success is remembered for the TTL and no longer: a timer in event time deletes it once the watermark
shows that no request younger than that can still come, so the state holds the successes of one TTL,
whatever the age of the stream. A micro-batch's requests of one key meet in one task and are ordered
there; ``maxFilesPerTrigger`` of the source bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.request_dedupe import KEY

_OUTPUT = "source_id string, request_fp string, ts_us bigint, seq bigint, ok boolean, hit boolean"


class _Anchor(StatefulProcessor):
    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchor = handle.getValueState("anchor", "at_us bigint")

    def _end_ms(self, at_us: int) -> int:
        return -(-(at_us + self.ttl_us) // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.anchor.get()
        before = at = None if state is None else state[0]
        out = []
        for r in sorted(rows, key=lambda r: (r.ts_us, r.seq)):
            hit = at is not None and r.ts_us - at < self.ttl_us
            if r.ok and not hit:
                at = r.ts_us
            out.append(Row(source_id=r.source_id, request_fp=r.request_fp, ts_us=r.ts_us, seq=r.seq, ok=r.ok, hit=hit))
        if at != before:
            if before is not None:
                self.handle.deleteTimer(self._end_ms(before))
            self.anchor.update((at,))
            self.handle.registerTimer(self._end_ms(at))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.anchor.clear()
        yield from ()

    def close(self) -> None:
        pass


def request_dedupe_stream(requests: DataFrame, ttl_seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """Streaming counterpart of ``request_dedupe``; input as from ``dedupe_input``, arriving in time order.

    A request that comes out of order is judged against the success remembered when it comes. One that
    is more than ``lateness`` behind the newest of the batches before it is dropped by the watermark and
    counted in the query's progress (``numRowsDroppedByWatermark``).
    """
    timed = requests.withColumn("_at", F.timestamp_micros("ts_us")).withWatermark("_at", lateness)
    return timed.groupBy(*KEY).transformWithState(
        statefulProcessor=_Anchor(int(ttl_seconds * 1_000_000)),
        outputStructType=_OUTPUT, outputMode="append", timeMode="eventTime",
    )


def remembered(spark: SparkSession, checkpoint: str, batch_id: int) -> DataFrame:
    """(source_id, request_fp, at_us): the successes a query with this checkpoint remembered after a micro-batch."""
    state = spark.read.format("statestore").option("stateVarName", "anchor").option("batchId", batch_id).load(checkpoint)
    return state.select("key.*", "value.at_us")
