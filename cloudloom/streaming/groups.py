"""Truth groups of a stream: gap chains that are closed once no later hit can join them.

Hits of an event arrive in any order within the watermark's delay.  Each event keeps the hits of its open chains; a chain
is closed when the watermark has passed its last hit by more than the gap, and its hits leave with the event's next group
number.  Chains of an event close in order of time, so the numbers are those of ``windows.truth_groups`` over all hits.
Timers close chains of events that get no more hits.  State holds open chains only, and a hit that comes after
the watermark is dropped and counted by Spark (``numRowsDroppedByWatermark`` of the progress).

Defined results: hits without a time are not grouped and do not leave; equal times go in order of hit_id; repeated hits
leave as often as they came; times count to the microsecond.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class GapChains(StatefulProcessor):
    """Open hits of one event, and the number of its closed groups."""

    def __init__(self, keys: list[str], gap_micros: int):
        self.keys, self.gap = keys, gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "t long, hit_id long, e double")
        self.closed = handle.getValueState("closed", "n long")

    def _settle(self, key: tuple, hits: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        hits.sort(key=lambda h: h[:2])
        n = self.closed.get()[0] if self.closed.exists() else 0
        ends = [k for k in range(len(hits)) if k + 1 == len(hits) or hits[k + 1][0] - hits[k][0] > self.gap]
        done, out = 0, []
        for end in ends:
            if hits[end][0] + self.gap >= watermark * 1000:
                break
            out += [(*h, n) for h in hits[done : end + 1]]
            done, n = end + 1, n + 1
        left = hits[done:]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left:
            self.open.put(left)
            first = next(hits[end][0] for end in ends if end >= done)
            self.handle.registerTimer((first + self.gap) // 1000 + 1)
        else:
            self.open.clear()
        if out:
            self.closed.update((n,))
            frame = pd.DataFrame(out, columns=["t", "hit_id", "e", "g"])
            for name, value in zip(self.keys, key, strict=True):
                frame.insert(0, name, value)
            yield frame[[*self.keys, "hit_id", "t", "e", "g"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hits = [tuple(h) for h in self.open.get()]
        for part in rows:
            hits += zip(part["t"].tolist(), part["hit_id"].tolist(), part["e"].tolist(), strict=True)
        yield from self._settle(key, hits, max(0, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, [tuple(h) for h in self.open.get()], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def group_stream(hits: DataFrame, keys: list[str], gap: float, delay: str, time: str = "ts") -> DataFrame:
    """Stream of (keys, hit_id, t, e, g): hits of closed chains; ``time`` is a timestamp, t its microseconds, ``gap`` in seconds."""
    from pyspark.sql import types as T

    rows = hits.where(F.col(time).isNotNull()).withWatermark(time, delay)
    rows = rows.select(*keys, time, F.unix_micros(time).alias("t"), F.col("hit_id").cast("long").alias("hit_id"), F.coalesce(F.col("e").cast("double"), F.lit(0.0)).alias("e"))
    made = T.StructType([rows.schema[k] for k in keys] + [T.StructField("hit_id", T.LongType()), T.StructField("t", T.LongType()), T.StructField("e", T.DoubleType()), T.StructField("g", T.LongType())])
    grouped = rows.groupBy(*keys)
    return grouped.transformWithStateInPandas(GapChains(keys, round(gap * 1_000_000)), made, "Append", "EventTime")


def write_groups(spark: SparkSession, groups: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed groups to Parquet at ``path`` until the source has no more; the state store that timers need is set for this query only."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return groups.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
