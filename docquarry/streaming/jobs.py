"""Incremental forms of the table jobs: each run takes what is new and stops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import library
from ..sources import stored


def run_batches(source: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> None:
    """Run step on each batch of new rows until none are left; finished batches aren't repeated."""
    source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def file_source(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def section_ingest(source: DataFrame, target: str, checkpoint: str, key, only, order) -> None:
    """Append new sections that the table at target lacks. A batch that is repeated after a
    failure is written to the same folder again, so it isn't counted twice. Of the table only
    the keys are read, from the folders of other batches by their names."""
    spark = source.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        done = [f for f in stored.folders(spark, target, done=True) if f.startswith("batch=") and f != f"batch={n}"]
        known = spark.read.schema(batch.schema).parquet(*[f"{target}/{f}" for f in done]) if done else batch.limit(0)
        library.dedup_against_library(batch, known.filter(only), key, key, only, order).write.mode("overwrite").parquet(f"{target}/batch={n}")

    run_batches(source, checkpoint, step)


def upsert_stream(source: DataFrame, target: str, checkpoint: str, key: list[str], version: list[str], buckets: int = stored.BUCKETS) -> stored.BucketedTable:
    """Keep the latest row of each key in a bucketed table at target, which is returned. A batch
    is written beside the base; after some batches those buckets are rewritten that they touch.
    A restarted stream goes on from what is there; a batch that is repeated replaces itself."""
    table = stored.BucketedTable(source.sparkSession, target, source.schema, key, version, buckets=buckets)
    run_batches(source, checkpoint, table.add)
    return table


class LatestStatus(StatefulProcessor):
    """For each key the newest known status; rows say whether the cache could answer them.

    A status is forgotten when the stream's watermark is past its time and the hours it holds:
    a timer of its key clears it, so state is as large as the keys of these last hours."""

    def __init__(self, ttl_hours: int = 24):
        self.ttl = ttl_hours * 3600

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "at double, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        state = []
        for at, status in zip(events["ts"].map(pd.Timestamp.timestamp), events["status"], strict=True):
            fresh = held is not None and at - held[0] < self.ttl and held[1] != "unknown"
            held = held if fresh else (at, status)
            state.append("fresh" if fresh else "check")
        self.held.update(held)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int((held[0] + self.ttl) * 1000))
        yield pd.DataFrame({"event_id": events["event_id"], "state": state})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists() and (self.held.get()[0] + self.ttl) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def ttl_cache(events: DataFrame, key: str, hours: int = 24, late: str = "0 seconds") -> DataFrame:
    """event_id, state of a stream event_id, key, ts, status: each row asks the cache, and a
    row that isn't answered renews it. Rows come by time, at most so late."""
    return events.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(LatestStatus(hours), "event_id long, state string", "Append", "EventTime")
