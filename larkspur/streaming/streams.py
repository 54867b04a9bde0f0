"""Structured Streaming twins of the batch operators; each gives its twin's rows once the input is read.

Stream state is keyed and small: a version per thread, a number per slot. Event-time windows
and watermarks go beyond the reference and are marked so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A Parquet folder as a stream; the schema is that of the files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Read all that is there, in micro-batches, into a Parquet folder; restarts go on where they stopped."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def guarded_versions(writes: DataFrame) -> DataFrame:
    """thread, version, accepted: a write counts only above the highest version its thread has accepted.

    Within a batch writes are taken in the order of ``at``, then version.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (top,) = state.get if state.exists else (-1,)
        rows = pd.concat(list(frames)).sort_values(["at", "version"])
        out = []
        for version in rows["version"]:
            out.append((key[0], int(version), bool(version > top)))
            top = max(top, int(version))
        state.update((top,))
        yield pd.DataFrame(out, columns=["thread", "version", "accepted"])

    return writes.groupBy("thread").applyInPandasWithState(step, "thread long, version long, accepted boolean", "top long", "append", GroupStateTimeout.NoTimeout)


def capacity_holds(requests: DataFrame, capacity: int) -> DataFrame:
    """slot_id, request_id, granted, booked as in the batch fold; the state is the number booked."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (booked,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values(["at", "request_id"])
        out = []
        for request, size in zip(rows["request_id"], rows["size"], strict=True):
            granted = size <= 0 or booked + size <= capacity
            booked = max(0, booked + int(size)) if granted else booked
            out.append((key[0], int(request), bool(granted), booked))
        state.update((booked,))
        yield pd.DataFrame(out, columns=["slot_id", "request_id", "granted", "booked"])

    return requests.groupBy("slot_id").applyInPandasWithState(step, "slot_id long, request_id long, granted boolean, booked long", "booked long", "append", GroupStateTimeout.NoTimeout)


def first_confirmations(requests: DataFrame, key: str, at: str, horizon: str) -> DataFrame:
    """The first request of each key; keys are forgotten once the watermark is past them."""
    return requests.withWatermark(at, horizon).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Spark-native addition: tumbling event-time counts that drop what is later than the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
