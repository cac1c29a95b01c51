"""Structured Streaming: rate limits, expiring caches, incremental indexing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.chunking import fixed_size
from quarry.operators.store import rate_limited


def rate_limit_stream(events: DataFrame, by: str = "user_id", most: int = 100, late: str = "2 minutes") -> DataFrame:
    """Windows of a minute in which a group searched too often; final once the watermark has passed."""
    return rate_limited(events.withWatermark("ts", late), by, most)


def session_stream(events: DataFrame, by: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap).alias("w")
    return events.withWatermark("ts", late).groupBy(by, w).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def cached_stream(lookups: DataFrame, ttl_ms: int) -> DataFrame:
    """(key, ts) lookups against a cache whose entries live for ``ttl_ms`` from their last load: key, hits, misses.

    Counts are those of one batch, to be added up: the state is the entry's end alone and
    goes with the entry.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (until,) = state.get if state.exists else (0,)
        hits = misses = 0
        for ts in sorted(int(t.timestamp() * 1000) for b in batches for t in b["ts"]):
            if ts < until:
                hits += 1
            else:
                misses, until = misses + 1, ts + ttl_ms
        state.update((until,))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "hits": [hits], "misses": [misses]})

    late = lookups.withWatermark("ts", "1 minute")
    return late.groupBy("key").applyInPandasWithState(step, "key string, hits long, misses long", "until long", "update", GroupStateTimeout.EventTimeTimeout)


def index_stream(docs: DataFrame, path: str, checkpoint: str, split: Callable[[DataFrame], DataFrame] = fixed_size):
    """Chunk documents as they arrive and append them; a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        split(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
