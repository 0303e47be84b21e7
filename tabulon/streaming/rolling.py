"""Streams of requests: rolling latency and flag rates, sessions, and the image cache as keyed state."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, *, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rolling_latency(events: DataFrame, *, window: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Per window and type: requests, mean, approximate p50 and p95, share of slow ones; rows later than ``late`` are left out."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = events.groupBy(F.window("ts", window, slide), "event_type")
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile_approx("value", [0.5, 0.95]).alias("p"), F.avg((F.col("value") > 200).cast("double")).alias("slow")).select(F.col("window.start").alias("start"), "event_type", "n", "mean", F.get("p", F.lit(0)).alias("p50"), F.get("p", F.lit(1)).alias("p95"), "slow")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def streaming_cache_hits(events: DataFrame, *, server: str, key: str, capacity: int = 64) -> DataFrame:
    """server, event_id, hit for a stream, with one least-recently-used cache of ``capacity`` keys per server as state."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = OrderedDict.fromkeys(state.get[0] if state.exists else [])
        for batch in batches:
            batch = batch.sort_values("event_id")
            hits = []
            for k in batch["key"]:
                hits.append(k in held)
                held[k] = None
                held.move_to_end(k)
                if len(held) > capacity:
                    held.popitem(last=False)
            yield pd.DataFrame({"server": group[0], "event_id": batch["event_id"], "hit": hits})
        state.update((list(held),))

    rows = events.select(F.col(server).cast("string").alias("server"), "event_id", F.col(key).cast("string").alias("key"))
    return rows.groupBy("server").applyInPandasWithState(step, "server string, event_id long, hit boolean", "keys array<string>", "append", GroupStateTimeout.NoTimeout)
