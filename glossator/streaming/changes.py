"""Change streams: debounced indexing, late-add checks, alert bursts, pending work with a time limit.

All take streaming or batch DataFrames of (key, ts) changes; a stream needs the watermark, a batch ignores it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

INDEX_QUIET, CHECK_QUIET, ALERT_QUIET = "20 seconds", "15 seconds", "4 seconds"


def timed(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Parquet times without a zone as instants, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def debounced(changes: DataFrame, quiet: str = INDEX_QUIET, late: str = "10 minutes") -> DataFrame:
    """(key, first, last, n, fires): bursts of a key's changes, each of which fires when it has been quiet that long."""
    w = F.session_window("ts", quiet)
    df = changes.withWatermark("ts", late) if changes.isStreaming else changes
    out = df.groupBy("key", w.alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return out.select("key", "first", "last", "n", F.col("w.end").alias("fires"))


def bursts(alerts: DataFrame, quiet: str = ALERT_QUIET, late: str = "1 minute", shown: int = 8) -> DataFrame:
    """(begin, fires, n, titles): one alert for each burst of all keys, with the first titles in order.

    A burst spans all keys, so it is one task's, and its distinct titles are gathered before they are cut: it is for the alerts
    of one reader, not for the changes of a whole lake.
    """
    df = alerts.withWatermark("ts", late) if alerts.isStreaming else alerts
    got = df.groupBy(F.session_window("ts", quiet).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("title")), 1, shown).alias("titles"))
    return got.select(F.col("w.start").alias("begin"), F.col("w.end").alias("fires"), "n", "titles")


def recent(adds: DataFrame, now: Any, minutes: int = 10) -> DataFrame:
    """Items added no longer ago than that."""
    return adds.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"interval {minutes} minutes"))


def check_new(adds: DataFrame, hashes: DataFrame, ignored: DataFrame) -> DataFrame:
    """New files (key, hash) that equal other known files: (key, other, hash). A join of the stream with static tables."""
    known = hashes.join(ignored.select("hash").distinct(), "hash", "left_anti").select("hash", F.col("key").alias("other"))
    return adds.join(known, "hash").where("key != other").select("key", "other", "hash")


def index_changes(changes: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, quiet: str = INDEX_QUIET, late: str = "10 minutes", once: bool = False) -> StreamingQuery:
    """Run ``handle`` on each batch of debounced changes; with ``once``, on what there is now."""
    writer = debounced(changes, quiet, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=quiet)).start()


def pending(changes: DataFrame, hours: int = 24, late: str = "10 minutes") -> DataFrame:
    """(key, outcome, at): started work and what came of it - done when the file's size changes, expired after a time without.

    changes: (key, kind, size, ts) with kind started or seen.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (size, at) = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "outcome": ["expired"], "at": [pd.Timestamp(at, unit="ms")]})
            return
        rows = pd.concat(batches).sort_values("ts", kind="stable")
        held = state.get if state.exists else None
        out = []
        for r in rows.itertuples():
            at = int(r.ts.timestamp() * 1000)
            if r.kind == "started":
                held = (int(r.size), at)
            elif held and int(r.size) != held[0]:
                out.append((key[0], "done", r.ts))
                held = None
        if held:
            state.update(held)
            state.setTimeoutTimestamp(max(held[1] + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "outcome", "at"])

    df = changes.withWatermark("ts", late)
    return df.groupBy("key").applyInPandasWithState(step, "key string, outcome string, at timestamp", "size long, at long", "append", GroupStateTimeout.EventTimeTimeout)


def coalesced(events: DataFrame, every: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """(begin, n, keys): events together by a fixed interval, one refresh each; keys: how many differ, about."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    got = df.groupBy(F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("key").alias("keys"))
    return got.select(F.col("w.start").alias("begin"), "n", "keys")


def throttled(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Run handle at most once an interval, on what has come since."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(processingTime=every).start()
