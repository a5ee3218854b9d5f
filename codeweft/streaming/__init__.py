"""Structured Streaming: change records applied to a stored graph, and edges from event streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeweft.operators.store import GraphStore
from codeweft.operators.sync import apply_changes
from codeweft.sources.changes import decode


def change_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of name-status lines (column line) from text files that arrive in folder."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(folder).select(F.col("value").alias("line"))


def follow(lines: DataFrame, root: str, store: GraphStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Applies each micro-batch of change lines to the store.

    A batch that is run again after a failure finds unchanged hashes and changes
    nothing, so files are applied as if once.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_changes(batch.sparkSession, root, store, decode(batch))

    writer = lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): counts by window and type; events later than lateness are dropped."""
    sums = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def next_event_edges(events: DataFrame) -> DataFrame:
    """(source, target): each user's event and the one after it, in order of time, across micro-batches.

    The state of a user is the last event seen; an event that comes with an earlier
    time than that is an edge source for none.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = state.get if state.exists else None
        if last is not None:
            rows = rows[rows["ts"].astype("int64") >= last[1]]
        ids = ([last[0]] if last is not None else []) + rows["event_id"].tolist()
        if len(rows):
            state.update((int(rows["event_id"].iloc[-1]), int(rows["ts"].astype("int64").iloc[-1])))
        yield pd.DataFrame({"source": ids[:-1], "target": ids[1:]})

    return events.groupBy("user_id").applyInPandasWithState(step, "source long, target long", "event_id long, ts long", "append", GroupStateTimeout.NoTimeout)
