"""Streaming forms over the events table: windowed counts, sessions, running gaps per user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files whose ts is an event time (a timestamp without zone is cast, as watermarks need one)."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late) if events.isStreaming else events
    return g.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late) if events.isStreaming else events
    return g.groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late) if events.isStreaming else events
    return g.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_gaps(events: DataFrame) -> DataFrame:
    """(user_id, event_id, ratio): each event's gap to the last one of its user over the mean gap of up to five before it.
    State is the last five event times of a user."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        for pdf in pdfs:
            out = []
            for i, x in sorted(zip(pdf["event_id"], pdf["at"])):
                if not seen:
                    r = 0.01
                elif len(seen) == 1:
                    r = seen[0] / (max(x - seen[0], seen[0]) * 1.2)
                else:
                    r = (x - seen[-1] + 0.95) / ((seen[-1] - seen[0]) / (len(seen) - 1) + 1)
                out.append((key[0], i, r))
                seen = (seen + [x])[-5:]
            yield pd.DataFrame(out, columns=["user_id", "event_id", "ratio"])
        state.update((seen,))

    timed = events.withColumn("at", F.unix_micros("ts") / 1e6).select("user_id", "event_id", "at")
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, ratio double", "seen array<double>", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there into Parquet files, then stop; a restart goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
