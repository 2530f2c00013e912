"""Streaming forms: projections pass through, window averages and grids wait for the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.surface import compute_azimuth_and_elevation
from ..plans.neighbours import col
from ..schema import KEY, TS

crop_angles = compute_azimuth_and_elevation  # stateless, so the batch operator serves


def with_event_time(df: DataFrame, delay: str, ts: str = TS) -> DataFrame:
    """Event time in microseconds beside the exact nanoseconds, under a watermark."""
    return df.withColumn("event_time", F.timestamp_micros(F.expr(f"`{ts}` div 1000"))).withWatermark("event_time", delay)


def grid_average(df: DataFrame, step: str, columns: list[str], delay: str = "1 second", key: str = KEY, ts: str = TS) -> DataFrame:
    """Means over tumbling windows of a fixed grid, emitted when the watermark has passed them."""
    timed = with_event_time(df, delay, ts)
    out = timed.groupBy(col(key), F.window("event_time", step)).agg(*[F.avg(col(c)).alias(c) for c in columns], F.count("*").alias("n_samples"))
    return out.select(col(key), (F.unix_micros("window.start") * 1000).alias(ts), *[col(c) for c in columns], "n_samples")


def annotate_live(samples: DataFrame, events: DataFrame, id_col: str, longest: str, delay: str = "1 second", key: str = KEY, ts: str = TS, start: str = "start timestamp [ns]", end: str = "end timestamp [ns]") -> DataFrame:
    """Samples joined with the events that hold them; ``longest`` bounds an event, and so the state."""
    left = with_event_time(samples, delay, ts)
    right = events.withColumn("event_start", F.timestamp_micros(F.expr(f"`{start}` div 1000"))).withWatermark("event_start", delay).withColumnRenamed(key, "__key")
    on = (col(key) == F.col("__key")) & (col(ts) >= col(start)) & (col(ts) <= col(end)) & (F.col("event_time") >= F.col("event_start")) & (F.col("event_time") <= F.col("event_start") + F.expr(f"interval {longest}"))
    return left.join(right, on).select(*[col(c) for c in samples.columns], col(id_col))
