"""Samples and event intervals: annotation, masking and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.neighbours import PREV, around, col
from ..plans.ranges import within
from ..schema import END, KEY, START, TS, channels, require
from .align import interpolate


def annotate_events(df: DataFrame, events: DataFrame, id_col: str, key: str = KEY, ts: str = TS, start: str = START, end: str = END) -> DataFrame:
    """``df`` with the id of the event that holds the sample (ends included), or null.

    Of overlapping events the one that started last counts (of equal starts the
    smallest id), provided the sample is before its end.  One shuffle.
    """
    require(events, id_col, start, end)
    held = events.select(col(key), col(start).alias(ts), col(end).alias("__end"), col(id_col).alias("__id"))
    keep = [c for c in df.columns if c != id_col]
    out = around(held, df.select(*[col(c) for c in keep]), ["__id", "__end"], key, ts)
    return out.select(*[col(c) for c in keep], F.when(col(ts) <= F.col(f"{PREV}.c1"), F.col(f"{PREV}.c0")).alias(id_col))


def annotate_overlapping(df: DataFrame, events: DataFrame, id_col: str, key: str = KEY, ts: str = TS, start: str = START, end: str = END, bin_ns: int | None = None) -> DataFrame:
    """``df`` with the sorted ids of all events that hold the sample."""
    slim = events.select(col(key), col(start).alias("__start"), col(end).alias("__end"), col(id_col).alias("__id"))
    found = within(df.select(col(key), col(ts)).distinct(), slim, "__start", "__end", key, ts, bin_ns).groupBy(col(key), col(ts)).agg(F.sort_array(F.collect_set("__id")).alias(f"{id_col}s"))
    return df.join(found, [key, ts], "left")


def masked(df: DataFrame, events: DataFrame, buffer_ms: float = 0, key: str = KEY, ts: str = TS, start: str = START, end: str = END) -> DataFrame:
    """``df`` with ``__inside``: whether any event, widened by the buffer, holds the sample.

    The running maximum of widened ends over the starts so far decides, so the cost
    is a sort, however events overlap.
    """
    buffer = int(buffer_ms * 1e6)
    edges = events.select(col(key), (col(start) - buffer).alias(ts), (col(end) + buffer).alias("__end"), F.lit(0).alias("__kind"))
    both = df.withColumn("__kind", F.lit(1)).unionByName(edges, allowMissingColumns=True)
    w = Window.partitionBy(col(key)).orderBy(col(ts), "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("__reach", F.max("__end").over(w)).where("__kind = 1")
    return out.select(*[col(c) for c in df.columns], F.coalesce(F.col("__reach") >= col(ts), F.lit(False)).alias("__inside"))


def drop_events(df: DataFrame, events: DataFrame, buffer_ms: float = 0, **names) -> DataFrame:
    """Samples that no (widened) event holds."""
    return masked(df, events, buffer_ms, **names).where("not __inside").drop("__inside")


def interpolate_events(df: DataFrame, events: DataFrame, buffer_ms: float = 0, float_kind: str = "linear", other_kind: str = "nearest", max_gap_ms: float | None = None, key: str = KEY, ts: str = TS, start: str = START, end: str = END) -> DataFrame:
    """Samples inside events get values from their neighbours outside; all others stay.

    Samples before the first or after the last one outside become null, and so does
    everything where no sample is outside.
    """
    kept = drop_events(df, events, buffer_ms, key=key, ts=ts, start=start, end=end)
    columns = channels(df, key, ts)
    return interpolate(kept, df.select(col(key), col(ts)), columns, float_kind, other_kind, max_gap_ms, key, ts).select(*[col(c) for c in df.columns])
