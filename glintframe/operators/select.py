"""Cropping, restricting and filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.neighbours import col
from ..schema import DURATION, END, KEY, START, TS, require


def check_not_empty(df: DataFrame, what: str) -> DataFrame:
    """An action: raises where nothing is left."""
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def crop(df: DataFrame, tmin=None, tmax=None, by: str = "timestamp", key: str = KEY, ts: str = TS, negative: bool = False) -> DataFrame:
    """Rows from ``tmin`` to ``tmax``, both included.

    ``by``: ``timestamp`` (ns), ``time`` (seconds from the recording's first row) or
    ``sample`` (0-based position).  A bound may be None, not both.
    """
    if tmin is None and tmax is None:
        raise ValueError("at least one of tmin or tmax must be given")
    if not negative and any(x is not None and x < 0 for x in (tmin, tmax)):
        raise ValueError("bounds must not be negative")
    require(df, key, ts)
    if by == "timestamp":
        at = col(ts)
    elif by == "time":
        at = (col(ts) - F.min(col(ts)).over(Window.partitionBy(col(key)))) / F.lit(1e9)
    elif by == "sample":
        at = F.row_number().over(Window.partitionBy(col(key)).orderBy(col(ts))) - 1
    else:
        raise ValueError("by must be 'timestamp', 'time' or 'sample'")
    if by == "timestamp":  # a plain predicate, so it reaches the scan
        for bound, test in ((tmin, at.__ge__), (tmax, at.__le__)):
            df = df if bound is None else df.where(test(F.lit(int(bound))))
        return df
    out = df.withColumn("__at", at)
    for bound, op in ((tmin, ">="), (tmax, "<=")):
        out = out if bound is None else out.where(F.expr(f"__at {op} {bound!r}" + ("D" if by == "time" else "")))
    return out.drop("__at")


def restrict(df: DataFrame, other: DataFrame, key: str = KEY, ts: str = TS, other_ts: str = TS) -> DataFrame:
    """Rows within the other table's first and last instant, by recording."""
    span = other.groupBy(col(key)).agg(F.min(col(other_ts)).alias("__a"), F.max(col(other_ts)).alias("__b"))
    return df.join(span, key).where((col(ts) >= F.col("__a")) & (col(ts) <= F.col("__b"))).select(*[col(c) for c in df.columns])


def renumbered(events: DataFrame, id_col: str, key: str = KEY, start: str = START) -> DataFrame:
    """Ids anew: 0, 1, ... by start (and old id) within a recording."""
    order = Window.partitionBy(col(key)).orderBy(col(start), col(id_col))
    return events.withColumn(id_col, (F.row_number().over(order) - 1).cast("int"))


def filter_by_duration(events: DataFrame, least=None, most=None, reset_id: str | None = None, key: str = KEY, start: str = START, duration: str = DURATION) -> DataFrame:
    """Events whose duration in ms lies within the bounds, both included."""
    if least is None and most is None:
        raise ValueError("at least one of the bounds must be given")
    require(events, duration)
    out = events
    if least is not None:
        out = out.where(col(duration) >= least)
    if most is not None:
        out = out.where(col(duration) <= most)
    return renumbered(out, reset_id, key, start) if reset_id else out


def filter_by_name(events: DataFrame, names: str | list[str], column: str = "name", reset_id: str | None = None, key: str = KEY, start: str = START) -> DataFrame:
    """Events whose ``column`` is one of the names, exactly."""
    require(events, column)
    out = events.where(col(column).isin([names] if isinstance(names, str) else list(names)))
    return renumbered(out, reset_id, key, start) if reset_id else out


def frame_window(frames: DataFrame, start=None, end=None, by: str = "frame", step: int = 1, key: str = KEY, ts: str = TS, index: str = "frame index") -> DataFrame:
    """Every ``step``-th frame from ``start`` to ``end`` (frames, seconds or ns), both included."""
    at = {"frame": col(index), "timestamp": col(ts), "time": (col(ts) - F.min(col(ts)).over(Window.partitionBy(col(key)))) / F.lit(1e9)}[by]
    out = frames.withColumn("__at", at)
    if start is not None:
        out = out.where(F.col("__at") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("__at") <= F.lit(end))
    first = F.min(col(index)).over(Window.partitionBy(col(key)))
    return out.withColumn("__first", first).where((col(index) - F.col("__first")) % step == 0).drop("__at", "__first")


def with_end(events: DataFrame, end: str = END, start: str = START, duration: str = DURATION) -> DataFrame:
    return events if end in events.columns else events.withColumn(end, col(start) + col(duration) * 1_000_000)
