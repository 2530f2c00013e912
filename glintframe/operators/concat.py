"""Putting streams on one clock, and events of all kinds in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.neighbours import col
from ..schema import DURATION, END, KEY, NOMINAL_RATES, START, TS, channels
from .align import interpolate


def concat(left: DataFrame, right: DataFrame, key: str = KEY, ts: str = TS, **how) -> DataFrame:
    """``left`` with the columns of ``right`` at its instants; columns of equal name are ``left``'s."""
    new = [c for c in channels(right, key, ts) if c not in left.columns]
    return interpolate(right, left, new, key=key, ts=ts, **how).select(*[col(c) for c in left.columns], *[col(c) for c in new])


def common_grid(streams: list[DataFrame], rate_hz: float, key: str = KEY, ts: str = TS) -> DataFrame:
    """(recording, instant) from the latest first sample, before the earliest last one."""
    spans = [s.groupBy(col(key)).agg(F.min(col(ts)).alias("a"), F.max(col(ts)).alias("b")) for s in streams]
    both = reduce(DataFrame.unionByName, spans).groupBy(col(key)).agg(F.max("a").alias("a"), F.min("b").alias("b"), F.count("*").alias("n"))
    return both.where(f"n = {len(streams)} and b > a").select(col(key), F.explode(F.sequence("a", F.col("b") - 1, F.lit(int(1e9 / rate_hz)))).alias(ts))


def sampling_rate(names: list[str], rate: str | float) -> float:
    if isinstance(rate, str):
        if rate not in ("min", "max"):
            raise ValueError("the sampling rate must be 'min', 'max' or a number")
        return float({"min": min, "max": max}[rate](NOMINAL_RATES[n] for n in names))
    return float(rate)


def concat_streams(streams: dict[str, DataFrame], rate: str | float = "min", key: str = KEY, ts: str = TS, float_kind: str = "linear", other_kind: str = "nearest") -> DataFrame:
    """All streams interpolated, without a gap limit, onto one uniform clock; the first column of a name counts."""
    if len(streams) < 2:
        raise ValueError("at least two streams are needed")
    out = common_grid(list(streams.values()), sampling_rate(list(streams), rate), key, ts)
    for s in streams.values():
        new = [c for c in channels(s, key, ts) if c not in out.columns]
        out = interpolate(s, out, new, float_kind, other_kind, None, key, ts)
    return out


def concat_events(kinds: dict[str, DataFrame], key: str = KEY, ts: str = TS) -> DataFrame:
    """One event table: physiological events and messages, with ``type``, numbered by start, type and old order."""
    if len(kinds) < 2:
        raise ValueError("at least two kinds of events are needed")
    parts = []
    for name, df in kinds.items():
        if name == "events":
            df = df.select(*[col(c).alias({ts: START, "name": "message name", "type": "message type"}.get(c, c)) for c in df.columns if c != "event id"]).withColumn("type", F.lit("event"))
        else:
            df = df.drop("type").withColumn("type", F.lit(name.removesuffix("s")))
        parts.append(df)
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    ids = [c for c in ("blink id", "fixation id", "saccade id") if c in both.columns]
    order = Window.partitionBy(col(key)).orderBy(col(START), col("type"), *[col(c) for c in ids], *[col(c) for c in ("message name",) if c in both.columns])
    front = [key, *[c for c in (START, END, DURATION, "type") if c in both.columns]]
    return both.withColumn("event id", (F.row_number().over(order) - 1).cast("int")).select(col(key), col("event id"), *[col(c) for c in front[1:]], *[col(c) for c in both.columns if c not in (*front, "event id")])
