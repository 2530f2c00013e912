"""What a stream's timestamps say: differences, rates, regularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.neighbours import col
from ..schema import KEY, TS


def ts_diff(df: DataFrame, key: str = KEY, ts: str = TS) -> DataFrame:
    """Each sample but the first of a recording, with its distance from the one before."""
    w = Window.partitionBy(col(key)).orderBy(col(ts))
    return df.withColumn("ts_diff", col(ts) - F.lag(col(ts)).over(w)).where("ts_diff is not null")


def relative_time(df: DataFrame, key: str = KEY, ts: str = TS) -> DataFrame:
    """Seconds since the recording's first sample, as ``time``."""
    return df.withColumn("time", (col(ts) - F.min(col(ts)).over(Window.partitionBy(col(key)))) / F.lit(1e9))


def summary(df: DataFrame, key: str = KEY, ts: str = TS) -> DataFrame:
    """By recording: samples, first and last instant, duration in s, mean rate in Hz.  One combined aggregate."""
    span = F.max(col(ts)) - F.min(col(ts))
    return df.groupBy(col(key)).agg(
        F.count("*").alias("n_samples"), F.min(col(ts)).alias("first_ts"), F.max(col(ts)).alias("last_ts"),
        (span / F.lit(1e9)).alias("duration"), F.try_divide(F.lit(1e9) * (F.count("*") - 1), span).alias("sampling_freq_effective"),
    )


def is_uniform(df: DataFrame, key: str = KEY, ts: str = TS) -> DataFrame:
    """Whether all distances equal the first one to 1e-5 of it (plus 1e-8)."""
    d = ts_diff(df, key, ts)
    w = Window.partitionBy(col(key)).orderBy(col(ts))
    d = d.withColumn("__first", F.first("ts_diff").over(w))
    return d.groupBy(col(key)).agg(F.every(F.abs(F.col("ts_diff") - F.col("__first")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col("__first"))).alias("is_uniform"))


def time_to_ts(df: DataFrame, times: DataFrame, key: str = KEY, ts: str = TS, time: str = "time") -> DataFrame:
    """For a table of (recording, seconds): the nearest sample's instant, the earlier of a tie."""
    from ..plans.neighbours import NEXT, PREV, around

    first = df.groupBy(col(key)).agg(F.min(col(ts)).alias("__first"))
    asked = times.join(first, key).withColumn(ts, F.col("__first") + F.round(col(time) * F.lit(1e9)).cast("bigint"))
    near = around(df, asked, [], key, ts)
    p, n, t = F.col(f"{PREV}.t"), F.col(f"{NEXT}.t"), col(ts)
    pick = F.when(p.isNull(), n).when(n.isNull() | ((t - p) <= (n - t)), p).otherwise(n)
    return near.select(col(key), col(time), pick.alias(ts))


def gaps(df: DataFrame, max_gap_ms: float, key: str = KEY, ts: str = TS) -> DataFrame:
    """By recording: how many distances reach the limit, and the largest."""
    limit = int(max_gap_ms * 1e6)
    return ts_diff(df, key, ts).groupBy(col(key)).agg(F.count_if(F.col("ts_diff") >= limit).alias("n_gaps"), F.max("ts_diff").alias("largest_gap"))
