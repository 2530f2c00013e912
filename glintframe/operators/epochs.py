"""Event-locked windows over streams and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.neighbours import col
from ..plans.ranges import within
from ..schema import CIRCULAR_COLUMNS, KEY, START, TS, channels, require
from .align import interpolate

FACTORS = {"s": 1e9, "ms": 1e6, "us": 1e3, "ns": 1}
INFO = ("t_ref", "t_before", "t_after", "description")


def _ns(value, unit: str):
    if unit not in FACTORS:
        raise ValueError(f"unit must be one of {list(FACTORS)}")
    return ((value if not isinstance(value, (int, float)) else F.lit(value)) * F.lit(FACTORS[unit])).cast("bigint")


def epochs_info(refs: DataFrame, t_before, t_after, description="description", ref_unit: str = "ns", other_unit: str = "s", global_t_ref: int = 0, key: str = KEY, t_ref: str = "t_ref") -> DataFrame:
    """One row per reference: its window and index (by reference time) in its recording.

    ``t_before``, ``t_after``: numbers or columns; ``description``: a column of
    ``refs`` if it has one of that name, else the text itself.
    """
    what = col(description) if description in refs.columns else F.lit(description)
    out = refs.select(col(key), (_ns(col(t_ref), ref_unit) + F.lit(int(global_t_ref))).alias("t_ref"), _ns(t_before, other_unit).alias("t_before"), _ns(t_after, other_unit).alias("t_after"), what.cast("string").alias("description"))
    out = out.withColumn("t_start", F.col("t_ref") - F.col("t_before")).withColumn("t_end", F.col("t_ref") + F.col("t_after"))
    order = Window.partitionBy(col(key)).orderBy("t_ref", "description")
    return out.withColumn("epoch index", (F.row_number().over(order) - 1).cast("int"))


def events_to_epochs_info(events: DataFrame, t_before, t_after, unit: str = "s", event_name: str | list[str] | None = None, kind: str = "events", key: str = KEY, start: str = START, ts: str = TS) -> DataFrame:
    """Windows around event starts; messages are described by name and may be chosen by it."""
    at = start if start in events.columns else ts
    if kind in ("blinks", "fixations", "saccades"):
        refs = events.select(col(key), col(at).alias("t_ref"), F.lit(kind.removesuffix("s")).alias("description"))
    else:
        name = require(events, "name") and "name"
        if event_name is not None:
            events = events.where(col(name).isin([event_name] if isinstance(event_name, str) else list(event_name)))
        refs = events.select(col(key), col(at).alias("t_ref"), col(name).alias("description"))
    return epochs_info(refs, t_before, t_after, "description", "ns", unit, key=key)


def slices(source: DataFrame, info: DataFrame, key: str = KEY, ts: str = TS, bin_ns: int | None = None) -> DataFrame:
    """Samples of every epoch, long: with ``epoch index`` and ``epoch time [ns]``; epochs may overlap."""
    slim = info.select(col(key), "t_ref", "t_start", "t_end", col("epoch index"))
    out = within(source, slim, "t_start", "t_end", key, ts, bin_ns)
    return out.select(*[col(c) for c in source.columns], col("epoch index"), (col(ts) - F.col("t_ref")).alias("epoch time [ns]"))


def empty_epochs(source: DataFrame, info: DataFrame, key: str = KEY, ts: str = TS, bin_ns: int | None = None) -> DataFrame:
    """Epochs without a sample."""
    full = slices(source.select(col(key), col(ts)), info, key, ts, bin_ns).select(col(key), col("epoch index")).distinct()
    return info.join(full, [key, "epoch index"], "left_anti")


def overlaps(info: DataFrame, key: str = KEY) -> DataFrame:
    """By recording: epochs, those that start before an earlier one ends, and whether all lengths are equal."""
    w = Window.partitionBy(col(key)).orderBy("t_ref", col("epoch index"))
    marked = info.withColumn("__o", F.coalesce(F.col("t_start") < F.lag("t_end").over(w), F.lit(False)))
    equal = (F.min("t_before") == F.max("t_before")) & (F.min("t_after") == F.max("t_after"))
    return marked.groupBy(col(key)).agg(F.count("*").alias("n_epochs"), F.count_if("__o").alias("n_overlaps"), equal.alias("is_equal_length"))


def annotate_source(source: DataFrame, info: DataFrame, key: str = KEY, ts: str = TS, bin_ns: int | None = None) -> DataFrame:
    """Every sample with the sorted indices of the epochs that hold it (an empty list for none)."""
    found = slices(source.select(col(key), col(ts)).distinct(), info, key, ts, bin_ns)
    lists = found.groupBy(col(key), col(ts)).agg(F.sort_array(F.collect_set(col("epoch index"))).alias("epoch indices"))
    return source.join(lists, [key, ts], "left").withColumn("epoch indices", F.coalesce(col("epoch indices"), F.array().cast("array<int>")))


def tensor(source: DataFrame, info: DataFrame, rate_hz: float, columns: list[str] | None = None, float_kind: str = "linear", other_kind: str = "nearest", key: str = KEY, ts: str = TS) -> DataFrame:
    """Long tensor: every epoch's uniform grid (end excluded) with the source interpolated onto it.

    All epochs' grids go through one neighbour search; only ``columns`` are read.
    """
    columns = columns or channels(source, key, ts)
    step = int(1e9 / rate_hz)
    grid = info.where(F.col("t_before") + F.col("t_after") > 0).select(col(key), col("epoch index"), "t_ref", F.posexplode(F.sequence(-F.col("t_before"), F.col("t_after") - 1, F.lit(step))).alias("time index", "epoch time [ns]"))
    grid = grid.withColumn(ts, F.col("t_ref") + col("epoch time [ns]")).drop("t_ref")
    out = interpolate(source, grid, columns, float_kind, other_kind, None, key, ts)
    return out.select(col(key), col("epoch index"), col("time index"), col("epoch time [ns]"), *[col(c) for c in columns])


def to_arrays(cells: DataFrame, columns: list[str], key: str = KEY) -> DataFrame:
    """One row per epoch and channel with its values in time order."""
    long = cells.select(col(key), col("epoch index"), col("time index"), F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), col(c).cast("double").alias("value")) for c in columns])).alias("x"))
    pairs = F.sort_array(F.collect_list(F.struct(col("time index"), F.col("x.value").alias("v"))))
    return long.groupBy(col(key), col("epoch index"), F.col("x.channel").alias("channel")).agg(F.transform(pairs, lambda p: p["v"]).alias("values"))


def grand_average(cells: DataFrame, columns: list[str], key: str = KEY) -> DataFrame:
    """Mean and population deviation over epochs, by time index."""
    return cells.groupBy(col(key), col("time index")).agg(*[f(col(c)).alias(f"{n} {c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def apply_baseline(epochs: DataFrame, baseline: tuple[float | None, float | None] = (None, 0), method: str = "mean", columns: list[str] | None = None, exclude: tuple[str, ...] = (), key: str = KEY, half_turn: float = 1e-9) -> DataFrame:
    """Correct each epoch's doubles by the mean, or the line, of its baseline window (seconds, ends included).

    Epochs whose window holds nothing (or, for the line, under two samples or any
    null) stay as they are.  Circular columns are wrapped to [-180, 180) afterwards;
    with a ``half_turn`` of 0 as ``x - 360 * floor(x / 360)`` gives it in doubles,
    which is 180 where an angle is below -180 by its last bits.
    """
    low, high = baseline
    if low is None and high is None:
        raise ValueError("the baseline needs at least one bound")
    if method not in ("mean", "linear", "regression"):
        raise ValueError("method must be 'mean' or 'linear'")
    seconds = col("epoch time [ns]") / F.lit(1e9)
    inside = F.lit(True)
    inside = inside if low is None else inside & (seconds >= F.lit(float(low)))
    inside = inside if high is None else inside & (seconds <= F.lit(float(high)))
    kinds = dict(epochs.dtypes)
    columns = [c for c in (columns or [c for c in epochs.columns if kinds[c] == "double"]) if c not in exclude]
    # In the order of time, so that every run adds up a mean alike.
    w = Window.partitionBy(col(key), col("epoch index")).orderBy(col("epoch time [ns]")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = epochs
    for c in columns:
        x, y = F.when(inside, seconds), F.when(inside, col(c))
        if method == "mean":
            shift = F.avg(y).over(w)
        else:
            slope, intercept = F.regr_slope(y, x).over(w), F.regr_intercept(y, x).over(w)
            usable = (F.count_if(inside).over(w) >= 2) & (F.count_if(inside & col(c).isNull()).over(w) == 0)
            shift = F.when(usable, slope * seconds + intercept)
        new = col(c) - F.coalesce(shift, F.lit(0.0))
        if c in CIRCULAR_COLUMNS and half_turn > 0:
            # The last bits of a mean follow the order of its rows: an angle that they alone keep under 180 is -180.
            turned = F.pmod(new + 180, F.lit(360.0))
            new = F.when(turned.between(360 - half_turn, 360.0), F.lit(0.0)).otherwise(turned) - 180
        elif c in CIRCULAR_COLUMNS:
            turned = new + 180 - 360 * F.floor((new + 180) / 360).cast("double")
            new = F.when(F.abs(new) == float("inf"), F.lit(float("nan"))).otherwise(turned) - 180
        out = out.withColumn(f"__b {c}", new)
    return out.select(*[(col(f"__b {c}").alias(c) if c in columns else col(c)) for c in epochs.columns])
