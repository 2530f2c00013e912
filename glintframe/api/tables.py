"""``Stream`` and ``Events``: lazy tables with the operators as methods.

Nothing runs until a property or method needs a value.  Methods return a new
object; with ``inplace`` they rebind the object's frame and return None.  Tables may
hold many recordings; properties that are one number need a single recording.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import align, concat, intervals, properties, select, surface
from ..plans.neighbours import col
from ..schema import DURATION, END, KEY, NOMINAL_RATES, START, TS


class Table:
    """A DataFrame with a recording key; known columns in their types."""

    def __init__(self, data: DataFrame, recording_id: str | None = None) -> None:
        if KEY not in data.columns:
            data = data.withColumn(KEY, F.lit(recording_id or "recording"))
        self.df = schema.typed(data.drop("section id"))

    def _with(self, df: DataFrame, inplace: bool = False):
        if inplace:
            self.df = df
            return None
        new = object.__new__(type(self))
        new.__dict__ = dict(self.__dict__)
        new.df = df
        return new

    def __len__(self) -> int:
        return self.df.count()

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self.columns)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (KEY, TS)]

    @property
    def dtypes(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    def copy(self):
        return self._with(self.df)

    def save(self, path: str, header: bool = True) -> None:
        """CSV with a header; Spark writes doubles so that they read back the same."""
        self.df.write.mode("overwrite").option("header", header).csv(str(path))

    def _checked(self, df: DataFrame, what: str, strict: bool) -> DataFrame:
        return select.check_not_empty(df, what) if strict else df


class Stream(Table):
    """Samples over time."""

    def __init__(self, data: DataFrame, recording_id: str | None = None) -> None:
        schema.require(data, TS)
        super().__init__(data, recording_id)
        self.type = schema.stream_type(self.df.columns)

    @classmethod
    def read_csv(cls, spark: SparkSession, path: str, recording_id: str | None = None) -> Stream:
        from ..sources.cloud import read_csv

        return cls(read_csv(spark, path, recording_id))

    def __getitem__(self, column: str) -> DataFrame:
        return schema.require(self.df, column).select(col(KEY), col(TS), col(column))

    def __repr__(self) -> str:
        return f"Stream type: {self.type}\nColumns: {self.columns}"

    @property
    def timestamps(self) -> DataFrame:
        return self.df.select(col(KEY), col(TS))

    ts = timestamps

    @property
    def summary(self) -> DataFrame:
        return properties.summary(self.df)

    def _one(self):
        rows = self.summary.limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"needs one recording, not {'none' if not rows else 'several'}; see summary")
        return rows[0]

    first_ts = property(lambda self: self._one()["first_ts"])
    last_ts = property(lambda self: self._one()["last_ts"])
    duration = property(lambda self: self._one()["duration"])
    sampling_freq_effective = property(lambda self: self._one()["sampling_freq_effective"])

    @property
    def ts_diff(self) -> DataFrame:
        return properties.ts_diff(self.df).select(col(KEY), col(TS), "ts_diff")

    @property
    def times(self) -> DataFrame:
        return properties.relative_time(self.df).select(col(KEY), col(TS), "time")

    @property
    def sampling_freq_nominal(self) -> int | None:
        return NOMINAL_RATES.get(self.type)

    @property
    def is_uniformly_sampled(self) -> bool:
        return bool(properties.is_uniform(self.df).agg(F.every("is_uniform").alias("x")).first()["x"])

    def time_to_ts(self, times: list[float] | float) -> DataFrame:
        asked = times if isinstance(times, (list, tuple)) else [times]
        table = self.df.select(col(KEY)).distinct().select(col(KEY), F.explode(F.array(*[F.lit(float(t)) for t in asked])).alias("time"))
        return properties.time_to_ts(self.df, table)

    def crop(self, tmin=None, tmax=None, by: str = "timestamp", inplace: bool = False, strict: bool = True):
        return self._with(self._checked(select.crop(self.df, tmin, tmax, by), "samples", strict), inplace)

    def restrict(self, other: Stream, inplace: bool = False, strict: bool = True):
        return self._with(self._checked(select.restrict(self.df, other.df), "samples", strict), inplace)

    def interpolate(self, new_ts: DataFrame | None = None, float_kind: str = "linear", other_kind: str = "nearest", max_gap_ms: float | None = 500, inplace: bool = False):
        """Onto ``new_ts`` (recording, instant), or onto a uniform grid of the nominal rate."""
        if new_ts is None:
            if self.sampling_freq_nominal is None:
                raise ValueError("a stream without a nominal rate needs instants to interpolate onto")
            new_ts = align.uniform_grid(self.df, self.sampling_freq_nominal)
        return self._with(align.interpolate(self.df, new_ts, None, float_kind, other_kind, max_gap_ms), inplace)

    def annotate_events(self, events: Events, inplace: bool = False):
        return self._with(intervals.annotate_events(self.df, select.with_end(events.df), events.id_name), inplace)

    def interpolate_events(self, events: Events, buffer_ms: float = 0, float_kind: str = "linear", other_kind: str = "nearest", max_gap_ms: float | None = None, inplace: bool = False):
        return self._with(intervals.interpolate_events(self.df, select.with_end(events.df), buffer_ms, float_kind, other_kind, max_gap_ms), inplace)

    def window_average(self, new_ts: DataFrame, window_ns: int | None = None, inplace: bool = False):
        """Means around ``new_ts``; the default window is the median distance of its instants."""
        step = lambda df: properties.ts_diff(df.select(col(KEY), col(TS))).agg(F.median("ts_diff").alias("m")).first()["m"]
        new, old = step(new_ts), step(self.df)
        if new is not None and old is not None and new < old:
            raise ValueError("the new instants must not be closer than the samples")
        window_ns = int(new) if window_ns is None else window_ns
        if old is not None and window_ns < old:
            raise ValueError("the window must not be shorter than the samples' distance")
        return self._with(align.window_average(self.df, new_ts.select(col(KEY), col(TS)), window_ns), inplace)

    def compute_azimuth_and_elevation(self, method: str = "linear", overwrite: bool = False, inplace: bool = False):
        return self._with(surface.compute_azimuth_and_elevation(self.df, method, overwrite), inplace)

    def apply_homographies(self, homographies: Stream, max_gap_ms: float | None = 500, overwrite: bool = False, inplace: bool = False):
        return self._with(surface.apply_homographies(self.df, homographies.df, max_gap_ms=max_gap_ms, overwrite=overwrite), inplace)

    def concat(self, other: Stream, float_kind: str = "linear", other_kind: str = "nearest", max_gap_ms: float | None = None, inplace: bool = False):
        return self._with(concat.concat(self.df, other.df, float_kind=float_kind, other_kind=other_kind, max_gap_ms=max_gap_ms), inplace)


class Events(Table):
    """Intervals (blinks, fixations, saccades) or messages; the id is a column."""

    def __init__(self, data: DataFrame, recording_id: str | None = None) -> None:
        super().__init__(data, recording_id)
        self.type, self.id_name = schema.event_type(self.df.columns)
        self.at = START if START in self.df.columns else TS
        if self.id_name not in self.df.columns:
            self.df = select.renumbered(self.df.withColumn(self.id_name, F.lit(0)), self.id_name, start=self.at)

    @classmethod
    def read_csv(cls, spark: SparkSession, path: str, recording_id: str | None = None) -> Events:
        from ..sources.cloud import read_csv

        return cls(read_csv(spark, path, recording_id))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (KEY, self.id_name)]

    def __repr__(self) -> str:
        return f"Events type: {self.type}\nColumns: {self.columns}"

    def __getitem__(self, index: int) -> DataFrame:
        """The event at a position, by start."""
        return select.crop(self.df, index, index, "sample", ts=self.at)

    def _part(self, column: str) -> DataFrame:
        return schema.require(self.df, column).select(col(KEY), col(self.id_name), col(column))

    start_ts = property(lambda self: self._part(self.at))
    end_ts = property(lambda self: self._part(END))
    durations = property(lambda self: self._part(DURATION))
    id = property(lambda self: self.df.select(col(KEY), col(self.id_name)))

    def crop(self, tmin=None, tmax=None, by: str = "timestamp", inplace: bool = False, strict: bool = True):
        if by == "time":
            raise ValueError("events are cropped by 'timestamp' or 'sample'")
        return self._with(self._checked(select.crop(self.df, tmin, tmax, by, ts=self.at, negative=True), "events", strict), inplace)

    def restrict(self, other: Stream, inplace: bool = False, strict: bool = True):
        return self._with(self._checked(select.restrict(self.df, other.df, ts=self.at), "events", strict), inplace)

    def filter_by_duration(self, dur_min=None, dur_max=None, reset_id: bool = True, inplace: bool = False, strict: bool = True):
        out = select.filter_by_duration(self.df, dur_min, dur_max, self.id_name if reset_id else None, start=self.at)
        return self._with(self._checked(out, "events", strict), inplace)

    def filter_by_name(self, names: str | list[str], col_name: str = "name", reset_id: bool = True, inplace: bool = False, strict: bool = True):
        out = select.filter_by_name(self.df, names, col_name, self.id_name if reset_id else None, start=self.at)
        return self._with(self._checked(out, "events", strict), inplace)

    def apply_homographies(self, homographies: Stream, max_gap_ms: float | None = 500, overwrite: bool = False, inplace: bool = False):
        return self._with(surface.apply_homographies_to_fixations(self.df, homographies.df, max_gap_ms=max_gap_ms, overwrite=overwrite), inplace)
