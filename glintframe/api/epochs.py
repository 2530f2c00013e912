"""``Epochs``: event-locked windows over a stream or a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import epochs as ops
from ..plans.neighbours import col
from ..schema import KEY, TS
from .tables import Events, Stream


class Epochs:
    """A source and its windows; the samples of all epochs are one long, lazy table."""

    def __init__(self, source: Stream | Events, info: DataFrame, long: DataFrame | None = None) -> None:
        if "t_start" not in info.columns:
            info = ops.epochs_info(info, F.col("t_before"), F.col("t_after"), "description", "ns", "ns")
        self.source, self.info, self._long = source, info, long
        self.at = source.at if isinstance(source, Events) else TS

    def __len__(self) -> int:
        return self.info.count()

    @property
    def data(self) -> DataFrame:
        """Samples with ``epoch index`` and ``epoch time [ns]``."""
        return ops.slices(self.source.df, self.info, ts=self.at) if self._long is None else self._long

    def epoch(self, index: int) -> DataFrame:
        return self.data.where(col("epoch index") == index)

    empty_epochs = property(lambda self: ops.empty_epochs(self.source.df, self.info, ts=self.at))
    columns = property(lambda self: self.source.columns)
    dtypes = property(lambda self: self.source.dtypes)

    def _part(self, name: str) -> DataFrame:
        return self.info.select(col(KEY), col("epoch index"), name)

    t_ref = property(lambda self: self._part("t_ref"))
    t_before = property(lambda self: self._part("t_before"))
    t_after = property(lambda self: self._part("t_after"))
    description = property(lambda self: self._part("description"))

    @property
    def is_equal_length(self) -> bool:
        r = self.info.agg(F.min("t_before") == F.max("t_before"), F.min("t_after") == F.max("t_after")).first()
        return bool(r[0] and r[1])

    @property
    def has_overlap(self) -> bool:
        return not ops.overlaps(self.info).where("n_overlaps > 0").isEmpty()

    def annotate_source(self) -> DataFrame:
        return ops.annotate_source(self.source.df, self.info, ts=self.at)

    def tensor(self, column_names: list[str] | None = None, sampling_rate: float | None = None, float_kind: str = "linear", other_kind: str = "nearest") -> DataFrame:
        """Long cells on uniform grids; needs a stream and epochs of equal length."""
        if not isinstance(self.source, Stream):
            raise TypeError("only epochs of a stream have a tensor")
        if not self.is_equal_length:
            raise ValueError("epochs must be of equal length")
        rate = sampling_rate or self.source.sampling_freq_nominal
        if rate is None:
            raise ValueError("the sampling rate must be given")
        return ops.tensor(self.source.df, self.info, rate, column_names or self.source.columns, float_kind, other_kind)

    def to_numpy(self, column_names: list[str] | None = None, sampling_rate: float | None = None, **kinds):
        """The tensor of one recording on the driver: (epochs, channels, times), and its axes."""
        import numpy as np

        names = column_names or self.source.columns
        cells = self.tensor(names, sampling_rate, **kinds).select(col("epoch index"), col("time index"), col("epoch time [ns]"), *[col(c).cast("double") for c in names]).toPandas().sort_values(["epoch index", "time index"])
        n, m = cells["epoch index"].nunique(), cells["time index"].nunique()
        values = cells[names].to_numpy(float).reshape(n, m, len(names)).transpose(0, 2, 1)
        return values, {"epoch_times": cells["epoch time [ns]"].to_numpy()[:m] / 1e9, "column_names": names, "nan_flag": bool(np.isnan(values).any())}

    def apply_baseline(self, baseline: tuple[float | None, float | None] = (None, 0), method: str = "mean", exclude_cols: tuple[str, ...] = (), inplace: bool = False):
        long = ops.apply_baseline(self.data, baseline, method, exclude=tuple(exclude_cols))
        if inplace:
            self._long = long
            return None
        return Epochs(self.source, self.info, long)


def events_to_epochs_info(events: Events, t_before, t_after, t_unit: str = "s", event_name: str | list[str] | None = None) -> DataFrame:
    return ops.events_to_epochs_info(events.df, t_before, t_after, t_unit, event_name, events.type)


construct_epochs_info = ops.epochs_info
