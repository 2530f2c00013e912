"""Sequential operators over streams: rows wait until the watermark has passed them, then follow one another in order.

Late and shuffled micro-batches therefore give what the batch operators give.  State is
kept by recording: what is waiting, and what the next row needs of those before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.neighbours import col
from ..schema import KEY, TS
from .live import with_event_time


class InOrder(StatefulProcessor):
    """Releases rows ``(t, kind, values)`` by time, then kind, once the watermark is past them; subclasses take them.

    ``take`` gets the state (None at first) and the released rows, and returns the new
    state and the rows to emit.  A row at or before the last one released is late and
    left out.
    """

    STATE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t bigint, kind int, place bigint, v array<double>")
        self.done = handle.getValueState("done", "t bigint")
        self.state = handle.getValueState("state", self.STATE)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        done = self.done.get()[0] if self.done.exists() else None
        more = []
        for part in rows:
            for t, kind, place, v in zip(part["t"].tolist(), part["kind"].tolist(), part["place"].tolist(), part["v"].tolist()):
                if done is None or t > done:
                    more.append((t, kind, place, [float("nan") if x is None else float(x) for x in v]))
        if more:
            self.waiting.appendList(more)
            self.handle.registerTimer(max(r[0] for r in more) // 1_000_000 + 1)
        yield from self._release(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield from self._release(key, timerValues)

    def _release(self, key, timerValues) -> Iterator:
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in held if r[0] // 1_000_000 < mark), key=lambda r: r[:3])
        if not ready:
            return
        rest = [r for r in held if r[0] // 1_000_000 >= mark]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.done.update((ready[-1][0],))
        state, out = self.take(tuple(self.state.get()) if self.state.exists() else None, ready)
        self.state.update(state)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["k", *(f"o{i}" for i in range(len(out[0])))])

    def take(self, state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Kalman(InOrder):
    STATE = "frame bigint, p double, x array<double>"

    def __init__(self, p0: float, q: float, r: float, gate: float) -> None:
        self.p0, self.q, self.r, self.gate = p0, q, r, gate

    def take(self, state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        """Every frame from the last one to each row's; frames without a pose are predicted only."""
        out: list[tuple] = []
        frame, p, x = (state[0], state[1], np.array(state[2])) if state else (None, self.p0, None)
        for _, _, place, v in rows:
            z = np.array(v)
            if frame is None:
                frame, x = place - 1, z
            if place <= frame:  # a second pose of one frame: the first in order counted
                continue
            for f in range(frame + 1, place + 1):
                p += self.q
                if f == place:
                    y = z - x
                    if np.sqrt((y * y).sum() / (p + self.r)) < self.gate:
                        k = p / (p + self.r)
                        x, p = x + k * y, (1 - k) * p
                out.append((f, x.tolist()))
            frame = place
        return (frame, p, x.tolist()), out


def _taken(rows: DataFrame, step: InOrder, key: str, columns: dict[str, str]) -> DataFrame:
    """Rows (``key, t, kind, place, v, event_time``) through a step; state and its schema know plain names only."""
    rows = rows.withColumnRenamed(key, "k")
    schema = ", ".join([f"k {dict(rows.dtypes)['k']}", *(f"o{i} {kind}" for i, kind in enumerate(columns.values()))])
    return rows.groupBy("k").transformWithStateInPandas(step, schema, "Append", "EventTime").toDF(key, *columns)


def kalman_live(poses: DataFrame, initial_noise: float = 0.1, process_noise: float = 0.1, measurement_noise: float = 0.01, gate: float = 2.0, delay: str = "1 second", key: str = KEY, ts: str = TS, index: str = "frame index", pos: str = "camera_pos") -> DataFrame:
    """The forward filter of ``smooth_camera_pose`` over a stream of poses with frame indices and instants.

    Frames must rise with their instants.  A frame is emitted when the watermark has
    passed it, and frames without a pose when the next pose has been; null frames and
    poses are left out.  Needs the state store of RocksDB.
    """
    rows = with_event_time(poses.where(col(index).isNotNull() & col(pos).isNotNull()), delay, ts)
    rows = rows.select(col(key), col(ts).alias("t"), F.lit(0).alias("kind"), col(index).cast("bigint").alias("place"), col(pos).cast("array<double>").alias("v"), "event_time")
    return _taken(rows, Kalman(initial_noise, process_noise, measurement_noise, gate), key, {index: "bigint", pos: "array<double>"})


class Interpolation(InOrder):
    STATE = "t bigint, v array<double>, asked array<bigint>"

    def __init__(self, width: int, gap: int | None) -> None:
        self.width, self.gap = width, gap

    def take(self, state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        """Samples come before instants of the same time; an instant waits for the sample behind it."""
        out: list[tuple] = []
        t0, v0, asked = (state[0], list(state[1]), list(state[2])) if state else (None, [], [])
        none = [None] * self.width
        for t, kind, _, v in rows:
            if kind == 0:
                for a in asked:
                    near = self.gap is None or (a - t0 < self.gap and t - a < self.gap) if t0 is not None else False
                    value = [y0 + (y1 - y0) * ((a - t0) / (t - t0)) for y0, y1 in zip(v0, v)] if near else none
                    out.append((a, *[None if y is None or np.isnan(y) else y for y in value]))
                t0, v0, asked = t, list(v), []
            elif t0 == t:
                out.append((t, *[None if np.isnan(y) else y for y in v0]))
            elif t0 is None:
                out.append((t, *none))
            else:
                asked.append(t)
        return (t0, v0, asked), out


def interpolate_live(samples: DataFrame, targets: DataFrame, columns: list[str], max_gap_ms: float | None = 500, delay: str = "1 second", key: str = KEY, ts: str = TS) -> DataFrame:
    """Linear interpolation of a stream's columns at the instants of another stream.

    As ``interpolate`` of linear kind: an instant at a sample has its values, others need
    samples on both sides, strictly closer than ``max_gap_ms`` where it is given, and are
    null otherwise.  An instant is emitted when the watermark has passed the sample behind
    it; behind the last sample nothing is emitted, as the stream may go on.  Of several
    samples at one time the last in order of values counts; several equal instants are as
    many rows.  Late rows are left out.  Needs the state store of RocksDB.
    """
    values = F.array(*[col(c).cast("double") for c in columns])
    left = samples.select(col(key), col(ts).alias("t"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("place"), values.alias("v"))
    right = targets.select(col(key), col(ts).alias("t"), F.lit(1), F.lit(0).cast("bigint"), F.array().cast("array<double>"))
    rows = with_event_time(left.union(right).where("t is not null"), delay, "t")
    step = Interpolation(len(columns), None if max_gap_ms is None else int(max_gap_ms * 1e6))
    return _taken(rows, step, key, {ts: "bigint", **dict.fromkeys(columns, "double")})
