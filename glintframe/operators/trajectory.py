"""Camera poses smoothed over time, scanpaths, and frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.neighbours import NEXT, PREV, around, col
from ..plans.ranges import within
from ..schema import END, KEY, START, TS, require


def kalman(frames: np.ndarray, z: np.ndarray, p0: float, q: float, r: float, gate: float, two_way: bool) -> tuple[np.ndarray, np.ndarray]:
    """All frames from first to last, and the filtered (and smoothed) position at each.

    State, transition and noise are multiples of the identity, so the covariance is one number.
    """
    every = np.arange(frames[0], frames[-1] + 1)
    at = {int(f): z[i] for i, f in enumerate(frames)}
    x, p, xs, ps = z[0], p0, [], []
    for f in every.tolist():
        p += q
        if f in at:
            y = at[f] - x
            if np.sqrt((y * y).sum() / (p + r)) < gate:
                k = p / (p + r)
                x, p = x + k * y, (1 - k) * p
        xs.append(x)
        ps.append(p)
    out, n = np.array(xs), len(every)
    if two_way:
        for k in range(n - 2, -1, -1):
            out[k] = xs[k] + (1 - k / n) ** 2 * ps[k] / ps[k + 1] * (out[k + 1] - xs[k])
    return every, out


def smooth_camera_pose(poses: DataFrame, initial_noise: float = 0.1, process_noise: float = 0.1, measurement_noise: float = 0.01, gate: float = 2.0, two_way: bool = False, key: str = KEY, index: str = "frame index", pos: str = "camera_pos") -> DataFrame:
    """Kalman filter over a recording's frames, and backwards again if ``two_way``.

    Missing frames are predicted only; a measurement ``gate`` or more standard
    deviations off is not used.  Of poses at one frame the smallest counts; null
    frames and poses are ignored.  A filter is sequential, so a recording is one task.
    """
    require(poses, index, pos)
    rows = poses.select(col(key), col(index).cast("bigint").alias("f"), col(pos).cast("array<double>").alias("z")).where("f is not null and z is not null")
    rows = rows.groupBy(col(key), "f").agg(F.min("z").alias("z"))
    kind = dict(poses.dtypes)[key]

    def run(part):
        import pandas as pd

        part = part.sort_values("f")
        every, out = kalman(part["f"].to_numpy(), np.stack(part["z"].to_list()), initial_noise, process_noise, measurement_noise, gate, two_way)
        return pd.DataFrame({key: part[key].iloc[0], index: every, pos: list(out)})

    return rows.groupBy(col(key)).applyInPandas(run, f"`{key}` {kind}, `{index}` bigint, `{pos}` array<double>")


def fixation_status(frames: DataFrame, fixations: DataFrame, key: str = KEY, ts: str = TS, bin_ns: int | None = None, x: str = "fixation x [px]", y: str = "fixation y [px]") -> DataFrame:
    """Each (frame, fixation) that belong together, with ``start``, ``during`` or ``end``; one frame alone is ``end``."""
    slim = fixations.select(col(key), col(START).alias("__a"), col(END).alias("__b"), col("fixation id"), *[col(c) for c in (x, y) if c in fixations.columns])
    both = within(frames, slim, "__a", "__b", key, ts, bin_ns).drop("__a", "__b")
    up, down = (Window.partitionBy(col(key), col("fixation id")).orderBy(o) for o in (col(ts), col(ts).desc()))
    status = F.when(F.row_number().over(down) == 1, "end").when(F.row_number().over(up) == 1, "start").otherwise("during")
    return both.withColumn("fixation status", status)


def scanpath(frames: DataFrame, fixations: DataFrame, key: str = KEY, ts: str = TS, bin_ns: int | None = None, max_fixations: int | None = None) -> DataFrame:
    """Every frame with its fixations as an array of structs (null for none), at most the first ``max_fixations``; no optical flow."""
    long = fixation_status(frames.select(col(key), col(ts)), fixations, key, ts, bin_ns)
    row = F.struct(col("fixation id"), *[col(c) for c in ("fixation x [px]", "fixation y [px]") if c in long.columns], col("fixation status"))
    lists = long.groupBy(col(key), col(ts)).agg(F.sort_array(F.collect_list(row)).alias("fixations"))
    if max_fixations is not None:
        lists = lists.withColumn("fixations", F.slice("fixations", 1, max_fixations))
    return frames.join(lists, [key, ts], "left")


def timestamp_to_frame_index(targets: DataFrame, frames: DataFrame, nearest: bool = False, key: str = KEY, ts: str = TS, index: str = "frame index") -> DataFrame:
    """The first frame at or after each instant (or the nearest one); null beyond the last."""
    out = around(frames, targets, [index], key, ts)
    p, n = F.col(PREV), F.col(NEXT)
    pick = n["c0"]
    if nearest:
        pick = F.when(p.isNull() | ((n["t"] - col(ts)) < (col(ts) - p["t"])), n["c0"]).otherwise(p["c0"])
    return out.select(*[col(c) for c in targets.columns if c != index], pick.alias(index))
