"""Operators on decoded grey frames: rows ``recording id, frame index, height, width, pixels`` (bytes by rows).

Decoding a video is left to the reader of one's choice; frames are rows like others,
so Spark deals them over tasks, and numpy works inside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.neighbours import col
from ..schema import KEY, require
from .pose import _distorted

FRAME = ("frame index", "height", "width", "pixels")


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values of a grey image at places; 0 beyond its edges."""
    height, width = image.shape
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    a, b = y - i, x - j
    out = np.zeros(np.shape(x))
    for di, wi in ((0, 1 - a), (1, a)):
        for dj, wj in ((0, 1 - b), (1, b)):
            inside = (i + di >= 0) & (i + di < height) & (j + dj >= 0) & (j + dj < width)
            out += np.where(inside, image[np.clip(i + di, 0, height - 1), np.clip(j + dj, 0, width - 1)], 0.0) * wi * wj
    return out


def source_places(height: int, width: int, matrix: np.ndarray, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every pixel of the undistorted frame, where it lies in the distorted one."""
    v, u = np.mgrid[:height, :width].astype(float)
    focus, centre = matrix[[0, 1], [0, 1]], matrix[:2, 2]
    at = _distorted((np.stack([u.ravel(), v.ravel()], 1) - centre) / focus, coefficients) * focus + centre
    return at[:, 0].reshape(height, width), at[:, 1].reshape(height, width)


def undistort_frames(frames: DataFrame, camera_matrix: list, distortion: list, key: str = KEY) -> DataFrame:
    """Frames as a camera without distortion would have taken them, of the same size and matrix.

    The map is made once for each size in a task; pixels that the camera did not see
    are 0.  A frame is one row and needs no shuffle; null frames stay null.
    """
    require(frames, *FRAME)
    matrix, coefficients = np.array(camera_matrix, float), np.array(distortion, float).ravel()

    def run(batches: Iterator) -> Iterator:
        places = lru_cache(4)(lambda h, w: source_places(h, w, matrix, coefficients))
        for b in batches:
            pixels = []
            for h, w, p in zip(b["height"], b["width"], b["pixels"]):
                image = None if p is None else np.frombuffer(p, np.uint8).reshape(int(h), int(w)).astype(float)
                pixels.append(None if image is None else np.rint(sampled(image, *places(int(h), int(w)))).astype(np.uint8).tobytes())
            yield b.assign(pixels=pixels)

    return frames.mapInPandas(run, frames.schema)


def pyramid(image: np.ndarray, levels: int) -> list[np.ndarray]:
    """The image and its halves, each smoothed before every second pixel is left out."""
    out = [image]
    for _ in range(levels - 1):
        x = np.pad(out[-1], 2, mode="edge")
        for axis in (0, 1):
            x = sum(w * np.take(x, np.arange(k, x.shape[axis] - 4 + k), axis) for k, w in enumerate((1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)))
        out.append(x[::2, ::2])
    return out


def flow(before: list[np.ndarray], after: list[np.ndarray], points: np.ndarray, half: int = 7, steps: int = 20) -> np.ndarray:
    """Where points (``n x 2``) of one frame are in the next, by pyramids of both; NaN where the picture does not tell.

    From the coarsest level down, the shift of each point's window that leaves the least
    squared difference is found by repeated 2 x 2 solves.
    """
    oy, ox = np.mgrid[-half : half + 1, -half : half + 1].astype(float)
    shift, lost = np.zeros_like(points), np.zeros(len(points), bool)
    for level in range(len(before) - 1, -1, -1):
        a, b, at = before[level], after[level], points / 2**level
        shift = shift * 2
        x, y = at[:, 0, None, None] + ox, at[:, 1, None, None] + oy
        patch = sampled(a, x, y)
        gx, gy = (sampled(a, x + 1, y) - sampled(a, x - 1, y)) / 2, (sampled(a, x, y + 1) - sampled(a, x, y - 1)) / 2
        xx, xy, yy = ((p * q).sum((1, 2)) for p, q in ((gx, gx), (gx, gy), (gy, gy)))
        det = xx * yy - xy * xy
        flat = (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2 < 1e-3 * patch[0].size
        det = np.where(flat, 1.0, det)
        for _ in range(steps):
            left = patch - sampled(b, x + shift[:, 0, None, None], y + shift[:, 1, None, None])
            p, q = (left * gx).sum((1, 2)), (left * gy).sum((1, 2))
            move = np.stack([(yy * p - xy * q) / det, (xx * q - xy * p) / det], 1)
            shift = shift + np.where(flat[:, None], 0.0, move)
            if np.abs(move[~flat]).max(initial=0) < 0.01:
                break
        if level == 0:
            lost = flat
    out = points + shift
    height, width = before[0].shape
    lost |= ~((out >= 0).all(1) & (out[:, 0] <= width - 1) & (out[:, 1] <= height - 1))
    out[lost] = np.nan
    return out


def track_points(frames: DataFrame, points: DataFrame, longest: int = 30, chunk: int = 60, levels: int = 3, key: str = KEY, index: str = "frame index") -> DataFrame:
    """Points (``recording id, frame index, point id, x, y``) followed over the next ``longest`` frames of their recording.

    Returns ``recording id, point id, frame index, x, y``: the point itself and where it is
    found in each frame after, until the picture does not tell or a frame is missing.
    A task has ``chunk`` frames and the ``longest`` after them, which other tasks have
    too, so a recording is many tasks and a point is followed inside one of them.
    Points with a null in them and frames without pixels are left out.
    """
    require(frames, *FRAME)
    require(points, index, "point id", "x", "y")
    own = (col(index) / chunk).cast("bigint")
    first = F.floor((col(index) - longest) / chunk).cast("bigint")
    shown = frames.where(col("pixels").isNotNull()).withColumn("chunk", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("bigint")), own)))
    shown = shown.select(col(key), "chunk", col(index).cast("bigint").alias("f"), "height", "width", "pixels")
    asked = points.dropna(subset=[index, "point id", "x", "y"]).select(col(key), own.alias("chunk"), col(index).cast("bigint").alias("f"), F.col("point id").cast("bigint").alias("point"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def follow(left, right):
        import pandas as pd

        pictures = {int(f): (int(h), int(w), p) for f, h, w, p in zip(left["f"], left["height"], left["width"], left["pixels"])}
        out, alive, layers = [], [], {}

        def seen(f: int) -> list[np.ndarray]:
            if f not in layers:
                layers.pop(f - 2, None)
                h, w, p = pictures[f]
                layers[f] = pyramid(np.frombuffer(p, np.uint8).reshape(h, w).astype(float), levels)
            return layers[f]

        start = {f: g for f, g in right.groupby("f")}
        for f in range(int(right["f"].min()), int(right["f"].max()) + longest + 1) if len(right) else ():
            if alive and f in pictures and f - 1 in pictures:
                moved = flow(seen(f - 1), seen(f), np.array([a[2] for a in alive]))
                alive = [(p, since, at) for (p, since, _), at in zip(alive, moved) if np.isfinite(at).all() and f - since <= longest]
                out += [(p, f, *at) for p, _, at in alive]
            else:
                alive = []
            if f in start and f in pictures:
                new = [(p, f, np.array([x, y])) for p, x, y in zip(start[f]["point"], start[f]["x"], start[f]["y"])]
                alive += new
                out += [(p, f, *at) for p, _, at in new]
        name = right[key].iloc[0] if len(right) else None
        return pd.DataFrame([(name, *r) for r in out], columns=[key, "point id", index, "x", "y"])

    kind = dict(frames.dtypes)[key]
    both = shown.groupBy(col(key), "chunk").cogroup(asked.groupBy(col(key), "chunk"))
    return both.applyInPandas(follow, f"`{key}` {kind}, `point id` bigint, `{index}` bigint, x double, y double")
