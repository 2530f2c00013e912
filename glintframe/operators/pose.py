"""Camera poses from markers at known places: a perspective-n-point problem per frame, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.neighbours import col
from ..schema import CORNERS, KEY, require
from .surface import homographies_of


#: Frames that are solved at once.
STACK = 2048


def rotation(vector: np.ndarray) -> np.ndarray:
    """The matrices of rotation vectors (``... x 3``)."""
    angle = np.linalg.norm(vector, axis=-1)[..., None]
    x, y, z = np.moveaxis(vector / np.where(angle > 0, angle, 1), -1, 0)
    none, angle = np.zeros_like(x), angle[..., None]
    k = np.stack([np.stack([none, -z, y], -1), np.stack([z, none, -x], -1), np.stack([-y, x, none], -1)], -2)
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def rotation_vector(matrix: np.ndarray) -> np.ndarray:
    """The rotation vectors of matrices (``... x 3 x 3``), their angles within [0, pi]."""
    angle = np.arccos(np.clip((np.trace(matrix, axis1=-2, axis2=-1) - 1) / 2, -1, 1))[..., None]
    axis = np.stack([matrix[..., 2, 1] - matrix[..., 1, 2], matrix[..., 0, 2] - matrix[..., 2, 0], matrix[..., 1, 0] - matrix[..., 0, 1]], -1)
    size = np.linalg.norm(axis, axis=-1)[..., None]
    half = np.sqrt(np.maximum((np.diagonal(matrix, axis1=-2, axis2=-1) + 1) / 2, 0))  # half a turn: the matrix is 2 a a' - 1
    lead = half.argmax(-1)[..., None]
    signs = np.where(np.arange(3) == lead, 1, np.take_along_axis(matrix, lead[..., None], -2)[..., 0, :])
    turned = np.where(angle < 1, 0.0, np.pi * np.copysign(half, signs))
    return np.where(size > 1e-9, axis / np.where(size > 1e-9, size, 1) * angle, turned)


def _distorted(u: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    k1, k2, p1, p2, k3, k4, k5, k6 = (*coefficients, *[0.0] * 8)[:8]
    x, y = u[..., 0], u[..., 1]
    r = x * x + y * y
    s = (1 + r * (k1 + r * (k2 + r * k3))) / (1 + r * (k4 + r * (k5 + r * k6)))
    return np.stack([x * s + 2 * p1 * x * y + p2 * (r + 2 * x * x), y * s + p1 * (r + 2 * y * y) + 2 * p2 * x * y], -1)


def _undistorted(u: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    x = u
    for _ in range(20):
        x = x + u - _distorted(x, coefficients)
    return x


def _start(world: np.ndarray, rays: np.ndarray) -> np.ndarray:
    """Poses (six numbers) to begin with: of a plane by its homography, else by the linear transform of 3-D points; NaN for none."""
    middle = world.mean(1, keepdims=True)
    away, count = world - middle, world.shape[1]
    _, size, axes = np.linalg.svd(away, full_matrices=False)
    flat = (size[:, 2] < 1e-6 * size[:, 0]) | (count < 6)
    a, t = np.full((len(world), 3, 3), np.nan), np.full((len(world), 3), np.nan)
    if flat.any():
        axes = axes[flat]
        axes[np.linalg.det(axes) <= 0, 2] *= -1
        h = homographies_of(away[flat] @ np.swapaxes(axes[:, :2], 1, 2), rays[flat])
        h /= np.linalg.norm(h[:, :, :2], axis=1).mean(1)[:, None, None]
        a[flat], t[flat] = np.stack([h[..., 0], h[..., 1], np.cross(h[..., 0], h[..., 1])], -1) @ axes, h[..., 2]
    if not flat.all():
        solid = ~flat
        scale = np.abs(away[solid]).max((1, 2))
        x = np.concatenate([away[solid] / scale[:, None, None], np.ones((solid.sum(), count, 1))], -1)
        none, r = np.zeros_like(x), rays[solid]
        m = np.linalg.svd(np.concatenate([np.concatenate([x, none, -x * r[..., :1]], -1), np.concatenate([none, x, -x * r[..., 1:]], -1)], 1))[2][:, -1].reshape(-1, 3, 4)
        m = m / np.cbrt(np.linalg.det(m[..., :3]))[:, None, None]
        a[solid], t[solid] = m[..., :3], m[..., 3] * scale[:, None]
    good = np.isfinite(a).all((1, 2)) & np.isfinite(t).all(1)
    u, _, v = np.linalg.svd(np.where(good[:, None, None], a, np.eye(3)))
    u[..., 2] *= np.linalg.det(u @ v)[:, None]
    r = u @ v
    return np.where(good[:, None], np.concatenate([rotation_vector(r), t - (r @ np.swapaxes(middle, 1, 2))[..., 0]], 1), np.nan)


def _solved(a: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Solutions of a stack of systems; NaN for those that have none."""
    try:
        return np.linalg.solve(a, g[..., None])[..., 0]
    except np.linalg.LinAlgError:
        if len(a) == 1:
            return np.full_like(g, np.nan)
        half = len(a) // 2
        return np.concatenate([_solved(a[:half], g[:half]), _solved(a[half:], g[half:])])


def solve_poses(world: np.ndarray, image: np.ndarray, matrix: np.ndarray, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation vectors of frames with as many points (``frames x n x 3`` and ``x 2``); NaN where the points fix no pose.

    They project the world points to the pixels with least squared error, by damped
    Gauss-Newton steps of all frames in one stack; a frame leaves it when it has converged.
    """
    focus, centre = matrix[[0, 1], [0, 1]], matrix[:2, 2]
    out = np.full((len(world), 6), np.nan)
    with np.errstate(all="ignore"):
        rays = _undistorted((image - centre) / focus, coefficients)
        open_ = np.flatnonzero(np.isfinite(world).all((1, 2)) & np.isfinite(rays).all((1, 2)))
        out[open_] = _start(world[open_], rays[open_])
        open_ = open_[np.isfinite(out[open_]).all(1)]

        def left(x: np.ndarray, at: np.ndarray) -> np.ndarray:
            p = world[at] @ np.swapaxes(rotation(x[..., :3]), -1, -2) + x[..., None, 3:]
            d = (_distorted(p[..., :2] / p[..., 2:], coefficients) * focus + centre) - image[at]
            return d.reshape(*d.shape[:-2], 2 * world.shape[1])

        step, damp = 1e-6, np.full(len(world), 1e-3)
        error = np.full((len(world), 2 * world.shape[1]), np.nan)
        error[open_] = left(out[open_], open_)
        for _ in range(60):
            if not len(open_):
                break
            x, e, d = out[open_], error[open_], damp[open_]
            moved = step * np.eye(6)[:, None]
            j = np.moveaxis((left(x + moved, open_) - left(x - moved, open_)) / (2 * step), 0, -1)
            a, g = np.swapaxes(j, 1, 2) @ j, (np.swapaxes(j, 1, 2) @ e[..., None])[..., 0]
            move = -_solved(a + d[:, None, None] * a * np.eye(6) + 1e-12 * np.eye(6), g)
            new = left(x + move, open_)
            before, after = (e * e).sum(1), (new * new).sum(1)
            better = np.isfinite(new).all(1) & (after < before)
            lost = np.isnan(move).any(1)
            done = lost | np.where(better, (before - after < 1e-14 * before) | (np.abs(move).max(1) < 1e-13), d > 1e12)
            taken = open_[better]
            out[taken], error[taken] = (x + move)[better], new[better]
            damp[open_] = np.where(better, d / 10, d * 10)
            out[open_[lost]] = np.nan
            open_ = open_[~done]
        return rotation_vector(rotation(out[:, :3])), out[:, 3:]


def solve_pose(world: np.ndarray, image: np.ndarray, matrix: np.ndarray, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The pose of one frame, or None."""
    r, t = solve_poses(world[None], image[None], matrix, coefficients)
    return (r[0], t[0]) if np.isfinite(r).all() and np.isfinite(t).all() else None


def marker_corners(place: np.ndarray, normal: np.ndarray, size: float | np.ndarray) -> np.ndarray:
    """The four corners of markers in the world, in the order in which a detection's corners are paired with them."""
    z = normal / np.linalg.norm(normal, axis=-1)[..., None]
    upright = np.isclose(np.abs(z), (0, 0, 1)).all(-1)[..., None]
    x = np.cross(z, np.where(upright, [1.0, 0, 0], [0, 0, 1.0]))
    x /= np.linalg.norm(x, axis=-1)[..., None]
    y = np.cross(z, x)
    return place[..., None, :] + np.asarray(size)[..., None, None] / 2 * np.stack([-x - y, x - y, x + y, y - x], -2)


def estimate_camera_pose(detections: DataFrame, locations: DataFrame, camera_matrix: list, distortion: list | None = None, key: str = KEY, index: str = "frame index") -> DataFrame:
    """The camera's pose in each frame with a marker of known place.

    ``locations``: ``marker_id, pos_vec, norm_vec, size`` of each marker; it is joined by
    id (detections of others are left out).  Returns ``translation_vector``,
    ``rotation_vector`` and ``camera_pos`` (arrays of 3) by recording and frame.  A frame's
    markers are gathered by Spark; Python solves batches of frames in stacks.  A frame
    whose points fix no pose gives no row, and a marker without a whole place counts as unknown.
    """
    require(locations, "marker_id", "pos_vec", "norm_vec", "size")
    require(detections, index, "marker id")
    place = locations.select(F.col("marker_id").cast("string").alias("__m"), F.col("pos_vec").cast("array<double>").alias("p"), F.col("norm_vec").cast("array<double>").alias("n"), F.col("size").cast("double").alias("z")).where("size(p) = 3 and size(n) = 3")
    seen = detections.select(col(key), col(index).cast("bigint").alias("f"), col("marker id").cast("string").alias("__m"), F.array(*[col(f"{c} {a} [px]").cast("double") for c in CORNERS for a in "xy"]).alias("c"))
    frames = seen.join(place, "__m").groupBy(col(key), "f").agg(F.sort_array(F.collect_list(F.struct("__m", "c", "p", "n", "z"))).alias("m"))
    matrix, coefficients = np.array(camera_matrix, float), np.array(distortion if distortion is not None else [0.0] * 8, float).ravel()
    vectors = ("translation_vector", "rotation_vector", "camera_pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            markers = b.column(2)
            many = markers.value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum(many) - many
            _, c, p, n, z = markers.flatten().flatten()
            numbers = lambda x, *shape: x.flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape)
            with np.errstate(all="ignore"):
                corners = marker_corners(numbers(p, 3), numbers(n, 3), z.to_numpy(zero_copy_only=False))
            pixels = numbers(c, 4, 2)
            r, t = np.full((b.num_rows, 3), np.nan), np.full((b.num_rows, 3), np.nan)
            for k in np.unique(many):
                for own in np.split(np.flatnonzero(many == k), range(STACK, int((many == k).sum()), STACK)):
                    at = first[own, None] + np.arange(k)
                    r[own], t[own] = solve_poses(corners[at].reshape(len(own), -1, 3), pixels[at].reshape(len(own), -1, 2), matrix, coefficients)
            good = np.flatnonzero(np.isfinite(r).all(1) & np.isfinite(t).all(1))
            r, t = r[good], t[good]
            place = -(np.swapaxes(rotation(r), 1, 2) @ t[..., None])[..., 0]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(good) + 1, 3, dtype="i4")), pa.array(v.ravel())) for v in (t, r, place)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), b.column(1).take(pa.array(good)), *lists], names=[key, index, *vectors])

    schema = ", ".join([f"`{key}` {dict(detections.dtypes)[key]}", f"`{index}` bigint", *[f"{v} array<double>" for v in vectors]])
    return frames.mapInArrow(run, schema)
