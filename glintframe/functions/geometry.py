"""Scalar expressions: angles, projections, wrapping, camera distortion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scene image size in px and field of view in degrees.
WIDTH, HEIGHT, FOV_X, FOV_Y = 1600, 1200, 103, 77


def azimuth(x: Column) -> Column:
    return (x - WIDTH / 2) / F.lit(float(WIDTH)) * FOV_X


def elevation(y: Column) -> Column:
    return -((y - HEIGHT / 2) / F.lit(float(HEIGHT)) * FOV_Y)


def project(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a homography (nine columns by rows); null where it goes to infinity."""
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def wrap(degrees: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(degrees + 180, F.lit(360.0)) - 180


def distort(x: Column, y: Column, matrix: list[list[float]], coefficients: list[float]) -> tuple[Column, Column]:
    """Undistorted to distorted pixels by the rational model of eight coefficients."""
    k1, k2, p1, p2, k3, k4, k5, k6 = (list(coefficients) + [0.0] * 8)[:8]
    fx, fy, cx, cy = matrix[0][0], matrix[1][1], matrix[0][2], matrix[1][2]
    u, v = (x - cx) / fx, (y - cy) / fy
    r = u * u + v * v
    radial = (1 + r * (k1 + r * (k2 + r * k3))) / (1 + r * (k4 + r * (k5 + r * k6)))
    a = u * radial + 2 * p1 * u * v + p2 * (r + 2 * u * u)
    b = v * radial + p1 * (r + 2 * v * v) + 2 * p2 * u * v
    return a * fx + cx, b * fy + cy


def undistort(x: Column, y: Column, matrix: list[list[float]], coefficients: list[float], steps: int = 20) -> Column:
    """Distorted to undistorted pixels (struct ``x, y``): the fixed point of ``distort``, as a fold without Python."""
    start = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def nearer(at: Column, _: Column) -> Column:
        a, b = distort(at["x"], at["y"], matrix, coefficients)
        return F.struct((at["x"] + x - a).cast("double").alias("x"), (at["y"] + y - b).cast("double").alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, nearer)


def rectangle_score(corners: Column) -> Column:
    """How rectangular four corners (structs x, y in order) are: 0 for a square, else negative."""
    at = lambda i: corners[i % 4]
    angles, sides = [], []
    for i in range(4):
        ax, ay = at(i + 3)["x"] - at(i)["x"], at(i + 3)["y"] - at(i)["y"]
        bx, by = at(i + 1)["x"] - at(i)["x"], at(i + 1)["y"] - at(i)["y"]
        cosine = F.try_divide(ax * bx + ay * by, F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))
        angles.append(F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))))
        sides.append(F.sqrt(bx * bx + by * by))
    mean = sum(angles[1:], angles[0]) / 4
    spread = sum(((a - mean) * (a - mean) for a in angles[1:]), (angles[0] - mean) * (angles[0] - mean)) / 4
    aspect = F.try_divide(F.greatest(*sides), F.least(*sides))
    return -spread - 10 * F.abs(aspect - 1)


def ordered_corners(corners: Column) -> Column:
    """Four corners as top left, top right, bottom right, bottom left (image axes)."""
    by = lambda points, a, b: F.array_sort(F.transform(points, lambda p: F.struct(p[a].alias("k"), p[b].alias("l"))))
    point = lambda e: F.struct(e["k"].alias("x"), e["l"].alias("y"))
    down = F.transform(by(corners, "y", "x"), lambda e: F.struct(e["l"].alias("x"), e["k"].alias("y")))
    top, bottom = by(F.slice(down, 1, 2), "x", "y"), by(F.slice(down, 3, 2), "x", "y")
    return F.array(point(top[0]), point(top[1]), point(bottom[1]), point(bottom[0]))
