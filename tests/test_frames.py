import numpy as np
import pytest

from glintframe.operators import frames as fr
from glintframe.schema import KEY

MATRIX, LENS = [[60.0, 0, 40], [0, 60, 30], [0, 0, 1]], [-0.1, 0.05, 0.001, 0.002, 0, 0.2, 0, 0]


def scene(x, y):
    """A smooth picture, defined everywhere."""
    return 128 + 50 * np.sin(x / 5 + y / 11) + 40 * np.cos(y / 4 - x / 13) + 20 * np.sin(x / 2.5) * np.sin(y / 3.1)


def rows(spark, pictures):
    return spark.createDataFrame([(k, f, p.shape[0], p.shape[1], np.rint(p).astype(np.uint8).tobytes()) for k, f, p in pictures], f"`{KEY}` string, `frame index` bigint, height int, width int, pixels binary")


def test_undistort_after_distort(spark):
    """A picture taken through the lens is the scene again, but for the rounding of its pixels."""
    from glintframe.operators.pose import _undistorted

    v, u = np.mgrid[:60, :80].astype(float)
    matrix = np.array(MATRIX)
    at = _undistorted((np.stack([u.ravel(), v.ravel()], 1) - matrix[:2, 2]) / 60, np.array(LENS)) * 60 + matrix[:2, 2]
    taken = scene(at[:, 0], at[:, 1]).reshape(60, 80)
    df = rows(spark, [("a", 0, taken), ("a", 1, taken)]).union(spark.createDataFrame([("a", 2, 60, 80, None)], f"`{KEY}` string, `frame index` bigint, height int, width int, pixels binary"))
    got = {r["frame index"]: r["pixels"] for r in fr.undistort_frames(df, MATRIX, LENS).collect()}
    image = np.frombuffer(got[1], np.uint8).reshape(60, 80).astype(float)
    inside = (slice(8, -8), slice(8, -8))
    assert np.abs(image - scene(u, v))[inside].max() < 4 and got[2] is None
    assert np.abs(taken - scene(u, v))[inside].max() > 8  # the lens does matter
    straight = fr.undistort_frames(df, MATRIX, [0.0] * 8).where("`frame index` = 0").first()["pixels"]
    assert bytes(straight) == np.rint(taken).astype(np.uint8).tobytes()


@pytest.mark.parametrize("chunk", [4, 100])
def test_known_shifts_are_followed(spark, chunk):
    v, u = np.mgrid[:90, :120].astype(float)
    path = np.cumsum([[0.0, 0.0], [1.5, 0.5], [2.0, -1.0], [0.3, 2.2], [-3.0, 1.0], [4.0, 4.0], [0.0, 0.0], [-1.0, -2.0], [2.5, 0.0], [1.0, 1.0]], 0)
    pictures = [("a", f, scene(u - dx, v - dy)) for f, (dx, dy) in enumerate(path)] + [("b", f, np.full((90, 120), 7.0)) for f in range(3)]
    points = [("a", 0, 1, 50.0, 40.0), ("a", 0, 2, 60.0, 50.0), ("a", 3, 3, 55.0, 45.0), ("b", 0, 4, 50.0, 40.0), ("a", 2, 5, None, 1.0), ("c", 0, 6, 1.0, 1.0)]
    asked = spark.createDataFrame(points, f"`{KEY}` string, `frame index` bigint, `point id` bigint, x double, y double")
    frames = rows(spark, [p for p in pictures if p[:2] != ("a", 9)])
    got = {(r["point id"], r["frame index"]): (r["x"], r["y"]) for r in fr.track_points(frames, asked, longest=5, chunk=chunk).collect()}
    want = {(p, f): (x + path[f][0] - path[s][0], y + path[f][1] - path[s][1]) for _, s, p, x, y in points[:3] for f in range(s, min(s + 5, 8) + 1)}
    assert set(got) == set(want) | {(4, 0)}  # a flat picture tells nothing
    for k, at in want.items():
        assert np.allclose(got[k], at, atol=0.3), (k, got[k], at)
    assert fr.track_points(frames, asked.limit(0)).count() == 0
