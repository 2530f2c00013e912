"""Points on surfaces: angles, homographies found and applied, densities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans.neighbours import col
from ..schema import CORNERS, HOMOGRAPHY_COLUMNS, KEY, START, TS, require
from .align import interpolate


def compute_azimuth_and_elevation(df: DataFrame, method: str = "linear", overwrite: bool = False) -> DataFrame:
    """Angles of the gaze point in the scene camera's field of view."""
    if method != "linear":
        raise ValueError("only the linear method is known")
    require(df, "gaze x [px]", "gaze y [px]")
    new = ("azimuth [deg]", "elevation [deg]")
    if not overwrite and any(c in df.columns for c in new):
        raise ValueError("the columns are there already; set overwrite")
    return df.withColumns({new[0]: G.azimuth(col("gaze x [px]")), new[1]: G.elevation(col("gaze y [px]"))})


def apply_homographies(points: DataFrame, homographies: DataFrame, x: str = "gaze x [px]", y: str = "gaze y [px]", prefix: str = "gaze", at: str = TS, max_gap_ms: float | None = 500, overwrite: bool = False, key: str = KEY, ts: str = TS) -> DataFrame:
    """Points in surface coordinates, under the homography interpolated elementwise to their instants.

    Points without a homography, or with one that is not whole, get null.
    """
    require(points, x, y)
    new = [f"{prefix} {a} [surface coord]" for a in "xy"]
    if not overwrite and any(c in points.columns for c in new):
        raise ValueError("the columns are there already; set overwrite")
    keep = [c for c in points.columns if c not in new]
    asked = points.select(*[col(c) for c in keep])
    asked = asked if at == ts else asked.withColumn(ts, col(at))
    out = interpolate(homographies, asked, list(HOMOGRAPHY_COLUMNS), max_gap_ms=max_gap_ms, key=key, ts=ts)
    h = [col(c) for c in HOMOGRAPHY_COLUMNS]
    px, py = G.project(h, col(x), col(y))
    return out.select(*[col(c) for c in keep], px.alias(new[0]), py.alias(new[1]))


def apply_homographies_to_fixations(events: DataFrame, homographies: DataFrame, **how) -> DataFrame:
    """The same for fixations, at their starts."""
    return apply_homographies(events, homographies, "fixation x [px]", "fixation y [px]", "fixation", START, **how)


def homographies_of(image: np.ndarray, surface: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
    """Least-squares homographies of stacks of point pairs (``... x n x 2``) by the normalised direct linear transform.

    ``use``: which pairs count (``... x n``).  Pairs that tell no homography, such as points
    on a line, give NaN.
    """
    use = np.ones(image.shape[:-1], bool) if use is None else use
    many = np.maximum(use.sum(-1), 1)[..., None]

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = (p * use[..., None]).sum(-2) / many
        away = np.sqrt(((p - centre[..., None, :]) ** 2).sum(-1))
        d = (away * use).sum(-1) / many[..., 0]
        s = np.sqrt(2) / np.where(d > 0, d, np.nan)
        t = np.zeros((*s.shape, 3, 3))
        t[..., 0, 0] = t[..., 1, 1] = s
        t[..., :2, 2] = -s[..., None] * centre
        t[..., 2, 2] = 1
        return (p - centre[..., None, :]) * s[..., None, None], t

    (a, ta), (b, tb) = normal(image), normal(surface)
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    none, one = np.zeros_like(x), np.ones_like(x)
    rows = np.concatenate([np.stack([-x, -y, -one, none, none, none, u * x, u * y, u], -1), np.stack([none, none, none, -x, -y, -one, v * x, v * y, v], -1)], -2)
    rows = rows * np.concatenate([use, use], -1)[..., None]
    good = np.isfinite(rows).all((-1, -2))
    _, size, vt = np.linalg.svd(np.where(good[..., None, None], rows, 0.0), full_matrices=True)
    good &= (size[..., 7] > 1e-9 * np.maximum(size[..., 0], 1e-300)) & (use.sum(-1) >= 4)
    h = vt[..., -1, :].reshape(*vt.shape[:-2], 3, 3)
    h = np.linalg.inv(np.where(good[..., None, None], tb, np.eye(3))) @ h @ ta
    with np.errstate(divide="ignore", invalid="ignore"):
        h = h / h[..., 2:, 2:]
    return np.where((good & np.isfinite(h).all((-1, -2)) & (np.abs(np.linalg.det(np.where(np.isfinite(h), h, 0.0))) > 1e-15))[..., None, None], h, np.nan)


def homography(image: np.ndarray, surface: np.ndarray) -> np.ndarray:
    """Least-squares homography of point pairs; NaN where they tell none."""
    return homographies_of(np.asarray(image, float), np.asarray(surface, float))


def _transfer(h: np.ndarray, image: np.ndarray, surface: np.ndarray) -> np.ndarray:
    """Squared distances of the projected points to their partners, for stacks of both."""
    p = np.concatenate([image, np.ones((*image.shape[:-1], 1))], -1) @ np.swapaxes(h, -1, -2)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = ((p[..., :2] / p[..., 2:] - surface) ** 2).sum(-1)
    return np.where(np.isfinite(d), d, np.inf)


#: Homographies that are fitted at once.
FITS = 4096


def robust_homographies(image: np.ndarray, surface: np.ndarray, method: str = "lmeds", threshold: float = 3.0, samples: int = 200) -> np.ndarray:
    """Homographies of frames (``frames x n x 2``) that some wrong point pairs do not move.

    Of homographies of four pairs each (the same draws in every frame, all frames of a
    batch in one stack), the one of least median error (``lmeds``) or of most pairs within
    ``threshold`` (``ransac``) tells a frame's good pairs, and the least-squares fit of these
    is the result.  Draws go on, up to ``samples``, only for frames whose share of good
    pairs leaves a doubt of one in a thousand that four good ones were drawn.
    """
    if method not in ("lstsq", "lmeds", "ransac"):
        raise ValueError("method must be 'lstsq', 'lmeds' or 'ransac'")
    count, n = image.shape[:2]
    if method == "lstsq" or n <= 4:
        return homographies_of(image, surface)
    random = np.random.default_rng(0)
    draws = np.stack([random.choice(n, 4, replace=False) for _ in range(samples)])
    best, error = np.full(count, np.inf), np.full((count, n), np.inf)
    open_ = np.arange(count)
    for k in range(0, samples, 20):
        pick = draws[k : k + 20]
        for i in range(0, len(open_), max(1, FITS // len(pick))):
            own = open_[i : i + max(1, FITS // len(pick))]
            h = homographies_of(image[own][:, pick], surface[own][:, pick])
            found = _transfer(h, image[own][:, None], surface[own][:, None])
            worth = np.median(found, -1) if method == "lmeds" else -(found <= threshold**2).sum(-1).astype(float)
            at = worth.argmin(1)
            worth, found = np.take_along_axis(worth, at[:, None], 1)[:, 0], found[np.arange(len(own)), at]
            better = worth < best[own]
            best[own[better]], error[own[better]] = worth[better], found[better]
        share = (error[open_] <= _limit(best[open_], n, method, threshold)[:, None]).mean(1)
        open_ = open_[(1 - share**4) ** (k + len(pick)) > 1e-3]
        if not len(open_):
            break
    good = error <= _limit(best, n, method, threshold)[:, None]
    good[good.sum(1) < 4] = True
    return homographies_of(image, surface, good)


def _limit(best: np.ndarray, n: int, method: str, threshold: float) -> np.ndarray:
    """The squared error of a good pair: within 2.5 deviations, as the median of normal errors tells them, or the threshold."""
    if method == "ransac":
        return np.full(len(best), threshold**2)
    return np.maximum((2.5 * 1.4826 * (1 + 5 / max(1, n - 4))) ** 2 * best, 1e-9)


def robust_homography(image: np.ndarray, surface: np.ndarray, method: str = "lmeds", threshold: float = 3.0, samples: int = 200) -> np.ndarray:
    """``robust_homographies`` of one frame."""
    return robust_homographies(np.asarray(image, float)[None], np.asarray(surface, float)[None], method, threshold, samples)[0]


def find_homographies(detections: DataFrame, layout: DataFrame | np.ndarray, name: str = "marker name", min_markers: int = 2, method: str = "lmeds", threshold: float = 3.0, key: str = KEY, ts: str = TS) -> DataFrame:
    """A homography per instant with at least ``min_markers`` markers of the layout.

    The layout of markers (marker name, size, center x, center y) is joined by name; markers that
    it lacks are left out.  The layout of a contour is a 4 x 2 array of its corners.  Corners go
    around from the top left.  ``method``: ``lstsq``, ``lmeds`` or ``ransac``.  A frame's corners are
    gathered by Spark; Python fits all frames of a batch that have as many corners in one stack.  A
    marker with a null or NaN corner is left out; a frame whose corners tell no homography
    (equal ones, or all on a line) gives no row.
    """
    corners = [F.array(*[col(f"{c} {a} [px]").cast("double") for c in CORNERS for a in "xy"]).alias("i")]
    if isinstance(layout, np.ndarray):
        if layout.shape != (4, 2):
            raise ValueError("the layout of a contour is a 4 x 2 array")
        own = F.array(*[F.lit(float(v)) for v in layout.ravel()]).alias("s")
        rows, min_markers = detections.select(col(key), col(ts), F.lit("").alias("n"), *corners, own), 1
    else:
        require(layout, "marker name", "size", "center x", "center y")
        signs = ((-1, -1), (1, -1), (1, 1), (-1, 1))
        slim = layout.select(col("marker name").alias(name), F.array(*[(col(f"center {a}") + s * col("size") / 2).cast("double") for sxy in signs for a, s in zip("xy", sxy)]).alias("s"))
        rows = detections.select(col(key), col(ts), col(name), *corners).join(slim, name).withColumnRenamed(name, "n")
    whole = ~F.exists("i", lambda x: x.isNull() | F.isnan(x)) & ~F.exists("s", lambda x: x.isNull() | F.isnan(x))
    frames = rows.where(whole).groupBy(col(key), col(ts)).agg(F.sort_array(F.collect_list(F.struct("n", "i", "s"))).alias("m")).where(F.size("m") >= min_markers)
    frames = frames.select(col(key), col(ts), F.flatten(F.transform("m", lambda x: x["i"])).alias("i"), F.flatten(F.transform("m", lambda x: x["s"])).alias("s"))
    schema = ", ".join([f"`{key}` {dict(detections.dtypes)[key]}", f"`{ts}` bigint", *[f"`{c}` double" for c in HOMOGRAPHY_COLUMNS]])

    def run(batches):
        import pandas as pd

        for b in batches:
            h = np.full((len(b), 3, 3), np.nan)
            size = b["i"].map(len).to_numpy()
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                image, surface = (np.stack(b[c].iloc[own].to_list()).reshape(len(own), -1, 2) for c in "is")
                h[own] = robust_homographies(image, surface, method, threshold)
            told = np.isfinite(h).all((1, 2))
            yield pd.concat([b[[key, ts]], pd.DataFrame(h.reshape(-1, 9), columns=list(HOMOGRAPHY_COLUMNS), index=b.index)], axis=1)[told]

    return frames.mapInPandas(run, schema)


def select_contours(candidates: DataFrame, mode: str = "largest", min_area_ratio: float = 0.01, max_area_ratio: float = 0.98, corners: str = "corners", area: str = "area_ratio", key: str = KEY, ts: str = TS) -> DataFrame:
    """Of each frame's candidate quadrilaterals the largest, or the most rectangular (``best``), as a detection row.

    A candidate has four ``corners`` (structs x, y, in any order) and its share of the
    frame's area; others than those within the bounds are left out.  Ties go to the
    better score or area, then to the corners.
    """
    if mode not in ("largest", "best"):
        raise ValueError("mode must be 'largest' or 'best'")
    rows = candidates.where(col(area).between(min_area_ratio, max_area_ratio) & (F.size(col(corners)) == 4))
    rows = rows.select(col(key), col(ts), col(area).alias("area_ratio"), G.ordered_corners(col(corners)).alias("c"))
    rows = rows.withColumn("score", G.rectangle_score(F.col("c")))
    rank = F.struct("area_ratio", "score", "c") if mode == "largest" else F.struct("score", "area_ratio", "c")
    best = rows.groupBy(col(key), col(ts)).agg(F.max(rank).alias("b"))
    at = [F.col("b.c")[i][a].alias(f"{c} {a} [px]") for i, c in enumerate(CORNERS) for a in "xy"]
    middle = [(sum((F.col("b.c")[i][a] for i in range(1, 4)), F.col("b.c")[0][a]) / 4).alias(f"center {a} [px]") for a in "xy"]
    return best.select(col(key), col(ts), F.lit("contour_0").alias("contour name"), *at, *middle, F.col("b.area_ratio").alias("area_ratio"), F.col("b.score").alias("score"))


def frame_detections(frames: DataFrame, detections: DataFrame, columns: list[str], key: str = KEY, index: str = "frame index") -> DataFrame:
    """Every frame with the detections in it, as an array of structs in order (empty for none)."""
    lists = detections.groupBy(col(key), col(index)).agg(F.sort_array(F.collect_list(F.struct(*[col(c) for c in columns]))).alias("detections"))
    out = frames.join(lists, [key, index], "left")
    return out.withColumn("detections", F.coalesce("detections", F.array().cast(lists.schema["detections"].dataType)))


def density(df: DataFrame, x: str = "gaze x [px]", y: str = "gaze y [px]", step: float = 10, width: float = G.WIDTH, height: float = G.HEIGHT, key: str = KEY) -> DataFrame:
    """Counts by recording and grid cell; points outside are left out, the far edges belong to the last cells."""
    cell = lambda c, size: F.least(F.floor(col(c) / F.lit(float(step))), F.lit(int(np.ceil(size / step)) - 1)).cast("int")
    inside = col(x).between(0, width) & col(y).between(0, height)
    return df.where(inside).groupBy(col(key), cell(x, width).alias("x bin"), cell(y, height).alias("y bin")).agg(F.count("*").alias("count"))


def gaussian(sigma: float) -> list[float]:
    """Weights of a Gaussian to four deviations, of sum 1."""
    radius = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return (kernel / kernel.sum()).tolist()


def smooth_density(counts: DataFrame, sigma: float | None, step: float = 10, width: float = G.WIDTH, height: float = G.HEIGHT, key: str = KEY) -> DataFrame:
    """A density (see there) under a Gaussian of ``sigma`` cells with reflected edges; None or 0 leaves it.

    The Gaussian is separable: along each axis every cell is dealt to its neighbours by
    weight, images beyond the edges included, and the shares are summed.  A sum is combined
    before its shuffle, so a recording's grid is never gathered.  Cells beyond the
    reach of all points have no row.
    """
    counts = counts.withColumn("count", F.col("count").cast("double"))
    if not sigma or sigma <= 0:
        return counts
    weights = gaussian(sigma)
    radius = len(weights) // 2
    kernel = F.array(*[F.lit(w) for w in weights])
    for axis, size in (("x bin", width), ("y bin", height)):
        n, other = int(np.ceil(size / step)), "y bin" if axis == "x bin" else "x bin"
        # Where the cell itself and its mirror images lie on the axis without end.
        turns = F.explode(F.array(*[F.lit(2 * n * m) for m in range(-(radius // (2 * n)) - 1, radius // (2 * n) + 2)]))
        images = counts.select(col(key), col(axis).alias("i"), col(other), "count", turns.alias("turn"))
        images = images.select(col(key), col(other), "count", F.explode(F.array(F.col("turn") + F.col("i"), F.col("turn") - 1 - F.col("i"))).alias("p"))
        images = images.where((F.col("p") >= -radius) & (F.col("p") < n + radius))
        to = F.sequence(F.greatest(F.lit(0), F.col("p") - radius), F.least(F.lit(n - 1), F.col("p") + radius))
        dealt = images.select(col(key), col(other), "count", "p", F.explode(to).alias(axis))
        share = F.col("count") * F.get(kernel, F.col("p") - col(axis) + radius)
        counts = dealt.groupBy(col(key), col(axis), col(other)).agg(F.sum(share).alias("count"))
    return counts.select(col(key), col("x bin"), col("y bin"), "count")
