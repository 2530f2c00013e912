"""Image operators: they need OpenCV, which is optional; frames come as encoded images.

Everything that needs no pixels (scores, selection, homographies, statuses) is in the
other modules and works without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from ..plans.neighbours import col
from ..schema import CORNERS, KEY, TS

# Marker families.
APRILTAG = ("16h5", "25h9", "36h10", "36h11")
ARUCO_SIZES, ARUCO_COUNTS = (4, 5, 6, 7), (50, 100, 250, 1000)


def opencv():
    try:
        import cv2
    except ImportError as e:
        raise ImportError("this operator needs OpenCV (cv2), which is not installed") from e
    return cv2


def marker_dictionary(family: str) -> str:
    """The OpenCV dictionary of a family: ``36h11``, ``6x6_250``, ``aruco_original``."""
    name = family.lower().removeprefix("tag")
    if name in APRILTAG:
        return f"DICT_APRILTAG_{name}"
    size, _, count = name.partition("_")
    if size in [f"{s}x{s}" for s in ARUCO_SIZES] and count in map(str, ARUCO_COUNTS):
        return f"DICT_{size.upper()}_{count}"
    if name in ("aruco_original", "original"):
        return "DICT_ARUCO_ORIGINAL"
    raise ValueError(f"unknown marker family: {family}")


def detect_markers(frames: DataFrame, families: list[str], image: str = "image", key: str = KEY, ts: str = TS) -> DataFrame:
    """Markers of every frame image: id, name, corners from the top left around, and centre."""
    names = {f: marker_dictionary(f) for f in families}
    opencv()
    numbers = [f"`{c} {a} [px]` double" for c in (*CORNERS, "center") for a in "xy"]
    schema = ", ".join([f"`{key}` {dict(frames.dtypes)[key]}", f"`{ts}` bigint", "`frame index` bigint", "`marker family` string", "`marker id` string", "`marker name` string", *numbers])
    rows = frames.select(col(key), col(ts), col("frame index"), col(image).alias("image"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        cv2 = opencv()
        finders = {f: cv2.aruco.ArucoDetector(cv2.aruco.getPredefinedDictionary(getattr(cv2.aruco, n))) for f, n in names.items()}
        for batch in batches:
            found = []
            for k, t, i, data in batch.itertuples(index=False):
                gray = cv2.imdecode(np.frombuffer(data, np.uint8), cv2.IMREAD_GRAYSCALE)
                for family, finder in finders.items():
                    corners, ids, _ = finder.detectMarkers(gray)
                    for c, m in zip(corners, [] if ids is None else ids.ravel()):
                        c = c.reshape(4, 2)
                        c = c[[2, 3, 0, 1]] if names[family].startswith("DICT_APRILTAG") else c
                        found.append([k, t, i, family, str(m), f"{family}_{m}", *c.ravel().tolist(), *c.mean(0).tolist()])
            yield pd.DataFrame(found, columns=[x.split("`")[1] for x in schema.split(", ")])

    return rows.mapInPandas(run, schema)


def brightness(frames: DataFrame, image: str = "image", key: str = KEY, ts: str = TS) -> DataFrame:
    """Mean grey value of every frame image."""
    opencv()
    rows = frames.select(col(key), col(ts), col(image).alias("image"))

    def run(batches: Iterator) -> Iterator:
        cv2 = opencv()
        for b in batches:
            b["brightness"] = [float(cv2.imdecode(np.frombuffer(x, np.uint8), cv2.IMREAD_GRAYSCALE).mean()) for x in b["image"]]
            yield b.drop(columns="image")

    return rows.mapInPandas(run, f"`{key}` {dict(frames.dtypes)[key]}, `{ts}` bigint, brightness double")
