"""Recordings in the native layout: packed structs, nanosecond times, dtype literals.

Where Python tasks can reach the store, parts are read range by range through the
data source of ``records``.  In any other store that Spark reads, its ``binaryFile``
source gives whole files: a recording is one task's work then.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import azimuth, elevation
from ..plans.neighbours import col
from ..schema import DURATION, END, KEY, NATIVE_NAMES, START, TS, typed
from .records import PLACE, dtype_of, listing, registered
from .stores import reachable

# Names of the parts, and the fields of the calibration file.
PARTS = {"gaze": "gaze", "imu": "imu", "eye_states": "eye_state", "blinks": "blinks", "fixations": "fixations", "saccades": "fixations"}
CALIBRATION = [
    ("version", "u1"), ("serial", "S6"),
    ("scene_camera_matrix", "f8", (3, 3)), ("scene_distortion_coefficients", "f8", (8,)), ("scene_extrinsics_affine_matrix", "f8", (4, 4)),
    ("right_camera_matrix", "f8", (3, 3)), ("right_distortion_coefficients", "f8", (8,)), ("right_extrinsics_affine_matrix", "f8", (4, 4)),
    ("left_camera_matrix", "f8", (3, 3)), ("left_distortion_coefficients", "f8", (8,)), ("left_extrinsics_affine_matrix", "f8", (4, 4)),
    ("crc", "u4"),
]


def calibration(data: bytes) -> dict:
    """The scene camera's matrix, distortion and serial number."""
    c = np.frombuffer(data, np.dtype(CALIBRATION), count=1)[0]
    return {"camera_matrix": c["scene_camera_matrix"].tolist(), "distortion_coefficients": [c["scene_distortion_coefficients"].tolist()], "serial_number": c["serial"].decode()}


def _files(spark: SparkSession, folder: str | list[str], glob: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder if isinstance(folder, list) else str(folder))
    parts = F.split("path", "/")
    return rows.select(F.element_at(parts, -2).alias(KEY), F.element_at(parts, -1).alias("file"), "content")


def _structs(spark: SparkSession, folder: str | list[str], stem: str, timed: bool) -> DataFrame:
    """All records of ``stem*.raw`` with their place ``__i``, and the times of ``stem*.time``, recording by recording.

    Each recording is read by the dtype file in its own folder; a field that it lacks is null.
    """
    files = _files(spark, folder, f"{{{stem} ps*,{stem}_200hz*,{stem[:3]}*.dtype}}")
    files = files.where(F.col("file").endswith(".raw") | F.col("file").endswith(".time") | F.col("file").endswith(".dtype"))
    # Different dtypes are as many as there are versions of the recording software.
    kinds: dict[str, str] = {}
    texts = files.where(F.col("file").endswith(".dtype")).select(F.decode("content", "UTF-8").alias("t")).distinct().collect()
    if not texts:
        raise FileNotFoundError(f"no file {stem[:3]}*.dtype in {folder}")
    for dtype in (dtype_of(r["t"]) for r in sorted(texts)):
        for n in dtype.names:
            if n != "timestamp_ns":
                kinds[n] = "double" if "double" in (kinds.get(n), "double" if dtype[n].kind == "f" else "bigint") else "bigint"
    schema = ", ".join([f"`{KEY}` string", "__i bigint", *(["t bigint"] if timed else []), *[f"`{n}` {k}" for n, k in kinds.items()]])

    def run(table: pa.Table) -> pa.Table:
        by = dict(zip(table.column("file").to_pylist(), table.column("content").to_pylist()))
        raws = sorted((f for f in by if f.endswith(".raw")), key=lambda f: "200hz" not in f)
        described = sorted(f for f in by if f.endswith(".dtype"))
        kind = lambda n: pa.float64() if kinds[n] == "double" else pa.int64()
        if not raws:
            empty = {KEY: pa.string(), "__i": pa.int64(), **({"t": pa.int64()} if timed else {}), **{n: kind(n) for n in kinds}}
            return pa.table({n: pa.array([], t) for n, t in empty.items()})
        if not described:
            raise FileNotFoundError(f"{table.column(KEY)[0]}: no dtype file for {raws[0]}")
        dtype = dtype_of(by[described[0]].decode())
        records = np.frombuffer(by[raws[0]], dtype)
        out = {KEY: pa.array([table.column(KEY)[0].as_py()] * len(records), pa.string()), "__i": pa.array(np.arange(len(records)))}
        if timed:
            times = by.get(raws[0].removesuffix(".raw") + ".time")
            if times is None or len(times) != 8 * len(records):
                raise ValueError(f"{raws[0]}: samples and times differ in number")
            out["t"] = pa.array(np.frombuffer(times, "<i8"))
        for n in kinds:
            out[n] = pa.array(records[n].astype("f8" if kinds[n] == "double" else "i8")) if n in dtype.names else pa.nulls(len(records), kind(n))
        return pa.table(out)

    return files.groupBy(col(KEY)).applyInArrow(run, schema)


def _named(df: DataFrame) -> DataFrame:
    """Columns under their names; fields that recordings name differently are one column."""
    by: dict[str, list[str]] = {}
    for c in df.columns:
        by.setdefault(NATIVE_NAMES.get(c, c), []).append(c)
    return df.select(*[F.coalesce(*map(col, own)).alias(name) if len(own) > 1 else col(own[0]).alias(name) for name, own in by.items()])


def _records(spark: SparkSession, folder: str | list[str], stem: str, timed: bool, columns: list[str] | None = None, records: int | None = None) -> DataFrame | None:
    """A part through the records source, or None where Python tasks cannot reach the store."""
    folders = [str(f) for f in (folder if isinstance(folder, list) else [folder])]
    if not all(map(reachable, folders)):
        return None
    options = {"folders": json.dumps(folders), "part": stem, "timed": "true" if timed else "false"}
    options |= {"columns": json.dumps(columns)} if columns is not None else {}
    options |= {"records": str(records)} if records else {}
    found = listing(spark, folders, stem, timed)
    options |= {"found": found} if found else {}
    return registered(spark).read.format("glintframe_records").options(**options).load()


def read_stream(spark: SparkSession, folder: str | list[str], name: str, columns: list[str] | None = None, records: int | None = None) -> DataFrame:
    """``gaze``, ``imu`` or ``eye_states`` of one recording, of a folder of them, or of a list of folders.

    ``columns``: the only columns to be decoded besides recording and instant; azimuth and
    elevation of gaze come with its coordinates.  ``records``: structs of one task.
    """
    asked = None if columns is None else [TS, *columns]
    rows = _records(spark, folder, PARTS[name], True, asked, records)
    if rows is None:
        rows = _whole_stream(spark, folder, name)
        rows = rows if asked is None else rows.select(*[col(c) for c in rows.columns if c in (KEY, *asked)])
    else:
        rows = rows.drop(PLACE)
    if name == "gaze" and {"gaze x [px]", "gaze y [px]"} <= set(rows.columns):
        rows = rows.withColumns({"azimuth [deg]": azimuth(col("gaze x [px]")), "elevation [deg]": elevation(col("gaze y [px]"))})
    return typed(rows)


def _whole_stream(spark: SparkSession, folder: str | list[str], name: str) -> DataFrame:
    """A stream by Spark's own reader of whole files: a recording is one task."""
    rows = _named(_structs(spark, folder, PARTS[name], True).withColumnRenamed("t", TS))
    if name == "gaze":
        try:
            worn = _structs(spark, folder, "worn", False)
        except FileNotFoundError:
            return rows.drop("__i")
        # The flag of a sample stands at the same place of its own file, whatever the order of the times.
        rows = rows.join(worn.select(col(KEY), "__i", "worn"), [KEY, "__i"], "left")
    return rows.drop("__i")


def read_events(spark: SparkSession, folder: str | list[str], name: str) -> DataFrame:
    """``blinks``, ``fixations``, ``saccades`` (with ids from 1) or ``events`` (messages)."""
    if name == "events":
        return _messages(spark, folder)
    rows = _records(spark, folder, PARTS[name], False)
    rows = _named(_structs(spark, folder, PARTS[name], False).drop("__i")) if rows is None else rows.drop(PLACE)
    if name != "blinks":
        rows = rows.where(F.col("event_type") == (1 if name == "fixations" else 0)).drop("event_type")
    from pyspark.sql import Window

    order = Window.partitionBy(col(KEY)).orderBy(col(START), col(END))
    own = {"blinks": (), "fixations": ("fixation x [px]", "fixation y [px]"), "saccades": ("amplitude [px]", "amplitude [deg]", "mean velocity [px/s]", "peak velocity [px/s]")}[name]
    rows = rows.withColumn(f"{name.removesuffix('s')} id", F.row_number().over(order)).withColumn(DURATION, F.expr(f"(`{END}` - `{START}`) div 1000000"))
    return typed(rows.select(col(KEY), col(f"{name.removesuffix('s')} id"), col(START), col(END), col(DURATION), *[col(c) for c in own if c in rows.columns]))


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder, "event.t*")

    def run(table: pa.Table) -> pa.Table:
        by = dict(zip(table.column("file").to_pylist(), table.column("content").to_pylist()))
        names = by.get("event.txt", b"").decode().splitlines()
        times = np.frombuffer(by.get("event.time", b""), "<i8")
        if len(names) != len(times):
            raise ValueError("messages and their times differ in number")
        return pa.table({KEY: pa.array([table.column(KEY)[0].as_py()] * len(names), pa.string()), TS: pa.array(times), "name": pa.array(names, pa.string()), "type": pa.array(["recording"] * len(names), pa.string())})

    return typed(files.groupBy(col(KEY)).applyInArrow(run, f"`{KEY}` string, `{TS}` bigint, name string, type string"))


def frame_clock(spark: SparkSession, folder: str | list[str], glob: str = "Neon Scene Camera*.time") -> DataFrame:
    """Frame instants and 0-based indices of a video, from its times alone."""
    files = _files(spark, folder, glob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                t = np.frombuffer(data, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(t), pa.string()), pa.array(t), pa.array(np.arange(len(t)))], names=[KEY, TS, "frame index"])

    return files.mapInArrow(run, f"`{KEY}` string, `{TS}` bigint, `frame index` bigint")
