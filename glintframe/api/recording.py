"""``Recording`` and ``Dataset``: one folder of tables, and many."""

from __future__ import annotations

import json
import warnings
from datetime import UTC, datetime
from functools import cached_property, reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, concat, surface
from ..plans.neighbours import col
from ..schema import KEY, TS
from ..sources import cloud, native
from ..sources.files import Place
from .tables import Events, Stream

STREAMS, EVENTS = ("gaze", "imu", "eye_states"), ("blinks", "fixations", "saccades", "events")
# File names that tell the layouts apart, and metadata files.
CLOUD_MARK, NATIVE_MARKS, INFO, WEARER = "gaze.csv", ("gaze ps1.raw", "gaze ps1.time"), "info.json", "wearer.json"
# Camera data where a recording has none.
DEFAULT_CAMERA = {
    "camera_matrix": [[888.2934878427146, 0.0, 797.1412921708228], [0.0, 888.1105774610824, 612.7149562541089], [0.0, 0.0, 1.0]],
    "distortion_coefficients": [[-0.1297193048199076, 0.10875170107148817, 6.7953760874676e-07, -0.00022697967572936557, 5.796552672316462e-06, 0.16980611822301264, 0.050610238505094475, 0.025633412650283308]],
    "serial_number": "unknown",
}


class Recording:
    """A folder in the cloud or the native layout, in any store that Spark reads; tables are read when first asked for."""

    def __init__(self, spark: SparkSession, recording_dir: object, info: dict | None = None, wearer: dict | None = None) -> None:
        """``info`` and ``wearer``: the contents of the metadata files, where they have been read already."""
        self.spark, self.recording_dir = spark, Place(spark, recording_dir)
        if not self.recording_dir.is_dir():
            raise FileNotFoundError(f"no folder {recording_dir}")
        self.files = self.recording_dir.names()
        if INFO not in self.files:
            raise FileNotFoundError(f"{recording_dir} has no {INFO}")
        self.info: dict = json.loads((self.recording_dir / INFO).read_text()) if info is None else dict(info)
        if CLOUD_MARK in self.files:
            self.format = "cloud"
        elif all(m in self.files for m in NATIVE_MARKS):
            self.format = "native"
            if WEARER in self.files:
                wearer = json.loads((self.recording_dir / WEARER).read_text()) if wearer is None else wearer
                self.info.setdefault("wearer_name", wearer.get("name"))
        else:
            raise FileNotFoundError(f"no gaze data in {recording_dir}: not a recording")
        self.recording_id = self.info.get("recording_id", self.recording_dir.name)

    def has(self, name: str) -> bool:
        """Whether the folder holds the files of a table."""
        if self.format == "cloud":
            return cloud.FILES[name] in self.files
        if name == "events":
            return "event.txt" in self.files
        return any(f.startswith(f"{native.PARTS[name]} ") and f.endswith(".raw") for f in self.files)

    def _rows(self, name: str) -> DataFrame:
        if self.format == "cloud":
            if not self.has(name):
                raise FileNotFoundError(f"{self.recording_dir}/{cloud.FILES[name]}")
            rows = cloud.read_csv(self.spark, str(self.recording_dir / cloud.FILES[name]), self.recording_id)
        else:
            rows = (native.read_stream if name in STREAMS else native.read_events)(self.spark, str(self.recording_dir), name)
        return rows.withColumn(KEY, F.lit(self.recording_id))

    def _load(self, name: str):
        try:
            return (Stream if name in STREAMS else Events)(self._rows(name))
        except Exception as e:
            raise ValueError(f"Recording.{name} cannot be read because: {e}") from e

    gaze = cached_property(lambda self: self._load("gaze"))
    imu = cached_property(lambda self: self._load("imu"))
    eye_states = cached_property(lambda self: self._load("eye_states"))
    blinks = cached_property(lambda self: self._load("blinks"))
    fixations = cached_property(lambda self: self._load("fixations"))
    saccades = cached_property(lambda self: self._load("saccades"))
    events = cached_property(lambda self: self._load("events"))

    @cached_property
    def scene_frames(self) -> DataFrame:
        """Instants and indices of the scene video's frames."""
        if self.format == "native":
            return native.frame_clock(self.spark, str(self.recording_dir)).withColumn(KEY, F.lit(self.recording_id))
        from pyspark.sql import Window

        rows = cloud.read_csv(self.spark, str(self.recording_dir / "world_timestamps.csv"), self.recording_id)
        return rows.select(F.lit(self.recording_id).alias(KEY), col(TS), (F.row_number().over(Window.orderBy(col(TS))) - 1).cast("bigint").alias("frame index"))

    @cached_property
    def camera(self) -> dict:
        """Matrix, distortion and serial number of the scene camera."""
        for name, read in (("scene_camera.json", lambda p: json.loads(p.read_text())), ("calibration.bin", lambda p: native.calibration(p.read_bytes()))):
            if name in self.files:
                return read(self.recording_dir / name)
        return DEFAULT_CAMERA

    @property
    def start_time(self) -> int:
        return self.info["start_time"]

    @property
    def start_datetime(self) -> datetime:
        return datetime.fromtimestamp(self.start_time / 1e9, UTC)

    def __repr__(self) -> str:
        return f"Recording ID: {self.recording_id}\nFormat: {self.format}\nWearer: {self.info.get('wearer_name')}"

    def __enter__(self) -> Recording:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for name in (*STREAMS, *EVENTS, "scene_frames"):
            self.__dict__.pop(name, None)

    def _names(self, names: str | list[str], known: tuple[str, ...]) -> list[str]:
        if isinstance(names, str):
            if names.lower() != "all":
                raise ValueError("names must be a list or 'all'")
            found = []
            for n in known:
                try:
                    found += [n] if getattr(self, n) else []
                except ValueError:
                    pass
            return found
        alias = {"3d_eye_states": "eye_states"}
        out = [alias.get(n.lower(), n.lower()) for n in names]
        out = [n if n in known else f"{n}s" for n in out]
        if bad := [n for n in out if n not in known]:
            raise ValueError(f"unknown names: {bad}")
        return out

    def concat_streams(self, stream_names: str | list[str], sampling_freq: str | float = "min", float_kind: str = "linear", other_kind: str = "nearest") -> Stream:
        names = self._names(stream_names, STREAMS)
        return Stream(concat.concat_streams({n: getattr(self, n).df for n in names}, sampling_freq, float_kind=float_kind, other_kind=other_kind))

    def concat_events(self, events_names: str | list[str]) -> Events:
        names = self._names(events_names, EVENTS)
        return Events(concat.concat_events({n: getattr(self, n).df.drop("event id") if n == "events" else getattr(self, n).df for n in names}))

    def sync_gaze_to_video(self, window_ns: int | None = None) -> Stream:
        return self.gaze.window_average(self.scene_frames, window_ns)

    def density(self, source: str = "gaze", step_size: float = 10, sigma: float | None = None) -> DataFrame:
        """Counts of gaze points or fixations by cell of the scene image, under a Gaussian of ``sigma`` cells if given."""
        kind = "gaze" if source == "gaze" else "fixation"
        counts = surface.density(getattr(self, "gaze" if kind == "gaze" else "fixations").df, f"{kind} x [px]", f"{kind} y [px]", step_size)
        return surface.smooth_density(counts, sigma, step_size) if sigma else counts

    def export_cloud_format(self, target_dir: object) -> None:
        from ..sinks.cloud_export import export_cloud_format

        export_cloud_format(self, target_dir)

    def export_motion_bids(self, motion_dir: object, prefix: str | None = None, extra_metadata: dict | None = None) -> None:
        from ..sinks.bids import export_motion_bids

        export_motion_bids(self, motion_dir, prefix, extra_metadata)

    def export_eye_tracking_bids(self, output_dir: object, prefix: str | None = None, extra_metadata: dict | None = None) -> None:
        from ..sinks.bids import export_eye_tracking_bids

        export_eye_tracking_bids(self, output_dir, prefix, extra_metadata)


class Dataset:
    """All recordings of a folder; each table of all recordings is one DataFrame."""

    def __init__(self, spark: SparkSession, dataset_dir: object) -> None:
        self.spark, self.dataset_dir = spark, Place(spark, dataset_dir)
        if not self.dataset_dir.is_dir():
            raise FileNotFoundError(f"no folder {dataset_dir}")
        listed = "sections.csv" in self.dataset_dir.names()
        folders = self.dataset_dir.names(folders=True)
        if listed:
            self.sections = spark.read.option("header", True).csv(str(self.dataset_dir / "sections.csv"))
            wanted = [r[0].split("-")[0] for r in self.sections.select(col("recording id")).collect()]
            folders = [d for w in wanted for d in self._only([f for f in folders if f.endswith(f"-{w}")], w)]
        told = self._metadata() if folders else {}
        self.recordings: list[Recording] = []
        for d in folders:
            try:
                info, wearer = (json.loads(t) if (t := told.get((d, file))) is not None else None for file in (INFO, WEARER))
                self.recordings.append(Recording(spark, self.dataset_dir / d, info, wearer))
            except Exception as e:
                warnings.warn(f"Skipping {d}: {e}", stacklevel=2)
        if not listed:
            names = ("recording_id", "recording_name", "wearer_id", "wearer_name", "start_time", "duration")
            rows = [(r.info.get("section_id"), *[r.info.get(n) for n in names]) for r in self.recordings]
            rows = [(*map(lambda v: None if v is None else str(v), x[:5]), x[5], None if x[5] is None or x[6] is None else x[5] + x[6]) for x in rows]
            self.sections = spark.createDataFrame(rows, "`section id` string, `recording id` string, `recording name` string, `wearer id` string, `wearer name` string, `section start time [ns]` bigint, `section end time [ns]` bigint")

    def _metadata(self) -> dict[tuple[str, str], str]:
        """By folder and file name: the metadata files of all recordings, read by one job."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{INFO},{WEARER}}}").load(str(self.dataset_dir))
        at = F.split("path", "/")
        above = F.element_at(at, -3) == self.dataset_dir.name
        return {(r[0], r[1]): r[2] for r in files.where(above).select(F.element_at(at, -2), F.element_at(at, -1), F.decode("content", "UTF-8")).collect()}

    @staticmethod
    def _only(found: list[str], what: str) -> list[str]:
        if len(found) != 1:
            raise FileNotFoundError(f"{len(found)} folders for recording {what}")
        return found

    def __len__(self) -> int:
        return len(self.recordings)

    def __getitem__(self, index: int) -> Recording:
        return self.recordings[index]

    def __repr__(self) -> str:
        return f"Dataset | {len(self)} recordings"

    def table(self, name: str) -> Stream | Events:
        """One table of all recordings together; recordings without it are left out.

        Native recordings are one scan.  Files of the cloud layout are one scan for each
        different header, of which there are as many as the layout has versions.
        """
        if name not in (*STREAMS, *EVENTS):
            raise ValueError(f"unknown table: {name}")
        have = [r for r in self.recordings if r.has(name)]
        for r in self.recordings:
            if r not in have:
                warnings.warn(f"{r.recording_dir.name} has no {name}", stacklevel=2)
        if not have:
            raise ValueError(f"no recording has {name}")
        parts = []
        if folders := [str(r.recording_dir) for r in have if r.format == "native"]:
            parts.append((native.read_stream if name in STREAMS else native.read_events)(self.spark, folders, name))
        files = [r.recording_dir / cloud.FILES[name] for r in have if r.format == "cloud"]
        headers: dict[str, list[str]] = {}
        with ThreadPool(16) as pool:
            for file, header in zip(files, pool.map(Place.first_line, files)):
                headers.setdefault(header, []).append(str(file))
        parts += [cloud.read_csv(self.spark, paths, by_folder=True) for paths in headers.values()]
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        ids = self.spark.createDataFrame([(r.recording_dir.name, r.recording_id) for r in have], "__folder string, __id string")
        both = both.join(ids, col(KEY) == F.col("__folder")).withColumn(KEY, F.col("__id")).drop("__folder", "__id")
        return (Stream if name in STREAMS else Events)(both)


    def export_cloud_format(self, target_dir: object) -> None:
        """All native recordings in the cloud layout, by one job."""
        from ..sinks.cloud_export import export_dataset_cloud

        export_dataset_cloud(self, target_dir)

    def export_bids(self, target_dir: object, task: str = "TaskName", extra_metadata: dict | None = None) -> None:
        """Motion and eye tracking of all recordings, by one job."""
        from ..sinks.bids import export_dataset_bids

        export_dataset_bids(self, target_dir, task, extra_metadata)


resample_grid = align.uniform_grid
