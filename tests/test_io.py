import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe import Dataset, Recording, Stream
from glintframe.operators import video
from glintframe.schema import KEY, NATIVE_NAMES, TS, event_type, stream_type
from glintframe.sinks import bids, named
from glintframe.sinks.native import write_native_stream
from glintframe.sources import native
from glintframe.sources.files import Place


def test_cloud_recording(spark, cloud_dir, frames):
    r = Recording(spark, cloud_dir)
    assert r.format == "cloud" and r.recording_id == "r1"
    got = r.gaze.df.orderBy(F.col(f"`{TS}`")).toPandas()
    assert (got["gaze x [px]"].to_numpy() == frames["gaze"]["gaze x [px]"].to_numpy()).all() and r.gaze.type == "gaze"
    assert r.events.type == "events" and len(r.blinks) == 5
    assert len(r.concat_events("all")) == 15
    assert r.concat_streams(["gaze", "imu"]).columns[0] == "gaze x [px]"
    with pytest.raises(ValueError):
        r.concat_streams(["nothing", "imu"])
    (cloud_dir / "imu.csv").unlink()
    r.close()
    with pytest.raises(ValueError, match="Recording.imu cannot be read"):
        r.imu  # noqa: B018


def test_csv_round_trip(spark, tables, frames, tmp_path):
    Stream(tables["custom"]).save(tmp_path / "s")
    again = Stream.read_csv(spark, str(tmp_path / "s")).df.orderBy(F.col(f"`{TS}`")).toPandas()
    assert (again["custom x"].to_numpy() == frames["custom"]["custom x"].to_numpy()).all()


def test_native_recording_and_export(spark, native_dir, tmp_path):
    r = Recording(spark, native_dir)
    g = r.gaze.df.orderBy(F.col(f"`{TS}`")).toPandas()
    assert r.format == "native" and g["gaze y [px]"].to_list() == [2.0 * i for i in range(10)] and g["worn"].to_list() == [1] * 10 and "azimuth [deg]" in g
    assert r.imu.columns == ["gyro x [deg/s]", "acceleration y [g]"]
    assert r.fixations.df.count() == 2 and r.saccades.df.count() == 1
    assert r.blinks.df.first()["duration [ms]"] == 20 and r.blinks.df.first()["blink id"] == 1
    assert r.scene_frames.count() == 4 and r.info["wearer_name"] == "Someone"
    out = tmp_path / "cloud"
    with pytest.warns(UserWarning):
        r.export_cloud_format(out)
    c = Recording(spark, out)
    assert c.format == "cloud" and len(c.gaze) == 10 and len(c.events) == 2 and not (out / "3d_eye_states.csv").exists()
    assert (out / "gaze.csv").read_text().startswith("section id,recording id,timestamp [ns]") and (out / "template.csv").read_text().split() == ["id,title", "1,a"]
    with pytest.raises(ValueError):
        c.export_cloud_format(tmp_path / "again")
    with pytest.raises(ValueError):
        r.export_cloud_format(native_dir)


def test_native_records_by_place_and_dtype(spark, native_dir):
    """Times out of order, and a second recording whose software wrote other fields."""
    t = np.frombuffer((native_dir / "gaze ps1.time").read_bytes(), "<i8")[::-1]
    (native_dir / "gaze ps1.time").write_bytes(t.tobytes())
    worn = np.zeros(10, [("worn", "u1")])
    worn["worn"][:3] = 1
    (native_dir / "worn ps1.raw").write_bytes(worn.tobytes())
    other = native_dir.parent / "native-2"
    other.mkdir()
    gaze = np.zeros(4, [("timestamp_ns", "<i8"), ("point_x", "<f8"), ("point_y", "<f8")])
    gaze["point_x"] = [5, 6, 7, 8]
    (other / "gaze ps1.raw").write_bytes(gaze.tobytes())
    (other / "gaze ps1.time").write_bytes(np.arange(4, dtype="<i8").tobytes())
    (other / "gaze.dtype").write_text(str(gaze.dtype.descr))
    both = native.read_stream(spark, f"file://{native_dir.parent}", "gaze").toPandas()
    one = both[both["recording id"] == "native-1"].sort_values(TS)
    assert one["worn"].to_list() == [0] * 7 + [1] * 3 and one["gaze x [px]"].to_list() == [float(i) for i in range(9, -1, -1)]
    two = both[both["recording id"] == "native-2"].sort_values(TS)
    assert two["gaze x [px]"].to_list() == [5.0, 6.0, 7.0, 8.0] and two["worn"].isna().all()


def test_dataset(spark, cloud_dir):
    (cloud_dir.parent / "broken").mkdir()
    with pytest.warns(UserWarning, match="Skipping"):
        d = Dataset(spark, cloud_dir.parent)
    assert len(d) == 1 and d[0].recording_id == "r1" and d.sections.count() == 1 and len(d.table("gaze")) == 199


def test_motion_bids(spark, cloud_dir, tmp_path):
    r = Recording(spark, cloud_dir)
    out = tmp_path / "sub-7" / "ses-2" / "motion"
    with pytest.raises(RuntimeWarning):
        r.export_motion_bids(tmp_path / "elsewhere")
    assert not (tmp_path / "elsewhere").exists()
    with pytest.raises(ValueError):
        r.export_motion_bids(out, prefix="sub-7_task-x")
    r.export_motion_bids(out)
    r.export_motion_bids(out)
    prefix = "sub-7_ses-2_task-TaskName_tracksys-NeonIMU"
    lines = (out / f"{prefix}_motion.tsv").read_text().splitlines()
    assert len(lines) == r.imu.interpolate(max_gap_ms=None).df.count() and len(lines[0].split("\t")) == 2
    meta = json.loads((out / f"{prefix}_motion.json").read_text())
    assert meta["GYROChannelCount"] == 2 and meta["SamplingFrequency"] == 110 and meta["TaskName"] == "TaskName"
    assert len((out.parent / "sub-7_ses-2_scans.tsv").read_text().splitlines()) == 2
    assert (out / f"{prefix}_channels.tsv").read_text().splitlines()[1].split("\t")[:3] == ["gyro x", "x", "GYRO"]


def test_eye_tracking_bids(spark, cloud_dir, tmp_path):
    r = Recording(spark, cloud_dir)
    out = tmp_path / "sub-9" / "beh"
    r.export_eye_tracking_bids(out)
    physio = gzip.decompress((out / "sub-9_task-TaskName_physio.tsv.gz").read_bytes()).decode().splitlines()
    assert len(physio) == 199 and physio[0].split("\t")[3] == "n/a" and len(physio[0].split("\t")) == 5
    events = [x.split("\t") for x in gzip.decompress((out / "sub-9_task-TaskName_physioevents.tsv.gz").read_bytes()).decode().splitlines()]
    assert len(events) == 15 and [int(e[0]) for e in events] == sorted(int(e[0]) for e in events)
    with pytest.raises(ValueError):
        r.export_eye_tracking_bids(out, prefix="task-x")


def test_optional_parts():
    assert video.marker_dictionary("36h11") == "DICT_APRILTAG_36h11" and video.marker_dictionary("6x6_250") == "DICT_6X6_250"
    with pytest.raises(ValueError):
        video.marker_dictionary("7h7")
    with pytest.raises(ImportError):
        video.opencv()
    assert NATIVE_NAMES["pupil_diameter_left_mm"] == "pupil diameter left [mm]" and NATIVE_NAMES["eyeball_center_left_x"] == "eyeball center left x [mm]" and NATIVE_NAMES["eyelid_aperture_left_mm"] == "eyelid aperture left [mm]"
    assert NATIVE_NAMES["eyelid_angle_top_left"] == "eyelid angle top left [rad]" and NATIVE_NAMES["accel_x"] == "acceleration x [g]" and NATIVE_NAMES["angular_velocity_z"] == "gyro z [deg/s]" and len(NATIVE_NAMES) == 49


def test_dataset_reads_many_recordings_together(spark, cloud_dir, native_dir):
    """Two cloud recordings with different columns and a native one, in folders with spaces, as one table."""
    top = cloud_dir.parent
    other = top / "rec 2+%"
    other.mkdir()
    (other / "info.json").write_text(json.dumps({"recording_id": "r2", "start_time": 1, "duration": 2}))
    (other / "gaze.csv").write_text("recording id,timestamp [ns],gaze x [px],gaze y [px],extra\nx,3,1.5,2.5,9\nx,5,3.5,4.5,8\n")
    native_dir.rename(top / "native 1")
    d = Dataset(spark, f"file://{top}")
    assert [r.recording_id for r in d.recordings] == ["n1", "r2", "r1"] and d[0].info["wearer_name"] == "Someone"
    gaze = d.table("gaze").df
    assert {r[0]: r[1] for r in gaze.groupBy("recording id").count().collect()} == {"n1": 10, "r1": 199, "r2": 2}
    assert gaze.where("`recording id` = 'r2'").agg(F.sum("extra")).first()[0] == 17
    with pytest.warns(UserWarning, match="has no imu"):
        imu = d.table("imu")
    assert imu.df.select("recording id").distinct().count() == 2
    (top.parent / "empty").mkdir()
    with pytest.raises(ValueError, match="no recording has"):
        Dataset(spark, top.parent / "empty").table("imu")


def test_place(spark, tmp_path):
    here = Place(spark, f"file://{tmp_path}") / "a b"
    here.mkdir()
    (here / "x.txt").write_text("ä\nb")
    assert (here / "x.txt").read_text() == "ä\nb" and (here / "x.txt").first_line() == "ä" and here.names() == ["x.txt"] and here.parent.names(folders=True) == ["a b"]
    (here / "x.txt").copy_to(here / "y.txt")
    (here / "t.csv").write_csv(spark.range(3).where("id < 0"), header=True)
    (here / "t.csv").write_csv(spark.range(3).orderBy("id"), header=True)
    assert (tmp_path / "a b" / "t.csv").read_text().split() == ["id", "0", "1", "2"]
    assert sorted(p.name for p in (tmp_path / "a b").iterdir()) == ["t.csv", "x.txt", "y.txt"] and not (here / "z").is_file()


def test_types_and_channels():
    assert stream_type([TS, "gaze x [px]"]) == "gaze" and stream_type(["gyro x [deg/s]"]) == "imu" and stream_type(["pupil diameter left [mm]"]) == "eye_states"
    assert stream_type(["gaze x [px]", "gyro x [deg/s]"]) == "custom" and stream_type(["v"]) == "custom"
    assert event_type(["blink id", "start timestamp [ns]"]) == ("blinks", "blink id") and event_type([TS, "name"]) == ("events", "event id")
    with pytest.warns(UserWarning, match="odd"):
        rows = bids.channel_rows(["gyro x [deg/s]", "quaternion w", "odd [m]"], 110.0)
    assert [tuple(r[k] for k in ("name", "component", "type", "units")) for r in rows] == [("gyro x", "x", "GYRO", "deg/s"), ("quaternion w", "quat_w", "ORNT", "arbitrary"), ("odd", "n/a", "n/a", "n/a")]


def test_a_recording_is_read_by_many_tasks(spark, tmp_path):
    rows = spark.range(2500).select(F.lit("r 1").alias(KEY), (F.col("id") * 10).alias(TS), F.col("id").cast("double").alias("gaze x [px]"), F.when(F.col("id") > 5, F.col("id") * 2.0).alias("gaze y [px]"))
    write_native_stream(rows, str(tmp_path), "gaze", {"gaze x [px]": ("x", "<f4"), "gaze y [px]": ("y", "<f8")})
    (tmp_path / "r 1" / "worn ps1.raw").write_bytes(bytes([1] * 1000 + [0] * 1000))  # ends early
    (tmp_path / "r 1" / "worn.dtype").write_text("[('worn', 'u1')]")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["r 1"]
    got = native.read_stream(spark, str(tmp_path), "gaze", records=300)
    assert got.rdd.getNumPartitions() == 9
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() == 9
    back = got.orderBy(f"`{TS}`").collect()
    assert [r[TS] for r in back] == [10 * i for i in range(2500)] and back[3]["gaze y [px]"] is None and back[7]["gaze y [px]"] == 14.0
    assert [r["worn"] for r in back] == [1] * 1000 + [0] * 1000 + [None] * 500
    some = native.read_stream(spark, str(tmp_path), "gaze", columns=["gaze x [px]"], records=300).where(f"`{TS}` > 20000 and `{TS}` <= 20100 and `gaze x [px]` <> 2005")
    assert some.columns == [KEY, TS, "gaze x [px]"] and sorted(r[2] for r in some.collect()) == [float(i) for i in range(2001, 2011) if i != 2005]
    assert some.select(F.spark_partition_id().alias("p")).distinct().count() == 1  # ranges without an instant inside give nothing
    (tmp_path / "r 1" / "gaze ps1.time").write_bytes(b"x" * 8)
    with pytest.raises(Exception, match="differ in number"):
        native.read_stream(spark, str(tmp_path), "gaze")


def test_many_recordings_are_few_tasks(spark, tmp_path):
    """Ranges share partitions, rows stay as they are, and no task gets the list of all recordings."""
    import pickle

    from glintframe.sources import records

    rows = spark.range(4200).select(F.concat(F.lit("r"), F.col("id") % 700).alias(KEY), (F.col("id") * 10).alias(TS), F.col("id").alias("v"))
    write_native_stream(rows, str(tmp_path), "imu", {"v": ("v", "<i8")})
    got = native.read_stream(spark, str(tmp_path), "imu", records=4)
    assert got.rdd.getNumPartitions() <= records.TASKS
    assert sorted(map(tuple, got.collect())) == sorted((f"r{i % 700}", 10 * i, i) for i in range(4200))
    some = native.read_stream(spark, str(tmp_path), "imu", columns=["v"], records=4).where(f"`{TS}` >= 20000 and `{TS}` < 20100")
    assert sorted(r["v"] for r in some.collect()) == list(range(2000, 2010))
    source = records.Records({"folders": json.dumps([str(tmp_path)]), "part": "imu", "timed": "true", "records": "4"})
    reader = source.reader(source.schema())
    assert len(pickle.dumps(reader)) < 2000 and sum(p.count for b in reader.partitions() for p in b.parts) == 4200


def test_folders_are_listed_once(spark, tmp_path, monkeypatch):
    """The data source keeps what it found from the schema to the plans, and does not lose records of a file cut since."""
    import pickle

    from glintframe.sources import records

    rows = spark.range(60).select(F.concat(F.lit("r"), F.col("id") % 6).alias(KEY), (F.col("id") * 10).alias(TS), F.col("id").alias("v"))
    write_native_stream(rows, str(tmp_path), "imu", {"v": ("v", "<i8")})
    source = records.Records({"folders": json.dumps([str(tmp_path)]), "part": "imu", "timed": "true"})
    schema = source.schema()
    kept = pickle.loads(pickle.dumps(source))  # as Spark keeps it between its planners
    for name in ("listed", "read_all"):
        monkeypatch.setattr(records, name, None)
    reader = kept.reader(schema)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 60
    got = native.read_stream(spark, str(tmp_path), "imu")
    times = tmp_path / "r3" / "imu ps1.time"
    times.write_bytes(times.read_bytes()[:-8])
    with pytest.raises(Exception, match="has become shorter"):
        got.collect()


def test_instants_alone_are_read_without_structs(spark, tmp_path, monkeypatch):
    from glintframe.sources import records

    rows = spark.range(60).select(F.concat(F.lit("r"), F.col("id") % 6).alias(KEY), (F.col("id") * 10).alias(TS), F.col("id").alias("v"))
    write_native_stream(rows, str(tmp_path), "imu", {"v": ("v", "<i8")})
    opened, read = [], records.read_at
    monkeypatch.setattr(records, "read_at", lambda uri, *a: opened.append(uri.rpartition(".")[2]) or read(uri, *a))
    for columns, want in (([TS], {"time"}), ([TS, "v"], {"time", "raw"})):
        source = records.Records({"folders": json.dumps([str(tmp_path)]), "part": "imu", "timed": "true", "columns": json.dumps(columns)})
        reader = source.reader(source.schema())
        opened.clear()
        found = [x for p in reader.partitions() for b in reader.read(p) for x in b.column(TS).to_pylist()]
        assert sorted(found) == [10 * i for i in range(60)] and set(opened) == want
    assert native.read_stream(spark, str(tmp_path), "imu", columns=[]).columns == [KEY, TS]


def test_events_are_those_of_the_listing(spark, tmp_path):
    """A recording that begins to be written after the frame was made does not break its plans."""
    rows = spark.range(40).select(F.concat(F.lit("r"), F.col("id") % 4).alias(KEY), F.col("id").alias(TS), F.col("id").alias("a"), (F.col("id") + 2_000_000).alias("b"))
    write_native_stream(rows, str(tmp_path), "blinks", {"a": ("start_timestamp_ns", "<i8"), "b": ("end_timestamp_ns", "<i8")})
    got = native.read_events(spark, str(tmp_path), "blinks")
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "blinks ps1.raw").write_bytes(bytes(8))
    want = sorted((f"r{i % 4}", i // 4 + 1, i, i + 2_000_000, 2) for i in range(40))
    assert sorted(map(tuple, got.collect())) == want


def _stages(spark, group: str, work) -> list[int]:
    """How many tasks each stage of the jobs of ``work`` has."""
    spark.sparkContext.setJobGroup(group, "")
    work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    found = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return [s.numTasks for s in found if s]


def test_many_recordings_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Neither the driver nor the planner looks at the files of each recording; little data is still written by all tasks."""
    from glintframe.sources import records

    rows = spark.range(400).select(F.concat(F.lit("r "), F.col("id") % 100).alias(KEY), F.col("id").alias(TS), F.col("id").alias("a"), (F.col("id") + 2_000_000).alias("b"))
    fields = {"a": ("start_timestamp_ns", "<i8"), "b": ("end_timestamp_ns", "<i8")}
    assert _stages(spark, "written", lambda: write_native_stream(rows, str(tmp_path), "blinks", fields))[-1] == named.tasks(spark) == 4
    assert sorted(p.name for p in (tmp_path / "r 7").iterdir()) == ["blinks ps1.raw", "blinks ps1.time", "blinks.dtype"]
    for name in ("listed", "read_all"):
        monkeypatch.setattr(records, name, None)
    found = []
    assert records.LISTERS in _stages(spark, "found", lambda: found.append(records.listing(spark, [str(tmp_path)] * 2, "blinks", False)))
    source = records.Records({"folders": json.dumps([str(tmp_path)]), "part": "blinks", "timed": "false", "found": found[0]})
    reader = source.reader(source.schema())
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 400
    want = sorted((f"r {i % 100}", i // 100 + 1, i, i + 2_000_000, 2) for i in range(400))
    assert sorted(map(tuple, native.read_events(spark, str(tmp_path), "blinks").collect())) == want
    # A file beside the recordings, or a recording beside them, is found as before.
    (tmp_path / "blinks ps1.raw").write_bytes((tmp_path / "r 7" / "blinks ps1.raw").read_bytes())
    (tmp_path / "blinks.dtype").write_bytes((tmp_path / "r 7" / "blinks.dtype").read_bytes())
    monkeypatch.undo()
    assert records.listing(spark, [str(tmp_path)], "blinks", False) is None
    assert native.read_events(spark, str(tmp_path), "blinks").count() == 404


def test_new_folders_are_named_by_one_move(tmp_path, monkeypatch):
    import pyarrow as pa

    moved = []

    class Counting:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return getattr(self.files, name)

        def move(self, a, b):
            moved.append(b)
            self.files.move(a, b)

    real = named.store
    monkeypatch.setattr(named, "store", lambda uri: (Counting(real(uri)[0]), real(uri)[1]))
    places = [*(f"r{k}" for k in range(20)), "r1/deep", "old", ""]
    file = [f"{p}/{n}".lstrip("/") for p in places for n in ("a", "b", "c")]
    writer = named.NamedFilesWriter(str(tmp_path), "job", {"b": "head "})
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "kept").write_text("kept")
    (tmp_path / "old" / "a").write_text("before")
    batch = pa.RecordBatch.from_arrays([pa.array(file), pa.array([f.encode() for f in file], pa.binary())], names=["file", "data"])
    writer.commit([writer.write(iter([batch.slice(0, 4), batch.slice(4)])), None])
    assert len(moved) <= 20 + 3 * 2 + 8  # a folder, and files of those that exist; "r1" and "r1/deep" in either order
    got = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert got == {**{f: ("head " if f.endswith("b") else "") + f for f in file}, "old/kept": "kept"}


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    from glintframe.sources import cloud

    for k in range(150):
        (tmp_path / f"r{k}").mkdir()
        (tmp_path / f"r{k}" / "blinks.csv").write_text(f"recording id,blink id\nr{k},{k}\n")
        (tmp_path / f"r{k}" / "gaze.csv").write_text("other\n1\n")
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, tracker = spark.conf.get(name), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "")
    rows = cloud.read_csv(spark, str(tmp_path), files="blinks.csv")
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages if s) <= cloud.LISTERS
    assert sorted(map(tuple, rows.collect())) == sorted((f"r{k}", k) for k in range(150)) and spark.conf.get(name) == before


def test_named_files(spark, tmp_path):
    rows = [(f"{d}/f{k}{end}", f"{d}{k}{i}\n".encode(), i) for d in ("a", "b/c") for k in range(3) for end in ("", ".gz") for i in range(50)]
    pieces = spark.createDataFrame(rows, "file string, data binary, at bigint").repartition(7)
    named.write_files(pieces, f"file:{tmp_path}/out", "at", heads={"f1": "head\n"})
    for d in ("a", "b/c"):
        for k in range(3):
            want = "".join(f"{d}{k}{i}\n" for i in range(50))
            assert (tmp_path / "out" / d / f"f{k}").read_text() == ("head\n" if k == 1 else "") + want
            assert gzip.decompress((tmp_path / "out" / d / f"f{k}.gz").read_bytes()).decode() == want
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "b"]
    broken = pieces.withColumn("data", F.when(F.col("file") == "b/c/f2", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        named.write_files(broken, f"file:{tmp_path}/none", "at")
    assert not [p for p in tmp_path.rglob("*") if p.is_file() and "none" in str(p)]
    (tmp_path / "big").write_bytes(bytes(range(256)) * 40_000)
    named.write_files(named.copies(spark, [(str(tmp_path / "big"), "x/again"), (str(tmp_path / "big"), "x/more")]), str(tmp_path / "out"), "file", "at")
    assert (tmp_path / "out/x/again").read_bytes() == (tmp_path / "out/x/more").read_bytes() == (tmp_path / "big").read_bytes()


def test_dataset_exports(spark, native_dir, cloud_dir, tmp_path):
    """Two native recordings and a cloud one: one job each for the cloud layout and for BIDS."""
    import shutil

    top = tmp_path / "data"
    top.mkdir()
    shutil.copytree(native_dir, top / "native 1")
    shutil.copytree(native_dir, top / "native 2")
    info = {"recording_id": "n2", "section_id": "s2", "start_time": 10**18, "duration": 1}
    (top / "native 2" / "info.json").write_text(json.dumps(info))
    (top / "native 1" / "Neon Scene Camera v1 ps1.mp4").write_bytes(b"video")
    (top / "native 2" / "template.json").unlink()
    for f in ("blinks ps1.raw", "blinks.dtype"):
        (top / "native 2" / f).unlink()
    shutil.copytree(cloud_dir, top / "rec-1")
    d = Dataset(spark, f"file:{top}")
    assert len(d) == 3
    with pytest.warns(UserWarning, match="eye_states is not exported"):
        Dataset(spark, f"file:{top}").export_cloud_format(f"file:{tmp_path}/cloud")
    out = tmp_path / "cloud"
    assert sorted(p.name for p in out.iterdir()) == ["native 1", "native 2"]
    assert not (out / "native 2" / "blinks.csv").exists() and (out / "native 1" / "blinks.csv").exists()
    assert (out / "native 1" / "Neon Scene Camera v1 ps1.mp4").read_bytes() == b"video" and not (out / "native 2" / "template.csv").exists()
    assert (out / "native 2" / "gaze.csv").read_text().splitlines()[1].startswith("s2,n2,1000000000000000000,")
    assert (out / "native 1" / "world_timestamps.csv").read_text().splitlines()[0] == "section_id,recording_id,timestamp [ns]"
    again = Dataset(spark, f"file:{out}")
    assert [r.format for r in again.recordings] == ["cloud"] * 2 and again[1].scene_frames.count() == 4
    for name in ("gaze", "imu", "events", "fixations", "saccades"):
        key = [c for c in again.table(name).df.columns if c != "event id"]
        rows = lambda x: sorted(map(repr, x.df.where(f"`{KEY}` <> 'r1'").select(*[f"`{c}`" for c in key]).collect()))  # noqa: B023, E731
        assert rows(again.table(name)) == rows(d.table(name)), name
    d.export_bids(f"file:{tmp_path}/bids", "Read")
    found = sorted(str(p.relative_to(tmp_path / "bids")) for p in (tmp_path / "bids").rglob("*.*") if not p.name.startswith("."))
    assert "sub-Someone/ses-2/motion/sub-Someone_ses-2_task-Read_tracksys-NeonIMU_motion.tsv" in found and "sub-W/ses-1/beh/sub-W_ses-1_task-Read_physio.tsv.gz" in found
    one = tmp_path / "bids" / "sub-W" / "ses-1"
    physio = gzip.decompress((one / "beh" / "sub-W_ses-1_task-Read_physio.tsv.gz").read_bytes()).decode().splitlines()
    assert len(physio) == 199 and physio[0].split("\t")[3] == "n/a"
    events = [x.split("\t") for x in gzip.decompress((one / "beh" / "sub-W_ses-1_task-Read_physioevents.tsv.gz").read_bytes()).decode().splitlines()]
    assert len(events) == 15 and [int(e[0]) for e in events] == sorted(int(e[0]) for e in events)
    assert json.loads((one / "motion" / "sub-W_ses-1_task-Read_tracksys-NeonIMU_motion.json").read_text())["GYROChannelCount"] == 2
    assert (one / "sub-W_ses-1_scans.tsv").read_text().splitlines()[1].startswith("motion/sub-W_ses-1_task-Read")


def test_ranges_of_lines_in_any_cut(tmp_path, monkeypatch):
    """Every line once, by the range in which it begins, with all three line ends and reads of any length."""
    from glintframe.sources import lines

    r = np.random.default_rng(7)
    for k in range(40):
        text = b"".join(r.choice([b"a", b"bc", b"", b"\xc3\xa9,"]) + r.choice([b"\n", b"\r\n", b"\r"]) for _ in range(r.integers(0, 30))) + r.choice([b"", b"end"])
        (tmp_path / "f").write_bytes(text)
        monkeypatch.setattr(lines, "READ", int(r.integers(1, 9)))
        for split in (2, 3, 5, 11, 1000):
            cuts = list(lines.ranges(str(tmp_path / "f"), len(text), split))
            assert [x for c in cuts for some in lines.lines(*c) for x in some] == text.splitlines()
            assert len(cuts) == -(-len(text) // split)


def test_files_of_very_many_folders_in_few_tasks(spark, tmp_path, monkeypatch):
    """As Spark's reader gives them: odd lines, blank ones, files that are empty, hidden or deep below."""
    from glintframe.sources import cloud, lines

    odd = b'\xef\xbb\xbf\n"event id",name,timestamp [ns]\r\n1,"a, ""b""",5\r\n\r\n   \n2,,6\n3,"",7\n4\n5,e,8,more\n6,\xff\xc3\xa9,9\n7," x ",10\r8,"open,11\n9,\\"q\\",12'
    for k in range(200):
        folder = tmp_path / (f"rec +%20 {k}" if k % 3 else f"deep {k}/below") / ("_hidden" if k % 50 == 49 else "")
        folder.mkdir(parents=True)
        body = odd if k % 2 else b'event id,"name",timestamp [ns]\n'
        (folder / "events.csv").write_bytes(b"" if k % 7 == 5 else body + b"\n" + b"".join(b"%d,n%d,%d\n" % (i, k, i) for i in range(k % 11)))
        (folder / ".events.csv").write_bytes(b"other\n1\n")
    read = lambda **x: cloud.read_csv(spark, str(tmp_path), files="events.csv", **x)
    monkeypatch.setattr(lines.table, "__defaults__", (50,))  # short ranges
    few = read()
    assert few.rdd.getNumPartitions() == 4  # one for every 32 files before
    got, ided = few.collect(), read(recording_id="x").collect()
    monkeypatch.setattr(cloud, "_many", lambda *a: None)
    want = read().collect()
    assert few.columns == read().columns and len(want) > 900
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
    assert sorted(map(repr, map(tuple, ided))) == sorted(map(repr, map(tuple, read(recording_id="x").collect())))
    monkeypatch.undo()
    (tmp_path / "rec +%20 1" / "events.csv").write_bytes(b"event id,other,timestamp [ns]\n1,a,5\n")
    with pytest.raises(Exception, match="other"):
        read().collect()
    (tmp_path / "own.csv").write_bytes(b"a\n")
    assert cloud._many(spark, str(tmp_path), "events.csv") is None and cloud._many(spark, f"{tmp_path}/own.csv", "own.csv") is None


def test_pieces_of_one_file_are_written_as_one(tmp_path):
    import pyarrow as pa

    files = pa.array(["x", "a/b", "a/b", "c", "c", "a/b", "z"])
    for kind in (pa.binary(), pa.large_binary()):
        data = pa.array([b"0", b"1", b"", b"22", b"3", b"", b"9"], kind)
        assert [(f, bytes(x)) for f, x in named.runs(files.slice(1, 5), data.slice(1, 5))] == [("a/b", b"1"), ("c", b"223"), ("a/b", b"")]
        assert not list(named.runs(files[:0], data[:0]))
        with pytest.raises(ValueError, match="null"):
            list(named.runs(files[:1], pa.array([None], kind)))
    big = [bytes([k]) * (named.HELD // 2 + k) for k in range(7)]
    batch = pa.RecordBatch.from_arrays([pa.array(["r/f"] * 7), pa.array(big, pa.binary())], names=["file", "data"])
    writer = named.NamedFilesWriter(str(tmp_path), "job", {"f": "head\n"})
    writer.commit([writer.write(iter([batch.slice(0, 2), batch.slice(2)]))])
    assert (tmp_path / "r" / "f").read_bytes() == b"head\n" + b"".join(big)
