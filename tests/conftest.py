import json
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def regular(start, stop, step, columns, seed, drop=(2,)):
    """Samples every ``step`` ns with random values, less some rows."""
    t = np.delete(np.arange(start, stop, step, dtype=np.int64), list(drop))
    r = np.random.default_rng(seed)
    return pd.DataFrame({"recording id": "r1", "timestamp [ns]": t, **{c: r.random(len(t)) for c in columns}})


@pytest.fixture(scope="session")
def frames():
    """Simulated tables by name, as pandas."""
    s = 10**9
    start = lambda *x: [int(v * s) for v in x]

    def events(name, starts, ms, **more):
        return pd.DataFrame({"recording id": "r1", f"{name} id": range(1, len(starts) + 1), "start timestamp [ns]": starts, "end timestamp [ns]": [a + m * 10**6 for a, m in zip(starts, ms)], "duration [ms]": ms, **more})

    return {
        "gaze": regular(s, 5 * s, 2 * 10**7, ["gaze x [px]", "gaze y [px]"], 1),
        "imu": regular(s, 4 * s, 5 * 10**6, ["gyro x [deg/s]", "gyro y [deg/s]"], 2),
        "eye_states": regular(2 * s, 6 * s, 10**7, ["pupil diameter left [mm]", "pupil diameter right [mm]"], 3),
        "custom": regular(0, 6 * s, 33_333_333, ["custom x", "custom y"], 4, drop=()),
        "blinks": events("blink", start(1, 3, 5, 8, 10), [50, 100, 100, 100, 500]),
        "fixations": events("fixation", start(0.5, 3, 7), [200] * 3, **{"fixation x [px]": [1.0, 2.0, 3.0], "fixation y [px]": [4.0, 5.0, 6.0]}),
        "saccades": events("saccade", start(2.5, 5, 8), [50] * 3, **{"amplitude [px]": [1.0, 2.0, 3.0], "amplitude [deg]": [0.1, 0.2, 0.3]}),
        "events": pd.DataFrame({"recording id": "r1", "timestamp [ns]": start(0, 4, 9, 10), "name": ["recording.begin", "stimulus_onset", "stimulus_offset", "recording.end"], "type": "recording"}),
    }


@pytest.fixture(scope="session")
def tables(spark, frames):
    return {k: spark.createDataFrame(v).cache() for k, v in frames.items()}


@pytest.fixture
def cloud_dir(tmp_path, frames):
    """A recording in the cloud layout."""
    d = tmp_path / "sub-1" / "rec-1"
    d.mkdir(parents=True)
    files = {"gaze": "gaze.csv", "imu": "imu.csv", "eye_states": "3d_eye_states.csv", "blinks": "blinks.csv", "fixations": "fixations.csv", "saccades": "saccades.csv", "events": "events.csv"}
    for name, file in files.items():
        frames[name].assign(**{"section id": "s1"}).to_csv(d / file, index=False)
    info = {"recording_id": "r1", "start_time": 10**18, "duration": 6 * 10**9, "wearer_name": "W", "module_serial_number": "m", "app_version": "1", "pipeline_version": "2"}
    (d / "info.json").write_text(json.dumps(info))
    return d


@pytest.fixture
def native_dir(tmp_path):
    """A recording in the native layout."""
    d = tmp_path / "native-1"
    d.mkdir()
    t = np.arange(10, dtype="<i8") * 5_000_000 + 10**18
    gaze = np.zeros(10, [("x", "<f4"), ("y", "<f4")])
    gaze["x"], gaze["y"] = np.arange(10), np.arange(10) * 2
    imu = np.zeros(10, [("gyro_x", "<f4"), ("accel_y", "<f4"), ("timestamp_ns", "<i8")])
    imu["gyro_x"] = np.arange(10) / 2
    for name, data in (("gaze", gaze), ("imu", imu)):
        (d / f"{name} ps1.raw").write_bytes(data.tobytes())
        (d / f"{name} ps1.time").write_bytes(t.tobytes())
        (d / f"{name}.dtype").write_text(str(data.dtype.descr))
    worn = np.ones(10, [("worn", "u1")])
    (d / "worn ps1.raw").write_bytes(worn.tobytes())
    (d / "worn.dtype").write_text(str(worn.dtype.descr))
    fix = np.zeros(3, [("event_type", "<i4"), ("start_timestamp_ns", "<i8"), ("end_timestamp_ns", "<i8"), ("mean_gaze_x", "<f4"), ("mean_gaze_y", "<f4"), ("amplitude_pixels", "<f4")])
    fix["event_type"], fix["start_timestamp_ns"], fix["end_timestamp_ns"] = [1, 0, 1], t[[0, 3, 6]], t[[2, 4, 9]]
    (d / "fixations ps1.raw").write_bytes(fix.tobytes())
    (d / "fixations.dtype").write_text(str(fix.dtype.descr))
    blinks = np.zeros(1, [("start_timestamp_ns", "<i8"), ("end_timestamp_ns", "<i8")])
    blinks["start_timestamp_ns"], blinks["end_timestamp_ns"] = t[1], t[5] + 999_999
    (d / "blinks ps1.raw").write_bytes(blinks.tobytes())
    (d / "blinks.dtype").write_text(str(blinks.dtype.descr))
    (d / "event.txt").write_text("recording.begin\nrecording.end\n")
    (d / "event.time").write_bytes(t[[0, 9]].tobytes())
    (d / "Neon Scene Camera v1 ps1.time").write_bytes(t[::3].tobytes())
    (d / "info.json").write_text(json.dumps({"recording_id": "n1", "start_time": 10**18, "duration": 1}))
    (d / "wearer.json").write_text(json.dumps({"name": "Someone"}))
    (d / "template.json").write_text(json.dumps({"items": [{"id": 1, "title": "a"}]}))
    return d
