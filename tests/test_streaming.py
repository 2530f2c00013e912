import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glintframe.operators import align, trajectory
from glintframe.schema import KEY, TS
from glintframe.streaming import stateful
from glintframe.streaming.live import annotate_live, grid_average


def drain(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_grid_average(spark, tmp_path):
    s = 10**9
    src = spark.createDataFrame([("r", int(t * s), float(t)) for t in (0.1, 0.4, 1.2, 1.4, 2.5, 9.0)], f"`{KEY}` string, `{TS}` bigint, v double")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    got = {r[TS]: (r["v"], r["n_samples"]) for r in drain(spark, grid_average(live, "1 second", ["v"]), "averages")}
    assert {k: (round(v, 9), n) for k, (v, n) in got.items()} == {0: (0.25, 2), s: (1.3, 2), 2 * s: (2.5, 1)}


def test_annotate_live(spark, tmp_path):
    s = 10**9
    samples = spark.createDataFrame([("r", int(t * s)) for t in (0.5, 1.5, 2.5)], f"`{KEY}` string, `{TS}` bigint")
    events = spark.createDataFrame([("r", 1 * s, 2 * s, 7)], f"`{KEY}` string, `start timestamp [ns]` bigint, `end timestamp [ns]` bigint, `blink id` int")
    for n, d in (("s", samples), ("e", events)):
        d.write.parquet(str(tmp_path / n))
    read = lambda n, d: spark.readStream.schema(d.schema).parquet(str(tmp_path / n))
    got = drain(spark, annotate_live(read("s", samples), read("e", events), "blink id", "5 seconds").select(F.col(f"`{TS}`"), F.col("`blink id`")), "annotated")
    assert [tuple(r) for r in got] == [(int(1.5 * s), 7)]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(spark, frame, name):
    drain(spark, frame, name)
    return spark.table(name)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def batches(spark, df, folder, order):
    """Rows written as one file for each value of ``order``, read back one by one."""
    for k in sorted(df[order].unique()):
        part = df[df[order] == k].drop(columns=order)
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(f"{folder}")
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_live_kalman_equals_batch(rocks, tmp_path):
    """Shuffled within micro-batches and between neighbouring ones; gaps, outliers and a late row."""
    spark, r = rocks, np.random.default_rng(4)
    rows = [("a" if k % 2 else "b", f, 10**9 * f, [float(v) for v in r.normal(size=3).cumsum()]) for k in range(2) for f in range(3, 60) if r.random() < 0.8]
    rows[10] = (*rows[10][:3], [500.0, 0.0, 0.0])
    df = pd.DataFrame(rows, columns=["recording id", "frame index", TS, "camera_pos"])
    df["n"] = (df["frame index"] + r.integers(0, 8, len(df))) // 10
    late = pd.DataFrame([("a", 4, 4 * 10**9, [99.0] * 3, 90)], columns=df.columns)
    flush = pd.DataFrame([(k, 1000, 10**12, [0.0] * 3, n) for k in "ab" for n in (80, 91)], columns=df.columns)
    stream = batches(spark, pd.concat([df, late, flush]), str(tmp_path / "in"), "n")
    got = run(spark, stateful.kalman_live(stream, gate=3.0, delay="20 seconds"), "kalman").where("`frame index` < 60").toPandas()
    want = trajectory.smooth_camera_pose(spark.createDataFrame(df.drop(columns="n")), gate=3.0).toPandas()
    last = df.groupby("recording id")["frame index"].max()
    got = got[got["frame index"] <= got["recording id"].map(last)]
    assert len(got) == len(want)
    both = got.merge(want, on=["recording id", "frame index"])
    assert len(both) == len(want) and np.allclose(np.stack(both["camera_pos_x"]), np.stack(both["camera_pos_y"]))


def test_live_interpolation_equals_batch(rocks, tmp_path):
    spark, r = rocks, np.random.default_rng(9)
    s = 10**9
    samples = pd.DataFrame([("a", int(t * s), float(v), None if t == 7 else float(t)) for t, v in zip([1, 2, 3, 5, 7, 8, 20, 21], r.random(8))], columns=["recording id", TS, "x", "y"])
    asked = [0.5, 1, 1.5, 2.25, 3.5, 4.9, 5, 6, 7.5, 9, 19, 20.5, 21]
    targets = pd.DataFrame([("a", int(t * s)) for t in asked], columns=["recording id", TS])
    both = []
    for name, df, columns in (("s", samples, ["x", "y"]), ("t", targets, [])):
        df = df.copy()
        df["n"] = (df[TS] // s + r.integers(0, 4, len(df))) // 4
        flush = pd.DataFrame([("z", 10**12, *[0.0] * len(columns), n) for n in (80, 81)], columns=df.columns)
        both.append(batches(spark, pd.concat([df, flush]), str(tmp_path / name), "n"))
    for gap in (None, 2500):
        got = run(spark, stateful.interpolate_live(*both, ["x", "y"], gap, "10 seconds"), f"interp{gap}").where("`recording id` = 'a'").toPandas().sort_values(TS).reset_index(drop=True)
        want = align.interpolate(spark.createDataFrame(samples), spark.createDataFrame(targets), max_gap_ms=gap).toPandas().sort_values(TS).reset_index(drop=True)
        assert got[TS].to_list() == want[TS].to_list()
        for c in "xy":
            assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), (gap, c)
