import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe import Events, Stream
from glintframe.operators import align, concat
from glintframe.plans.neighbours import around
from glintframe.schema import KEY, TS, typed

KINDS = ["linear", "nearest", "nearest-up", "zero", "slinear", "quadratic", "cubic", "previous", "next"]


def values(df, *columns):
    return df.select(*[F.col(f"`{c}`") for c in (TS, *columns)]).orderBy(F.col(f"`{TS}`")).toPandas()


def test_properties(tables, frames):
    s = Stream(tables["gaze"])
    t = frames["gaze"][TS].to_numpy()
    assert s.type == "gaze" and s.sampling_freq_nominal == 200 and len(s) == 199
    assert (s.first_ts, s.last_ts) == (t[0], t[-1])
    assert s.sampling_freq_effective == pytest.approx(1e9 / np.diff(t).mean())
    assert not s.is_uniformly_sampled and Stream(tables["custom"]).is_uniformly_sampled
    got = s.time_to_ts([0.0, 0.05, 1.234]).orderBy("time").toPandas()[TS].to_list()
    times = (t - t[0]) / 1e9
    assert got == [int(t[np.abs(times - x).argmin()]) for x in (0.0, 0.05, 1.234)]


@pytest.mark.parametrize("name", ["gaze", "imu", "custom"])
@pytest.mark.parametrize("by,bounds", [("timestamp", (2 * 10**9, 3 * 10**9)), ("time", (0.5, 1.5)), ("sample", (10, 50))])
def test_crop(tables, frames, name, by, bounds):
    t = frames[name][TS].to_numpy()
    at = {"timestamp": t, "time": (t - t[0]) / 1e9, "sample": np.arange(len(t))}[by]
    want = t[(at >= bounds[0]) & (at <= bounds[1])]
    got = values(Stream(tables[name]).crop(*bounds, by=by).df)[TS].to_numpy()
    assert (got == want).all()


def test_crop_errors(tables):
    s = Stream(tables["gaze"])
    with pytest.raises(ValueError):
        s.crop()
    with pytest.raises(ValueError):
        s.crop(-1, 5)
    with pytest.raises(ValueError):
        s.crop(10**15, 10**16)
    assert s.crop(10**15, 10**16, strict=False).df.isEmpty()


@pytest.mark.parametrize("kind", KINDS)
def test_resample_to_nominal(tables, kind):
    out = Stream(tables["gaze"]).interpolate(float_kind=kind, max_gap_ms=None)
    assert out.is_uniformly_sampled and out.sampling_freq_effective == pytest.approx(200)
    assert out.columns == ["gaze x [px]", "gaze y [px]"]
    with pytest.raises(ValueError):
        Stream(tables["custom"]).interpolate()


def test_linear_equals_numpy_at_epoch_magnitude(spark):
    base = 1_770_000_000_000_000_000
    r = np.random.default_rng(0)
    t = np.unique(r.integers(0, 10**9, 200))
    y = r.random(len(t))
    ask = np.unique(np.concatenate([r.integers(-(10**7), 10**9 + 10**7, 500), t[:20]]))
    src = spark.createDataFrame([("a", int(base + a), float(b)) for a, b in zip(t, y)], f"`{KEY}` string, `{TS}` bigint, v double")
    q = spark.createDataFrame([("a", int(base + a)) for a in ask], f"`{KEY}` string, `{TS}` bigint")
    got = values(align.interpolate(src, q, max_gap_ms=None), "v")["v"].to_numpy()
    want = np.interp(ask, t, y, left=np.nan, right=np.nan)
    assert np.allclose(got, want, equal_nan=True, atol=1e-12)
    chunked = values(align.interpolate(src, q, max_gap_ms=None, chunk_ns=7_000_000), "v")["v"].to_numpy()
    assert np.allclose(chunked, want, equal_nan=True, atol=1e-12)


def test_ties_gaps_nulls_and_leaks(spark):
    src = spark.createDataFrame([("a", 0, 0.0, 1), ("a", 10, 10.0, 2), ("a", 30, None, 3), ("a", 50, 50.0, 4), ("b", 5, 99.0, 9), ("a", 10, 10.0, 2)], f"`{KEY}` string, `{TS}` bigint, v double, i int")
    q = spark.createDataFrame([("a", x) for x in (-1, 0, 5, 10, 20, 30, 40, 50, 51)], f"`{KEY}` string, `{TS}` bigint")
    near = values(align.interpolate(src, q, max_gap_ms=None), "v", "i")
    assert near["i"].to_list()[1:8] == [1, 1, 2, 2, 3, 3, 4]  # a tie goes to the earlier sample
    assert near["v"].isna().to_list() == [True, False, False, False, True, True, True, False, True]
    up = values(align.interpolate(src, q, other_kind="nearest-up", max_gap_ms=None), "i")
    assert up["i"].to_list()[1:8] == [1, 2, 2, 3, 3, 4, 4]
    gap = values(align.interpolate(src, q, ["i"], max_gap_ms=10e-6), "i")  # strictly under 10 ns on both sides
    assert gap["i"].isna().to_list() == [True, False, False, False, True, False, True, False, True]


def test_splines_of_many_recordings_in_one_stack(spark):
    """Recordings of all lengths together give what each gives alone, in time that loops over samples do not keep."""
    import time

    from glintframe.operators import align

    random = np.random.default_rng(5)
    xs = [np.sort(random.choice(10_000, n, replace=False)) / 10 for n in [*range(1, 9), *random.integers(40, 90, 800)]]
    ys, ats = [random.normal(size=len(x)) for x in xs], [np.linspace(x[0], x[-1], 50) for x in xs]
    ys[20][3] = np.nan
    for degree in (2, 3):
        now = time.process_time()
        got = align.spline_values(xs, ys, ats, degree)
        assert time.process_time() - now < 0.8
        for k in (*range(30), 400, 801):
            assert np.allclose(got[k], align.spline(xs[k], ys[k], ats[k], degree), rtol=1e-9, atol=1e-9, equal_nan=True)
        assert np.isnan(got[20]).all() and not np.isnan(got[21]).any()
    rows = [(f"r{k}", 1_000_000_000 * i, float(i**3 - k * i)) for k in range(40) for i in range(6 + k)]
    s = spark.createDataFrame([*rows, *rows[:50], ("alone", 5, 1.0)], f"`{KEY}` string, `{TS}` bigint, v double")
    at = spark.createDataFrame([(f"r{k}", 500_000_000 + 1_000_000_000 * i, i) for k in range(41) for i in range(5)], f"`{KEY}` string, `{TS}` bigint, n int")
    want = {(f"r{k}", i): (i + 0.5) ** 3 - k * (i + 0.5) if k < 40 else None for k in range(41) for i in range(5)}
    for r in align.interpolate(s, at, ["v"], "cubic", max_gap_ms=None).collect():
        value = want.pop((r[KEY], r["n"]))
        assert r["v"] is None if value is None else abs(r["v"] - value) < 1e-6
    assert not want


def test_splines_reproduce_polynomials(spark):
    t = np.array([0, 1, 2, 4, 5, 7, 8, 10]) * 10**8
    src = spark.createDataFrame([("a", int(x), float((x / 1e9) ** 2 + 1), float((x / 1e9) ** 3)) for x in t], f"`{KEY}` string, `{TS}` bigint, q double, c double")
    ask = spark.createDataFrame([("a", int(x)) for x in range(0, 10**9 + 1, 37_000_000)], f"`{KEY}` string, `{TS}` bigint")
    for kind, column, f in (("quadratic", "q", lambda x: x**2 + 1), ("cubic", "q", lambda x: x**2 + 1), ("cubic", "c", lambda x: x**3)):
        out = values(align.interpolate(src, ask, [column], kind, max_gap_ms=None), column)
        assert np.allclose(out[column], f(out[TS] / 1e9), atol=1e-9)


@pytest.mark.parametrize("w", [40_000, 40_001])
def test_window_average_equals_pandas(spark, w):
    import pandas as pd

    r = np.random.default_rng(1)
    t, q = np.unique(r.integers(0, 10**6, 300)), np.arange(0, 10**6, 50_000)
    y = r.random(len(t))
    src = spark.createDataFrame([("a", int(a), float(b), int(b * 100)) for a, b in zip(t, y)], f"`{KEY}` string, `{TS}` bigint, v double, i int")
    ask = spark.createDataFrame([("a", int(a)) for a in q], f"`{KEY}` string, `{TS}` bigint")
    got = values(align.window_average(src, ask, w), "v", "i")
    s = pd.Series(y, index=pd.to_datetime(t))
    s = pd.concat([s, pd.Series(np.nan, index=pd.to_datetime(np.setdiff1d(q, t)))]).sort_index()
    want = s.rolling(pd.Timedelta(w, "ns"), center=True, min_periods=1).mean()
    assert np.allclose(got["v"], want.loc[pd.to_datetime(q)].to_numpy(), equal_nan=True)
    with pytest.raises(TypeError):
        align.window_average(src.withColumn("s", F.lit("x")), ask, w)


def test_concat(tables):
    out = Stream(tables["gaze"]).concat(Stream(tables["imu"]))
    assert out.columns == ["gaze x [px]", "gaze y [px]", "gyro x [deg/s]", "gyro y [deg/s]"] and len(out) == 199
    both = concat.concat_streams({"gaze": tables["gaze"], "imu": tables["imu"]}, "min")
    s = Stream(both)
    assert s.first_ts == 10**9 and s.last_ts < 4 * 10**9 and s.is_uniformly_sampled
    with pytest.raises(ValueError):
        concat.concat_streams({"gaze": tables["gaze"]})
    with pytest.raises(ValueError):
        concat.concat_streams({"gaze": tables["gaze"], "imu": tables["imu"]}, "median")


def test_annotate_and_repair(tables):
    s, blinks = Stream(tables["gaze"]), Events(tables["blinks"])
    marked = s.annotate_events(blinks).df.toPandas()
    t = marked[TS]
    assert (marked["blink id"].eq(1) == ((t >= 10**9) & (t <= 1_050_000_000))).all()
    fixed = s.interpolate_events(blinks, buffer_ms=10).df.toPandas().sort_values(TS)
    assert fixed["gaze x [px]"].isna().sum() == 3  # nothing stands before the first blink
    assert len(fixed) == 199


def test_azimuth(tables):
    out = Stream(tables["gaze"]).compute_azimuth_and_elevation()
    r = out.df.limit(3).toPandas()
    assert np.allclose(r["azimuth [deg]"], (r["gaze x [px]"] - 800) / 1600 * 103) and np.allclose(r["elevation [deg]"], -(r["gaze y [px]"] - 600) / 1200 * 77)
    with pytest.raises(ValueError):
        out.compute_azimuth_and_elevation()
    with pytest.raises(KeyError):
        Stream(tables["imu"]).compute_azimuth_and_elevation()


def test_inplace_copy_and_types(spark, tables):
    s = Stream(tables["gaze"])
    c = s.copy()
    assert c.crop(2 * 10**9, inplace=True) is None and len(c) < len(s)
    df = typed(spark.createDataFrame([("a", 1, float("nan"), "3")], f"`{KEY}` string, `{TS}` int, `gaze x [px]` double, `fixation id` string"))
    assert dict(df.dtypes) == {KEY: "string", TS: "bigint", "gaze x [px]": "double", "fixation id": "int"} and df.first()["gaze x [px]"] is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], f"`{KEY}` string, `{TS}` bigint, v double")
    assert align.interpolate(empty, empty.drop("v"), ["v"]).count() == 0
    assert align.window_average(empty, empty.drop("v"), 10).count() == 0
    assert around(empty, empty.drop("v"), ["v"]).count() == 0
