import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe import Epochs, Events, Stream, construct_epochs_info, events_to_epochs_info
from glintframe.operators import concat, epochs, pose, surface, trajectory
from glintframe.plans.ranges import within
from glintframe.schema import CORNERS, HOMOGRAPHY_COLUMNS, KEY, START, TS

S = 10**9


def test_filters(tables):
    e = Events(tables["blinks"])
    assert e.type == "blinks" and e.id_name == "blink id"
    assert len(e.filter_by_duration(dur_min=100)) == 4 and len(e.filter_by_duration(100, 100)) == 3
    assert sorted(r[0] for r in e.filter_by_duration(100).df.select(F.col("`blink id`")).collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        e.filter_by_duration()
    with pytest.raises(ValueError):
        e.filter_by_duration(10_000)
    with pytest.raises(KeyError):
        Events(tables["events"]).filter_by_duration(1)
    m = Events(tables["events"])
    assert len(m.filter_by_name(["stimulus_onset", "stimulus_offset"])) == 2
    with pytest.raises(ValueError):
        m.filter_by_name("Stimulus_onset")
    assert len(e.crop(3 * S, 8 * S)) == 3 and len(e.crop(1, 2, by="sample")) == 2 and len(e.restrict(Stream(tables["gaze"]))) == 2
    assert e[1].first()[START] == 3 * S


def test_concat_events(tables):
    out = concat.concat_events({k: tables[k] for k in ("blinks", "fixations", "saccades", "events")})
    r = out.orderBy(F.col("`event id`")).toPandas()
    assert len(r) == 15 and r["event id"].to_list() == list(range(15)) and r[START].is_monotonic_increasing
    assert set(r["type"]) == {"blink", "fixation", "saccade", "event"} and r["message name"].notna().sum() == 4
    with pytest.raises(ValueError):
        concat.concat_events({"blinks": tables["blinks"]})


def info_of(spark, refs, before=1.0, after=1.0):
    return construct_epochs_info(spark.createDataFrame([("r1", int(x)) for x in refs], f"`{KEY}` string, t_ref bigint"), before, after, "d")


def test_epochs(spark, tables, frames):
    info = info_of(spark, [4 * S, 2 * S, 40 * S], 0.5, 0.5)
    e = Epochs(Stream(tables["gaze"]), info)
    assert len(e) == 3 and e.is_equal_length and not e.has_overlap
    t = frames["gaze"][TS].to_numpy()
    got = e.epoch(0).toPandas()
    want = t[(t >= 1.5 * S) & (t <= 2.5 * S)]
    assert sorted(got[TS]) == list(want) and sorted(got["epoch time [ns]"]) == list(want - 2 * S)
    assert [r["epoch index"] for r in e.empty_epochs.collect()] == [2]
    assert Epochs(Stream(tables["gaze"]), info_of(spark, [2 * S, 3 * S])).has_overlap
    lists = e.annotate_source().toPandas().set_index(TS)["epoch indices"]
    assert list(lists[2 * S]) == [0] and list(lists[3 * S]) == []


def test_tensor(spark, tables, frames):
    e = Epochs(Stream(tables["gaze"]), info_of(spark, [2 * S, 4 * S], 0.5, 0.5))
    x, meta = e.to_numpy(sampling_rate=100)
    assert x.shape == (2, 2, 100) and meta["epoch_times"][0] == -0.5 and not meta["nan_flag"]
    g = frames["gaze"]
    assert np.allclose(x[0, 0], np.interp(2 * S + meta["epoch_times"] * 1e9, g[TS], g["gaze x [px]"]), atol=1e-6)
    with pytest.raises(ValueError):
        Epochs(Stream(tables["custom"]), e.info).to_numpy()
    arrays = epochs.to_arrays(e.tensor(sampling_rate=100), ["gaze x [px]"]).orderBy(F.col("`epoch index`")).collect()
    assert np.allclose(arrays[1]["values"], x[1, 0])


def test_baseline(spark, tables):
    e = Epochs(Stream(tables["gaze"]), info_of(spark, [2 * S, 3 * S], 0.5, 0.5))
    before = e.data.toPandas()
    mean = e.apply_baseline((None, 0)).data.toPandas()
    for k, part in before.groupby("epoch index"):
        shift = part.loc[part["epoch time [ns]"] <= 0, "gaze x [px]"].mean()
        got = mean[mean["epoch index"] == k].sort_values(TS)["gaze x [px]"].to_numpy()
        assert np.allclose(got, part.sort_values(TS)["gaze x [px]"] - shift)
    line = e.apply_baseline((-0.4, 0), "linear").data.toPandas()
    part = before[before["epoch index"] == 1].sort_values(TS)
    at = part["epoch time [ns]"] / 1e9
    use = (at >= -0.4) & (at <= 0)
    fit = np.polyfit(at[use], part["gaze y [px]"][use], 1)
    assert np.allclose(line[line["epoch index"] == 1].sort_values(TS)["gaze y [px]"], part["gaze y [px]"] - np.polyval(fit, at))
    with pytest.raises(ValueError):
        e.apply_baseline((None, None))
    assert len(before) == len(e.data.toPandas())  # the epochs themselves are unchanged


def test_events_to_epochs_info(tables):
    m = events_to_epochs_info(Events(tables["events"]), 1, 2, event_name="stimulus_onset").collect()
    assert len(m) == 1 and m[0]["t_ref"] == 4 * S and m[0]["t_end"] == 6 * S and m[0]["description"] == "stimulus_onset"
    assert {r["description"] for r in events_to_epochs_info(Events(tables["blinks"]), 100, 100, "ms").collect()} == {"blink"}


def test_homography(spark):
    h = np.array([[1.2, 0.1, 5], [-0.05, 0.9, 3], [1e-4, 2e-4, 1]])
    p = np.random.default_rng(0).random((6, 2)) * 500
    q = np.c_[p, np.ones(6)] @ h.T
    assert np.allclose(surface.homography(p, q[:, :2] / q[:, 2:]), h, atol=1e-8)
    hs = spark.createDataFrame([("r", 0, *h.ravel().tolist()), ("r", 100, *h.ravel().tolist())], ", ".join([f"`{KEY}` string, `{TS}` bigint", *[f"`{c}` double" for c in HOMOGRAPHY_COLUMNS]]))
    pts = spark.createDataFrame([("r", 50, float(p[0, 0]), float(p[0, 1])), ("r", 500, 1.0, 1.0)], f"`{KEY}` string, `{TS}` bigint, `gaze x [px]` double, `gaze y [px]` double")
    out = {r[TS]: r for r in surface.apply_homographies(pts, hs).collect()}
    assert out[50]["gaze x [surface coord]"] == pytest.approx(q[0, 0] / q[0, 2]) and out[500]["gaze x [surface coord]"] is None


def test_kalman_fills_gaps_and_gates(spark):
    z = [(0, 0.0), (1, 0.1), (2, 0.2), (5, 0.5), (6, 50.0), (7, 0.7)]
    poses = spark.createDataFrame([("r", f, [x, -x, 1.0]) for f, x in z], f"`{KEY}` string, `frame index` bigint, camera_pos array<double>")
    out = trajectory.smooth_camera_pose(poses).orderBy(F.col("`frame index`")).toPandas()
    assert out["frame index"].to_list() == list(range(8)) and max(v[0] for v in out["camera_pos"]) < 1
    both = trajectory.smooth_camera_pose(poses, two_way=True).orderBy(F.col("`frame index`")).toPandas()
    assert np.allclose(both["camera_pos"].iloc[-1], out["camera_pos"].iloc[-1]) and not np.allclose(both["camera_pos"].iloc[2], out["camera_pos"].iloc[2])


def test_density_and_scanpath(spark, tables):
    pts = spark.createDataFrame([("r", 0.0, 0.0), ("r", 1600.0, 1200.0), ("r", -1.0, 5.0), ("r", 15.0, 5.0)], f"`{KEY}` string, `gaze x [px]` double, `gaze y [px]` double")
    got = {(r["x bin"], r["y bin"]): r["count"] for r in surface.density(pts).collect()}
    assert got == {(0, 0): 1, (159, 119): 1, (1, 0): 1}
    clock = spark.createDataFrame([("r1", int(t)) for t in (0.5 * S, 0.6 * S, 0.7 * S, 3 * S, 9 * S)], f"`{KEY}` string, `{TS}` bigint")
    status = {r[TS]: [x["fixation status"] for x in r["fixations"] or []] for r in trajectory.scanpath(clock, tables["fixations"]).collect()}
    assert status == {int(0.5 * S): ["start"], int(0.6 * S): ["during"], int(0.7 * S): ["end"], 3 * S: ["end"], 9 * S: []}


def test_robust_homographies(spark):
    """One marker of five lies wrong: the least median and the consensus do not follow it."""
    r = np.random.default_rng(1)
    want = np.array([[1.2, 0.1, 30], [-0.05, 0.9, -20], [1e-4, 2e-4, 1]])
    image = r.random((20, 2)) * 800
    p = np.column_stack([image, np.ones(20)]) @ want.T
    target = p[:, :2] / p[:, 2:]
    target[16:] += 90
    for method in ("lmeds", "ransac"):
        assert np.allclose(surface.robust_homography(image, target, method), want, atol=1e-6)
    assert not np.allclose(surface.robust_homography(image, target, "lstsq"), want, atol=1e-2)
    with pytest.raises(ValueError):
        surface.robust_homography(image, target, "other")
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    corners = [10.0, 10.0, 30.0, 10.0, 30.0, 50.0, 10.0, 50.0]
    names = ", ".join(f"`{c} {a} [px]` double" for c in CORNERS for a in "xy")
    got = surface.find_homographies(spark.createDataFrame([("r1", 5, *corners)], f"`recording id` string, `timestamp [ns]` bigint, {names}"), square).first()
    assert np.allclose([got[c] for c in HOMOGRAPHY_COLUMNS], [0.05, 0, -0.5, 0, 0.025, -0.25, 0, 0, 1])


def test_camera_pose(spark):
    matrix, bend = np.array([[900.0, 0, 800], [0, 880, 600], [0, 0, 1]]), [-0.13, 0.11, 1e-4, -2e-4, 0, 0.17, 0.05, 0.02]
    places = [(1, [0.0, 0.0, 0.0], [0.0, 0.0, 1.0], 0.2), (2, [0.5, 0.1, 0.0], [0.0, 0.0, 1.0], 0.1), (3, [0.2, 0.4, 0.3], [0.0, 1.0, 1.0], 0.15)]
    rows, want = [], {}
    for f, ids, turn, shift in [(0, (1, 2), [0.1, -0.2, 0.3], [0.1, 0.0, 2.0]), (1, (1, 2, 3), [2.9, 0.1, 0.2], [-0.2, 0.1, 1.5]), (2, (3,), [0.4, 0.3, -0.1], [0.0, 0.1, 1.2])]:
        turn, shift = np.array(turn), np.array(shift)
        want[f] = (-pose.rotation(turn).T @ shift, turn)
        for m, at, n, size in places:
            if m in ids:
                p = pose.marker_corners(np.array(at), np.array(n), size) @ pose.rotation(turn).T + shift
                c = pose._distorted(p[:, :2] / p[:, 2:], bend) * matrix[[0, 1], [0, 1]] + matrix[:2, 2]
                rows.append(("r1", f, str(m), *c.ravel().tolist()))
    rows.append(("r1", 3, "99", *[0.0] * 8))
    names = ", ".join(f"`{c} {a} [px]` double" for c in CORNERS for a in "xy")
    seen = spark.createDataFrame(rows, f"`recording id` string, `frame index` bigint, `marker id` string, {names}")
    known = spark.createDataFrame(places, "marker_id int, pos_vec array<double>, norm_vec array<double>, size double")
    got = {r["frame index"]: r for r in pose.estimate_camera_pose(seen, known, matrix.tolist(), bend).collect()}
    assert set(got) == {0, 1, 2}
    for f, (place, turn) in want.items():
        assert np.allclose(got[f]["camera_pos"], place, atol=1e-5) and np.allclose(got[f]["rotation_vector"], turn, atol=1e-5)
    with pytest.raises(KeyError):
        pose.estimate_camera_pose(seen, known.drop("size"), matrix.tolist())


def test_poses_of_many_frames_in_one_stack():
    """Frames with points in a plane and in space, and some that fix no pose, in time that one frame after another does not keep."""
    import time

    random = np.random.default_rng(3)
    matrix, bend = np.array([[900.0, 0, 800], [0, 880, 600], [0, 0, 1]]), np.array([-0.13, 0.11, 1e-4, -2e-4, 0, 0.17, 0.05, 0.02])
    count = 2000
    turn, shift = random.uniform(-0.5, 0.5, (count, 3)), random.uniform(-0.2, 0.2, (count, 3)) + [0, 0, 2.0]
    world = random.uniform(-0.4, 0.4, (count, 8, 3)) * np.where(np.arange(count) % 2, 1.0, 0.0)[:, None, None] ** np.array([0, 0, 1])
    p = world @ np.swapaxes(pose.rotation(turn), 1, 2) + shift[:, None]
    image = pose._distorted(p[..., :2] / p[..., 2:], bend) * matrix[[0, 1], [0, 1]] + matrix[:2, 2]
    image[7, 2, 0], world[9], image[11] = np.nan, world[9, :1], image[11, :1]
    now = time.process_time()
    r, t = pose.solve_poses(world, image, matrix, bend)
    assert time.process_time() - now < 4
    good = np.setdiff1d(np.arange(count), [7, 9, 11])
    assert np.abs(r[good] - turn[good]).max() < 1e-6 and np.abs(t[good] - shift[good]).max() < 1e-6
    assert np.isnan(r[[7, 9]]).all()
    one = pose.solve_pose(world[4], image[4], matrix, bend)
    assert np.allclose(one, (r[4], t[4]), atol=1e-9) and pose.solve_pose(world[7], image[7], matrix, bend) is None


def test_half_a_turn_in_any_order_of_the_rows(spark):
    """A mean's last bits differ with the order of its rows; half a turn is -180 with all of them."""
    rows = [(f"r{k}", 0, at, yaw) for k, bits in enumerate((-1, 0, 1)) for at, yaw in ((0, 137.46 - bits * 2.8e-14), (10, -42.54))]
    e = spark.createDataFrame([*rows, ("n", 0, 0, float("nan")), ("e", 0, 0, 1.0), ("e", 0, 10, 180.5)], f"`{KEY}` string, `epoch index` int, `epoch time [ns]` bigint, `yaw [deg]` double")
    got = {(r[KEY], r["epoch time [ns]"]): r["yaw [deg]"] for r in epochs.apply_baseline(e, (None, 0), "mean", ["yaw [deg]"]).collect()}
    assert [round(got[f"r{k}", 10], 9) for k in range(3)] == [-180.0] * 3
    assert np.isnan(got["n", 0]) and got["e", 10] == 179.5


def test_intervals_of_any_length(spark):
    """The default bins give each pair once, for lengths from 0 to nearly all of the time."""
    r = np.random.default_rng(4)
    at = [(1, int(t)) for t in r.integers(0, 10**12, 300)] + [(2, 5), (1, None)]
    ends = [(1, i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(r.integers(0, 10**12, 60), r.choice([0, 5, 10**9, 9 * 10**11], 60)))] + [(1, 99, 7, 3), (3, 98, 0, 9)]
    points = spark.createDataFrame(at, "`recording id` int, `timestamp [ns]` bigint")
    held = spark.createDataFrame(ends, "`recording id` int, i int, a bigint, b bigint")
    got = sorted((x["timestamp [ns]"], x["i"]) for x in within(points, held, "a", "b").collect())
    assert got == sorted((t, i) for k, t in at if t is not None for j, i, a, b in ends if j == k and a <= t <= b) and len(got) > 100
    assert within(points, held.limit(0), "a", "b", how="left").count() == len(at)


@pytest.mark.parametrize("sigma,n", [(1.0, 10), (2.5, 4), (0.3, 3)])
def test_smoothed_density(spark, sigma, n):
    """Against a padded convolution of the whole grid; small grids reflect more than once."""
    r = np.random.default_rng(3)
    grid = r.integers(0, 5, (n, n)).astype(float)
    rows = [("r", int(x), int(y), int(grid[x, y])) for x in range(n) for y in range(n) if grid[x, y]]
    counts = spark.createDataFrame(rows, "`recording id` string, `x bin` int, `y bin` int, count bigint")
    kernel = np.array(surface.gaussian(sigma))
    radius = len(kernel) // 2
    want = grid
    for axis in (0, 1):
        wide = np.pad(want, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        want = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), axis, wide)
    got = np.zeros((n, n))
    for row in surface.smooth_density(counts, sigma, 1, n, n).collect():
        got[row["x bin"], row["y bin"]] = row["count"]
    assert got == pytest.approx(want, abs=1e-12)
    assert surface.smooth_density(counts, None).count() == len(rows)


def test_homographies_of_bad_frames(spark):
    """Null, NaN and equal corners and corners on a line end nothing and give no rows."""
    names = [f"`{c} {a} [px]` double" for c in ("top left", "top right", "bottom right", "bottom left") for a in "xy"]
    nan = float("nan")
    good = [0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0]
    frames = [good, [None, *good[1:]], [nan, *good[1:]], [1.0] * 8, [0.0, 0.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0]]
    rows = spark.createDataFrame([("r", k, *f) for k, f in enumerate(frames)], "`recording id` string, `timestamp [ns]` bigint, " + ", ".join(names))
    out = surface.find_homographies(rows, np.array([[10.0, 20], [14, 20], [14, 24], [10, 24]])).collect()
    assert [r["timestamp [ns]"] for r in out] == [0] and out[0]["homography (0,0)"] == pytest.approx(2) and out[0]["homography (1,2)"] == pytest.approx(20)


def test_stacked_robust_homographies():
    r = np.random.default_rng(8)
    truth = np.array([[1.2, 0.1, 30], [-0.05, 0.9, 12], [1e-4, -2e-4, 1]])
    image = r.uniform(0, 1000, (50, 24, 2))
    p = np.concatenate([image, np.ones((50, 24, 1))], -1) @ truth.T
    target = p[..., :2] / p[..., 2:]
    for k in range(50):  # up to a third of the pairs are wrong
        target[k, : k % 9] += r.uniform(50, 400, (k % 9, 2))
    for method in ("lmeds", "ransac"):
        h = surface.robust_homographies(image, target, method)
        assert np.abs(h - truth).max() < 1e-6
        assert np.abs(surface.robust_homography(image[5], target[5], method) - h[5]).max() < 1e-9
    assert np.abs(surface.homography(image[0], target[0]) - truth).max() < 1e-6
