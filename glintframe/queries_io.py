"""Registered queries over files: written from the shared test tables by the sinks and read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import properties
from .plans.neighbours import col
from .queries import BASE, interval_events, query, samples, short, stream
from .schema import END, KEY, START, TS, event_type, stream_type
from .sinks import bids
from .sinks.cloud_export import table_pieces
from .sinks.named import write_files
from .sinks.native import write_native_stream
from .sources import cloud, native
from .sources.files import scratch

#: Records of one task: small, so that recordings of the test tables are several ranges.
RANGE = 40


def _native(spark, d) -> str:
    folder = scratch(spark)
    write_native_stream(stream(spark, d), folder, "imu", {"v": ("v", "<f8"), "id": ("id", "<i8")})
    return folder


@query("native_stream", BASE + "SELECT rec::VARCHAR AS rec, t, v, id FROM s")
def _(spark, d):
    """Samples as native files, a pair a recording, read range by range."""
    return short(native.read_stream(spark, _native(spark, d), "imu", records=RANGE), col(TS).alias("t"), "v", "id")


@query("native_time_bounds", BASE + "SELECT rec::VARCHAR AS rec, t, v FROM s WHERE t >= 1704600000000000000 AND t < 1705000000000000000")
def _(spark, d):
    """Bounds on the instants reach the source, and one column is decoded."""
    rows = native.read_stream(spark, _native(spark, d), "imu", columns=["v"], records=RANGE)
    return short(rows.where((col(TS) >= 1704600000000000000) & (col(TS) < 1705000000000000000)), col(TS).alias("t"), "v")


@query("native_events", BASE + "SELECT rec::VARCHAR AS rec, row_number() OVER (PARTITION BY rec ORDER BY a, b) AS id, a AS start, b AS end_, (b - a) // 1000000 AS ms FROM e")
def _(spark, d):
    """Intervals as native records without times; ids count from 1."""
    folder = scratch(spark)
    rows = interval_events(spark, d).withColumn(TS, col(START))
    write_native_stream(rows, folder, "blinks", {START: ("start_timestamp_ns", "<i8"), END: ("end_timestamp_ns", "<i8")})
    out = native.read_events(spark, folder, "blinks")
    return short(out, col("blink id").alias("id"), col(START).alias("start"), col(END).alias("end_"), col("duration [ms]").alias("ms"))


def _cloud(spark, d) -> str:
    """Three cloud tables of every recording, written by one job."""
    folder = scratch(spark)
    s = samples(spark, d).withColumn(KEY, col(KEY).cast("string"))
    gaze = s.select(col(KEY), col(TS), F.col("v").alias("gaze x [px]"), (F.col("v") / 2).alias("gaze y [px]"))
    messages = s.where("kind = 'signup'").select(col(KEY), col(TS), F.concat("kind", F.lit(', "'), F.col("id"), F.lit('"')).alias("name"), F.lit("recording").alias("type"))
    blinks = interval_events(spark, d).withColumn(KEY, col(KEY).cast("string")).withColumnRenamed("event id", "blink id")
    folders = s.select(col(KEY).alias("key"), F.concat(F.lit("rec "), col(KEY)).alias("folder"), F.lit(None).cast("string").alias("section")).distinct()
    pieces, heads = None, {}
    for rows, file in ((gaze, "gaze.csv"), (messages, "events.csv"), (blinks, "blinks.csv")):
        more, heads[file] = table_pieces(rows, folders, file)
        pieces = more if pieces is None else pieces.union(more)
    write_files(pieces, folder, "file", "at", heads=heads)
    return folder


@query("cloud_gaze", BASE + "SELECT rec::VARCHAR AS rec, t, v AS x, v / 2 AS y FROM s")
def _(spark, d):
    out = cloud.read_csv(spark, _cloud(spark, d), files="gaze.csv")
    return short(out, col(TS).alias("t"), col("gaze x [px]").alias("x"), col("gaze y [px]").alias("y"))


@query("cloud_messages", BASE + "SELECT rec::VARCHAR AS rec, t, kind || ', \"' || id || '\"' AS name FROM s WHERE kind = 'signup'")
def _(spark, d):
    out = cloud.read_csv(spark, _cloud(spark, d), files="events.csv")
    return short(out, col(TS).alias("t"), "name")


@query("infer_types", BASE + "SELECT 'gaze' AS kind, 'gaze' AS file, count(*) AS n, count(DISTINCT rec) AS recordings FROM s UNION ALL SELECT 'events', 'events', count(*), count(DISTINCT rec) FROM s WHERE kind = 'signup' UNION ALL SELECT 'blinks', 'blinks', count(*), count(DISTINCT rec) FROM e")
def _(spark, d):
    """What the tables of all recordings are, told by their columns."""
    folder, out = _cloud(spark, d), None
    for file in ("gaze", "events", "blinks"):
        rows = cloud.read_csv(spark, folder, files=f"{file}.csv")
        kind = stream_type(rows.columns) if file == "gaze" else event_type(rows.columns)[0]
        more = rows.agg(F.lit(kind).alias("kind"), F.lit(file).alias("file"), F.count("*").alias("n"), F.countDistinct(col(KEY)).alias("recordings"))
        out = more if out is None else out.union(more)
    return out


@query("bids_channels", BASE + ", r AS (SELECT rec, 1e9 * (count(*) - 1) / nullif(max(t) - min(t), 0) AS rate FROM s GROUP BY rec) SELECT rec, name, component, type, units, round(rate, 9) AS rate FROM r, (VALUES ('gyro x', 'x', 'GYRO', 'deg/s'), ('acceleration z', 'z', 'ACCEL', 'g'), ('yaw', 'z', 'ORNT', 'deg')) AS c(name, component, type, units)")
def _(spark, d):
    """The channels table of every recording, with the rate that it really has."""
    v = F.col("v")
    imu = stream(spark, d).select(col(KEY), col(TS), v.alias("gyro x [deg/s]"), v.alias("acceleration z [g]"), v.alias("yaw [deg]"))
    return short(bids.channel_table(imu), "name", "component", "type", "units", F.round("sampling_frequency", 9).alias("rate"))


@query("time_axis", BASE + "SELECT rec, count(*) AS n, max(t) - min(t) AS span, round(1e9 * (count(*) - 1) / nullif(max(t) - min(t), 0), 9) AS rate FROM g GROUP BY rec")
def _(spark, d):
    """The uniform grid as a native stream of instants alone: what a recording's clock says of it."""
    from .queries import grid

    folder = scratch(spark)
    write_native_stream(grid(spark, d).withColumn("frame", F.lit(0)), folder, "imu", {"frame": ("frame", "u1")})
    out = properties.summary(native.read_stream(spark, folder, "imu", columns=[]))
    return out.select(col(KEY).cast("bigint").alias("rec"), F.col("n_samples").alias("n"), (F.col("last_ts") - F.col("first_ts")).alias("span"), F.round("sampling_freq_effective", 9).alias("rate"))
