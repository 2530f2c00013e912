"""Recordings in the cloud layout: CSV files with unit-bearing column names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY, TYPES, typed
from .files import Place
from .lines import table
from .stores import reachable

# The file of each table.
FILES = {"gaze": "gaze.csv", "imu": "imu.csv", "eye_states": "3d_eye_states.csv", "blinks": "blinks.csv", "fixations": "fixations.csv", "saccades": "saccades.csv", "events": "events.csv"}


#: Tasks that list folders together; Spark's own default is one for each folder, up to 10,000.
LISTERS = 64


@contextmanager
def few_listers(spark: SparkSession) -> Iterator[None]:
    """While a table is opened, many folders are listed by few tasks; the session's setting comes back afterwards."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), LISTERS)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _many(spark: SparkSession, path: str, files: str) -> DataFrame | None:
    """The files of very many folders, read by Python tasks; None where these are few or cannot be opened there."""
    uri = str(Place(spark, path))
    return table(spark, uri, files, LISTERS) if reachable(uri) else None


def read_csv(spark: SparkSession, path: str | list[str], recording_id: str | None = None, by_folder: bool = False, files: str | None = None) -> DataFrame:
    """One file, a folder, a pattern or a list of files with the same header; types by column name, not by inference.

    ``files``: the name, or a pattern of names, of the files to be read at any depth below the folder ``path``.

    A ``recording id`` column is kept; without one the key is ``recording_id`` or else
    the folder of each file, so a pattern over many recordings reads them all.
    ``by_folder``: the folder is the key in any case.
    """
    rows, where = _many(spark, path, files) if files and not isinstance(path, list) else None, F.col("__folder")
    if rows is None:
        reader = spark.read.option("header", True).option("enforceSchema", False)
        if files:
            reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", files)
        with few_listers(spark):
            rows = reader.csv(path if isinstance(path, list) else str(path))
        # Spark gives the path as a URI, in which a plus sign stands for itself.
        where = F.url_decode(F.replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), F.lit("+"), F.lit("%2B")))
    if by_folder or KEY not in rows.columns:
        rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in (KEY, "__folder")], (F.lit(recording_id) if recording_id else where).alias(KEY))
    rows = rows.drop("__folder")
    unknown = [c for c in rows.columns if c not in (KEY, "section id", "section_id", "recording_id") and c not in TYPES]
    if unknown:  # columns of unknown name are doubles where their text is a number throughout: one aggregate over all of them
        other = rows.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.expr(f"try_cast(`{c}` as double)").isNull()).alias(str(i)) for i, c in enumerate(unknown)]).first()
        rows = rows.withColumns({c: F.col(f"`{c}`").cast("double") for i, c in enumerate(unknown) if not other[i]})
    return typed(rows)
