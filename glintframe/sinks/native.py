"""Streams written in the native layout: packed structs and instants, one pair of files a recording."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.neighbours import col
from ..schema import KEY, TS
from .named import tasks, write_files


def write_native_stream(df: DataFrame, target: str, stem: str, fields: dict[str, tuple[str, str]]) -> None:
    """Write a stream as ``<recording id>/<stem> ps1.raw``, ``.time`` and ``<stem>.dtype`` below ``target``.

    ``fields``: native field name and type code by column, such as ``{"gaze x [px]": ("x", "<f8")}``;
    nulls become NaN, or 0 in fields of integers.  One job writes all recordings; samples
    lie in the order of their times.
    """
    dtype = np.dtype([(name, code) for name, code in fields.values()])
    places = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            keys, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            records = np.zeros(len(keys), dtype)
            for k, c in enumerate(places):
                values = batch.column(k + 2)
                kind = dtype[k].kind
                records[dtype.names[k]] = values.fill_null(0).to_numpy() if kind in "iu" else values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            begin = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            file, data = [], []
            for a, b in zip(begin, [*begin[1:], len(keys)]):
                if keys[a] != before:
                    before = keys[a]
                    file.append(f"{before}/{stem}.dtype")
                    data.append(str(dtype.descr).encode())
                file += [f"{before}/{stem} ps1.raw", f"{before}/{stem} ps1.time"]
                data += [records[a:b].tobytes(), times[a:b].astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(data, pa.binary())], names=["file", "data"])

    # A recording is sorted in one task, which packs its records and writes its files.
    rows = df.select(F.coalesce(col(KEY).cast("string"), F.lit("None")).alias(KEY), col(TS), *[col(c) for c in places])
    rows = rows.repartition(tasks(df.sparkSession), col(KEY)).sortWithinPartitions(col(KEY), col(TS), *[col(c) for c in places])
    write_files(rows.mapInArrow(run, "file string, data binary"), target)
