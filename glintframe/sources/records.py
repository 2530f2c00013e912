"""Native records as a Python data source: ``spark.read.format("glintframe_records")``.

A recording's part is one file of packed structs and, for streams, one of instants.
Every range of ``records`` structs is a partition, so a long recording is many tasks,
and each task reads its bytes alone; beyond ``TASKS`` ranges, neighbouring ones share
a partition, so many short recordings are few tasks.  Bounds on the time column are pushed here: a
task reads the instants of its range first and then only the structs between the
first and the last that lie inside; a range without any is never read.  Only the
fields of the asked columns are decoded, and structs without an asked field are not read.
Folders are listed, and dtype files read, once: when the frame is made.  For many
recordings this is a Spark job (``listing``), as Spark's own readers list folders.

Options: ``folders`` (JSON list of recordings or folders of them), ``part`` (file
stem, such as ``gaze``), ``timed`` (``true`` for streams), ``records``, ``columns``
(JSON list of column names; all by default), ``found`` (what ``listing`` found there;
without it the source lists the folders itself).
"""

from __future__ import annotations

import ast
import base64
import json
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..schema import KEY, NATIVE_NAMES, TS
from .cloud import LISTERS
from .stores import below, listed, read_all, read_at

#: Records of one partition, and of one batch of rows.
RECORDS, ROWS = 1_000_000, 65_536
#: Ranges that are partitions of their own; more are bundled, up to ``RECORDS`` structs a partition.
TASKS = 512
#: The place of a record in its file.
PLACE = "record"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Part:
    """Records ``start`` to ``start + count`` of one recording."""

    key: str
    raw: str
    time: str | None
    worn: str | None
    dtype: str
    worn_dtype: str | None
    start: int
    count: int


@dataclass
class Bundle(InputPartition):
    """The ranges that one task reads."""

    parts: list[Part]


@lru_cache(256)
def dtype_of(text: str) -> np.dtype:
    """The dtype that a file's literal describes."""
    return np.dtype(ast.literal_eval(text))


def recordings(folders: list[str], stem: str, timed: bool) -> list[dict]:
    """By recording that has the part: its files, its dtype and how many records it holds."""
    by: dict[str, dict[str, int]] = {}
    for uri, size in listed(folders, (".raw", ".time", ".dtype")):
        by.setdefault(uri.rpartition("/")[0], {})[uri.rpartition("/")[2]] = size
    out, texts = [], {}

    def text(uri: str) -> str:
        # One file in each recording, but few different contents; it is a line of text.
        t = read_all(uri).decode()
        return texts.setdefault(t, t)

    for folder, files in sorted(by.items()):
        raws = sorted((f for f in files if f.endswith(".raw") and f.startswith((f"{stem} ps", f"{stem}_200hz"))), key=lambda f: ("200hz" not in f, f))
        if not raws:
            continue
        described = sorted(f for f in files if f.endswith(".dtype") and f.startswith(stem[:3]))
        if not described:
            raise FileNotFoundError(f"{folder}: no dtype file for {raws[0]}")
        dtype = text(f"{folder}/{described[0]}")
        count, rest = divmod(files[raws[0]], dtype_of(dtype).itemsize)
        time = raws[0].removesuffix(".raw") + ".time"
        if rest or (timed and files.get(time) != 8 * count):
            raise ValueError(f"{folder}/{raws[0]}: samples and times differ in number")
        worn = raws[0].replace(stem, "worn", 1) if stem == "gaze" else None
        has_worn = worn in files and "worn.dtype" in files
        out.append({
            "key": folder.rpartition("/")[2], "raw": f"{folder}/{raws[0]}", "time": f"{folder}/{time}" if timed else None, "dtype": dtype, "count": count,
            "worn": f"{folder}/{worn}" if has_worn else None, "worn_dtype": text(f"{folder}/worn.dtype") if has_worn else None,
        })
    return out


#: What a recording's entry of a listing is, as columns.
ENTRY = "key string, raw string, time string, dtype string, count bigint, worn string, worn_dtype string"


def listing(spark, folders: list[str], stem: str, timed: bool) -> str | None:
    """``recordings``, packed, by tasks that list some of the folders each; None where they are few, or a folder is a recording itself."""
    subs = []
    for uri in folders:
        more, own = below(uri)
        if own:
            return None
        subs += more
    if len(subs) <= LISTERS:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in ENTRY.split(", ")])
        for batch in batches:
            yield pa.RecordBatch.from_pylist(recordings(batch.column(0).to_pylist(), stem, timed), schema)

    dealt = spark.createDataFrame([(uri,) for uri in subs], "folder string").repartition(LISTERS)
    found = {r["raw"]: r.asDict() for r in dealt.mapInArrow(run, ENTRY).collect()}  # a folder may be asked for twice
    return base64.b64encode(zlib.compress(json.dumps([found[k] for k in sorted(found)]).encode(), 1)).decode()


class Records(DataSource):
    """See the module's text."""

    @classmethod
    def name(cls) -> str:
        return "glintframe_records"

    #: What was found, packed: Spark keeps this object from the schema to the plans, so the store is listed once.
    _packed: bytes | None = None

    def _found(self) -> list[dict]:
        if self._packed is not None:
            return pickle.loads(zlib.decompress(self._packed))
        folders, listed_before = json.loads(self.options["folders"]), self.options.get("found")
        if listed_before:
            found = json.loads(zlib.decompress(base64.b64decode(listed_before)))
        else:
            found = recordings(folders, self.options["part"], self.options.get("timed") == "true")
        if not found:
            raise FileNotFoundError(f"no recording with {self.options['part']} in {', '.join(folders)}")
        if not listed_before:
            self._packed = zlib.compress(pickle.dumps(found), 1)
        return found

    def schema(self) -> StructType:
        found = self._found()
        fields = {KEY: StringType(), PLACE: LongType()}
        if self.options.get("timed") == "true":
            fields[TS] = LongType()
        for dtype in sorted({r["dtype"] for r in found}):
            kinds = dtype_of(dtype)
            for n in kinds.names or ():
                if n != "timestamp_ns":
                    name = NATIVE_NAMES.get(n, n)
                    double = kinds[n].kind == "f" or fields.get(name) == DoubleType()
                    fields[name] = DoubleType() if double else LongType()
        if any(r["worn"] for r in found):
            fields["worn"] = LongType()
        asked = json.loads(self.options.get("columns", "null"))
        return StructType([StructField(n, t) for n, t in fields.items() if asked is None or n in asked or n == KEY])

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordsReader(schema, self._found(), int(self.options.get("records", RECORDS)))


class RecordsReader(DataSourceReader):
    def __init__(self, schema: StructType, found: list[dict], records: int) -> None:
        self.schema, self.found, self.records = schema, found, records
        self.low, self.high = LEAST, MOST

    def __getstate__(self) -> dict:
        """What tasks need: their partitions name the files, so the list of all recordings stays with the planner."""
        return {**self.__dict__, "found": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the instants stay here; all other filters go back to Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != (TS,) or not isinstance(value, int):
                yield f
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, value)
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, value + 1)
            elif isinstance(f, LessThanOrEqual):
                self.high = min(self.high, value)
            elif isinstance(f, LessThan):
                self.high = min(self.high, value - 1)
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, value), min(self.high, value)
            else:
                yield f

    def partitions(self) -> list[Bundle]:
        ranges = sum(-(-r["count"] // self.records) for r in self.found)
        most = -(-ranges // TASKS)
        out, held = [], 0
        for r in self.found:
            for start in range(0, r["count"], self.records):
                count = min(self.records, r["count"] - start)
                if not out or len(out[-1].parts) == most or held + count > RECORDS:
                    out.append(Bundle([]))
                    held = 0
                out[-1].parts.append(Part(r["key"], r["raw"], r["time"], r["worn"], r["dtype"], r["worn_dtype"], start, count))
                held += count
        return out or [Bundle([])]

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        """Batches of about ``ROWS`` rows, from however many ranges."""
        held, rows = [], 0
        for p in partition.parts:
            for batch in self._range(p):
                held.append(batch)
                rows += batch.num_rows
                if rows >= ROWS:
                    yield from _joined(held)
                    held, rows = [], 0
        yield from _joined(held)

    def _range(self, p: Part) -> Iterator[pa.RecordBatch]:
        dtype, asked = dtype_of(p.dtype), {f.name for f in self.schema.fields}
        for start in range(p.start, p.start + p.count, ROWS):
            n = min(ROWS, p.start + p.count - start)
            place, times = np.arange(start, start + n), None
            if p.time:
                times = np.frombuffer(_exactly(p.time, 8 * start, 8 * n), "<i8")
                inside = np.flatnonzero((times >= self.low) & (times <= self.high))
                if not len(inside):
                    continue
                place, times = place[inside], times[inside]
            records = None
            if any(NATIVE_NAMES.get(name, name) in asked for name in dtype.names):
                first, last = int(place[0]), int(place[-1])
                records = np.frombuffer(_exactly(p.raw, first * dtype.itemsize, (last - first + 1) * dtype.itemsize), dtype)[place - first]
            yield self._batch(p, dtype, place, times, records)

    def _batch(self, p: Part, dtype: np.dtype, place: np.ndarray, times: np.ndarray | None, records: np.ndarray | None) -> pa.RecordBatch:
        by = {NATIVE_NAMES.get(n, n): n for n in dtype.names}
        columns = []
        for field in self.schema.fields:
            kind = pa.float64() if isinstance(field.dataType, DoubleType) else pa.int64()
            if field.name == KEY:
                columns.append(pa.array([p.key] * len(place), pa.string()))
            elif field.name == PLACE:
                columns.append(pa.array(place))
            elif field.name == TS and times is not None:
                columns.append(pa.array(times))
            elif field.name in by:
                columns.append(pa.array(records[by[field.name]].astype("f8" if kind == pa.float64() else "i8")))
            elif field.name == "worn" and p.worn:
                columns.append(self._worn(p, place))
            else:
                columns.append(pa.nulls(len(place), kind))
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in self.schema.fields])

    @staticmethod
    def _worn(p: Part, place: np.ndarray) -> pa.Array:
        """The flag of a sample stands at the same place of its own file; a file that ends early leaves the rest null."""
        dtype, first = dtype_of(p.worn_dtype), int(place[0])
        flags = np.frombuffer(read_at(p.worn, first * dtype.itemsize, (int(place[-1]) - first + 1) * dtype.itemsize), dtype)["worn"]
        at = np.minimum(place - first, max(len(flags) - 1, 0))
        known = place - first < len(flags)
        return pa.array(flags[at].astype("i8") if len(flags) else np.zeros(len(place), "i8"), mask=~known)


def _exactly(uri: str, start: int, length: int) -> bytes:
    data = read_at(uri, start, length)
    if len(data) != length:
        raise ValueError(f"{uri} has become shorter since its folder was listed")
    return data


def _joined(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []


def registered(spark):
    """The session with the data source known to it, and pushed filters allowed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Records)
    return spark
