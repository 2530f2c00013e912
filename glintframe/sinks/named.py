"""Named files as a Python data sink: ``df.write.format("glintframe_files")``.

Rows are pieces of files: ``file`` (its path below the target) and ``data``.  Pieces
of one file, and of all files of one folder, must lie in one partition, in order;
``write_files`` sees to that.  A task writes into a folder of its own below the
target, and only the commit at the end of the job gives the files their names, so a
lost executor or a failed task leaves no half file, and a repeated task no second one.
A folder that is new in the target gets its name as a whole, by one move, in a local
or mounted store; elsewhere, and in folders that exist, the files are moved one by one.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..sources.stores import read_at, store

SCHEMA = "file string, data binary"
#: Bytes of a file that are held back and written, or compressed, together.
HELD = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """A task's folder, and the folder below the target that each of its numbered folders becomes, with the names of the files."""

    folder: str
    folders: list[tuple[str, list[str]]]


def runs(files: pa.Array, data: pa.Array) -> Iterator[tuple[str, memoryview]]:
    """Each run of pieces of one file, as the bytes that they are in a row."""
    if data.null_count:
        raise ValueError("a piece of a file is null")
    if not len(data):
        return
    wide = np.int64 if pa.types.is_large_binary(data.type) else np.int32
    _, places, held = data.buffers()
    places, held = np.frombuffer(places, wide)[data.offset : data.offset + len(data) + 1], memoryview(held or b"")
    same = pc.run_end_encode(files)
    ends = same.run_ends.to_numpy()
    for file, start, stop in zip(same.values.to_pylist(), places[np.r_[0, ends[:-1]]].tolist(), places[ends].tolist()):
        yield file, held[start:stop]


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "glintframe_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NamedFilesWriter(self.options["path"], self.options["job"], json.loads(self.options["heads"]))


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, target: str, job: str, heads: dict[str, str]) -> None:
        self.heads = heads
        self.target, self.scratch = target.rstrip("/"), f"{target.rstrip('/')}/_{job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder = f"{self.scratch}/{uuid.uuid4().hex}"
        files, path = store(folder)
        files.create_dir(path, recursive=True)
        folders: list[tuple[str, list[str]]] = []
        now: dict[str, tuple[object, bytearray]] = {}  # open files, all of one folder, and what is not yet written

        def put(name: str, least: int) -> None:
            stream, held = now[name]
            if len(held) >= least:
                stream.write(gzip.compress(held, 6, mtime=0) if name.endswith(".gz") else bytes(held))
                held.clear()

        def close() -> None:
            for name, (stream, _) in now.items():
                put(name, 1)
                stream.close()
            now.clear()

        for batch in iterator:
            for file, data in runs(batch.column("file"), batch.column("data")):
                place, _, name = file.rpartition("/")
                if not folders or place != folders[-1][0]:
                    close()
                    files.create_dir(f"{path}/{len(folders)}", recursive=False)
                    folders.append((place, []))
                if name not in now:
                    now[name] = files.open_output_stream(f"{path}/{len(folders) - 1}/{name}", compression=None), bytearray(self.heads.get(name, "").encode())
                    folders[-1][1].append(name)
                for at in range(0, len(data), HELD):
                    now[name][1].extend(data[at : at + HELD])
                    put(name, HELD)
        close()
        return Written(folder, folders)

    def commit(self, messages: list[Written | None]) -> None:
        # No two tasks have files of one folder.
        found = [(f"{m.folder}/{k}", place, names) for m in messages if m is not None for k, (place, names) in enumerate(m.folders)]
        with ThreadPool(16) as pool:
            pool.starmap(self._name, found, 64)
        self._clear()

    def _name(self, written: str, place: str, names: list[str]) -> None:
        """Give the files of one folder their names."""
        files, folder = store(written)
        _, target = store(f"{self.target}/{place}" if place else self.target)
        if place and files.type_name == "local":
            try:
                if "/" in place:
                    files.create_dir(target.rpartition("/")[0], recursive=True)
                files.move(folder, target)
                return
            except OSError:  # the folder exists and holds something
                pass
        files.create_dir(target, recursive=True)
        for name in names:
            files.move(f"{folder}/{name}", f"{target}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, path = store(self.scratch)
        try:
            files.delete_dir(path)
        except FileNotFoundError:
            pass


def tasks(spark) -> int:
    """How many tasks write: files take their time whatever they hold, so a number that Spark does not lower for few bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_files(pieces: DataFrame, target: str, *order: str, heads: dict[str, str] | None = None) -> None:
    """Write pieces (``file, data`` and the columns of ``order``) as the files they name below ``target``, in one job.

    Folders are dealt over the tasks, so one job writes the files of any number of
    recordings; the pieces of a file follow one another by ``order``.  ``heads``: what
    every file of a name, in whatever folder, begins with.  Without ``order`` the pieces
    of a folder lie in one partition already, one after another, and stay where they are.
    """
    spark = pieces.sparkSession
    spark.dataSource.register(NamedFiles)
    dealt = pieces
    if order:
        folder = F.regexp_replace("file", "[^/]*$", "")
        dealt = pieces.withColumn("__folder", folder).repartition(tasks(spark), "__folder").sortWithinPartitions("__folder", *order)
    options = {"path": str(target), "job": uuid.uuid4().hex, "heads": json.dumps(heads or {})}
    dealt.select("file", "data").write.format("glintframe_files").mode("append").options(**options).save()


def lines(df: DataFrame, file, order: str, columns: list[str], sep: str = ",", null: str = "") -> DataFrame:
    """A table's rows as pieces ``file, data, at``: one line each, by Spark's CSV functions; ``at`` is the column of ``order``."""
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in columns]), {"sep": sep, "nullValue": null, "emptyValue": ""})
    return df.select(file.alias("file"), F.concat(line, F.lit("\n")).cast("binary").alias("data"), F.col(f"`{order}`").cast("bigint").alias("at"))


def head(columns: list[str], sep: str = ",") -> str:
    """The header line of such a file."""
    return sep.join(f'"{c}"' if sep in c or '"' in c else c for c in columns) + "\n"


def texts(spark, files: dict[str, str]) -> DataFrame:
    """Small whole files as pieces."""
    rows = [(name, text.encode(), 0) for name, text in files.items()]
    return spark.createDataFrame(rows, "file string, data binary, at bigint")


#: Bytes of one piece of a copied file.
PIECE = 4 << 20


def copies(spark, files: list[tuple[str, str]]) -> DataFrame:
    """Whole files, given by URI and by the name they get, as pieces that tasks read."""
    sizes = []
    for uri, name in files:
        fs, path = store(uri)
        sizes.append((uri, name, fs.get_file_info(path).size))
    rows = spark.createDataFrame(sizes, "uri string, file string, size bigint")
    rows = rows.select("uri", "file", F.explode(F.sequence(F.lit(0).cast("bigint"), "size", F.lit(PIECE).cast("bigint"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, name, at in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([read_at(uri, at, PIECE)], pa.binary()), pa.array([at])], names=["file", "data", "at"])

    # The pieces' places are dealt over tasks first; their bytes go to the task that writes the file.
    return rows.repartition("uri", "at").mapInArrow(run, "file string, data binary, at bigint")
