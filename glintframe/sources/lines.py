"""Lines of the files of one header below very many folders, found and read by Python tasks.

Spark's own readers take some milliseconds for each such file.  Here tasks list the folders,
once, when the frame is made; the files they find are cut into ranges and dealt, in bundles, over
as many tasks as Spark shuffles into, and each of those reads its ranges one after another.  The
driver keeps the list in packed form.
"""

from __future__ import annotations

import csv
import json
import re
import zlib
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import below, store

#: Bytes of a range, of one read, and of one batch of lines; lines of one batch.
SPLIT, READ, HELD, ROWS = 32 << 20, 1 << 20, 4 << 20, 65_536
#: Ranges that are dealt to a task together.
BUNDLE = 32
BLANK = bytes(range(33))
MARK = b"\xef\xbb\xbf"


def hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def found(uri: str, pattern: str) -> list[tuple[str, int]]:
    """URIs and sizes of the files below a folder whose names match, by URI."""
    files, path = store(uri)
    root, out = path.rstrip("/"), []
    for f in files.get_file_info(fs.FileSelector(path, recursive=True)):
        if f.type == fs.FileType.File and fnmatchcase(f.base_name, pattern) and not any(map(hidden, f.path[len(root) + 1 :].split("/"))):
            out.append((uri.rstrip("/") + f.path[len(root) :], f.size))
    return sorted(out)


def ranges(uri: str, size: int, split: int) -> Iterator[tuple[str, int, int]]:
    """A file's ranges; ``stop`` is -1 in one that ends with the file."""
    for at in range(0, size, split):
        yield uri, at, at + split if at + split < size else -1


def lines(uri: str, at: int, stop: int) -> Iterator[list[bytes]]:
    """Lists of the lines that begin in a range, without their ends; a line ends with LF, CR or CR LF."""
    files, path = store(uri)
    skip, place = at > 0, max(at - 1, 0)  # from the byte before: what is left of the line of that byte belongs to the range before
    with files.open_input_file(path) as f:
        f.seek(place)
        rest, more = b"", True
        while more:
            data = f.read(READ)
            more = bool(data)
            held = rest + data
            # A CR at the end of what was read may be half of a CR LF.
            whole = held if not more else held[: max(held.rfind(b"\n"), held.rfind(b"\r", 0, -1)) + 1]
            rest = held[len(whole) :]
            if not whole:
                continue
            if stop < 0 and not skip:
                yield whole.splitlines()
                continue
            out = []
            for line in whole.splitlines(keepends=True):
                if skip:
                    skip = False
                elif 0 <= stop <= place:
                    yield out
                    return
                else:
                    out.append(line.rstrip(b"\r\n"))
                place += len(line)
            yield out


def filled(uri: str, at: int, stop: int) -> Iterator[list[bytes]]:
    """The lines of a range that are not blank; the first of a file without a byte order mark."""
    first = at == 0
    for some in lines(uri, at, stop):
        if first and some:
            some[0], first = some[0].removeprefix(MARK), False
        yield [x for x in some if x.strip(BLANK)]


def names(head: bytes) -> list[str]:
    return next(csv.reader([head.decode("utf-8", "replace")]))


def text(some: list[bytes]) -> pa.Array:
    try:
        return pa.array(some, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in some], pa.string())


def table(spark: SparkSession, uri: str, pattern: str, listers: int, split: int = SPLIT) -> DataFrame | None:
    """The files of a name at any depth below ``uri`` as strings by the names of their header, with ``__folder``, the name of the folder of each.

    None where at most ``listers`` folders, which is how many tasks list them, are directly below, or what Spark's
    reader alone knows: files of the folder's own or none at all, other patterns than ``*`` and ``?`` before ``.csv``
    (what is compressed has other names), columns without a name of their own.  A file with another header ends
    the job, as with ``enforceSchema`` off.
    """
    files, path = store(uri)
    if re.search(r"[\[\]{}\\^]", pattern) or not pattern.endswith(".csv") or files.get_file_info(path).type != fs.FileType.Directory:
        return None
    subs, own = below(uri)
    subs = [s for s in subs if not hidden(s.rpartition("/")[2])]
    if own or len(subs) <= listers:
        return None

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            here = [r for folder in batch.column(0).to_pylist() for f in found(folder, pattern) for r in ranges(*f, split)]
            rows = []
            for some in (here[i : i + BUNDLE] for i in range(0, len(here), BUNDLE)):
                # The header of the first file that is not blank; one in each task.
                head = head or next((x[0] for u, at, _ in some if not at for x in filled(u, 0, -1) if x), None)
                rows.append({"uri": some[0][0], "head": head, "packed": zlib.compress(json.dumps(some).encode(), 1)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("uri", pa.string()), ("head", pa.binary()), ("packed", pa.binary())]))

    dealt = spark.createDataFrame(pa.table({"folder": subs})).repartition(listers)
    bundles = sorted(map(tuple, dealt.mapInArrow(listed, "uri string, head binary, packed binary").collect()))
    head = next((bytes(h) for _, h, _ in bundles if h is not None), None)
    columns = names(head) if head is not None else []
    exact = spark.conf.get("spark.sql.caseSensitive") == "true"
    same = (lambda x: x) if exact else (lambda x: [n.lower() for n in x])
    if not columns or len({*same(columns)}) < len(columns) or not all(columns) or "__folder" in columns or "`" in "".join(columns):
        return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        owners: list[tuple[str, int]] = []  # the folder of each run of lines, and how many they are

        def batch() -> pa.RecordBatch:
            index = pa.array([i for i, (_, n) in enumerate(owners) for _ in range(n)], pa.int32())
            out = pa.RecordBatch.from_arrays([text(held), pa.array([f for f, _ in owners], pa.string()).take(index)], names=["line", "folder"])
            held.clear()
            owners.clear()
            return out

        size = 0
        for file, at, stop in (r for b in batches for packed in b.column(0).to_pylist() for r in json.loads(zlib.decompress(packed))):
            folder, first = file.rsplit("/", 2)[1], at == 0
            for some in filled(file, at, stop):
                if first and some:
                    if some[0] != head and same(names(some[0])) != same(columns):
                        raise ValueError(f"{file}: the header is {names(some[0])}, that of the first file {columns}")
                    some, first = some[1:], False
                if some:
                    held += some
                    owners.append((folder, len(some)))
                    size += sum(map(len, some))
                if size > HELD or len(held) > ROWS:
                    yield batch()
                    size = 0
        if held:
            yield batch()

    tasks = min(len(bundles), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = spark.createDataFrame(pa.table({"packed": [p for _, _, p in bundles]})).repartition(tasks).mapInArrow(read, "line string, folder string")
    parsed = F.from_csv("line", ", ".join(f"`{c}` string" for c in columns)).alias("row")
    return rows.select(parsed, F.col("folder").alias("__folder")).select("row.*", "__folder")
