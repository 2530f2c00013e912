"""Folders and small files on any store that Spark reads, through the session's file systems.

Tables are read and written by Spark itself; this is for metadata files, for the
names in a folder, and for the one named file that an export format asks for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared place that the session names; below ``/tmp`` only on a local master without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{found or 'file:/tmp/checkpoints'}/glintframe-{uuid.uuid4().hex}"


class Place:
    """A file or folder; a path without a scheme lies in the session's default file system."""

    def __init__(self, spark: SparkSession, path: object) -> None:
        self.spark = spark
        path = spark._jvm.org.apache.hadoop.fs.Path(str(path))
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = fs.makeQualified(path)
        # The local file system as it is, without checksum files beside those that are written.
        self._fs = fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs

    def __str__(self) -> str:
        return self._path.toString()

    def __repr__(self) -> str:
        return f"Place({str(self)!r})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Place) and str(self) == str(other)

    def __hash__(self) -> int:
        return hash(str(self))

    def __truediv__(self, name: str) -> Place:
        return Place(self.spark, f"{self}/{name}")

    @property
    def name(self) -> str:
        return self._path.getName()

    @property
    def parent(self) -> Place:
        return Place(self.spark, self._path.getParent().toString())

    def is_dir(self) -> bool:
        return self._fs.exists(self._path) and self._fs.getFileStatus(self._path).isDirectory()

    def is_file(self) -> bool:
        return self._fs.exists(self._path) and self._fs.getFileStatus(self._path).isFile()

    def names(self, folders: bool = False) -> list[str]:
        """Sorted names of the files, or of the folders, directly below."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path) if s.isDirectory() == folders)

    def read_bytes(self) -> bytes:
        stream = self._fs.open(self._path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_text(self) -> str:
        return self.read_bytes().decode()

    def first_line(self) -> str:
        """The first line alone, however long the file is."""
        jvm = self.spark._jvm
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(self._fs.open(self._path), "UTF-8"))
        try:
            return lines.readLine() or ""
        finally:
            lines.close()

    def write_text(self, text: str) -> None:
        stream = self._fs.create(self._path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def mkdir(self) -> None:
        self._fs.mkdirs(self._path)

    def copy_to(self, other: Place) -> None:
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path, other._fs, other._path, False, self.spark._jsc.hadoopConfiguration())

    def write_csv(self, df: DataFrame, **options: object) -> None:
        """The table as this one file: Spark writes it into a folder beside, and the file is moved here.

        One task writes it, since an export's file holds one recording.
        """
        made = self.parent / f"_{self.name}-{uuid.uuid4().hex}"
        try:
            df.coalesce(1).write.options(**options).csv(str(made))
            part = made / next(n for n in made.names() if n.startswith("part-"))
            self._fs.delete(self._path, False)
            if not self._fs.rename(part._path, self._path):
                raise OSError(f"{part} cannot be moved to {self}")
        finally:
            self._fs.delete(made._path, True)
