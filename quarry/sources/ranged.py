"""Ranged reads of files inside tasks, on every file system that pyarrow opens: local and mounted folders, HDFS, S3, GCS.

Opened files seek and read ranges, so what needs an archive's directory and one member fetches just those bytes.
Listings are Spark's own, of paths and lengths only, so folders are listed wherever Spark can read, and no file is opened for it.
"""

from __future__ import annotations

import io
import os
import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUFFER = 1 << 16


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if local := re.match(r"(?:file:/{0,2}(?=/))?(/.*)$", uri):
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(uri)


def entries(folder: str) -> list[tuple[str, fs.FileInfo]]:
    """(path or URI, info) of what lies in a folder, by name. Links are left out."""
    system, path = file_system(folder)
    local, prefix = isinstance(system, fs.LocalFileSystem), folder[: len(folder) - len(path)] if folder.endswith(path) else ""
    found = system.get_file_info(fs.FileSelector(path, recursive=False))
    kept = [("" if local else prefix, i) for i in found if not (local and os.path.islink(i.path))]
    return [(before + i.path, i) for before, i in sorted(kept, key=lambda e: e[1].base_name)]


class _Ranges(io.RawIOBase):
    """Reads at places of a file, with the errors that readers of archives expect."""

    def __init__(self, source):
        self.source, self.at, self.length = source, 0, source.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        to = offset + (0, self.at, self.length)[whence]
        if to < 0:
            raise OSError("before the beginning of the file")
        self.at = to
        return to

    def readinto(self, target) -> int:
        n = max(0, min(len(target), self.length - self.at))
        if n:
            target[:n] = self.source.read_at(n, self.at)
            self.at += n
        return n

    def close(self) -> None:
        if not self.closed:
            self.source.close()
        super().close()


def opened(uri: str) -> io.BufferedReader:
    """The file as a seekable stream that fetches ranges of at least BUFFER bytes."""
    system, path = file_system(uri)
    return io.BufferedReader(_Ranges(system.open_input_file(path)), BUFFER)


def listing(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modified) of the files below `root` with names like `pattern`. Content is not read; empty files have no row."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def byte_ranges(files: DataFrame, split: int) -> DataFrame:
    """(path, start, end) of files (path, length): ranges of `split` bytes, one row each."""
    some = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"))
    return some.select("path", "start", F.least(F.col("start") + split, "length").alias("end"))
