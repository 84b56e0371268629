"""Folders listed and files read by tasks.

A folder is listed level by level: tasks list the folders of a level and write what they find, and the
folders among it are dealt out as the next level. Files have the paths, times and lengths that Spark's file
sources give them, and what these pass over is passed over: hidden names and files of no bytes.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources.tables import LISTED_PER_CORE, stored

FOUND = "path string, modificationTime timestamp, length bigint, folder boolean"
_ARROW = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("folder", pa.bool_())])
ROWS = 10_000  # of a batch of what is found
BYTES = 8 << 20  # of files that are read at once, or one file


class Folder(NamedTuple):
    uri: str  # of its file system's root
    prefix: str  # what Spark's paths have before those of the file system
    path: str  # in the file system, as Spark writes it


def folder(spark: SparkSession, path: str) -> Folder | None:
    """Where ``path`` is for tasks; nothing if it isn't a folder, or lies where pyarrow doesn't reach."""
    if any(c in path for c in "*?[]{}\\"):
        return None
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place) or not system.getFileStatus(place).isDirectory():
        return None
    uri = system.makeQualified(place).toUri()
    scheme, host = uri.getScheme(), uri.getAuthority()
    found = Folder(f"{scheme}://{host or ''}/", f"{scheme}://{host}" if host else f"{scheme}:", uri.getPath().rstrip("/"))
    try:
        _system(found)
    except (pa.ArrowException, OSError):
        return None
    return found


def _system(where: Folder) -> tuple[fs.FileSystem, str]:
    """The file system and what its paths have before Spark's, such as a bucket."""
    system, root = fs.FileSystem.from_uri(where.uri)
    return system, root.rstrip("/")


def _is_hidden(name: str, is_folder: bool) -> bool:
    """Spark's rule."""
    if is_folder and name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name


def _entries(system: fs.FileSystem, root: str, path: str) -> Iterator[tuple[str, int, int, bool]]:
    """(name, milliseconds, length, whether it is a folder) of what lies in a folder."""
    if isinstance(system, fs.LocalFileSystem):  # one after the other, however many there are
        with os.scandir(f"{root}{path}/") as found:
            for e in found:
                if e.is_dir():
                    yield e.name, 0, 0, True
                elif e.is_file():
                    at = e.stat()
                    yield e.name, at.st_mtime_ns // 1_000_000, at.st_size, False
        return
    for i in system.get_file_info(fs.FileSelector(f"{root}{path}")):
        if i.type == fs.FileType.Directory:
            yield i.base_name, 0, 0, True
        elif i.is_file:
            yield i.base_name, (i.mtime_ns or 0) // 1_000_000, i.size, False


def files(spark: SparkSession, where: Folder) -> DataFrame:
    """(path, modificationTime, length) of every file under a folder, as a stored table of even parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(where)

        def found() -> Iterator[tuple]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    for name, at, length, is_folder in _entries(system, root, path):
                        if _is_hidden(name, is_folder) or not (length or is_folder):
                            continue
                        whole = f"{path}/{name}"
                        yield (whole if is_folder else where.prefix + whole), at * 1000, length, is_folder

        rows = found()
        while part := list(itertools.islice(rows, ROWS)):
            columns = zip(*part)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    tasks = LISTED_PER_CORE * spark.sparkContext.defaultParallelism
    level, whole = spark.createDataFrame([(where.path,)], "path string"), None
    while True:
        listed = stored(level.mapInArrow(run, FOUND), "listing")
        whole = listed if whole is None else whole.union(listed)
        folders = listed.where("folder").select("path")
        if folders.isEmpty():
            break
        level = folders.repartition(tasks)
    # A folder of very many files was listed by one task; each part is read by a task of its own, or a few are.
    return stored(whole.where("NOT folder").drop("folder").repartition(tasks), "files-listed")


def content(where: Folder, path: Column) -> Column:
    """The bytes of the files of a folder."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        system, root = _system(where)
        for batch in batches:
            held, size = [], 0
            for name in batch.to_pylist():
                with system.open_input_stream(root + name[len(where.prefix) :], compression=None) as stream:
                    held.append(stream.read())
                size += len(held[-1])
                if size >= BYTES:
                    yield pa.array(held, pa.binary())
                    held, size = [], 0
            if held:
                yield pa.array(held, pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(path)
