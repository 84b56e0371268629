"""Files read by parser plug-ins as a Spark data source.

``spark.read.format("parsed_files")`` gives a row per block, and a row with ``error``
for a file that its parser could not read or that no parser takes. Files are packed into
partitions by their bytes, so many small files are one task and a large one is a task of
its own. A filter on ``file_type`` passes over files before they are read, and a schema of
file columns only reads no file at all. Paths are those that pyarrow's file systems reach
from the driver and the executors alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from pagemill.constants import MAX_UPLOAD_BYTES

NAME = "parsed_files"
FILE_COLUMNS = "path string, file_type string, length bigint"
SCHEMA = f"{FILE_COLUMNS}, position int, block_type string, text string, page_number int, error string"
PACKED, FILE_COST = 64 << 20, 256 << 10  # bytes of a partition; bytes that opening a file counts as
PACKS = 2048  # partitions, about, at most: a task costs more than opening many small files

# A parser takes a file's name and bytes and gives (block_type, text, page_number).
Parser = Callable[[str, bytes], Iterable[tuple[str, str, int | None]]]


class Pack(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]) -> None:
        self.files = files


def packed(files: Iterable[tuple[str, str, int]], most: int = PACKED) -> list[list[tuple[str, str, int]]]:
    """Files (path, type, length) in packs of about ``most`` bytes, the larger ones first; a larger file is a pack.

    Packs hold more where there would be more of them than ``PACKS``.
    """
    packs: list[list[tuple[str, str, int]]] = []
    room = 0
    found = sorted(files, key=lambda f: (-f[2], f[0]))
    most = max(most, sum(f[2] + FILE_COST for f in found) // PACKS)
    for file in found:
        cost = file[2] + FILE_COST
        if not packs or cost > room:
            packs.append([])
            room = most
        packs[-1].append(file)
        room -= cost
    return packs


class Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: StructType, parsers: Mapping[str, Parser]) -> None:
        self.path = options["path"]
        self.most = int(options.get("packedBytes", PACKED))
        self.limit = int(options.get("maxBytes", MAX_UPLOAD_BYTES))
        self.names = schema.names
        self.parsers = dict(parsers)
        self.types: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("file_type",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.types = wanted if self.types is None else self.types & wanted
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = re.compile(r"(^|/)[._][^/]*$").search
        files = [(i.path, _type_of(i.base_name), i.size) for i in found if i.is_file and not hidden(i.path[len(root) :])]
        return [Pack(p) for p in packed((f for f in files if self.types is None or f[1] in self.types), self.most)] or [Pack([])]

    def read(self, partition: Pack) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        narrow = not set(self.names) & {"position", "block_type", "text", "page_number", "error"}
        for path, kind, length in partition.files:
            own = {"path": path, "file_type": kind, "length": length}
            for row in [{}] if narrow else self._blocks(system, path, kind, length):
                yield tuple((own | row).get(name) for name in self.names)

    def _blocks(self, system, path: str, kind: str, length: int) -> list[dict]:  # noqa: ANN001
        if kind not in self.parsers:
            return [{"error": f"no parser for '{kind}'"}]
        if length > self.limit:
            return [{"error": "too_large"}]
        try:
            with system.open_input_stream(path) as stream:
                blocks = list(self.parsers[kind](path.rsplit("/", 1)[-1], stream.read()))
        except Exception as error:  # noqa: BLE001
            return [{"error": str(error) or type(error).__name__}]
        return [dict(zip(("position", "block_type", "text", "page_number"), (i, *b))) for i, b in enumerate(blocks)]


def _type_of(name: str) -> str:
    dot = name.rfind(".")
    return name[dot:].lower() if dot > 0 else ""


def register_parsers(spark: SparkSession, parsers: Mapping[str, Parser], name: str = NAME) -> None:
    """Make ``spark.read.format(name)`` read files with these parsers, by lower-case suffix.

    Reading takes a folder; options are ``packedBytes`` and ``maxBytes``.
    """
    held = dict(parsers)

    class ParsedFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(self.options, schema, held)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ParsedFiles)
