"""Tables whose rows are replaced by key at the cost of what changes.

A table is a base and changes. A write appends its rows, with the number of the write, as
one folder of changes; keys that are to have no rows any more are written as marks. The
table that readers see has, of every key, the rows of its latest write. When the
changes have grown to a share of the base, or to many folders, :meth:`KeyedTable.compact`
writes what readers see as a new base, so a row is rewritten about once each time the
changes reach that share.

Folders count from the moment their writer has marked them complete, so a failed write
leaves the table as it was. A write with the name of an earlier one does nothing, which
makes a retried batch harmless. Numbers are claimed by creating a file, which the
file system lets one writer do; of two writers of a key the larger number counts.
Null is a key like others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, GONE = "_version", "_gone"
SHARE, FOLDERS = 0.25, 64  # of the base's bytes, and number, that changes may reach
DONE = "_SUCCESS"
PACKED = "zstd"  # how the table is compressed, which lies on disk as base and changes
LOOKED_UP = 1000  # keys that a lookup sends to the scan
SALTS = 64


class KeyedTable:
    """The table at ``path`` whose rows are known by the column ``key``; a key may have many rows."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _at(self, folder: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _folders(self, part: str) -> list[tuple[int, str]]:
        """(number, name) of the complete folders of a part of the table, in order."""
        system, place = self._at(part)
        names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
        complete = (n for n in names if system.exists(self._at(f"{part}/{n}/{DONE}")[1]))
        return sorted((int(n.split(".")[0]), f"{part}/{n}") for n in complete)

    def _state(self) -> tuple[str | None, list[tuple[int, str]]]:
        """The newest base, and the changes that came after it."""
        base = self._folders("base")
        number, folder = base[-1] if base else (0, None)
        return folder, [c for c in self._folders("changes") if c[0] > number]

    def _claim(self) -> int:
        """A number above all earlier ones, which no other writer has."""
        system, place = self._at("numbers")
        taken = [int(s.getPath().getName()) for s in system.listStatus(place)] if system.exists(place) else []
        number = max(taken, default=0) + 1
        while not system.createNewFile(self._at(f"numbers/{number}")[1]):
            number += 1
        return number

    def write(self, rows: DataFrame, *, gone: DataFrame | None = None, name: str | None = None) -> None:
        """Put ``rows`` in the place of all rows of their keys, and remove the keys in ``gone``.

        A key in both has the new rows. ``name`` identifies the write.
        """
        if name is not None and self.has(name):
            return
        number = self._claim()
        marked = rows.withColumn(GONE, F.lit(False))
        if gone is not None:
            removed = gone.select(F.col(self.key).alias("_removed")).distinct()
            only = removed.join(rows.select(self.key), F.col("_removed").eqNullSafe(F.col(self.key)), "left_anti")
            marks = only.select(F.col("_removed").cast(rows.schema[self.key].dataType).alias(self.key), F.lit(True).alias(GONE))
            marked = marked.unionByName(marks, allowMissingColumns=True)
        self._append(marked, number, name)

    def put(self, changes: DataFrame, gone: str, *, name: str | None = None) -> None:
        """Write changes that have each key in one row, in one pass: keys marked in the column ``gone`` are removed."""
        if name is None or not self.has(name):
            self._append(changes.withColumnRenamed(gone, GONE), self._claim(), name)

    def _append(self, marked: DataFrame, number: int, name: str | None) -> None:
        folder = f"changes/{number:012d}.{name or uuid.uuid4().hex[:12]}"
        marked.withColumn(VERSION, F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/{folder}", compression=PACKED)

    def has(self, name: str) -> bool:
        """Whether there is a write of this name, unless it has been dropped."""
        return any(folder.endswith(f".{name}") for _, folder in self._folders("changes"))

    def exists(self) -> bool:
        return bool(self._folders("base") or self._folders("changes"))

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys (the only column of ``keys``), which are looked up in the base by range."""
        asked = keys.toDF("_asked")
        few = [r[0] for r in asked.limit(LOOKED_UP + 1).collect()]
        rows = self.read()
        if len(few) <= LOOKED_UP and None not in few:  # reaches the scan, where it passes over files and row groups
            rows = rows.filter(F.col(self.key).isin(few))
        return rows.join(asked, F.col(self.key).eqNullSafe(F.col("_asked")), "left_semi")

    def read(self) -> DataFrame:
        """The rows of every key's latest write."""
        base, changes = self._state()
        if not changes:
            return self._open([base]) if base else self.spark.createDataFrame([], f"{self.key} string")
        rows = self._open([folder for _, folder in changes])
        if len(changes) == 1:  # it has all rows of its keys from one write
            latest, current = rows.select(F.col(self.key).alias("_key")), rows
        else:
            latest = rows.groupBy(F.col(self.key).alias("_key")).agg(F.max(VERSION).alias("_latest"))
            current = rows.join(latest, self._same() & (F.col(VERSION) == F.col("_latest")), "left_semi")
        current = current.where(~F.col(GONE)).drop(VERSION, GONE)
        if base is None:
            return current
        kept = self._open([base]).join(latest, self._same(), "left_anti")
        return kept.unionByName(current, allowMissingColumns=True)

    def _same(self) -> Column:
        return F.col(self.key).eqNullSafe(F.col("_key"))

    def _open(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", len(folders) > 1).parquet(*(f"{self.path}/{f}" for f in folders))

    def compact(self, share: float = SHARE, folders: int = FOLDERS) -> bool:
        """Write a new base if the changes have reached ``share`` of the base or as many as ``folders``; whether it did."""
        base, changes = self._state()
        size = lambda names: sum(system.getContentSummary(place).getLength() for system, place in map(self._at, names))
        if not changes or (base and len(changes) < folders and size([f for _, f in changes]) < share * size([base])):
            return False
        target = f"base/{changes[-1][0]:012d}.{uuid.uuid4().hex[:12]}"
        whole = self.read()
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # By ranges of the key, so that a lookup passes over most files; a salt splits a key of very many rows.
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
        whole.repartitionByRange(partitions, self.key, salt).sortWithinPartitions(self.key).write.parquet(f"{self.path}/{target}", compression=PACKED)
        return True

    def drop_old(self) -> None:
        """Delete bases and changes that the newest base has made useless, when nobody reads them any more."""
        base = self._folders("base")
        if base:
            number, newest = base[-1]
            for n, folder in [*base, *self._folders("changes")]:
                if n <= number and folder != newest:
                    system, place = self._at(folder)
                    system.delete(place, True)
