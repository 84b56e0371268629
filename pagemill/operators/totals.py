"""Totals per group that follow a table's changes, without reading the table again.

Every write of a :class:`~pagemill.sources.keyed.KeyedTable` gives signed rows: the rows that
its keys had count with a minus, the new ones with a plus, and both are summed per group
before they are stored. The sum of all stored parts is the total of the table. Parts
go by the name of their write, so a write that is run again adds nothing, and
:meth:`Totals.fold` puts their sum in their place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.sources.keyed import KeyedTable
from pagemill.sources.tables import stored

COUNT, PART = "cnt", "part"


def signed(rows: DataFrame, sign: int, groups: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    values = [(F.coalesce(v, F.lit(0)) * sign).alias(n) for n, v in sums.items()]
    return rows.select(*groups, F.lit(sign).cast("bigint").alias(COUNT), *values)


class Totals:
    """Counts and sums of a table per group, kept in a table of parts at ``path``."""

    def __init__(self, table: KeyedTable, path: str, groups: Sequence[str], sums: Mapping[str, Column]) -> None:
        self.table, self.groups, self.sums = table, list(groups), dict(sums)
        self.parts = KeyedTable(table.spark, path, PART)

    def _summed(self, rows: DataFrame) -> DataFrame:
        names = [COUNT, *self.sums]
        out = rows.groupBy(*self.groups).agg(*(F.sum(n).alias(n) for n in names))
        some = F.lit(False)
        for n in names:
            some = some | (F.col(n) != 0)
        return out.filter(some)

    def write(self, rows: DataFrame, *, gone: DataFrame | None = None, name: str) -> None:
        """A write of the table, and what it changes in the totals; ``name`` identifies it.

        The part is stored before the rows are, and a write that was ended between the two is
        finished by running it again. One writer at a time works on a table and its totals.
        """
        key = self.table.key
        if not self.parts.has(name):
            keys = rows.select(key)
            keys = (keys if gone is None else keys.unionByName(gone.select(key))).distinct()
            before = signed(self.table.rows_of(stored(keys, "keys")), -1, self.groups, self.sums) if self.table.exists() else None
            after = signed(rows, 1, self.groups, self.sums)
            change = self._summed(after if before is None else after.unionByName(before))
            self.parts.write(change.withColumn(PART, F.lit(name)), name=name)
        self.table.write(rows, gone=gone, name=name)

    def read(self) -> DataFrame:
        """Groups with rows: the group's columns, ``cnt`` and the sums."""
        return self._summed(self.parts.read()).filter(F.col(COUNT) > 0)

    def fold(self, name: str) -> None:
        """Put the sum of all parts in their place."""
        if not self.parts.has(name):
            held = self.parts.read()
            whole = stored(self._summed(held), "totals").withColumn(PART, F.lit(name))
            self.parts.write(whole, gone=held.select(PART), name=name)
            self.parts.compact()
