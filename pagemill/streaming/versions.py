"""Documents that arrive again: a later version takes back the chunks of the one before.

The state of a document is its version and the hash of each of its chunks, so it grows
with the number of its chunks and not with their text. A delivery that repeats within
``late`` is dropped before it gets there, and older versions than the known one later.
What comes out are changes: chunks that are new or different, and the places of those that are
gone. They go into a :class:`~pagemill.sources.keyed.KeyedTable` under the number of their
micro-batch, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagemill.constants import ChunkingConfig
from pagemill.functions.chunking import chunk_blocks
from pagemill.functions.text import sanitize, text_hash, token_estimate
from pagemill.operators.blocks import text_block_array
from pagemill.sources.keyed import KeyedTable

CHUNK = "chunk_index int, chunk_text string, chunk_hash string, token_count int"
ID = "chunk_id"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
change = Row("document_id", "chunk_index", "chunk_text", "chunk_hash", "token_count", "gone")


def versions_with_chunks(documents: DataFrame, *, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """(document_id, version, at, chunks) of documents (document_id, version, at, text); a null text has no chunks."""

    def chunk(c, i):  # noqa: ANN001, ANN202
        text = sanitize(c["text"])
        return F.struct(
            i.cast("int").alias("chunk_index"), text.alias("chunk_text"), text_hash(text).alias("chunk_hash"), token_estimate(text).cast("int").alias("token_count")
        )

    pieces = chunk_blocks(text_block_array(F.coalesce(F.col("text"), F.lit(""))), config, offsets=False)
    return documents.select("document_id", "version", "at", F.transform(pieces, chunk).alias("chunks"))


class Latest(StatefulProcessor):
    """Keeps the latest version of a document, and tells what a later one changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One value a document: each access to state is a call from Python to the executor.
        self.known = handle.getValueState("known", "version bigint, places array<int>, hashes array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        newest = max(rows, key=lambda r: r.version)
        known = self.known.get()
        if known is not None and known[0] >= newest.version:
            return
        old = dict(zip(known[1], known[2])) if known is not None else {}
        fresh = newest.chunks or []
        self.known.update((newest.version, [c["chunk_index"] for c in fresh], [c["chunk_hash"] for c in fresh]))
        for c in fresh:
            index, hashed = c["chunk_index"], c["chunk_hash"]
            if old.pop(index, None) != hashed:
                yield change(key[0], index, c["chunk_text"], hashed, c["token_count"], False)
        for index in old:
            yield change(key[0], index, None, None, None, True)

    def close(self) -> None:
        pass


def changes(versions: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    """(document_id, chunk columns, gone): what each micro-batch changes."""
    kind = dict(versions.dtypes)["document_id"]
    once = versions.withWatermark("at", late).dropDuplicatesWithinWatermark(["document_id", "version"])
    return once.select("document_id", "version", "chunks").groupBy("document_id").transformWithState(
        statefulProcessor=Latest(), outputStructType=f"document_id {kind}, {CHUNK}, gone boolean", outputMode="Update", timeMode="None"
    )


def into_table(changed: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Put the changes of each micro-batch into the table, which is known by ``ID``.

    A micro-batch has a change of a key once, so it is written as it comes, in one pass. Before that, bases and
    changes go that an earlier one has made useless: who reads them has the time between two micro-batches.
    """
    spark = changed.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        name = f"batch-{number}"
        if not table.has(name):
            table.drop_old()
            spark.sparkContext._jvm.System.gc()  # rows that the last one shuffled are deleted with what the driver knew of them
        table.put(batch.withColumn(ID, F.concat_ws("#", "document_id", "chunk_index")), "gone", name=name)
        table.compact()

    writer = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with rocksdb_state(changed.sparkSession):
        return writer.start()


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """State on local disk, which keyed state needs; a stream takes the setting when it is started."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def chunk_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, ID)
