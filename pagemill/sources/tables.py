"""Table reads and writes."""

from __future__ import annotations

import atexit
import functools
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


LISTING, LISTED_PER_CORE = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4
BUCKET, BUCKETS = "_bucket", 64  # folders of a table whose rows are replaced by key


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when the input has fewer splits than there are cores.

    A single-row-group file is read by one task however many cores there are, and
    text work is bound by the processor. Large inputs have splits to spare, so
    for them this changes nothing and nothing is shuffled.
    """
    return df.repartition(_cores(df)) if _is_narrow(df) else df


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def _is_narrow(df: DataFrame) -> bool:
    return df.rdd.getNumPartitions() < 2 * _cores(df)


def list_by_cores(spark: SparkSession) -> None:
    """List folders in a few tasks per core, unless the session says otherwise; else each is a task, up to 10,000.

    The setting stays, as a stream takes it anew for the files of every micro-batch.
    """
    if LISTING not in spark.conf.getAll:
        spark.conf.set(LISTING, str(LISTED_PER_CORE * spark.sparkContext.defaultParallelism))


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a file stream; the pattern matches a file or a folder of that name."""
    table = read_table(spark, folder, name)
    pattern = f"{folder}/{name}.parque[t]"
    stream = (
        spark.readStream.schema(table.schema).option("maxFilesPerTrigger", "1000").parquet(pattern)
    )
    return stream.repartition(_cores(table)) if _is_narrow(table) else stream


@functools.cache
def _local_folder() -> str:
    """A folder of this process, removed when it ends."""
    path = tempfile.mkdtemp(prefix="pagemill-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the one all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; all folders of an
    application lie under its id there, so that their owner can drop them with
    :func:`drop_stored`. Only a local master, where every task runs on this
    machine, may go without the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex[:12]}"


def drop_stored(spark: SparkSession) -> None:
    """Delete all folders that this application has had from :func:`shared_folder`."""
    folder = shared_folder(spark, "any").rsplit("/", 1)[0]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder, for a costly input that is read again.

    The table survives the loss of executors and ends the lineage of the rows.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_documents(catalog: DataFrame, path: str, *, key: str = "id") -> None:
    """Put catalog rows into the table, in place of those with the same id.

    A missing status is 'uploaded', missing times are now.
    """
    now = F.current_timestamp()
    rows = catalog
    for name, default in (("status", F.lit("uploaded")), ("created_at", now), ("updated_at", now)):
        value = F.coalesce(F.col(name), default) if name in rows.columns else default
        rows = rows.withColumn(name, value)
    replace_rows(rows, path, key=key)


def write_chunks(chunks: DataFrame, path: str, *, key: str = "document_id") -> None:
    """Put chunk rows into the table, in place of all chunks of their documents."""
    rows = chunks
    if "created_at" not in rows.columns:
        rows = rows.withColumn("created_at", F.current_timestamp())
    replace_rows(rows, path, key=key)


def replace_rows(rows: DataFrame, path: str, *, key: str, buckets: int = BUCKETS) -> None:
    """Write rows so that all earlier rows of their keys are gone; doing it again changes nothing.

    The table lies in folders by a hash of the key. Folders that the rows touch
    are written anew, from the rows and what is kept of the folder; the others
    are not read. The job swaps all of them at its end, so a failure leaves the table
    as it was, but two writers must not work on a table at once.
    """
    spark = rows.sparkSession
    fresh = rows.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if _exists(spark, path):
        table = spark.read.parquet(path)
        touched = table.join(fresh.select(BUCKET).distinct(), BUCKET, "left_semi")
        kept = touched.join(rows.select(key).distinct(), key, "left_anti")
        fresh = fresh.unionByName(kept, allowMissingColumns=True)
    writer = fresh.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(place) and len(system.listStatus(place)) > 0


def write_by_month(rows: DataFrame, path: str, *, ts: str = "created_at", mode: str = "append") -> None:
    """Write under year=/month= folders, in files of even size however full a month is.

    The rebalance splits a month that holds much of the table over many tasks and
    puts sparse ones together.
    """
    dated = rows.withColumn("year", F.year(ts)).withColumn("month", F.month(ts))
    dated.hint("rebalance", "year", "month").write.mode(mode).partitionBy("year", "month").parquet(path)


def write_files(rows: DataFrame, path: str) -> None:
    """Write rows (a whole number, text) as a text file per number, ``<column>=<number>/part.txt``, a line per row.

    Tasks write through pyarrow's file systems, where opening a file costs a small part of
    what it costs in Spark's writer; a path that they do not know is left to Spark. A file
    is moved to its place when it is whole, so a task that runs again changes nothing.
    """
    key, text = rows.columns
    dealt = rows.repartition(key)
    try:
        system, root = fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError):
        dealt.write.partitionBy(key).text(path)
        return
    system.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        files = 0
        values = ((k.as_py(), t.as_py()) for batch in batches for k, t in zip(batch.column(0), batch.column(1)))
        for value, lines in itertools.groupby(values, key=lambda row: row[0]):
            place = f"{root}/{key}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"
            part = f"{place}/_{uuid.uuid4().hex}"
            system.create_dir(place)
            with system.open_output_stream(part) as out:
                for _, line in lines:
                    out.write((line or b"") + b"\n")
            system.move(part, f"{place}/part.txt")
            files += 1
        yield pa.record_batch([pa.array([files], pa.int64())], ["files"])

    found = dealt.select(key, F.col(text).cast("binary")).sortWithinPartitions(key)
    found.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def write_report(lines: DataFrame, path: str, *, column: str = "report", mode: str = "overwrite") -> None:
    """Write one text column as plain text files."""
    lines.select(column).write.mode(mode).text(path)
