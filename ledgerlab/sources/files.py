"""Files of a folder, listed and read by tasks.

Spark's reader of whole files keeps a status of every file in the driver. Here each round of tasks lists the folders that
the round before found, into a stored table, and a task reads the files whose rows it holds: no name passes through the
driver. That takes a folder which every machine has mounted; all other stores are left to Spark's reader.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlab.session import shared_folder

LISTED = "path STRING, modificationTime TIMESTAMP, length BIGINT"
# Rows of a batch of a listing; files that make a task of their own worth while.
_ROWS, _FILES = 10_000, 256


def _lister() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What lies in the folders of a task, but for names that Spark passes over; an inner function, so workers need no module of ours."""
    rows_of_batch = _ROWS

    def seen(path: str, name: str, folder: bool, stat: Callable[[], os.stat_result]) -> list[dict]:
        if name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"):
            return []
        with suppress(FileNotFoundError):  # it went meanwhile
            return [{"path": f"file:{path}", "ms": (found := stat()).st_mtime_ns // 1_000_000, "length": found.st_size, "carpeta": folder}]
        return []

    def below(path: str) -> Iterator[dict]:
        if not os.path.isdir(path):
            yield from seen(path, os.path.basename(path), False, lambda: os.stat(path))
            return
        with os.scandir(path) as entries:
            for entry in entries:
                yield from seen(entry.path, entry.name, entry.is_dir(), entry.stat)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for path in batch["path"].to_pylist() for row in below(path.removeprefix("file:")))
        while some := list(islice(rows, rows_of_batch)):
            yield pa.RecordBatch.from_pylist(some, pa.schema([("path", pa.string()), ("ms", pa.int64()), ("length", pa.int64()), ("carpeta", pa.bool_())]))

    return entries


def tasks_of(spark: SparkSession) -> int:
    """How many tasks files are dealt to."""
    return 8 * spark.sparkContext.defaultParallelism


def _roots(spark: SparkSession, path: str) -> list[str]:
    """What a path (or pattern) names; [] where it names nothing or lies in a store that only Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(place) if system.getScheme() == "file" else None
    return [status.getPath().toUri().getPath() for status in found or []]


def list_files(spark: SparkSession, path: str) -> DataFrame | None:
    """`LISTED` of all files below a path, as a stored table; None where only Spark's reader finds or misses them."""
    roots = _roots(spark, path)
    if not roots:
        return None
    kept, rounds = f"{shared_folder(spark).rstrip('/')}/listing-{uuid.uuid4().hex}", []
    folders = spark.createDataFrame([(root,) for root in roots], "path STRING").coalesce(1)
    while folders is not None:
        rounds.append(f"{kept}/{len(rounds)}")
        found = folders.mapInArrow(_lister(), "path STRING, ms BIGINT, length BIGINT, carpeta BOOLEAN")
        found.select("path", F.timestamp_millis("ms").alias("modificationTime"), "length", "carpeta").write.parquet(rounds[-1])
        more = spark.read.parquet(rounds[-1]).filter("carpeta").select("path")
        count = more.count()
        folders = more.repartition(min(count, tasks_of(spark))) if count else None
    return spark.read.parquet(*rounds).filter("NOT carpeta").drop("carpeta")


def dealt(files: DataFrame, count: int) -> DataFrame:
    """Rows of a listing dealt to as many tasks as some `count` files are worth."""
    return files.repartition(min(tasks_of(files.sparkSession), count // _FILES + 1))


def content_of(path: Column) -> Column:
    """The bytes of a listed file. A hundred rows at a time are sent to be read, so a batch of large files stays small."""
    def read(name: str) -> bytes:
        with open(name.removeprefix("file:"), "rb") as file:
            return file.read()

    # Not deterministic, so that no filter on what is made of the bytes reads a file once more.
    return F.udf(read, "binary", useArrow=False).asNondeterministic()(path)
