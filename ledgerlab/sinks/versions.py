"""Tables of immutable versions below a folder, behind one pointer that is replaced in one step.

The pointer names every version that can be read, oldest first, with the folder of its rows and who wrote it. A version's
rows are written completely before the pointer names them, so a reader sees the old table or the new one; a writer that is
lost halfway leaves a folder that nothing names. A writer that repeats itself (the same `origin` as the newest version's)
replaces what it wrote, so a replayed batch adds no version. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlab.errors import InvalidSpec

POINTER = "_versiones"


def _place(spark: SparkSession, path: str):
    """A path and the file system that holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None where there is none."""
    place, system = _place(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file aside and move it over the old one."""
    aside, system = _place(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    kinds = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    target, _ = _place(spark, path)
    context.rename(system.makeQualified(aside), system.makeQualified(target), options)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing names any more."""
    place, system = _place(spark, path)
    system.delete(place, True)


def versions(spark: SparkSession, folder: str) -> list[dict]:
    """{version, path, origin} of what can be read, oldest first."""
    text = read_text(spark, f"{folder.rstrip('/')}/{POINTER}")
    return json.loads(text) if text else []


def commit(df: DataFrame, folder: str, origin: str | None = None, keep: int | None = None) -> int:
    """Write `df` as the next version and point at it; returns its number.

    `origin` says who writes: when the newest version has the same one, it is replaced. With `keep`, only that many
    versions stay readable; the rows of older ones are removed.
    """
    spark, base = df.sparkSession, folder.rstrip("/")
    known = versions(spark, base)
    if origin is not None and known and known[-1]["origin"] == origin:
        known = known[:-1]
    number = known[-1]["version"] + 1 if known else 1
    path = f"{base}/v{number:08d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(path)
    named = [*known, {"version": number, "path": path, "origin": origin}]
    gone = named[:-keep] if keep else []
    replace_text(spark, f"{base}/{POINTER}", json.dumps(named[len(gone):]))
    for entry in gone:
        drop(spark, entry["path"])
    return number


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """Rows of a version, of the newest by default; negative numbers count from the newest (-1 is the one before it).

    None when nothing has been committed yet.
    """
    known = versions(spark, folder)
    if version is None or version < 0:
        at = len(known) - 1 + (version or 0)
        found = known[at] if 0 <= at < len(known) else None
        if found is None and version is None:
            return None
    else:
        found = next((entry for entry in known if entry["version"] == version), None)
    if found is None:
        raise InvalidSpec(f"no version {version} below {folder}")
    return spark.read.parquet(found["path"])


def base_of(spark: SparkSession, folder: str, origin: str) -> DataFrame | None:
    """What a writer builds on: the newest version that it has not written itself."""
    known = [entry for entry in versions(spark, folder) if entry["origin"] != origin]
    return spark.read.parquet(known[-1]["path"]) if known else None
