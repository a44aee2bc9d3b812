"""A store of content hashes that grows by small batches and stays few files.

Each batch writes a delta of its new hashes. Every `MERGE_AFTER` deltas, all hashes are dealt by bucket into a new base
with one file a bucket, and the store's pointer moves to it; deltas that the base holds are read no more. A hash's
bucket follows from its first bytes, so a batch reads the buckets of its own hashes alone. What lies on disk is the base's
buckets, at most `MERGE_AFTER` deltas and what the last merge replaced, whatever the number of batches.

Rows keep the batch that brought them: a replayed batch overwrites its delta and compares itself with the other batches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlab.sinks.versions import drop, read_text, replace_text

SCHEMA = "company_id INT, sha256 STRING, lote BIGINT, nombre STRING, bucket INT"
BUCKETS, MERGE_AFTER = 64, 8
POINTER = "_actual"


def bucket_of(sha256: Column, buckets: int = BUCKETS) -> Column:
    """A hash's bucket, from its first two bytes."""
    return (F.conv(F.substring(sha256, 1, 4), 16, 10).cast("int") % buckets).alias("bucket")


def state(spark: SparkSession, store: str) -> dict:
    """{base, deltas, buckets}: the folder of the base (None before the first), the batches with deltas beside it."""
    text = read_text(spark, f"{store}/{POINTER}")
    return json.loads(text) if text else {"base": None, "deltas": []}


def known_hashes(spark: SparkSession, store: str, wanted: list[int] | None = None) -> DataFrame:
    """Hashes of the store; of some buckets only, when `wanted` is given."""
    now = state(spark, store)
    rows = spark.createDataFrame([], SCHEMA)
    if now["base"]:
        rows = rows.unionByName(spark.read.schema(SCHEMA).parquet(now["base"]))
    if now["deltas"]:
        rows = rows.unionByName(spark.read.schema(SCHEMA).parquet(*[f"{store}/delta-{lote}" for lote in now["deltas"]]))
    return rows if wanted is None else rows.filter(F.col("bucket").isin(wanted))


def buckets_of(batch: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The buckets that a batch's hashes fall in: at most as many as there are buckets."""
    return [row.bucket for row in batch.select(bucket_of(F.col("sha256"), buckets)).distinct().collect()]


def add(spark: SparkSession, store: str, fresh: DataFrame, lote: int, buckets: int = BUCKETS, merge_after: int = MERGE_AFTER) -> None:
    """Store the new (company_id, sha256, nombre) of a batch; merge the deltas when there are enough of them.

    What a merge replaces stays until the next one, for readers that have begun.
    """
    rows = fresh.select("company_id", "sha256", F.lit(lote).cast("bigint").alias("lote"), "nombre", bucket_of(F.col("sha256"), buckets))
    rows.repartition("bucket").write.mode("overwrite").parquet(f"{store}/delta-{lote}")
    now = state(spark, store)
    if lote not in now["deltas"]:
        now["deltas"].append(lote)
        replace_text(spark, f"{store}/{POINTER}", json.dumps(now))
    if len(now["deltas"]) < merge_after:
        return
    merged = known_hashes(spark, store).dropDuplicates(["company_id", "sha256"])  # a replayed batch may be in both
    base = f"{store}/base-{uuid.uuid4().hex}"
    merged.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(base)
    replaced = [*([now["base"]] if now["base"] else []), *(f"{store}/delta-{number}" for number in now["deltas"])]
    replace_text(spark, f"{store}/{POINTER}", json.dumps({"base": base, "deltas": [], "replaced": replaced}))
    for path in now.get("replaced", []):
        if path not in replaced:
            drop(spark, path)
