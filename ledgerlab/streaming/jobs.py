"""Incremental ingest of attachments and daily rates, as file-source streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlab.operators.attachments import validate_attachment
from ledgerlab.operators.fx import upsert_fx
from ledgerlab.session import path_exists
from ledgerlab.sinks import versions
from ledgerlab.sources.feeds import fx_daily_rows, named_files
from ledgerlab.sources.files import LISTED, content_of, dealt, list_files, tasks_of
from ledgerlab.streaming import hashes

BINARY = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
RATES = "fecha DATE, compra DECIMAL(7,3), venta DECIMAL(7,3), fuente STRING, updated_at TIMESTAMP"


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def checked(files: DataFrame, company_id: int, max_bytes: int) -> DataFrame:
    """Files (path, nombre, length, content) of a company with their hash and what is wrong with them."""
    return validate_attachment(files, max_bytes).withColumn("company_id", F.lit(company_id))


def store_attachments(store: str, buckets: int = hashes.BUCKETS, merge_after: int = hashes.MERGE_AFTER) -> Callable[[DataFrame, int], None]:
    """What a batch does, `(checked files, batch id)`: it may be replayed.

    The batch is written once as it comes, which reads and hashes every file once; all further steps read what was
    written, contents only where they are kept. Files whose (company, sha256) another batch stored, or a lesser path of
    the same batch has, are duplicates. Parts are named by the batch, so a replay overwrites its own.
    """
    def store_batch(batch: DataFrame, batch_id: int) -> None:
        session, part, key = batch.sparkSession, f"lote={batch_id}", ["company_id", "sha256"]
        # Spark opens some 32 small files a task; a part for each of those would cost more than its files.
        accepted = batch.withColumn("content", F.when(F.col("ok"), F.col("content"))).coalesce(tasks_of(session))
        accepted.write.mode("overwrite").parquet(f"{store}/entrada")
        entered = session.read.parquet(f"{store}/entrada")
        valid = entered.filter("ok")
        wanted = hashes.buckets_of(valid, buckets)
        known = hashes.known_hashes(session, f"{store}/huellas", wanted).filter(F.col("lote") != batch_id)
        first = valid.groupBy(key).agg(F.min(F.struct("path", "nombre")).alias("f")).join(known.select(key), key, "left_anti")
        state = F.when(~F.col("ok"), "rechazado").when(F.col("nuevo"), "guardado").otherwise("duplicado")
        log = entered.drop("content").join(first.select("f.path", F.lit(True).alias("nuevo")), "path", "left")
        log.withColumn("estado", state).drop("nuevo").write.mode("overwrite").parquet(f"{store}/registro/{part}")
        done = session.read.parquet(f"{store}/registro/{part}")
        new = done.filter("estado = 'guardado'")
        entered.join(new.select("path"), "path", "left_semi").write.mode("overwrite").parquet(f"{store}/adjuntos/{part}")
        done.filter("estado = 'rechazado'").drop("estado").write.mode("overwrite").parquet(f"{store}/rechazados/{part}")
        hashes.add(session, f"{store}/huellas", new, batch_id, buckets, merge_after)

    return store_batch


def attachment_log(spark: SparkSession, store: str) -> DataFrame:
    """(lote, nombre, sha256, estado, motivo) of every file that came in: guardado, duplicado or rechazado."""
    log = spark.read.parquet(f"{store}/registro")
    return log.select(F.col("lote").cast("bigint").alias("lote"), "nombre", "sha256", "estado", F.coalesce("motivo", F.lit("")).alias("motivo"))


def _new_files(spark: SparkSession, inbox: str, checkpoint: str) -> DataFrame | None:
    """The stream of an inbox's files, by a listing beside its checkpoint that grows by those it lacks; None where tasks cannot list the inbox.

    The stream's source is the listing, a few files of many names, so neither its log nor the driver holds a name for each.
    A run that is lost behind its listing leaves names that the next one takes up.
    """
    found, folder = list_files(spark, inbox), f"{checkpoint.rstrip('/')}/listado"
    if found is None:
        return None
    if path_exists(spark, folder):
        found = found.join(spark.read.schema(LISTED).parquet(folder).select("path"), "path", "left_anti")
    else:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    count = found.count()
    if count:  # a part without rows would make a batch of its own
        found.write.mode("append").parquet(folder)
    return dealt(spark.readStream.schema(LISTED).parquet(folder), count).withColumn("content", content_of(F.col("path")))


def ingest_attachments_stream(
    spark: SparkSession, inbox: str, store: str, company_id: int, max_bytes: int, checkpoint: str, name: Column | None = None,
) -> StreamingQuery:
    """Validate and hash new files; keep those whose (company, sha256) is not stored, log the rest.

    Hashes stay unique for ever, so they are compared with a store of hashes in each batch instead of growing
    stream state. `name` is a file's name where its path does not end in it.
    """
    files = _new_files(spark, inbox, checkpoint)
    if files is None:
        files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(inbox)
        # A stream lists a batch's files again, under its session's settings while it runs: by default with a task for each.
        spark.conf.set(LISTING, min(int(spark.conf.get(LISTING)), tasks_of(spark)))
    return (checked(named_files(files, name), company_id, max_bytes).writeStream.foreachBatch(store_attachments(store)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def upsert_rates(table: str, source: str = "sunat") -> Callable[[DataFrame, int], None]:
    """What a batch of rates does: the table's next version; a replayed batch replaces the version it wrote."""
    def upsert(batch: DataFrame, batch_id: int) -> None:
        session, origin = batch.sparkSession, f"{source}-{batch_id}"
        current = versions.base_of(session, table, origin)
        old = session.createDataFrame([], RATES) if current is None else current
        versions.commit(upsert_fx(old, batch, source), table, origin)

    return upsert


def fx_daily_stream(spark: SparkSession, inbox: str, table: str, checkpoint: str, source: str = "sunat") -> StreamingQuery:
    """Upsert daily rate lines by date into versions of the rate table; manual days are kept."""
    rates = fx_daily_rows(spark.readStream.option("recursiveFileLookup", "true").text(inbox))
    return (rates.writeStream.foreachBatch(upsert_rates(table, source)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
