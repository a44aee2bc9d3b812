"""Streams over files rendered from the tables, and tables of versions, with their SQL checks.

A query renders its files in drops below the shared folder, runs the stream over them and returns what it stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import date
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlab.demo import ledgers as D
from ledgerlab.operators.fx import edit_fx
from ledgerlab.session import shared_folder
from ledgerlab.sinks import versions
from ledgerlab.sources import feeds
from ledgerlab.streaming import jobs

QUERIES, SQL = {}, {}
MAX_BYTES = 20_000


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        SQL[function.__name__] = sql
        return function
    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes one file for each run of rows with the same nombre; an inner function, so workers need no module of ours."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base)
        rows = (row for batch in batches for row in zip(batch["nombre"].to_pylist(), batch["value"].to_pylist(), strict=True))
        count = 0
        for name, lines in groupby(rows, key=itemgetter(0)):
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write("".join(f"{value or ''}\n" for _, value in lines).encode())
            count += 1
        yield pa.RecordBatch.from_pydict({"n": [count]})

    return write


def as_files(rows: DataFrame, folder: str) -> None:
    """A file of its own for each nombre, its values as lines, in one folder: paths sort as names do.

    Tasks write the files at their place: Spark's writers would make a folder for each, and move all of them in the
    driver. A task that is repeated writes the same files again.
    """
    named = rows.select(F.coalesce("nombre", F.lit("sin-nombre")).alias("nombre"), "value")
    dealt = named.repartition("nombre").sortWithinPartitions("nombre", "value")
    uri = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(folder).toUri()
    target = uri.getPath() if uri.getScheme() in (None, "file") else folder.replace("s3a://", "s3://", 1)
    dealt.mapInArrow(_writer(target), "n long").agg(F.sum("n")).collect()


# Every document as a file: a third with the wrong ending, some of no known kind, copies of one text in both drops.
_NAME = "concat('doc-', lpad(cast(doc_id as string), 10, '0'), CASE WHEN doc_id % 3 = 1 THEN '.webp' ELSE '.pdf' END)"
_BYTES = "concat(CASE WHEN doc_id % 11 = 5 THEN 'GIF89a ' ELSE '%PDF-1.4 ' END, text)"
_DROP = "CASE WHEN n_chars % 2 = 0 THEN 0 ELSE 1 END"


def files(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents").selectExpr(f"{_NAME} AS nombre", f"{_BYTES} AS value", f"{_DROP} AS entrega")


_FILES_SQL = f"SELECT *, sha256(c) AS sha256, strlen(c) AS bytes FROM (SELECT {_NAME} AS nombre, {_BYTES} || chr(10) AS c, {_DROP} AS lote FROM documents)"


@query(f"""WITH f AS ({_FILES_SQL}), v AS (SELECT *, CASE WHEN bytes < 64 THEN 'archivo_vacio_o_truncado' WHEN bytes > {MAX_BYTES} THEN 'tamano_excedido'
WHEN substr(c, 1, 5) <> '%PDF-' THEN 'tipo_no_reconocido' WHEN nombre NOT LIKE '%.pdf' THEN 'extension_no_coincide_con_contenido'
WHEN (bytes - strlen(replace(c, ' obj', ''))) / 4.0 / greatest(1, bytes // 1024) > 40 THEN 'pdf_sospechoso_de_bomba' ELSE '' END AS motivo FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY lote, nombre) AS vez FROM v WHERE motivo = '')
SELECT lote, nombre, sha256, CASE WHEN vez = 1 THEN 'guardado' ELSE 'duplicado' END AS estado, motivo FROM o
UNION ALL SELECT lote, nombre, sha256, 'rechazado', motivo FROM v WHERE motivo <> ''""")
def attachment_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The log of two drops of files; the second batch comes twice, as after a lost driver."""
    folder = _folder(spark, "attachments")
    inbox, store, rows = f"{folder}/inbox", f"{folder}/store", files(spark, sf)
    for drop in (0, 1):
        as_files(rows.filter(F.col("entrega") == drop), f"{inbox}/{drop}")
        jobs.ingest_attachments_stream(spark, inbox, store, 7, MAX_BYTES, f"{folder}/checkpoint").awaitTermination()
    again = feeds.read_attachments(spark, f"{inbox}/1")
    jobs.store_attachments(store)(jobs.checked(again, 7, MAX_BYTES), 1)
    return jobs.attachment_log(spark, store)


@query(f"""WITH f AS ({_FILES_SQL}) SELECT nombre, bytes AS length, sha256 FROM f WHERE bytes BETWEEN 200 AND 5000""")
def read_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files, those of a middling size, with the hash of their contents."""
    folder = _folder(spark, "files")
    as_files(files(spark, sf), folder)
    found = feeds.read_attachments(spark, folder, lengths=(200, 5000))
    return found.select("nombre", "length", F.sha2("content", 256).alias("sha256"))


# A daily line for every quote; odd days come again in a second drop at a higher rate, the first of a month was set by hand.
_LINES = "concat_ws('|', date_format(fecha, 'dd/MM/yyyy'), cast({0} as string), cast(venta as string), '')"
_RAISED = "cast(compra + cast(0.100 as decimal(7,3)) as decimal(7,3))"
HAND_SET = date(1996, 3, 1)


@query(f"""WITH q AS ({D.QUOTES_SQL}), hecho AS (SELECT CAST('{HAND_SET}' AS date) AS fecha),
v AS (
  SELECT 1 AS version, fecha, compra, venta, 'sunat' AS fuente FROM q
  UNION ALL SELECT 2, fecha, compra, venta, 'sunat' FROM q WHERE fecha NOT IN (SELECT fecha FROM hecho)
  UNION ALL SELECT 2, fecha, 1.000, 2.000, 'manual' FROM hecho
  UNION ALL SELECT 3, fecha, CASE WHEN day(fecha) % 2 = 1 THEN compra + 0.100 ELSE compra END, venta, 'sunat' FROM q WHERE fecha NOT IN (SELECT fecha FROM hecho)
  UNION ALL SELECT 3, fecha, 1.000, 2.000, 'manual' FROM hecho)
SELECT version, cast(fecha as varchar) AS fecha, cast(compra as double) AS compra, cast(venta as double) AS venta, fuente FROM v""")
def rate_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The rate table at its three versions: a first drop, an edit by hand, a second drop whose batch comes twice."""
    folder = _folder(spark, "rates")
    inbox, table, quotes = f"{folder}/inbox", f"{folder}/table", D.quotes(spark, sf)

    def run() -> None:
        jobs.fx_daily_stream(spark, inbox, table, f"{folder}/checkpoint").awaitTermination()

    quotes.selectExpr(f"{_LINES.format('compra')} AS value").write.text(f"{inbox}/1")
    run()
    by_hand = spark.createDataFrame([(HAND_SET, "1.000", "2.000")], "fecha date, compra string, venta string")
    by_hand = by_hand.select("fecha", F.col("compra").cast("decimal(7,3)"), F.col("venta").cast("decimal(7,3)"))
    versions.commit(edit_fx(versions.read_version(spark, table), by_hand), table, "manual-1")
    quotes.filter(F.dayofmonth("fecha") % 2 == 1).selectExpr(f"{_LINES.format(_RAISED)} AS value").write.text(f"{inbox}/2")
    run()
    jobs.upsert_rates(table)(feeds.read_fx_daily(spark, f"{inbox}/2"), 1)
    found = {1: versions.read_version(spark, table, 1), 2: versions.read_version(spark, table, -1), 3: versions.read_version(spark, table)}
    rows = reduce(DataFrame.unionByName, [rows.withColumn("version", F.lit(number)) for number, rows in found.items()])
    return rows.select("version", F.col("fecha").cast("string").alias("fecha"), F.col("compra").cast("double").alias("compra"),
                       F.col("venta").cast("double").alias("venta"), "fuente")


# A feed per month of quotes; even months list the sell rate first, Mondays hold no data.
_ABBREVIATIONS = "element_at(array('Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Set','Oct','Nov','Dic'), month(fecha))"


@query(f"""SELECT cast(make_date(2000 + year(fecha) % 100, month(fecha), day(fecha)) as varchar) AS fecha, cast(compra as double) AS compra, cast(venta as double) AS venta FROM ({D.QUOTES_SQL})
WHERE isodow(fecha) <> 1""")
def fx_quotes_json(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes read from JSON feeds, one file a month; the feed's years have two digits and are of this century."""
    folder, first = _folder(spark, "feeds"), F.col("mes") % 2 == 0
    series = [F.lit("Tipo de cambio SBS - Compra"), F.lit("Tipo de cambio SBS - Venta")]
    named = lambda pair: F.array(*[F.struct(s.alias("name")) for s in pair])
    value = lambda name: F.when(F.weekday("fecha") == 0, "n.d.").otherwise(F.col(name).cast("string"))
    pair = [value("compra"), value("venta")]
    days = D.quotes(spark, sf).withColumn("mes", F.year("fecha") * 12 + F.month("fecha"))
    day = F.struct(F.concat_ws(".", F.date_format("fecha", "dd"), F.expr(_ABBREVIATIONS), F.date_format("fecha", "yy")).alias("name"),
                   F.when(first, F.array(*reversed(pair))).otherwise(F.array(*pair)).alias("values"))
    months = days.withColumn("day", day).groupBy("mes").agg(F.array_sort(F.collect_list("day")).alias("periods"))  # 23 quotes at most
    config = F.struct(F.when(first, named(reversed(series))).otherwise(named(series)).alias("series"))
    months.select("mes", F.to_json(F.struct(config.alias("config"), "periods")).alias("value")).write.partitionBy("mes").text(folder)
    quotes = feeds.read_fx_quotes(spark, folder)
    return quotes.select(F.col("fecha").cast("string").alias("fecha"), F.col("compra").cast("double").alias("compra"),
                         F.col("venta").cast("double").alias("venta"))
