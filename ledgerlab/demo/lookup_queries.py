"""Validity, tickets, provenance and text notations derived from the tables, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlab.demo import ledgers as D
from ledgerlab.demo.ledger_queries import shown
from ledgerlab.functions import normalize as N
from ledgerlab.operators import reconcile as R
from ledgerlab.operators import records as C

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        SQL[function.__name__] = sql
        return function
    return add


_AUTHORITY = D.as_sql(D.SALES_AUTHORITY, "lineitem")


@query(f"""WITH a AS ({_AUTHORITY}), v AS (SELECT tipo_cdp, serie, numero, max(length(numero) % 7) AS codigo FROM a WHERE serie <> 'B003' GROUP BY ALL)
SELECT a.tipo_cdp, a.serie, a.numero, CASE v.codigo WHEN 0 THEN 'NO EXISTE' WHEN 1 THEN 'ACEPTADO' WHEN 2 THEN 'ANULADO' WHEN 3 THEN 'AUTORIZADO'
WHEN 4 THEN 'NO AUTORIZADO' ELSE coalesce(cast(v.codigo as varchar), '') END AS validez FROM a LEFT JOIN v USING (tipo_cdp, serie, numero)""")
def attach_validity(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.derive(spark, sf, D.SALES_AUTHORITY).select("tipo_cdp", "serie", "numero")
    codes = rows.filter("serie <> 'B003'").withColumn("estado_cp", (F.length("numero") % 7).cast("string"))
    return R.attach_validity(rows, codes)


@query("""SELECT strftime(o_orderdate, '%Y%m') AS periodo, max_by('T' || o_custkey, o_orderkey) AS ticket FROM orders
WHERE o_orderdate > timestamp '1998-01-01' - INTERVAL 17520 HOUR GROUP BY 1""")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    tickets = D.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyyMM").alias("periodo"), F.concat(F.lit("T"), "o_custkey").alias("ticket"),
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("creado"))
    return R.latest_per_key(tickets, F.lit("1998-01-01").cast("timestamp"), hours=17520)


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("message_id"), F.concat("o_orderpriority", F.lit(".pdf")).alias("original_name"),
        (F.col("o_orderkey") % 3).alias("company_id"))


def _mails(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("job_id"), F.col("c_name").alias("sender"),
        F.col("c_mktsegment").alias("subject"), F.col("c_nationkey").alias("received_at"))


def _records(files: DataFrame) -> DataFrame:
    return files.select(F.col("id").alias("attachment_id"), "company_id")


@query("""SELECT o_orderkey AS attachment_id, o_orderkey % 3 AS company_id, o_orderpriority || '.pdf' AS nombre_adjunto, c_name AS remitente, c_mktsegment AS asunto,
c_nationkey AS recibido_en FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def origin_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return C.origin_lookup(_records(_files(spark, sf)), _files(spark, sf).drop("company_id"), _mails(spark, sf))


@query("""SELECT o_orderkey AS id, o_custkey AS message_id, o_orderpriority || '.pdf' AS original_name FROM orders
JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND c_custkey % 4 = 1""")
def pending_extraction(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    done = _records(files.filter(~F.col("original_name").isin("1-URGENT.pdf", "2-HIGH.pdf")))
    return C.pending_extraction(files, _mails(spark, sf), done, job_id=1).select("id", "message_id", "original_name")


@query("""SELECT l_orderkey, l_linenumber, precio AS ingles, precio AS europeo, precio AS autoridad, precio AS libro, 0.0 AS basura, dia AS fecha, dia AS fecha_libro,
['03', '01', '07', '08', '99'][1 + l_orderkey % 5] AS tipo
FROM (SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS precio, cast(cast(l_shipdate as date) as varchar) AS dia FROM lineitem)""")
def ledger_notations(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts in four notations, dates in two, names of voucher types: all read back."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    english = F.format_number(price, 2)
    names = F.array(*map(F.lit, ["boleta de venta", "Factura Electrónica", "NOTA DE CRÉDITO ELECTRÓNICA", "nota de debito", "99"]))
    day = F.col("l_shipdate").cast("date")
    return shown(D.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", N.parse_amount(english).alias("ingles"), N.parse_amount(F.translate(english, ",.", ".,")).alias("europeo"),
        N.dot_amount(F.translate(price.cast("string"), ".", ",")).alias("autoridad"), N.plain_amount(english).alias("libro"),
        N.parse_amount(F.lit("n/a")).alias("basura"), N.parse_date(F.date_format(day, "d/M/yyyy")).alias("fecha"),
        N.book_date(F.date_format(day, "dd/MM/yyyy")).alias("fecha_libro"),
        N.normalize_doc_type(F.get(names, (F.col("l_orderkey") % 5).cast("int"))).alias("tipo")))
