"""Readers over text files rendered from the tables, with their SQL checks.

A query writes the lines to a new folder below the shared one and reads them back.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlab.demo import ledgers as D
from ledgerlab.demo.ledger_queries import shown
from ledgerlab.session import shared_folder
from ledgerlab.sources import delimited, feeds, ledgers

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        SQL[function.__name__] = sql
        return function
    return add


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"


def _rendered(rows: DataFrame, at: dict[int, Column], width: int, heading: bool = False, compression: str = "none") -> str:
    """A folder of '|' lines with the given fields; each file begins with a heading where asked."""
    folder = _folder(rows.sparkSession)
    fields = [F.coalesce(at.get(k, F.lit("")).cast("string"), F.lit("")).alias(f"campo_{k}") for k in range(width)]
    if heading:
        rows.select(fields).write.option("sep", "|").option("header", True).option("emptyValue", "").option("compression", compression).csv(folder)
    else:
        rows.select(F.concat_ws("|", *fields).alias("value")).write.option("compression", compression).text(folder)
    return folder


def _day(name: str) -> Column:
    return F.date_format(name, "dd/MM/yyyy")


_COMPANY = D.as_sql(D.SALES_COMPANY, "lineitem")
_AUTHORITY = D.as_sql(D.SALES_AUTHORITY, "lineitem")
_PURCHASES = D.as_sql(D.PURCHASES_COMPANY, "lineitem")


@query(f"""SELECT tipo_cdp AS tipo, upper(serie) AS serie, numero, cast(fecha_emision as varchar) AS fecha_emi, cast(base_imponible as double) AS base_imponible,
cast(igv as double) AS igv, cast(importe_total as double) AS total, moneda, cast(3.75 as double) AS tc, cast(NULL as varchar) AS fecha_doc_mod FROM ({_COMPANY})""")
def ple_sales_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.derive(spark, sf, D.SALES_COMPANY)
    folder = _rendered(rows, {
        0: F.lit("20240100"), 1: F.col("line_no"), 3: _day("fecha_emision"), 5: F.col("tipo_cdp"), 6: F.col("serie"), 7: F.col("numero"),
        8: F.col("numero_final"), 11: F.concat(F.lit('"'), F.col("razon_social")), 13: F.col("base_imponible"), 15: F.col("igv"),
        24: F.col("importe_total"), 25: F.lower("moneda"), 26: F.lit("3.750"), 27: F.lit("01/01/0001")}, 36)
    return shown(ledgers.read_ple_sales(spark, folder).select(
        "tipo", "serie", "numero", "fecha_emi", "base_imponible", "igv", "total", "moneda", "tc", "fecha_doc_mod"))


@query(f"""SELECT tipo_cdp, serie, numero, numero_final, cast(fecha_emision as varchar) AS fecha_emision, cast(base_imponible as double) AS base_imponible,
cast(igv as double) AS igv, cast(mto_exonerado as double) AS mto_exonerado, cast(importe_total + mto_exonerado as double) AS importe_total, moneda
FROM ({_COMPANY})""")
def ledger_sales(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.derive(spark, sf, D.SALES_COMPANY)
    one = F.lit("1.00").cast("decimal(18,2)")
    folder = _rendered(rows, {
        3: _day("fecha_emision"), 5: F.col("tipo_cdp"), 6: F.col("serie"), 7: F.col("numero"), 8: F.col("numero_final"),
        13: F.col("base_imponible") + one, 14: -one, 15: F.col("igv"), 17: F.col("mto_exonerado"),
        24: F.col("importe_total") + F.col("mto_exonerado"), 25: F.col("moneda"), 26: F.lit("1.000")}, 30)
    positions = ["tipo_cdp", "serie", "numero", "numero_final", "fecha_emision", "base_imponible", "igv", "mto_exonerado", "importe_total", "moneda"]
    return shown(ledgers.read_ledger_sales(spark, folder).select(positions))


@query(f"""SELECT ruc_proveedor, tipo_cdp, serie, numero, cast(fecha_emision as varchar) AS fecha_emision, cast(base_imponible as double) AS base_imponible,
cast(igv as double) AS igv, cast(bi_dgng as double) AS bi_dgng, cast(igv_dgng as double) AS igv_dgng, cast(bi_dng as double) AS bi_dng,
cast(igv_dng as double) AS igv_dng, cast(importe_total as double) AS importe_total, razon_social FROM ({_PURCHASES})""")
def ledger_purchases(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.derive(spark, sf, D.PURCHASES_COMPANY)
    names = ["base_imponible", "igv", "bi_dgng", "igv_dgng", "bi_dng", "igv_dng"]
    folder = _rendered(rows, {
        3: _day("fecha_emision"), 5: F.col("tipo_cdp"), 6: F.col("serie"), 8: F.col("numero"), 11: F.col("ruc_proveedor"), 12: F.col("razon_social"),
        **{13 + k: F.format_number(name, 2) for k, name in enumerate(names)}, 19: F.col("importe_total") - sum((F.col(n) for n in names[1:]), F.col(names[0])), 23: F.col("importe_total"), 24: F.col("moneda"), 25: F.lit("3.700")}, 30)
    return shown(ledgers.read_ledger_purchases(spark, folder).select(
        "ruc_proveedor", "tipo_cdp", "serie", "numero", "fecha_emision", *names, "importe_total", "razon_social"))


@query(f"""SELECT tipo_cdp, serie, numero, cast(fecha_emision as varchar) AS fecha_emision, cast(base_imponible as double) AS base_imponible,
cast(igv as double) AS igv, cast(mto_exonerado as double) AS mto_exonerado, cast(importe_total as double) AS importe_total FROM ({_AUTHORITY})""")
def authority_proposal(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.derive(spark, sf, D.SALES_AUTHORITY)
    ten = F.lit("10.00").cast("decimal(18,2)")
    folder = _rendered(rows, {
        4: _day("fecha_emision"), 6: F.col("tipo_cdp"), 7: F.col("serie"), 8: F.col("numero"), 14: F.col("base_imponible") + ten, 15: -ten,
        16: F.translate(F.col("igv").cast("string"), ".", ","), 18: F.col("mto_exonerado"), 25: F.col("importe_total"), 27: F.lit("0")}, 30, heading=True)
    return shown(ledgers.read_authority_proposal(spark, folder, "ventas").select(
        "tipo_cdp", "serie", "numero", "fecha_emision", "base_imponible", "igv", "mto_exonerado", "importe_total"))


_MAPPED = {"fecha_emision": 0, "tipo_cdp": 1, "numero": 2, "base_imponible": 3, "igv": 4, "importe_total": 5}


@query(f"""SELECT tipo_cdp, serie, numero, cast(fecha_emision as varchar) AS fecha_emision, cast(base_imponible as double) AS base_imponible,
cast(igv as double) AS igv, cast(importe_total as double) AS importe_total FROM ({_AUTHORITY})""")
def ledger_mapped(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.derive(spark, sf, D.SALES_AUTHORITY)
    folder = _rendered(rows, {
        0: _day("fecha_emision"), 1: F.col("tipo_cdp"), 2: F.concat_ws("-", "serie", "numero"), 3: F.format_number("base_imponible", 2),
        4: F.translate(F.format_number("igv", 2), ",.", ".,"), 5: F.col("importe_total")}, 6, heading=True)
    return shown(ledgers.read_ledger_mapped(spark, folder, _MAPPED, "|", 0, True, combined=True).select(
        "tipo_cdp", "serie", "numero", "fecha_emision", "base_imponible", "igv", "importe_total"))


@query(f"""SELECT tipo_cdp, serie, numero, cast(importe_total as double) AS importe_total FROM ({_AUTHORITY})""")
def ledger_minimal(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.derive(spark, sf, D.SALES_AUTHORITY)
    folder = _rendered(rows, {1: F.col("tipo_cdp"), 2: F.concat_ws("-", "serie", "numero"), 5: F.col("importe_total")}, 6, heading=True)
    kept = {name: _MAPPED[name] for name in ("tipo_cdp", "numero", "importe_total")}
    return shown(ledgers.read_ledger_minimal(spark, folder, kept, "|", 0, True).select("tipo_cdp", "serie", "numero", "importe_total"))


@query("""SELECT cast(o_orderkey as varchar) AS _c0, cast(o_custkey as varchar) AS _c1, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS _c2,
CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 THEN o_orderpriority END AS _c3 FROM orders""")
def delimited_surplus(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with fewer and with more fields than most: the text rung of the ladder keeps every field."""
    rows, folder = D.table(spark, sf, "orders"), _folder(spark)
    longer = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority"))
    line = F.when(F.col("o_orderkey") % 7 == 0, F.concat_ws(";", "o_orderkey", "o_custkey")).otherwise(
        F.concat_ws(";", "o_orderkey", "o_custkey", "o_orderstatus", longer))
    rows.select(line.alias("value")).write.text(folder)
    return delimited.read_delimited(spark, folder, sep=";", header=False, mode="raw")


# Orders as three folders of lines under a heading: whole rows; some short, others with separators in quotes; some with a field too many.
_ORDER = """o_orderkey AS clave, {0} round(o_totalprice, 2) {1} AS precio, {0} cast(cast(o_orderdate as date) as varchar) {1} AS fecha, {0} {2} {1} AS texto"""


@query(f"""SELECT 'normal' AS escalon, 'int,double,date,string' AS tipos, {_ORDER.format("", "", "o_orderpriority")}, NULL AS sobra FROM orders
UNION ALL SELECT 'padded', 'int,double,date,string', {_ORDER.format("CASE WHEN o_orderkey % 5 <> 0 THEN", "END", "'a;b;' || o_orderpriority")}, NULL FROM orders
UNION ALL SELECT 'raw', 'string,string,string,string,string', {_ORDER.format("", "", "chr(34) || o_orderpriority || chr(34)")}, CASE WHEN o_orderkey % 7 = 0 THEN 'sobra' END FROM orders""")
def delimited_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Each folder ends on the rung it needs, with its types, and no field is lost."""
    rows = D.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS clave", "cast(o_totalprice as decimal(18,2)) AS precio", "cast(o_orderdate as date) AS fecha", "o_orderpriority AS texto")
    line = lambda text: F.concat_ws(";", "clave", "precio", "fecha", text)
    quoted = lambda *parts: F.concat(F.lit('"'), *parts, F.lit('"'))
    lines = {
        "normal": line("texto"), "padded": F.when(F.col("clave") % 5 == 0, F.col("clave").cast("string")).otherwise(line(quoted(F.lit("a;b;"), F.col("texto")))),
        "raw": F.when(F.col("clave") % 7 == 0, F.concat(line(quoted(F.col("texto"))), F.lit(";sobra"))).otherwise(line(quoted(F.col("texto"))))}
    parts = []
    for one in lines.values():
        source, dest = _folder(spark), _folder(spark)
        # One column whose name is the heading, without quotes: every file begins with the heading.
        rows.select(one.alias("clave;precio;fecha;texto")).write.option("header", True).option("sep", "\u0001").option("quote", "").csv(source)
        delimited.ingest(spark, source, dest, sep=";")
        stored = delimited.open_dataset(spark, dest)
        kinds = ",".join(field.dataType.simpleString() for field in stored.schema)
        extra = F.col("_c4") if "_c4" in stored.columns else F.lit(None).cast("string")
        parts.append(stored.select(
            F.lit(delimited.rung(spark, dest)).alias("escalon"), F.lit(kinds).alias("tipos"), F.col("clave").cast("long").alias("clave"),
            F.col("precio").cast("double").alias("precio"), F.col("fecha").cast("string").alias("fecha"), "texto", extra.alias("sobra")))
    return reduce(DataFrame.unionByName, parts)


# An invoice, a credit note or a debit note for every order, an item for each of its lines; some in Latin-1.
_ROOTS = "CASE o_orderkey % 3 WHEN 0 THEN 'Invoice' WHEN 1 THEN 'CreditNote' ELSE 'DebitNote' END"
_ITEM = "concat('Artículo ', cast(l_partkey as string), ' & Cía')"


@query(f"""WITH i AS (SELECT l_orderkey, string_agg({_ITEM}, '; ' ORDER BY l_linenumber, l_partkey) AS concepto FROM lineitem GROUP BY l_orderkey)
SELECT 'F001-' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'Comercial ' ELSE 'Peñón ' END || o_custkey AS emisor, '20' || lpad(cast(o_custkey as varchar), 9, '0') AS ruc,
CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '03' ELSE '01' END WHEN 1 THEN '07' ELSE '08' END AS tipo,
cast(cast(o_totalprice as decimal(18,2)) as varchar) AS monto, CASE WHEN o_orderkey % 5 = 0 THEN 'USD' ELSE 'PEN' END AS moneda, cast(cast(o_orderdate as date) as varchar) AS fecha, coalesce(concepto, '') AS concepto
FROM orders LEFT JOIN i ON l_orderkey = o_orderkey""")
def invoices_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Vouchers read from XML with name spaces and repeated items, all descriptions shown."""
    items = D.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"replace({_ITEM}, '&', '&amp;') AS item")
    items = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "item"))).alias("items"))  # an order's lines
    orders = D.table(spark, sf, "orders").withColumn("root", F.expr(_ROOTS)).join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    latin = F.col("o_orderkey") % 2 == 0

    def tag(name: str, *parts: Column | str) -> Column:
        return F.concat(F.lit(f"<{name}>"), *[F.lit(part) if isinstance(part, str) else part for part in parts], F.lit(f"</{name.split(' ')[0]}>"))

    line = F.concat(F.lit("cac:"), F.col("root"), F.lit("Line"))
    lines = F.transform(F.coalesce("items", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,item:string>>")), lambda i: F.concat(
        F.lit("<"), line, F.lit(">"), tag("cac:Item", F.lit("<cbc:Description>"), i["item"], F.lit("</cbc:Description>")), F.lit("</"), line, F.lit(">")))
    customer = F.col("o_custkey").cast("string")
    # One name form or the other; the registered name wins where both are there.
    issuer = F.when(F.col("o_orderkey") % 4 == 0, tag("cac:PartyName", tag("cbc:Name", "Comercial ", customer))).otherwise(F.concat(
        tag("cac:PartyName", tag("cbc:Name", "otro")), tag("cac:PartyLegalEntity", tag("cbc:RegistrationName", "Peñón ", customer))))
    kind = F.when(F.col("root") == "Invoice", tag("cbc:InvoiceTypeCode", F.when(latin, "03").otherwise("01"))).otherwise("")
    total = F.concat(F.lit('<cbc:PayableAmount currencyID="'), F.when(F.col("o_orderkey") % 5 == 0, "USD").otherwise("PEN"), F.lit('">'),
                     F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("</cbc:PayableAmount>"))
    text = F.concat(
        F.lit('<?xml version="1.0" encoding="'), F.when(latin, "ISO-8859-1").otherwise("UTF-8"), F.lit('"?><'), F.col("root"),
        F.lit(' xmlns="urn:oasis:doc" xmlns:cac="urn:oasis:cac" xmlns:cbc="urn:oasis:cbc">'), tag("cbc:ID", "F001-", F.col("o_orderkey").cast("string")),
        tag("cbc:IssueDate", F.date_format("o_orderdate", "yyyy-MM-dd")), kind,
        tag("cac:AccountingSupplierParty", tag("cac:Party", tag("cac:PartyIdentification", tag("cbc:ID", "20", F.lpad(customer, 9, "0"))), issuer)),
        tag("cac:LegalMonetaryTotal", total), F.array_join(lines, ""), F.lit("</"), F.col("root"), F.lit(">"))
    content = F.when(latin, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return feeds.parse_invoices(orders.select(content.alias("content"))).drop("descripcion")
