"""Voucher lists: canonical rows, enrichment by XML, reports and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlab.functions.text import strip

# Codes with their names, and words for a code, tried in this order.
CODES = {1: "Factura", 2: "Recibo por Honorarios", 3: "Boleta de Venta", 7: "Factura - Nota de Credito",
         8: "Factura - Nota de Debito", 20: "Comprobante de Retencion", 40: "Liquidacion de Compra"}
WORDS = {
    "factura": 1, "recibo por honorarios": 2, "recibo": 2, "boleta": 3, "boleta de venta": 3, "nota de credito": 7,
    "nota de crédito": 7, "nota de debito": 8, "nota de débito": 8, "comprobante de retencion": 20,
    "comprobante de retención": 20, "retencion": 20, "liquidacion de compra": 40, "liquidación de compra": 40,
}
XML_TYPES = {"01": "Factura", "03": "Boleta", "07": "Nota de crédito", "08": "Nota de débito", "09": "Guía de remisión"}
NO_XML = "Sin XML — descripción no disponible"
ENRICHED = ["emisor", "ruc", "tipo", "monto", "moneda", "fecha", "concepto", "descripcion"]
RETRIED = ["Parcial", "Error"]


def voucher_code(value: Column) -> Column:
    """Number or words of a voucher type -> its code, NULL when unknown."""
    text = strip(value)
    lowered = F.lower(text)
    words = F.coalesce(*[F.when(lowered.contains(w), c) for w, c in WORDS.items()])
    number = text.try_cast("int")
    return F.when(text.rlike("^[0-9]+$"), F.when(number.isin(list(CODES)), number)).otherwise(words)


def read_voucher_list(rows: DataFrame, ruc: str, kind: str, series: str, number: str) -> DataFrame:
    """Canonical (id, ruc, serie, numero, tipo_num, tipo_texto); incomplete rows are dropped."""
    only_digits = r"[^0-9]"
    digits = F.nullif(F.regexp_replace(F.col(number).cast("string"), only_digits, ""), F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    out = rows.select(
        F.regexp_replace(F.coalesce(F.col(ruc).cast("string"), F.lit("")), only_digits, "").alias("ruc"),
        F.upper(strip(F.col(series).cast("string"))).alias("serie"), digits.try_cast("decimal(38,0)").alias("numero"),
        voucher_code(F.col(kind).cast("string")).alias("tipo_num"))
    out = out.filter("serie <> '' and numero is not null and tipo_num is not null")
    return out.select(F.concat_ws("-", "serie", F.col("numero").cast("string")).alias("id"), "*", F.element_at(names, F.col("tipo_num")).alias("tipo_texto"))


def enrich_results(results: DataFrame, invoices: DataFrame) -> DataFrame:
    """Results with the non-empty values of their XML; without one, a default description.

    Invoices are reduced to one per id before the join (the last file name wins).
    """
    key = F.upper(F.trim("id"))
    have = [c for c in ENRICHED if c in invoices.columns]
    order = F.col("archivo") if "archivo" in invoices.columns else F.struct(*have)
    parsed = invoices.groupBy(key.alias("_k")).agg(F.max_by(F.struct(*have), order).alias("x"))
    joined = results.withColumn("_k", key).join(parsed, "_k", "left")
    out = [F.col(c) for c in results.columns if c not in ENRICHED]
    for name in ENRICHED:
        old = F.col(name) if name in results.columns else F.lit(None).cast("string")
        new = F.nullif(F.col(f"x.{name}"), F.lit("")) if name in have else F.lit(None).cast("string")
        value = F.coalesce(new, old)
        if name == "descripcion":
            value = F.coalesce(value, F.when(F.col("x").isNull(), NO_XML))
        out.append(value.alias(name))
    return joined.select(out)


def voucher_report(results: DataFrame) -> DataFrame:
    """One labelled row per voucher."""
    names = F.create_map(*[F.lit(x) for pair in XML_TYPES.items() for x in pair])
    money = F.trim(F.concat_ws(" ", F.coalesce("moneda", F.lit("")), F.coalesce("monto", F.lit(""))))

    def yes(column: str) -> Column:
        return F.when(F.coalesce(F.col(column), F.lit(False)), "Sí").otherwise("No")

    columns = {
        "Comprobante": F.col("id"), "Tipo": F.coalesce(F.try_element_at(names, F.col("tipo")), "tipo", F.lit("")), "Emisor": F.col("emisor"),
        "RUC": F.col("ruc"), "PDF": yes("pdf"), "XML": yes("xml"), "Estado": F.col("estado"), "Monto": money, "Fecha": F.col("fecha"),
        "Descripción": F.col("descripcion")}
    return results.select([F.coalesce(c, F.lit("")).alias(n) for n, c in columns.items()])


def retry_missing(results: DataFrame) -> DataFrame:
    """Partial or failed results with what is still asked for and absent."""
    def lost(kind: str) -> Column:
        return F.coalesce(F.col(f"pide_{kind}"), F.lit(True)) & ~F.coalesce(F.col(kind), F.lit(True))
    return results.filter(F.col("estado").isin(RETRIED)).select("id", lost("pdf").alias("descargar_pdf"), lost("xml").alias("descargar_xml"))
