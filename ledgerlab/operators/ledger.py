"""Ledger rows: schema, match keys and the fixed values of reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Voucher types that are reconciled, by book.
SALES_TYPES = ["01", "03", "07", "08"]
PURCHASE_TYPES = ["01", "07", "08", "30", "50", "54"]
RECEIPT = "03"
# Labels of voucher types.
TYPE_LABELS = {
    "01": "Factura",
    "03": "Boleta",
    "05": "Boleto de transporte aéreo",
    "07": "Nota de Crédito",
    "08": "Nota de Débito",
    "09": "Guía de Remisión",
    "04": "Liquidación de Compra",
    "14": "Recibo de servicios públicos",
    "50": "DUA - Importación",
}
# Tolerances, all "greater than".
TOL_IGV, TOL_AMOUNT, TOL_RATE, RED_IGV = "1.00", "3.00", "0.001", "0.10"

MONEY, RATE = "decimal(18,2)", "decimal(9,3)"
TEXTS = ["ruc_proveedor", "tipo_cdp", "serie", "numero", "numero_final", "moneda", "status_description", "razon_social"]
AMOUNTS = [
    "base_imponible", "igv", "importe_total", "mto_exonerado", "mto_inafecto",
    "bi_dgng", "igv_dgng", "bi_dng", "igv_dng", "valor_adq_ng",
]
IGV_FIELDS = ["igv", "igv_dgng", "igv_dng"]
KEY = ["k_ruc", "k_tipo", "k_serie", "k_numero"]


def voucher_number(column: Column) -> Column:
    """Number without leading zeros; all zeros (or nothing) give '0'."""
    bare = F.ltrim(F.trim(F.coalesce(column, F.lit(""))), F.lit("0"))
    return F.when(bare == "", "0").otherwise(bare)


def clean_upper(column: Column) -> Column:
    return F.upper(F.trim(F.coalesce(column, F.lit(""))))


def whole_number(column: Column) -> Column:
    """Digits of a text as an exact integer of up to 30 digits, NULL without digits."""
    return F.nullif(F.regexp_replace(F.coalesce(column, F.lit("")), r"[^0-9]", ""), F.lit("")).try_cast("decimal(30,0)")


def is_receipt() -> Column:
    return F.trim(F.col("tipo_cdp")) == RECEIPT


def conform(df: DataFrame) -> DataFrame:
    """Give a ledger every expected column and type; missing amounts are 0, missing texts ''.

    `line_no` (position in the file) decides which of two rows with one key is the last.
    """
    have = set(df.columns)
    columns = [
        F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) if n in have else F.lit("").alias(n) for n in TEXTS
    ]
    columns += [
        F.coalesce(F.col(n).cast(MONEY), F.lit(0).cast(MONEY)).alias(n) if n in have
        else F.lit(0).cast(MONEY).alias(n) for n in AMOUNTS
    ]
    columns.append((F.col("tipo_cambio").cast(RATE) if "tipo_cambio" in have else F.lit(None).cast(RATE)).alias("tipo_cambio"))
    columns.append(F.col("fecha_emision").cast("date").alias("fecha_emision"))
    columns.append((F.col("periodo") if "periodo" in have else F.lit("")).alias("periodo"))
    columns.append((F.col("line_no").cast("long") if "line_no" in have else F.lit(0).cast("long")).alias("line_no"))
    return df.select(columns)


def with_key(df: DataFrame) -> DataFrame:
    """Append the four-part match key."""
    return df.select(
        "*",
        F.trim("ruc_proveedor").alias("k_ruc"),
        clean_upper(F.col("tipo_cdp")).alias("k_tipo"),
        clean_upper(F.col("serie")).alias("k_serie"),
        voucher_number(F.col("numero")).alias("k_numero"),
    )


def last_per_key(df: DataFrame, keys: list[str], rank_name: str | None = None) -> DataFrame:
    """Keep the last row of every key: highest `line_no`, then date and amounts for a stable choice; its rank too, when it has a name.

    Spark limits the rank within each task before the shuffle, so a hot key sends one row per task.
    """
    order = ["line_no", "fecha_emision", "base_imponible", "igv", "importe_total", "razon_social"]
    rank = F.row_number().over(Window.partitionBy(keys).orderBy([F.desc(n) for n in order]))
    last = df.withColumn("_rank", rank).filter("_rank = 1")
    return last.withColumnRenamed("_rank", rank_name) if rank_name else last.drop("_rank")


def surplus_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row `sobrantes`: rows beyond the first of each key."""
    counts = df.groupBy(keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("sobrantes"))
