"""Receipts: both ledgers summed by (normalised series, day) and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlab.operators.ledger import MONEY, RECEIPT, TOL_AMOUNT, TOL_IGV, clean_upper, is_receipt

# Summed fields with the ledger column and the tolerance of each.
FIELDS = {
    "base": ("base_imponible", TOL_AMOUNT),
    "igv": ("igv", TOL_IGV),
    "importe": ("importe_total", TOL_AMOUNT),
    "exonerado": ("mto_exonerado", TOL_AMOUNT),
    "inafecto": ("mto_inafecto", TOL_AMOUNT),
}
# States, and the number shown for a day's receipts.
ONLY_COMPANY, ONLY_AUTHORITY, MATCHES, DIFFERS = "solo_empresa", "solo_sunat", "cuadra", "difiere"
DAY_NUMBER = "Boletas del día"


def receipt_series(column: Column) -> Column:
    """'0127' and 'B127' are one series: all-digit names become 'B' and at least three digits."""
    text = clean_upper(column)
    bare = F.ltrim(text, F.lit("0"))
    digits = F.when(F.length(bare) < 3, F.lpad(bare, 3, "0")).otherwise(bare)
    return F.when(text.rlike("^[0-9]+$"), F.concat(F.lit("B"), digits)).otherwise(text)


def _side(ledger: DataFrame, company: bool) -> DataFrame:
    amounts = []
    for name, (column, _) in FIELDS.items():
        value, zero = F.col(column), F.lit(0).cast(MONEY)
        amounts.append((value if company else zero).alias(f"{name}_empresa"))
        amounts.append((zero if company else value).alias(f"{name}_sunat"))
    return ledger.filter(is_receipt()).select(
        "periodo", receipt_series(F.col("serie")).alias("serie"), F.col("fecha_emision").alias("fecha"),
        F.lit(int(company)).alias("en_empresa"), F.lit(int(not company)).alias("en_sunat"), *amounts,
    )


def receipts_by_day(company: DataFrame, authority: DataFrame) -> DataFrame:
    """One row per (period, series, day) of either conformed ledger.

    The two sides are stacked and summed in one aggregation: one shuffle of per-task partial
    sums, so a series with most of the rows costs no more than any other, and no join follows.
    """
    sides = [f"{n}_{s}" for n in FIELDS for s in ("empresa", "sunat")]
    sums = _side(company, True).unionByName(_side(authority, False)).groupBy("periodo", "serie", "fecha").agg(
        F.max("en_empresa").alias("en_empresa"), F.max("en_sunat").alias("en_sunat"),
        *[F.sum(n).cast(MONEY).alias(n) for n in sides],
    )
    differing = F.array_compact(F.array(*[
        F.when(F.abs(F.col(f"{n}_empresa") - F.col(f"{n}_sunat")) > F.lit(tol).cast(MONEY), F.lit(n))
        for n, (_, tol) in FIELDS.items()
    ]))
    both = (F.col("en_empresa") == 1) & (F.col("en_sunat") == 1)
    out = sums.withColumn("campos_diferentes", F.when(both, differing).otherwise(F.array().cast("array<string>")))
    state = (
        F.when(F.col("en_sunat") == 0, ONLY_COMPANY)
        .when(F.col("en_empresa") == 0, ONLY_AUTHORITY)
        .when(F.size("campos_diferentes") > 0, DIFFERS)
        .otherwise(MATCHES)
    )
    difference = F.col("igv_empresa") - F.col("igv_sunat")
    red = (
        F.when(F.col("estado") == MATCHES, False)
        .when(F.col("estado") == DIFFERS, F.array_contains("campos_diferentes", "igv"))
        .otherwise(F.abs(difference) > F.lit(TOL_IGV).cast(MONEY))
    )
    return out.withColumn("estado", state).select(
        "periodo", "serie", "fecha", *sides, "estado", "campos_diferentes",
        red.alias("es_alerta_roja"), difference.cast(MONEY).alias("diferencia_igv"),
    )


def receipts_as_scenarios(receipts: DataFrame) -> DataFrame:
    """Receipt days as rows of the scenario table (see `reconcile.matched`)."""
    letter = (
        F.when(F.col("estado") == ONLY_COMPANY, "A").when(F.col("estado") == ONLY_AUTHORITY, "B")
        .when(F.col("estado") == DIFFERS, "C").otherwise("D")
    )
    details = F.array_compact(F.array(*[
        F.when(F.array_contains("campos_diferentes", name), F.struct(
            F.lit(column).alias("campo"),
            F.col(f"{name}_empresa").cast("string").alias("valor_empresa"),
            F.col(f"{name}_sunat").cast("string").alias("valor_sunat"),
            (F.col(f"{name}_empresa") - F.col(f"{name}_sunat")).cast("decimal(19,3)").alias("diferencia"),
        )) for name, (column, _) in FIELDS.items()
    ]))
    has_company, has_authority = F.col("estado") != ONLY_AUTHORITY, F.col("estado") != ONLY_COMPANY
    amounts = []
    for name, (column, _) in FIELDS.items():
        amounts.append(F.when(has_company, F.col(f"{name}_empresa")).alias(f"{column}_empresa"))
        amounts.append(F.when(has_authority, F.col(f"{name}_sunat")).alias(f"{column}_sunat"))
    return receipts.select(
        letter.alias("escenario"), "periodo", F.lit(RECEIPT).alias("tipo_cdp"), "serie",
        F.lit(DAY_NUMBER).alias("numero"),
        F.when(has_company, F.col("fecha")).alias("fecha_emision_empresa"),
        F.when(has_authority, F.col("fecha")).alias("fecha_emision_sunat"),
        *amounts, details.alias("diferencias"), "es_alerta_roja",
    )
