"""Series x day matrices and report columns over the receipts comparison and the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlab.operators.ledger import MONEY, TOL_IGV
from ledgerlab.operators.receipts import DIFFERS, MATCHES, ONLY_AUTHORITY, ONLY_COMPANY

# State labels of the receipts sheet.
STATE_LABELS = {
    ONLY_COMPANY: "Solo en tu archivo", ONLY_AUTHORITY: "Solo en SUNAT", MATCHES: "Cuadra OK", DIFFERS: "Diferencia",
}


def series_totals(receipts: DataFrame) -> DataFrame:
    """IGV per series of both sides, their difference and its share of the company's IGV."""
    sums = receipts.groupBy("serie").agg(
        F.sum("igv_empresa").cast(MONEY).alias("igv_empresa"), F.sum("igv_sunat").cast(MONEY).alias("igv_sunat"))
    difference = (F.col("igv_empresa") - F.col("igv_sunat")).cast(MONEY)
    share = F.coalesce(F.round(F.abs(difference).cast("double") / F.nullif(F.col("igv_empresa").cast("double"), F.lit(0.0)), 4), F.lit(0.0))
    return sums.select("*", difference.alias("diferencia"), F.abs(difference).alias("diferencia_abs"), share.alias("porcentaje"))


def series_ranking(receipts: DataFrame, limit: int | None = None) -> DataFrame:
    """Series by absolute difference; `limit` for a top list."""
    ranked = series_totals(receipts).orderBy(F.desc("diferencia_abs"), "serie")
    return ranked.limit(limit) if limit else ranked


def report_days(receipts: DataFrame) -> list:
    """Days of the report in order: the columns of a matrix. `series_day_pairs` is the form without columns."""
    return [r.fecha for r in receipts.select("fecha").filter("fecha is not null").distinct().orderBy("fecha").collect()]


def series_day_matrix(receipts: DataFrame, side: str, days: list | None = None) -> DataFrame:
    """One row per series and one column per day (ISO), zero-filled, with a row total."""
    value = {"empresa": F.col("igv_empresa"), "sunat": F.col("igv_sunat"), "diferencia": F.col("diferencia_igv")}[side]
    days = report_days(receipts) if days is None else days
    zero = F.lit(0).cast(MONEY)
    cells = [F.coalesce(F.sum(F.when(F.col("fecha") == F.lit(d), value)), zero).cast(MONEY).alias(d.isoformat()) for d in days]
    return receipts.groupBy("serie").agg(*cells, F.coalesce(F.sum(value), zero).cast(MONEY).alias("Total")).orderBy("serie")


def difference_matrix(receipts: DataFrame, days: list | None = None) -> DataFrame:
    """Difference per series and day, only series with a day beyond tolerance, worst series first."""
    days = report_days(receipts) if days is None else days
    matrix = series_day_matrix(receipts, "diferencia", days)
    cells = F.array(*[F.abs(F.col(f"`{d.isoformat()}`")) for d in days])
    worst = F.aggregate(cells, F.lit(0).cast("decimal(28,2)"), lambda acc, x: (acc + x).cast("decimal(28,2)"))
    return matrix.filter(F.exists(cells, lambda x: x > F.lit(TOL_IGV).cast(MONEY))).orderBy(worst.desc(), "serie")


def series_day_pairs(receipts: DataFrame) -> DataFrame:
    """The matrices in long form (serie, fecha, both sides, difference): any number of days."""
    out = receipts.groupBy("serie", "fecha").agg(
        F.sum("igv_empresa").cast(MONEY).alias("igv_empresa"), F.sum("igv_sunat").cast(MONEY).alias("igv_sunat"))
    return out.withColumn("diferencia", (F.col("igv_empresa") - F.col("igv_sunat")).cast(MONEY))


def day_detail(receipts: DataFrame, series: str) -> DataFrame:
    """Days of one series."""
    return series_day_pairs(receipts.filter(F.col("serie") == series)).orderBy("fecha")


def receipts_sheet(receipts: DataFrame) -> DataFrame:
    """Series/day list with the state's label and the IGV difference."""
    named = F.create_map(*[F.lit(x) for pair in STATE_LABELS.items() for x in pair])
    return receipts.select(
        "fecha", "serie", "igv_empresa", "igv_sunat", "diferencia_igv",
        F.element_at(named, F.col("estado")).alias("estado")).orderBy("fecha", "serie")


def duplicates_sheet(duplicates: DataFrame) -> DataFrame:
    """Duplicate lines with the previous periods as text."""
    previous = (F.array_join("periodos_previos", ", ") if "periodos_previos" in duplicates.columns else F.lit(""))
    return duplicates.select(
        "periodo", "cuo", F.date_format("fecha_emi", "dd/MM/yyyy").alias("fecha_emision"), "tipo", "serie", "numero",
        "razon_social", "base_imponible", "igv", "total", "moneda", previous.alias("periodos_previos"))


def cuts_sheet(cuts: DataFrame) -> DataFrame:
    """Numbers missing between two periods, with the vouchers on either side of the cut as text."""
    voucher = lambda n: F.concat_ws("-", F.col("serie"), F.col(n).cast("string"))
    return cuts.select("tipo", "serie", voucher("ultimo_anterior").alias("ultimo_anterior"),
                       voucher("primero_actual").alias("primero_actual"), "faltantes", "cantidad").orderBy("tipo", "serie")


def month_of(column: Column) -> Column:
    """'2026-05-14' -> '202605', NULL when the text does not start like an ISO date."""
    return F.when(column.rlike("^[0-9]{4}.[0-9]{2}"), F.concat(F.substring(column, 1, 4), F.substring(column, 6, 2)))


def period_text(column: Column) -> Column:
    """'202605' -> '2026-05'."""
    return F.when(column.rlike("^[0-9]{6}$"), F.concat(F.substring(column, 1, 4), F.lit("-"), F.substring(column, 5, 2))).otherwise(column)
