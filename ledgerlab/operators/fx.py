"""Exchange-rate calendar (as-of), coverage, and rate differences of sales lines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlab.errors import InvalidSpec
from ledgerlab.operators.ledger import MONEY, TYPE_LABELS

RATE = "decimal(7,3)"
# Days read before a range, months kept for a period, local currency, note types.
LEAD_IN_DAYS, MONTHS_BACK = 10, 24
LOCAL_CURRENCY = "PEN"
NOTES = ["07", "08"]


def one_per_day(quotes: DataFrame) -> DataFrame:
    """One quote per date (the highest if a date repeats)."""
    return quotes.groupBy("fecha").agg(F.max(F.struct("venta", "compra")).alias("q")).select(
        "fecha", F.col("q.compra").cast(RATE).alias("compra"), F.col("q.venta").cast(RATE).alias("venta"))


def fx_calendar(quotes: DataFrame, since: date, until: date) -> DataFrame:
    """Rate of every day in [since, until]: the quote with the largest date strictly before it.

    Each quote is repeated over the days up to the next quote, an as-of join without a range
    join. The one-partition window is over quotes, at most one per calendar day.
    """
    daily = one_per_day(quotes).filter(F.col("fecha") < F.lit(until))
    following = F.lead("fecha").over(Window.orderBy("fecha"))
    valid = daily.withColumn("hasta", F.least(F.coalesce(following, F.lit(until)), F.lit(until))).withColumn(
        "desde", F.greatest(F.date_add("fecha", 1), F.lit(since)))
    days = valid.filter("desde <= hasta").select(F.explode(F.sequence("desde", "hasta")).alias("dia"), "compra", "venta")
    return days.select(F.col("dia").alias("fecha"), "compra", "venta")


def quotes_for_range(quotes: DataFrame, since: date, until: date) -> DataFrame:
    """Quotes a calendar over [since, until] needs: ten days of lead-in cross long holidays."""
    return quotes.filter(F.col("fecha").between(F.date_sub(F.lit(since), LEAD_IN_DAYS), F.lit(until)))


def fx_missing_range(wanted: DataFrame, rates: DataFrame) -> DataFrame:
    """One row (desde, hasta, dias) over the wanted dates without a rate."""
    lost = wanted.select("fecha").distinct().join(rates.select("fecha"), "fecha", "left_anti")
    return lost.agg(F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"), F.count(F.lit(1)).alias("dias"))


def period_bounds(period: str) -> tuple[Column, Column]:
    """First day 24 months before YYYYMM and the period's last day."""
    if len(period) != 6 or not period.isdigit():
        raise InvalidSpec(f"period must be YYYYMM: {period!r}")
    first = F.to_date(F.lit(period + "01"), "yyyyMMdd")
    return F.add_months(first, -MONTHS_BACK), F.last_day(first)


def fx_for_period(rates: DataFrame, period: str) -> DataFrame:
    """Rates of the period and 24 months back."""
    return rates.filter(F.col("fecha").between(*period_bounds(period)))


def rates_between(rates: DataFrame, since: date, until: date) -> DataFrame:
    return rates.filter(F.col("fecha").between(F.lit(since), F.lit(until))).orderBy("fecha")


def rates_on(rates: DataFrame, days: DataFrame) -> DataFrame:
    """Rates of a set of dates."""
    return rates.join(days.select("fecha").distinct(), "fecha", "left_semi")


def type_label(column: Column) -> Column:
    """'01 - Factura'; the bare code when it has no label."""
    named = F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])
    text = F.concat(column, F.lit(" - "), F.coalesce(F.try_element_at(named, column), F.lit("")))
    return F.regexp_replace(text, "[ -]+$", "")


def fx_differences(lines: DataFrame, rates: DataFrame, since: date, until: date) -> DataFrame:
    """Foreign-currency sales lines whose rate is not the official sell rate of their day.

    Notes use the date of the document they modify when it is present. The rate table is cut
    to [since, until] and to one row per day; Spark decides how to join it.
    """
    official = one_per_day(rates.filter(F.col("fecha").between(F.lit(since), F.lit(until)))).select(
        F.col("fecha").alias("fecha_tc"), F.col("venta").alias("tc_sunat"))
    modified = F.when(F.trim("tipo").isin(NOTES), F.col("fecha_doc_mod"))
    currency = F.upper(F.trim("moneda"))
    foreign = lines.filter((currency != "") & (currency != LOCAL_CURRENCY) & (F.col("tc") != 0))
    dated = foreign.withColumn("doc_mod", modified).withColumn("fecha_tc", F.coalesce("doc_mod", "fecha_emi"))
    hits = dated.join(official, "fecha_tc").filter(F.col("tc") != F.col("tc_sunat"))
    effect = F.col("igv").cast(MONEY) * (F.col("tc") - F.col("tc_sunat")) / F.col("tc")
    return hits.select(
        "cuo", "periodo", "fecha_emi", F.col("doc_mod").alias("fecha_doc_mod"),
        type_label(F.trim("tipo")).alias("tipo_label"), F.concat_ws("-", F.trim("serie"), F.trim("numero")).alias("num_documento"),
        "razon_social", F.col("igv").alias("v_igv"), F.col("total").alias("v_total"),
        F.col("tc").alias("tc_ple"), "tc_sunat", F.bround(effect, 2).cast(MONEY).alias("dif_igv"))


def fx_totals(differences: DataFrame) -> DataFrame:
    """Totals row of the differences."""
    return differences.agg(
        F.count(F.lit(1)).alias("lineas"),
        *[F.coalesce(F.sum(n), F.lit(0)).cast("decimal(28,2)").alias(n) for n in ("v_igv", "v_total", "dif_igv")])


def upsert_fx(stored: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Next snapshot of the rate table keyed by date; manual days keep their rate."""
    fresh = one_per_day(new).select(
        "fecha", F.struct("compra", "venta", F.lit(source).alias("fuente"), F.current_timestamp().alias("updated_at")).alias("n"))
    return _merged(stored, fresh, F.coalesce(F.col("o.fuente") == "manual", F.lit(False)))


def edit_fx(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """Next snapshot with hand-set rates; they overwrite any source."""
    fresh = one_per_day(edits).select(
        "fecha", F.struct("compra", "venta", F.lit("manual").alias("fuente"), F.current_timestamp().alias("updated_at")).alias("n"))
    return _merged(stored, fresh, F.lit(False))


def _merged(stored: DataFrame, fresh: DataFrame, keep_old: Column) -> DataFrame:
    old = stored.select("fecha", F.struct("compra", "venta", "fuente", "updated_at").alias("o"))
    row = F.when(keep_old, F.col("o")).otherwise(F.coalesce("n", "o"))
    return old.join(fresh, "fecha", "full_outer").select("fecha", row.alias("r")).select("fecha", "r.*")
