"""Numbering gaps, duplicates within and across periods, and cuts between periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlab.operators.ledger import clean_upper, voucher_number, whole_number

# Types checked for gaps, and when a numbering counts as irregular.
GAP_TYPES = ["03", "07"]
IRREGULAR_GAP, MAX_LISTED = 10_000, 30
NOT_CROSS_CHECKED = ["03"]
LISTED_DAYS = 6

# Numbers per bucket, and buckets per block: no window group holds more than this many rows, for
# numbers of up to 18 digits.
BUCKET, BLOCK = 1_000_000, 1_000_000
_INT = "decimal(38,0)"
_SERIES = ["tipo", "serie"]
DUP_KEY = ["tipo", "serie", "clave_numero"]


def _span(low: Column, high: Column) -> Column:
    low_text, high_text = low.cast("string"), high.cast("string")
    return F.when(low == high, low_text).otherwise(F.concat(low_text, F.lit("-"), high_text))


def _intervals(ledger: DataFrame) -> DataFrame:
    start = whole_number(F.col("numero"))
    end = whole_number(F.col("numero_final")) if "numero_final" in ledger.columns else F.lit(None).cast(_INT)
    rows = ledger.select(
        F.trim("tipo_cdp").alias("tipo"), clean_upper(F.col("serie")).alias("serie"), start.alias("ini"), end.alias("f"))
    rows = rows.filter(F.col("tipo").isin(GAP_TYPES) & F.col("ini").isNotNull())
    # Equal first numbers collapse before anything is sorted, so repeats of a hot series cost nothing.
    return rows.groupBy(*_SERIES, "ini").agg(
        F.max(F.greatest("ini", F.coalesce("f", "ini"))).alias("fin"), F.count(F.lit(1)).alias("n"))


def _carried_ends(ranges: DataFrame) -> DataFrame:
    """Per bucket, the highest end of all earlier buckets of its series (NULL for the first).

    Running maxima go over the buckets of a block and over the blocks of a series.
    """
    heads = ranges.groupBy(*_SERIES, "bloque", "cubo").agg(F.max("fin").alias("max_fin"))
    blocks = heads.groupBy(*_SERIES, "bloque").agg(F.max("max_fin").alias("max_fin"))
    past = (Window.unboundedPreceding, -1)
    over_blocks = Window.partitionBy(_SERIES).orderBy("bloque").rowsBetween(*past)
    over_cubes = Window.partitionBy(*_SERIES, "bloque").orderBy("cubo").rowsBetween(*past)
    before = blocks.select(*_SERIES, "bloque", F.max("max_fin").over(over_blocks).alias("antes"))
    return heads.withColumn("en_bloque", F.max("max_fin").over(over_cubes)).join(before, [*_SERIES, "bloque"]).select(
        *_SERIES, "cubo", F.greatest("en_bloque", "antes").alias("previo"))


def _measured(ledger: DataFrame, bucket: int, block: int) -> DataFrame:
    """Declared ranges with the highest end before them (`hasta_ahora`) and the width of the gap in between (`ancho`)."""
    ranges = _intervals(ledger).withColumn("cubo", F.floor(F.col("ini") / F.lit(bucket)))
    ranges = ranges.withColumn("bloque", F.floor(F.col("cubo") / F.lit(block)))
    cube = [*_SERIES, "cubo"]
    before = Window.partitionBy(cube).orderBy("ini").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.join(_carried_ends(ranges), cube)
    seen = F.greatest(F.max("fin").over(before), F.col("previo"))
    return carried.withColumn("hasta_ahora", seen).withColumn(
        "ancho", F.when(F.col("ini") > F.col("hasta_ahora") + 1, F.col("ini") - 1 - F.col("hasta_ahora")).otherwise(0).cast(_INT))


def gap_rows(ledger: DataFrame, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """Every gap of a numbering as a row (tipo, serie, desde, hasta, cantidad), however many there are."""
    return _measured(ledger, bucket, block).filter("ancho > 0").select(
        *_SERIES, (F.col("hasta_ahora") + 1).cast(_INT).alias("desde"), (F.col("ini") - 1).cast(_INT).alias("hasta"),
        F.col("ancho").alias("cantidad"))


def number_gaps(ledger: DataFrame, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """Missing numbers per (type, series) between declared ranges, as compact text and a count.

    A series is cut into number buckets, sorted in parallel; the highest end of earlier buckets is
    carried into each, so one series may hold most of the rows. Only the first gaps a listed series
    can show are kept per bucket; `gap_rows` has all of them.
    """
    gaps = _measured(ledger, bucket, block)
    inside = Window.partitionBy(*_SERIES, "cubo").orderBy("ini")
    listed = F.sum(F.when(F.col("ancho") > 0, 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    gap = F.struct((F.col("hasta_ahora") + 1).cast(_INT).alias("a"), (F.col("ini") - 1).cast(_INT).alias("b"))
    per_cube = gaps.withColumn("orden", listed).groupBy(*_SERIES, "cubo", "bloque").agg(
        F.sum("ancho").cast(_INT).alias("total"), F.max("ancho").alias("mayor"),
        F.collect_list(F.when((F.col("ancho") > 0) & (F.col("orden") <= MAX_LISTED), gap)).alias("tramos"),
        F.min("ini").alias("min_ini"), F.max("fin").alias("max_fin"), F.sum("n").alias("n"))
    # Buckets of a block after its first 30 missing numbers cannot belong to a listed series: drop
    # their text.
    earlier = Window.partitionBy(*_SERIES, "bloque").orderBy("cubo").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum("total").over(earlier), F.lit(0))
    per_cube = per_cube.withColumn("tramos", F.when(so_far <= MAX_LISTED, F.col("tramos")))
    out = per_cube.groupBy(_SERIES).agg(
        F.sum("total").cast(_INT).alias("cantidad"), F.max("mayor").alias("mayor"),
        F.flatten(F.collect_list("tramos")).alias("tramos"),
        F.min("min_ini").alias("n_min"), F.max("max_fin").alias("n_max"), F.sum("n").alias("registros"))
    irregular = (F.col("mayor") > IRREGULAR_GAP) | (F.col("cantidad") > MAX_LISTED)
    warning = F.concat(
        F.lit("numeración irregular (del "), F.format_number("n_min", 0), F.lit(" al "), F.format_number("n_max", 0),
        F.lit("; "), F.col("registros").cast("string"), F.lit(" registros) — revisar manualmente"))
    spans = F.array_join(F.transform(F.array_sort("tramos"), lambda g: _span(g["a"], g["b"])), ", ")
    return out.filter("cantidad > 0").select(
        *_SERIES, F.when(irregular, warning).otherwise(spans).alias("faltantes"), "cantidad").orderBy(*_SERIES)


def duplicate_keys(ledger: DataFrame) -> DataFrame:
    """(type, series, number) declared more than once, most repeated first."""
    counts = ledger.groupBy(
        F.trim("tipo_cdp").alias("tipo"), clean_upper(F.col("serie")).alias("serie"),
        voucher_number(F.col("numero")).alias("numero")).agg(F.count(F.lit(1)).alias("veces"))
    return counts.filter("veces > 1").orderBy(F.desc("veces"), "tipo", "serie", "numero")


def with_dup_key(lines: DataFrame) -> DataFrame:
    """Append the key of the cross-period checks to sales lines (`tipo, serie, numero`)."""
    return lines.withColumn("clave_numero", voucher_number(F.col("numero")))


def _repeated(lines: DataFrame, by: list[str]) -> DataFrame:
    return lines.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")


def duplicate_rows_in_period(lines: DataFrame) -> DataFrame:
    """Every occurrence of a key repeated within its period.

    Keys are counted with partial sums and joined back as a left semi join, which adaptive
    execution splits when one key is hot; no window gathers a key's rows.
    """
    keyed, by = with_dup_key(lines), ["periodo", *DUP_KEY]
    hits = keyed.join(_repeated(keyed, by), by, "left_semi")
    return hits.orderBy("periodo", "tipo", "serie", whole_number(F.col("numero"))).drop("clave_numero")


def periods_per_key(previous: DataFrame) -> DataFrame:
    """For each key, the sorted periods that declare it."""
    return with_dup_key(previous).groupBy(DUP_KEY).agg(F.sort_array(F.collect_set("periodo")).alias("periodos_previos"))


def duplicates_vs_previous(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Current lines declared in an earlier period, with those periods.

    Receipts and keys already repeated within a current period are left out; each line is compared
    with the periods before its own.
    """
    keyed = with_dup_key(current).filter(~F.col("tipo").isin(NOT_CROSS_CHECKED))
    by = ["periodo", *DUP_KEY]
    single = keyed.join(_repeated(keyed, by), by, "left_anti")
    before = F.filter("periodos_previos", lambda p: p < F.col("periodo"))
    hits = single.join(periods_per_key(previous), DUP_KEY).withColumn("periodos_previos", before)
    hits = hits.filter(F.size("periodos_previos") > 0)
    return hits.orderBy("tipo", "serie", whole_number(F.col("numero"))).drop("clave_numero")


def latest_period(previous: DataFrame) -> DataFrame:
    """Lines of the most recent previous period."""
    newest = previous.agg(F.max("periodo").alias("p")).scalar()
    return previous.filter(F.col("periodo") == newest)


def series_cuts(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Numbers missing between the last number of the previous period and the first of this one."""
    checked = F.col("tipo").isin(GAP_TYPES)
    first = whole_number(F.col("numero"))
    end = F.nullif(whole_number(F.col("numero_final")), F.lit(0).cast(_INT))
    starts = current.filter(checked & first.isNotNull()).groupBy(_SERIES).agg(F.min(first).alias("primero_actual"))
    last = previous.filter(checked).select(*_SERIES, F.coalesce(end, first).alias("n")).filter("n is not null")
    ends = last.groupBy(_SERIES).agg(F.max("n").alias("ultimo_anterior"))
    low, high = (F.col("ultimo_anterior") + 1).cast(_INT), (F.col("primero_actual") - 1).cast(_INT)
    missing = (high - low + 1).cast(_INT)
    text = F.when(missing > MAX_LISTED, F.concat(
        F.lit("numeración irregular (del "), F.format_number(low, 0), F.lit(" al "), F.format_number(high, 0),
        F.lit(") — revisar manualmente"))).otherwise(_span(low, high))
    return starts.join(ends, _SERIES).filter(missing > 0).select(
        *_SERIES, "ultimo_anterior", "primero_actual", text.alias("faltantes"), missing.alias("cantidad")).orderBy(_SERIES)


def file_dates(ledger: DataFrame) -> DataFrame:
    """Distinct valid dates of a file, in order."""
    return ledger.select(F.col("fecha_emision").alias("fecha")).filter("fecha is not null").distinct().orderBy("fecha")


def coverage_text(dates: DataFrame) -> DataFrame:
    """One row describing declared days: whole month, up to six days listed, a range, or a count."""
    days = dates.select("fecha").distinct()
    stats = days.agg(F.min("fecha").alias("a"), F.max("fecha").alias("b"), F.count("fecha").alias("n"))
    shown = F.transform(F.sort_array(F.collect_list("fecha")), lambda d: F.date_format(d, "dd/MM/yyyy"))
    listed = days.orderBy("fecha").limit(LISTED_DAYS).agg(F.array_join(shown, ", ").alias("d")).scalar()
    first, last = F.date_format("a", "dd/MM/yyyy"), F.date_format("b", "dd/MM/yyyy")
    text = (
        F.when(F.col("n") == 0, F.lit("Mes completo"))
        .when(F.col("n") == 1, first)
        .when(F.datediff("b", "a") + 1 == F.col("n"), F.concat(F.lit("del "), first, F.lit(" al "), last))
        .when(F.col("n") <= LISTED_DAYS, listed)
        .otherwise(F.concat(F.col("n").cast("string"), F.lit(" días entre el "), first, F.lit(" y el "), last)))
    return stats.select(F.col("n").alias("dias"), text.alias("cobertura"))
