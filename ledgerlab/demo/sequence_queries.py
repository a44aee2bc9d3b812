"""Numbering, duplicate and exchange-rate queries, with their SQL checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlab.demo import ledgers as D
from ledgerlab.demo.ledger_queries import shown
from ledgerlab.operators import fx as X
from ledgerlab.operators import sequence as S
from ledgerlab.operators.reports import cuts_sheet
from ledgerlab.operators.reports import duplicates_sheet as sheet_of

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function
    return add


SINCE, UNTIL = date(1992, 1, 1), date(2003, 12, 31)
_NUM = "coalesce(nullif(ltrim(numero, '0'), ''), '0')"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return D.derive(spark, sf, D.LINES_CURRENT)


def earlier(spark: SparkSession, sf: str) -> DataFrame:
    return D.derive(spark, sf, D.LINES_PREVIOUS, "orders")


@query(f"""WITH r AS (SELECT tipo_cdp AS tipo, upper(serie) AS serie, cast(numero as bigint) AS ini, greatest(cast(numero as bigint), cast(numero_final as bigint)) AS fin
  FROM ({D.as_sql(D.GAP_LEDGER, 'orders')})),
g AS (SELECT *, max(fin) OVER (PARTITION BY tipo, serie ORDER BY ini, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antes FROM r),
t AS (SELECT tipo, serie, sum(CASE WHEN ini > antes + 1 THEN ini - 1 - antes ELSE 0 END) AS total, max(CASE WHEN ini > antes + 1 THEN ini - 1 - antes ELSE 0 END) AS mayor,
  min(ini) AS n_min, max(fin) AS n_max, count(*) AS n,
  string_agg(CASE WHEN ini > antes + 1 THEN CASE WHEN antes + 1 = ini - 1 THEN cast(ini - 1 as varchar) ELSE (antes + 1) || '-' || (ini - 1) END END, ', ' ORDER BY ini) AS texto
  FROM g GROUP BY tipo, serie)
SELECT tipo, serie, CASE WHEN mayor > 10000 OR total > 30 THEN 'numeración irregular (del ' || format('{{:,}}', n_min) || ' al ' || format('{{:,}}', n_max) || '; ' || n || ' registros) — revisar manualmente'
ELSE texto END AS faltantes, cast(total as double) AS cantidad FROM t WHERE total > 0""")
def number_gaps(spark: SparkSession, sf: str) -> DataFrame:
    # A small bucket here, so that series really cross buckets at every scale.
    return shown(S.number_gaps(D.derive(spark, sf, D.GAP_LEDGER, "orders"), bucket=1000))


@query(f"""WITH r AS (SELECT tipo_cdp AS tipo, upper(serie) AS serie, cast(numero as bigint) AS ini, greatest(cast(numero as bigint), cast(numero_final as bigint)) AS fin
  FROM ({D.as_sql(D.GAP_LEDGER, 'orders')})),
g AS (SELECT *, max(fin) OVER (PARTITION BY tipo, serie ORDER BY ini, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antes FROM r)
SELECT tipo, serie, cast(antes + 1 as double) AS desde, cast(ini - 1 as double) AS hasta, cast(ini - 1 - antes as double) AS cantidad FROM g WHERE ini > antes + 1""")
def gap_rows(spark: SparkSession, sf: str) -> DataFrame:
    return shown(S.gap_rows(D.derive(spark, sf, D.GAP_LEDGER, "orders"), bucket=1000))


@query(f"""SELECT tipo_cdp AS tipo, upper(serie) AS serie, {_NUM} AS numero, count(*) AS veces FROM ({D.as_sql(D.SALES_COMPANY, 'lineitem')})
GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return S.duplicate_keys(D.derive(spark, sf, D.SALES_COMPANY))


_LINES = f"WITH c AS (SELECT *, {_NUM} AS k FROM ({D.as_sql(D.LINES_CURRENT, 'lineitem')})), p AS (SELECT *, {_NUM} AS k FROM ({D.as_sql(D.LINES_PREVIOUS, 'orders')})) "


@query(_LINES + """SELECT cuo, tipo, serie, numero, cast(total as double) AS total FROM c
WHERE (tipo, serie, k) IN (SELECT (tipo, serie, k) FROM c GROUP BY tipo, serie, k HAVING count(*) > 1)""")
def duplicate_rows_in_period(spark: SparkSession, sf: str) -> DataFrame:
    return shown(S.duplicate_rows_in_period(lines(spark, sf)).select("cuo", "tipo", "serie", "numero", "total"))


@query(_LINES + """, u AS (SELECT tipo, serie, k FROM c GROUP BY ALL HAVING count(*) = 1),
q AS (SELECT tipo, serie, k, string_agg(DISTINCT periodo, ', ' ORDER BY periodo) AS periodos_previos FROM p GROUP BY ALL)
SELECT c.periodo, c.cuo, strftime(c.fecha_emi, '%d/%m/%Y') AS fecha_emision, c.tipo, c.serie, c.numero, cast(c.total as double) AS total, q.periodos_previos
FROM c JOIN u USING (tipo, serie, k) JOIN q USING (tipo, serie, k) WHERE c.tipo <> '03'""")
def duplicates_vs_previous(spark: SparkSession, sf: str) -> DataFrame:
    hits = sheet_of(S.duplicates_vs_previous(lines(spark, sf), earlier(spark, sf)))
    return shown(hits.select("periodo", "cuo", "fecha_emision", "tipo", "serie", "numero", "total", "periodos_previos"))


@query(_LINES + """, a AS (SELECT tipo, serie, min(cast(k as bigint)) AS primero FROM c WHERE tipo IN ('03','07') GROUP BY ALL),
b AS (SELECT tipo, serie, max(coalesce(try_cast(nullif(numero_final, '') as bigint), cast(k as bigint))) AS ultimo FROM p
  WHERE tipo IN ('03','07') AND periodo = '199203' || '00' GROUP BY ALL)
SELECT tipo, serie, cast(ultimo as double) AS ultimo_anterior, cast(primero as double) AS primero_actual,
CASE WHEN primero - 1 - ultimo > 30 THEN 'numeración irregular (del ' || format('{:,}', ultimo + 1) || ' al ' || format('{:,}', primero - 1) || ') — revisar manualmente'
WHEN primero - 1 - ultimo = 1 THEN cast(ultimo + 1 as varchar) ELSE (ultimo + 1) || '-' || (primero - 1) END AS faltantes,
cast(primero - 1 - ultimo as double) AS cantidad FROM a JOIN b USING (tipo, serie) WHERE primero > ultimo + 1""".replace(
    "periodo = '199203' || '00'", "periodo = (SELECT max(periodo) FROM p)"))
def series_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return shown(S.series_cuts(lines(spark, sf), S.latest_period(earlier(spark, sf))))


@query(f"""SELECT count(DISTINCT fecha_emision) AS dias, CASE WHEN count(DISTINCT fecha_emision) = date_diff('day', min(fecha_emision), max(fecha_emision)) + 1
THEN 'del ' || strftime(min(fecha_emision), '%d/%m/%Y') || ' al ' || strftime(max(fecha_emision), '%d/%m/%Y')
ELSE count(DISTINCT fecha_emision) || ' días entre el ' || strftime(min(fecha_emision), '%d/%m/%Y') || ' y el ' || strftime(max(fecha_emision), '%d/%m/%Y') END AS cobertura
FROM ({D.as_sql(D.SALES_AUTHORITY, 'lineitem')})""")
def coverage_text(spark: SparkSession, sf: str) -> DataFrame:
    return S.coverage_text(S.file_dates(D.derive(spark, sf, D.SALES_AUTHORITY)))


@query(f"SELECT DISTINCT cast(fecha_emision as varchar) AS fecha FROM ({D.as_sql(D.PURCHASES_COMPANY, 'lineitem')})")
def file_dates(spark: SparkSession, sf: str) -> DataFrame:
    return shown(S.file_dates(D.derive(spark, sf, D.PURCHASES_COMPANY)))


_FX = f"""WITH q AS ({D.QUOTES_SQL}), dias AS (SELECT cast(range as date) AS fecha FROM range(timestamp '{SINCE}', timestamp '{UNTIL}' + INTERVAL 1 DAY, INTERVAL 1 DAY)),
tc AS (SELECT d.fecha, q.compra, q.venta FROM dias d ASOF JOIN q ON d.fecha > q.fecha) """


@query(_FX + "SELECT cast(fecha as varchar) AS fecha, cast(compra as double) AS compra, cast(venta as double) AS venta FROM tc")
def fx_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return shown(X.fx_calendar(D.quotes(spark, sf), SINCE, UNTIL))


@query(_FX + f""", l AS (SELECT * FROM ({D.as_sql(D.LINES_CURRENT, 'lineitem')})),
j AS (SELECT l.*, CASE WHEN tipo IN ('07','08') THEN fecha_doc_mod END AS dm, tc.venta FROM l
  JOIN tc ON tc.fecha = coalesce(CASE WHEN tipo IN ('07','08') THEN fecha_doc_mod END, fecha_emi) WHERE upper(moneda) NOT IN ('', 'PEN') AND l.tc <> tc.venta),
n AS (SELECT *, cast(igv * 100 as hugeint) * cast((tc - venta) * 1000 as hugeint) AS num, cast(tc * 1000 as hugeint) AS den FROM j),
h AS (SELECT *, abs(num) // den AS c, abs(num) % den AS r FROM n)
SELECT cuo, cast(fecha_emi as varchar) AS fecha_emi, cast(dm as varchar) AS fecha_doc_mod,
CASE tipo WHEN '01' THEN '01 - Factura' WHEN '03' THEN '03 - Boleta' WHEN '07' THEN '07 - Nota de Crédito' WHEN '08' THEN '08 - Nota de Débito' ELSE '14 - Recibo de servicios públicos' END AS tipo_label,
serie || '-' || numero AS num_documento, cast(tc as double) AS tc_ple, cast(venta as double) AS tc_sunat, cast(igv as double) AS v_igv,
sign(num) * (c + CASE WHEN 2 * r > den OR (2 * r = den AND c % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS dif_igv FROM h""")
def fx_differences(spark: SparkSession, sf: str) -> DataFrame:
    rates = X.fx_calendar(D.quotes(spark, sf), SINCE, UNTIL)
    out = X.fx_differences(lines(spark, sf), rates, SINCE, UNTIL)
    return shown(out.select("cuo", "fecha_emi", "fecha_doc_mod", "tipo_label", "num_documento", "tc_ple", "tc_sunat", "v_igv", "dif_igv"))


@query("SELECT a.*, b.dif_igv FROM (" + _FX + f""", l AS (SELECT * FROM ({D.as_sql(D.LINES_CURRENT, 'lineitem')}))
SELECT count(*) AS lineas, cast(sum(igv) as double) AS v_igv, cast(sum(total) as double) AS v_total FROM l
JOIN tc ON tc.fecha = coalesce(CASE WHEN tipo IN ('07','08') THEN fecha_doc_mod END, fecha_emi) WHERE upper(moneda) NOT IN ('', 'PEN') AND l.tc <> tc.venta""" + f") a, (SELECT round(sum(dif_igv), 2) AS dif_igv FROM ({SQL['fx_differences']})) b")
def fx_totals(spark: SparkSession, sf: str) -> DataFrame:
    rates = X.fx_calendar(D.quotes(spark, sf), SINCE, UNTIL)
    return shown(X.fx_totals(X.fx_differences(lines(spark, sf), rates, SINCE, UNTIL)))


@query(f"""SELECT cast(min(f) as varchar) AS desde, cast(max(f) as varchar) AS hasta, count(*) AS dias FROM
(SELECT DISTINCT cast(l_shipdate as date) AS f FROM lineitem EXCEPT SELECT fecha FROM ({D.QUOTES_SQL}))""")
def fx_missing_range(spark: SparkSession, sf: str) -> DataFrame:
    wanted = lines(spark, sf).select(F.col("fecha_emi").alias("fecha"))
    return shown(X.fx_missing_range(wanted, D.quotes(spark, sf)))


@query(f"""SELECT cast(fecha as varchar) AS fecha, cast(venta as double) AS venta FROM ({D.QUOTES_SQL}) WHERE fecha BETWEEN date '1996-03-01' AND date '1998-03-31'""")
def fx_for_period(spark: SparkSession, sf: str) -> DataFrame:
    return shown(X.fx_for_period(D.quotes(spark, sf), "199803").select("fecha", "venta"))


@query(f"""WITH q AS ({D.QUOTES_SQL}), viejo AS (SELECT fecha, venta, CASE WHEN day(fecha) % 5 = 0 THEN 'manual' ELSE 'bcrp' END AS fuente FROM q WHERE month(fecha) <> 12)
SELECT cast(coalesce(v.fecha, q.fecha) as varchar) AS fecha, cast(CASE WHEN v.fuente = 'manual' THEN v.venta ELSE q.compra END as double) AS venta,
CASE WHEN v.fuente = 'manual' THEN 'manual' ELSE 'sunat' END AS fuente FROM q LEFT JOIN viejo v ON v.fecha = q.fecha""")
def upsert_fx(spark: SparkSession, sf: str) -> DataFrame:
    quotes = D.quotes(spark, sf)
    source = F.when(F.dayofmonth("fecha") % 5 == 0, "manual").otherwise("bcrp")
    stored = quotes.filter(F.month("fecha") != 12).select("fecha", "compra", "venta", source.alias("fuente"), F.lit(None).cast("timestamp").alias("updated_at"))
    new = quotes.select("fecha", "compra", F.col("compra").alias("venta"))
    return shown(X.upsert_fx(stored, new, "sunat").select("fecha", "venta", "fuente"))


@query(f"""WITH q AS ({D.QUOTES_SQL}) SELECT cast(fecha as varchar) AS fecha, cast(CASE WHEN day(fecha) = 3 THEN compra ELSE venta END as double) AS venta,
CASE WHEN day(fecha) = 3 THEN 'manual' ELSE 'bcrp' END AS fuente FROM q""")
def edit_fx(spark: SparkSession, sf: str) -> DataFrame:
    quotes = D.quotes(spark, sf)
    stored = quotes.select("fecha", "compra", "venta", F.lit("bcrp").alias("fuente"), F.lit(None).cast("timestamp").alias("updated_at"))
    edits = quotes.filter(F.dayofmonth("fecha") == 3).select("fecha", "compra", F.col("compra").alias("venta"))
    return shown(X.edit_fx(stored, edits).select("fecha", "venta", "fuente"))


@query(f"SELECT cast(fecha as varchar) AS fecha, cast(venta as double) AS venta FROM ({D.QUOTES_SQL}) WHERE fecha BETWEEN date '1995-02-01' AND date '1995-04-30'")
def rates_between(spark: SparkSession, sf: str) -> DataFrame:
    return shown(X.rates_between(D.quotes(spark, sf), date(1995, 2, 1), date(1995, 4, 30)).select("fecha", "venta"))


@query(f"""SELECT cast(fecha as varchar) AS fecha, cast(venta as double) AS venta FROM ({D.QUOTES_SQL})
WHERE fecha IN (SELECT cast(l_shipdate as date) FROM lineitem WHERE l_linenumber = 7)""")
def rates_on(spark: SparkSession, sf: str) -> DataFrame:
    days = D.table(spark, sf, "lineitem").filter("l_linenumber = 7").select(F.col("l_shipdate").cast("date").alias("fecha"))
    return shown(X.rates_on(D.quotes(spark, sf), days).select("fecha", "venta"))


_CUTS = """, a AS (SELECT tipo, serie, min(cast(k as bigint)) AS primero, max(cast(k as bigint) % 3 + 1) AS ultimo FROM c WHERE tipo IN ('03','07') GROUP BY ALL),
t AS (SELECT *, primero - 1 - ultimo AS n FROM a WHERE primero > ultimo + 1)
SELECT tipo, serie, cast(ultimo as double) AS ultimo_anterior, cast(primero as double) AS primero_actual,
CASE WHEN n > 30 THEN 'numeración irregular (del ' || format('{:,}', ultimo + 1) || ' al ' || format('{:,}', primero - 1) || ') — revisar manualmente'
WHEN n = 1 THEN cast(ultimo + 1 as varchar) ELSE (ultimo + 1) || '-' || (primero - 1) END AS faltantes, cast(n as double) AS cantidad FROM t"""


def _low_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """A period before whose numbers all lie at the start of each series, so that series are cut."""
    low = (F.col("numero").cast("decimal(38,0)") % 3 + 1).cast("string")
    return lines(spark, sf).withColumn("numero", low).withColumn("numero_final", F.lit(""))


@query(_LINES + _CUTS)
def series_cuts_found(spark: SparkSession, sf: str) -> DataFrame:
    return shown(S.series_cuts(lines(spark, sf), _low_numbers(spark, sf)))


@query("SELECT tipo, serie, serie || '-' || cast(ultimo_anterior as bigint) AS ultimo_anterior, serie || '-' || cast(primero_actual as bigint) AS primero_actual, "
       "faltantes, cantidad FROM (" + _LINES + _CUTS + ")")
def cuts_report(spark: SparkSession, sf: str) -> DataFrame:
    return shown(cuts_sheet(S.series_cuts(lines(spark, sf), _low_numbers(spark, sf))))
