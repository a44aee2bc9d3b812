"""Reconciliation, receipts and report queries over derived ledgers, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlab.demo import ledgers as D
from ledgerlab.operators import ledger as L
from ledgerlab.operators import reconcile as R
from ledgerlab.operators import profile as P
from ledgerlab.operators import reports
from ledgerlab.operators.receipts import receipts_by_day as compare_receipts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function
    return add


def shown(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, so both engines print one spelling."""
    def cast(field):
        column = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind == "decimal":
            return column.cast("double").alias(field.name)
        return column.cast("string").alias(field.name) if kind == "date" else column
    return df.select([cast(f) for f in df.schema])


def sales(spark: SparkSession, sf: str, **options) -> R.Reconciliation:
    company, authority = D.derive(spark, sf, D.SALES_COMPANY), D.derive(spark, sf, D.SALES_AUTHORITY)
    return R.reconcile(company, authority, "ventas", **options)


def purchases(spark: SparkSession, sf: str, late: bool = True) -> R.Reconciliation:
    company, authority = D.derive(spark, sf, D.PURCHASES_COMPANY), D.derive(spark, sf, D.PURCHASES_AUTHORITY)
    return R.reconcile(company, authority, "compras", late=late)


def day_receipts(spark: SparkSession, sf: str) -> DataFrame:
    return compare_receipts(L.conform(D.derive(spark, sf, D.SALES_COMPANY)), L.conform(D.derive(spark, sf, D.SALES_AUTHORITY)))


# --- the same rules as SQL -------------------------------------------------------------------
_NUM = "coalesce(nullif(ltrim(trim(numero), '0'), ''), '0')"
_LAST = ("row_number() OVER (PARTITION BY {keys} ORDER BY line_no DESC, fecha_emision DESC, base_imponible DESC, igv DESC,"
         " importe_total DESC, razon_social DESC)")
_SALES_CTE = f"""WITH empresa AS ({D.as_sql(D.SALES_COMPANY, 'lineitem')}), sunat AS ({D.as_sql(D.SALES_AUTHORITY, 'lineitem')}),
e0 AS (SELECT *, upper(trim(serie)) AS ks, {_NUM} AS kn FROM empresa WHERE tipo_cdp <> '03' AND tipo_cdp IN ('01','07','08')),
s0 AS (SELECT *, upper(trim(serie)) AS ks, {_NUM} AS kn FROM sunat WHERE tipo_cdp <> '03'),
e AS (SELECT * FROM (SELECT *, {_LAST.format(keys='tipo_cdp, ks, kn')} AS rn FROM e0) WHERE rn = 1),
s AS (SELECT * FROM (SELECT *, {_LAST.format(keys='tipo_cdp, ks, kn')} AS rn FROM s0) WHERE rn = 1),
norm AS (
  SELECT 1 AS le, 0 AS ls, serie, fecha_emision AS fecha, base_imponible AS b, igv, importe_total AS t, mto_exonerado AS x FROM empresa WHERE tipo_cdp = '03'
  UNION ALL SELECT 0, 1, serie, fecha_emision, base_imponible, igv, importe_total, mto_exonerado FROM sunat WHERE tipo_cdp = '03'),
dias AS (
  SELECT CASE WHEN regexp_full_match(upper(serie), '[0-9]+') THEN 'B' || lpad(ltrim(upper(serie), '0'), cast(greatest(3, length(ltrim(upper(serie), '0'))) as integer), '0') ELSE upper(serie) END AS serie,
  fecha, max(le) AS le, max(ls) AS ls, sum(b*le) AS be, sum(b*ls) AS bs, sum(igv*le) AS ie, sum(igv*ls) AS isu, sum(t*le) AS te, sum(t*ls) AS ts, sum(x*le) AS xe, sum(x*ls) AS xs
  FROM norm GROUP BY ALL),
boletas AS (SELECT *, CASE WHEN ls = 0 THEN 'solo_empresa' WHEN le = 0 THEN 'solo_sunat'
  WHEN abs(be-bs) > 3 OR abs(ie-isu) > 1 OR abs(te-ts) > 3 OR abs(xe-xs) > 3 THEN 'difiere' ELSE 'cuadra' END AS estado FROM dias),
pares AS (SELECT e.tipo_cdp, e.serie, e.numero, e.fecha_emision AS fe, s.fecha_emision AS fs, e.base_imponible AS be, s.base_imponible AS bs, e.igv AS ie, s.igv AS isu,
  e.importe_total AS te, s.importe_total AS ts, e.mto_exonerado AS xe, s.mto_exonerado AS xs,
  coalesce(nullif(e.razon_social, ''), s.razon_social, '') AS razon_social,
  concat_ws(',', CASE WHEN e.fecha_emision <> s.fecha_emision THEN 'fecha' END, CASE WHEN abs(e.base_imponible - s.base_imponible) > 3 THEN 'base_imponible' END,
    CASE WHEN abs(e.igv - s.igv) > 1 THEN 'igv' END, CASE WHEN abs(e.importe_total - s.importe_total) > 3 THEN 'importe_total' END,
    CASE WHEN abs(e.mto_exonerado - s.mto_exonerado) > 3 THEN 'mto_exonerado' END) AS campos
  FROM e JOIN s USING (tipo_cdp, ks, kn)
  UNION ALL SELECT '03', serie, 'Boletas del día', fecha, fecha, be, bs, ie, isu, te, ts, xe, xs, '',
    concat_ws(',', CASE WHEN abs(be-bs) > 3 THEN 'base_imponible' END, CASE WHEN abs(ie-isu) > 1 THEN 'igv' END,
      CASE WHEN abs(te-ts) > 3 THEN 'importe_total' END, CASE WHEN abs(xe-xs) > 3 THEN 'mto_exonerado' END)
  FROM boletas WHERE le = 1 AND ls = 1),
a AS (SELECT tipo_cdp, serie, numero, fecha_emision, base_imponible, igv, importe_total, abs(igv) > 0.10 AS es_alerta_roja, razon_social
  FROM e ANTI JOIN s USING (tipo_cdp, ks, kn)
  UNION ALL SELECT '03', serie, 'Boletas del día', fecha, be, ie, te, abs(ie) > 1, '' FROM boletas WHERE estado = 'solo_empresa'),
b AS (SELECT tipo_cdp, serie, numero, fecha_emision, base_imponible, igv, importe_total, abs(igv) > 0.10 AS es_alerta_roja, razon_social
  FROM s ANTI JOIN e USING (tipo_cdp, ks, kn) WHERE fecha_emision IN (SELECT fecha_emision FROM e0)
  UNION ALL SELECT '03', serie, 'Boletas del día', fecha, bs, isu, ts, abs(isu) > 1, '' FROM boletas WHERE estado = 'solo_sunat')
"""
_AB_COLUMNS = """tipo_cdp, serie, numero, cast(fecha_emision as varchar) AS fecha_emision, cast(base_imponible as double) AS {0},
cast(igv as double) AS {1}, cast(importe_total as double) AS {2}, es_alerta_roja, razon_social"""


@query(_SALES_CTE + "SELECT " + _AB_COLUMNS.format("base_imponible", "igv", "importe_total") + " FROM a")
def recon_a(spark: SparkSession, sf: str) -> DataFrame:
    return shown(sales(spark, sf).scenario("A").drop("periodo", "status_description", "ruc_proveedor"))


@query(_SALES_CTE + "SELECT " + _AB_COLUMNS.format("base_imponible_sunat", "igv_sunat", "importe_total_sunat") + " FROM b")
def recon_b(spark: SparkSession, sf: str) -> DataFrame:
    rows = sales(spark, sf).scenario("B").drop("periodo", "ruc_proveedor")
    return shown(R.order_authority_only(rows))


_PAIR = """tipo_cdp, serie, numero, cast(fe as varchar) AS fecha_emision_empresa, cast(fs as varchar) AS fecha_emision_sunat,
cast(be as double) AS base_imponible_empresa, cast(bs as double) AS base_imponible_sunat, cast(ie as double) AS igv_empresa,
cast(isu as double) AS igv_sunat, cast(te as double) AS importe_total_empresa, cast(ts as double) AS importe_total_sunat, razon_social"""
_PAIR_COLUMNS = ["tipo_cdp", "serie", "numero", "fecha_emision_empresa", "fecha_emision_sunat", "base_imponible_empresa", "base_imponible_sunat",
                 "igv_empresa", "igv_sunat", "importe_total_empresa", "importe_total_sunat", "razon_social"]


@query(_SALES_CTE + f"""SELECT {_PAIR}, abs(ie - isu) > 1 AS es_alerta_roja, campos,
concat_ws(', ', CASE WHEN campos LIKE '%fecha%' THEN 'Fecha' END, CASE WHEN campos LIKE '%base%' THEN 'Base imponible' END,
CASE WHEN campos LIKE '%igv%' THEN 'IGV' END, CASE WHEN campos LIKE '%importe%' THEN 'Importe total' END,
CASE WHEN campos LIKE '%exonerado%' THEN 'Exonerado' END) AS etiquetas FROM pares WHERE campos <> ''""")
def recon_c(spark: SparkSession, sf: str) -> DataFrame:
    rows = sales(spark, sf).scenario("C")
    fields = F.array_join(F.transform("diferencias", lambda d: d["campo"]), ",")
    return shown(rows.select(*_PAIR_COLUMNS, "es_alerta_roja", fields.alias("campos"), R.difference_text(F.col("diferencias")).alias("etiquetas")))


@query(_SALES_CTE + f"SELECT {_PAIR} FROM pares WHERE campos = ''")
def recon_d(spark: SparkSession, sf: str) -> DataFrame:
    return shown(sales(spark, sf).scenario("D").select(_PAIR_COLUMNS))


@query(_SALES_CTE + """SELECT a.n AS escenario_a, b.n AS escenario_b, c.n AS escenario_c, d.n AS escenario_d, 0 AS reubicados,
cast(coalesce(c.igv, 0) + coalesce(b.igv, 0) as double) AS igv_diferencia_total, true AS tiene_alertas_rojas,
round(d.n::double / (a.n + c.n + d.n), 4) AS tasa_conciliacion
FROM (SELECT count(*) AS n FROM a) a, (SELECT count(*) AS n, sum(abs(igv)) AS igv FROM b) b,
(SELECT count(*) AS n, sum(CASE WHEN abs(ie-isu) > 1 THEN abs(ie-isu) END) AS igv FROM pares WHERE campos <> '') c,
(SELECT count(*) AS n FROM pares WHERE campos = '') d""")
def recon_summary(spark: SparkSession, sf: str) -> DataFrame:
    return shown(sales(spark, sf).summary())


@query(f"SELECT tipo_cdp, count(*) AS cantidad FROM ({D.as_sql(D.SALES_COMPANY, 'lineitem')}) WHERE tipo_cdp NOT IN ('01','03','07','08') GROUP BY tipo_cdp")
def ledger_excluded(spark: SparkSession, sf: str) -> DataFrame:
    return R.excluded_types(L.conform(D.derive(spark, sf, D.SALES_COMPANY)))


@query(_SALES_CTE + """SELECT 'empresa' AS lado, (SELECT count(*) FROM e0) - (SELECT count(*) FROM e) AS sobrantes
UNION ALL SELECT 'sunat', (SELECT count(*) FROM s0) - (SELECT count(*) FROM s)""")
def ledger_surplus(spark: SparkSession, sf: str) -> DataFrame:
    return sales(spark, sf).surplus.withColumn("sobrantes", F.col("sobrantes").cast("long"))


_BUY_LAST = ("row_number() OVER (PARTITION BY periodo, ruc_proveedor, tipo_cdp, serie, kn ORDER BY line_no DESC, fecha_emision DESC,"
             " base_imponible DESC, igv DESC, importe_total DESC, bi_dgng DESC, igv_dgng DESC, bi_dng DESC, igv_dng DESC)")
_BUY_CTE = f"""WITH empresa AS ({D.as_sql(D.PURCHASES_COMPANY, 'lineitem')}), sunat AS ({D.as_sql(D.PURCHASES_AUTHORITY, 'lineitem')}),
e AS (SELECT * FROM (SELECT *, {_BUY_LAST} AS rn FROM (SELECT *, {_NUM} AS kn FROM empresa WHERE tipo_cdp IN ('01','07','08','30','50','54'))) WHERE rn = 1),
s AS (SELECT * FROM (SELECT *, {_BUY_LAST} AS rn FROM (SELECT *, {_NUM} AS kn FROM sunat)) WHERE rn = 1),
directo AS (SELECT e.*, s.periodo IS NOT NULL AS hallado, strftime(e.fecha_emision, '%Y%m') AS mes FROM e LEFT JOIN s USING (periodo, ruc_proveedor, tipo_cdp, serie, kn)),
pares AS (
  SELECT e.periodo, '' AS periodo_hallazgo, struct_pack(r := e) AS x, struct_pack(r := s) AS y FROM e JOIN s USING (periodo, ruc_proveedor, tipo_cdp, serie, kn)
  UNION ALL
  SELECT d.periodo, d.mes, struct_pack(r := e), struct_pack(r := s) FROM directo d
  JOIN e ON e.periodo = d.periodo AND e.ruc_proveedor = d.ruc_proveedor AND e.tipo_cdp = d.tipo_cdp AND e.serie = d.serie AND e.kn = d.kn
  JOIN s ON s.periodo = d.mes AND s.ruc_proveedor = d.ruc_proveedor AND s.tipo_cdp = d.tipo_cdp AND s.serie = d.serie AND s.kn = d.kn
  WHERE NOT d.hallado AND d.mes < d.periodo
    AND d.mes >= strftime(strptime(d.periodo || '01', '%Y%m%d') - INTERVAL 12 MONTH, '%Y%m')),
campos AS (SELECT periodo, periodo_hallazgo, x.r.ruc_proveedor AS ruc_proveedor, x.r.tipo_cdp AS tipo_cdp, x.r.serie AS serie, x.r.numero AS numero,
  concat_ws(',', CASE WHEN x.r.fecha_emision <> y.r.fecha_emision THEN 'fecha' END, CASE WHEN abs(x.r.base_imponible - y.r.base_imponible) > 3 THEN 'base_imponible' END,
    CASE WHEN abs(x.r.igv - y.r.igv) > 1 THEN 'igv' END, CASE WHEN abs(x.r.importe_total - y.r.importe_total) > 3 THEN 'importe_total' END,
    CASE WHEN abs(x.r.bi_dgng - y.r.bi_dgng) > 3 THEN 'bi_dgng' END, CASE WHEN abs(x.r.igv_dgng - y.r.igv_dgng) > 1 THEN 'igv_dgng' END,
    CASE WHEN abs(x.r.bi_dng - y.r.bi_dng) > 3 THEN 'bi_dng' END, CASE WHEN abs(x.r.igv_dng - y.r.igv_dng) > 1 THEN 'igv_dng' END,
    CASE WHEN abs(x.r.valor_adq_ng - y.r.valor_adq_ng) > 3 THEN 'valor_adq_ng' END,
    CASE WHEN upper(trim(x.r.moneda)) <> upper(trim(y.r.moneda)) THEN 'moneda' END,
    CASE WHEN abs(x.r.tipo_cambio - y.r.tipo_cambio) > 0.001 THEN 'tipo_cambio' END) AS campos FROM pares)
"""


@query(_BUY_CTE + "SELECT * FROM campos WHERE campos <> ''")
def purchases_c(spark: SparkSession, sf: str) -> DataFrame:
    rows = purchases(spark, sf).scenario("C")
    fields = F.array_join(F.transform("diferencias", lambda d: d["campo"]), ",")
    return rows.select("periodo", "periodo_hallazgo", "ruc_proveedor", "tipo_cdp", "serie", "numero", fields.alias("campos"))


@query(_BUY_CTE + """SELECT periodo, periodo_hallazgo, count(*) AS filas, count(*) FILTER (WHERE campos = '') AS iguales
FROM campos WHERE periodo_hallazgo <> '' GROUP BY ALL""")
def late_rescue(spark: SparkSession, sf: str) -> DataFrame:
    found = purchases(spark, sf).rows.filter("periodo_hallazgo <> ''")
    return found.groupBy("periodo", "periodo_hallazgo").agg(
        F.count(F.lit(1)).alias("filas"), F.count_if(F.col("escenario") == "D").alias("iguales"))


@query(_BUY_CTE + """SELECT e.periodo, e.ruc_proveedor, e.tipo_cdp, e.serie, e.numero, cast(e.igv + e.igv_dgng + e.igv_dng as double) AS igv,
abs(e.igv + e.igv_dgng + e.igv_dng) > 0.10 AS es_alerta_roja FROM e
ANTI JOIN campos c ON c.periodo = e.periodo AND c.ruc_proveedor = e.ruc_proveedor AND c.tipo_cdp = e.tipo_cdp AND c.serie = e.serie AND c.numero = e.numero""")
def purchases_a(spark: SparkSession, sf: str) -> DataFrame:
    return shown(purchases(spark, sf).scenario("A").select("periodo", "ruc_proveedor", "tipo_cdp", "serie", "numero", "igv", "es_alerta_roja"))


@query(_BUY_CTE + """SELECT s.periodo, s.ruc_proveedor, s.tipo_cdp, s.serie, s.numero, cast(s.igv + s.igv_dgng + s.igv_dng as double) AS igv_sunat,
abs(s.igv + s.igv_dgng + s.igv_dng) > 0.10 AS es_alerta_roja FROM s ANTI JOIN e USING (periodo, ruc_proveedor, tipo_cdp, serie, kn)""")
def purchases_b(spark: SparkSession, sf: str) -> DataFrame:
    return shown(purchases(spark, sf).scenario("B").select(
        "periodo", "ruc_proveedor", "tipo_cdp", "serie", "numero", "igv_sunat", "es_alerta_roja"))


@query(_BUY_CTE + "SELECT periodo, periodo_hallazgo, ruc_proveedor, tipo_cdp, serie, numero FROM campos WHERE campos = ''")
def purchases_d(spark: SparkSession, sf: str) -> DataFrame:
    return purchases(spark, sf).scenario("D").select("periodo", "periodo_hallazgo", "ruc_proveedor", "tipo_cdp", "serie", "numero")


@query(f"""SELECT DISTINCT strftime(fecha_emision, '%Y%m') AS mes FROM ({D.as_sql(D.PURCHASES_COMPANY, 'lineitem')})
WHERE strftime(fecha_emision, '%Y%m') >= '199701' AND strftime(fecha_emision, '%Y%m') < '199801' ORDER BY mes""")
def months_to_fetch(spark: SparkSession, sf: str) -> DataFrame:
    return R.months_to_fetch(D.derive(spark, sf, D.PURCHASES_COMPANY), "199801")


@query(_SALES_CTE + """SELECT serie, cast(fecha as varchar) AS fecha, cast(be as double) AS base_empresa, cast(bs as double) AS base_sunat,
cast(ie as double) AS igv_empresa, cast(isu as double) AS igv_sunat, estado,
CASE WHEN estado IN ('difiere', 'cuadra') THEN concat_ws(',', CASE WHEN abs(be-bs) > 3 THEN 'base' END, CASE WHEN abs(ie-isu) > 1 THEN 'igv' END,
CASE WHEN abs(te-ts) > 3 THEN 'importe' END, CASE WHEN abs(xe-xs) > 3 THEN 'exonerado' END) ELSE '' END AS campos,
CASE WHEN estado = 'cuadra' THEN false ELSE abs(ie-isu) > 1 END AS es_alerta_roja, cast(ie - isu as double) AS diferencia_igv FROM boletas""")
def receipts_by_day(spark: SparkSession, sf: str) -> DataFrame:
    out = day_receipts(spark, sf).withColumn("campos", F.array_join("campos_diferentes", ","))
    return shown(out.select("serie", "fecha", "base_empresa", "base_sunat", "igv_empresa", "igv_sunat", "estado", "campos",
                            "es_alerta_roja", "diferencia_igv"))


@query(_SALES_CTE + """SELECT serie, cast(sum(ie) as double) AS igv_empresa, cast(sum(isu) as double) AS igv_sunat, cast(sum(ie) - sum(isu) as double) AS diferencia,
cast(abs(sum(ie) - sum(isu)) as double) AS diferencia_abs, coalesce(round(abs(cast(sum(ie) - sum(isu) as double)) / nullif(cast(sum(ie) as double), 0), 4), 0) AS porcentaje
FROM boletas GROUP BY serie""")
def series_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return shown(reports.series_ranking(day_receipts(spark, sf)))


@query(_SALES_CTE + """SELECT serie, cast(abs(sum(ie) - sum(isu)) as double) AS diferencia_abs FROM boletas GROUP BY serie ORDER BY diferencia_abs DESC, serie LIMIT 10""")
def series_top10(spark: SparkSession, sf: str) -> DataFrame:
    return shown(reports.series_ranking(day_receipts(spark, sf), 10).select("serie", "diferencia_abs"))


_DAYS = [f"2024-01-{d:02d}" for d in range(1, 32)] + ["2024-02-01"]


def _matrix(value: str) -> str:
    cells = ", ".join(f"""cast(coalesce(sum(CASE WHEN fecha = date '{d}' THEN {value} END), 0) as double) AS "{d}" """ for d in _DAYS)
    return f"SELECT serie, {cells}, cast(sum({value}) as double) AS \"Total\" FROM boletas GROUP BY serie"


@query(_SALES_CTE + _matrix("ie"))
def series_day_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return shown(reports.series_day_matrix(day_receipts(spark, sf), "empresa"))


@query(_SALES_CTE + _matrix("(ie - isu)") + " HAVING max(abs(ie - isu)) > 1")
def difference_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return shown(reports.difference_matrix(day_receipts(spark, sf)))


@query(_SALES_CTE + """SELECT serie, cast(fecha as varchar) AS fecha, cast(ie as double) AS igv_empresa, cast(isu as double) AS igv_sunat,
cast(ie - isu as double) AS diferencia FROM boletas WHERE serie = 'B007'""")
def day_detail(spark: SparkSession, sf: str) -> DataFrame:
    return shown(reports.day_detail(day_receipts(spark, sf), "B007"))


@query(_SALES_CTE + """SELECT serie, cast(fecha as varchar) AS fecha, cast(ie as double) AS igv_empresa, cast(isu as double) AS igv_sunat,
cast(ie - isu as double) AS diferencia_igv, CASE estado WHEN 'cuadra' THEN 'Cuadra OK' WHEN 'difiere' THEN 'Diferencia'
WHEN 'solo_empresa' THEN 'Solo en tu archivo' ELSE 'Solo en SUNAT' END AS estado FROM boletas""")
def receipts_sheet(spark: SparkSession, sf: str) -> DataFrame:
    return shown(reports.receipts_sheet(day_receipts(spark, sf)))


@query(f"""SELECT count(*) AS filas, round(avg(CASE WHEN abs(base_imponible + igv + bi_dgng + igv_dgng + bi_dng + igv_dng - importe_total) <= 0.02 THEN 1.0 ELSE 0.0 END), 6) AS proporcion,
avg(CASE WHEN abs(base_imponible + igv + bi_dgng + igv_dgng + bi_dng + igv_dng - importe_total) <= 0.02 THEN 1.0 ELSE 0.0 END) >= 0.9 AS pasa
FROM ({D.as_sql(D.PURCHASES_AUTHORITY, 'lineitem')})""")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    parts = ["base_imponible", "igv", "bi_dgng", "igv_dgng", "bi_dng", "igv_dng"]
    out = P.quality_gate(D.derive(spark, sf, D.PURCHASES_AUTHORITY), parts, "importe_total")
    return out.withColumn("proporcion", F.round("proporcion", 6))


@query(f"""SELECT round(avg(CASE WHEN abs(base_imponible + igv + mto_exonerado - importe_total) <= 0.5 THEN 100.0 ELSE 0.0 END), 1) AS aritmetica_pct, 100.0 AS fechas_pct,
avg(CASE WHEN abs(base_imponible + igv + mto_exonerado - importe_total) <= 0.5 THEN 100.0 ELSE 0.0 END) >= 50 AS ok, '' AS faltantes FROM ({D.as_sql(D.SALES_COMPANY, 'lineitem')})""")
def validate_mapping(spark: SparkSession, sf: str) -> DataFrame:
    ledger = L.conform(D.derive(spark, sf, D.SALES_COMPANY))
    return P.validate_mapping(ledger, {n: i for i, n in enumerate(P.REQUIRED["ventas"])}, "ventas")


_PROFILED = ["tipo_cdp", "serie", "numero", "importe_total"]


def _role_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS columna, trim(cast({c} as varchar)) AS v FROM l" for c in _PROFILED)
    scores = ", ".join(
        f"round(avg(CASE WHEN regexp_matches(v, '{p}') THEN 1.0 ELSE 0.0 END) * (0.5 + 0.5 * least((count(DISTINCT v) / count(*)) / {e}, 1.0)), 6) AS {r}"
        for r, (p, e) in P.LEDGER_ROLES.items())
    return f"WITH l AS ({D.as_sql(D.SALES_COMPANY, 'lineitem')}) SELECT columna, {scores} FROM ({long}) WHERE v NOT IN ('', 'nan', 'None', '<NA>') GROUP BY columna"


@query(_role_sql())
def column_roles(spark: SparkSession, sf: str) -> DataFrame:
    scores = P.role_scores(D.derive(spark, sf, D.SALES_COMPANY).select(_PROFILED))
    return scores.select("columna", *[F.round(r, 6).alias(r) for r in P.LEDGER_ROLES])


@query(f"""WITH l AS ({D.as_sql(D.SALES_COMPANY, 'lineitem')}), v AS (SELECT 'base_imponible' AS columna, base_imponible AS v FROM l UNION ALL SELECT 'igv', igv FROM l
UNION ALL SELECT 'importe_total', importe_total FROM l UNION ALL SELECT 'line_no', cast(line_no as decimal(18,2)) FROM l)
SELECT columna, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS positivos, round(avg(CASE WHEN v <> 0 THEN CASE WHEN v <> round(v, 0) THEN 1.0 ELSE 0.0 END END), 6) AS con_centimos,
cast(max(abs(v)) as double) AS mayor, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) >= 0.3 AND avg(CASE WHEN v <> 0 THEN CASE WHEN v <> round(v, 0) THEN 1.0 ELSE 0.0 END END) >= 0.15 AND max(abs(v)) < 1e9 AS es_monto
FROM v GROUP BY columna""")
def amount_columns(spark: SparkSession, sf: str) -> DataFrame:
    ledger = D.derive(spark, sf, D.SALES_COMPANY)
    out = P.amount_columns(ledger, ["base_imponible", "igv", "importe_total", "line_no"])
    return out.select("columna", F.round("positivos", 6).alias("positivos"), F.round("con_centimos", 6).alias("con_centimos"), "mayor", "es_monto")


@query(f"""WITH {{a}} SELECT tipo_cdp, serie, numero, prioridad FROM (SELECT tipo_cdp, serie, numero, min(prioridad) AS prioridad FROM (
SELECT 0 AS prioridad, tipo_cdp, serie, numero FROM empresa e WHERE (tipo_cdp, upper(serie), {_NUM}) IN (SELECT (tipo_cdp, upper(serie), {_NUM}) FROM empresa GROUP BY tipo_cdp, upper(serie), {_NUM} HAVING count(*) > 1)
UNION ALL SELECT 1, tipo_cdp, serie, numero FROM a) GROUP BY tipo_cdp, serie, numero)""".replace("WITH {a}", _SALES_CTE))
def validation_worklist(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerlab.operators.sequence import duplicate_rows_in_period

    company = D.derive(spark, sf, D.SALES_COMPANY)
    lines = company.select(F.lit("202401").alias("periodo"), F.col("tipo_cdp").alias("tipo"), F.upper("serie").alias("serie"), "numero", F.col("serie").alias("s"), "fecha_emision", "importe_total")
    repeated = duplicate_rows_in_period(lines).select(F.col("tipo").alias("tipo_cdp"), F.col("s").alias("serie"), "numero", "fecha_emision", "importe_total")
    return R.validation_worklist(sales(spark, sf).scenario("A"), repeated).select("tipo_cdp", "serie", "numero", "prioridad")
