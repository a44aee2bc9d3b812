"""Value parsing, profile fields, best reading, review and record reports, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlab.demo import documents as D
from ledgerlab.demo.ledger_queries import shown
from ledgerlab.demo.ledgers import table
from ledgerlab.functions import identity as I
from ledgerlab.operators import records as R
from ledgerlab.operators import vouchers as V

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function
    return add


_RUC = "concat(CASE l_orderkey % 4 WHEN 0 THEN '10' WHEN 1 THEN '20' WHEN 2 THEN '17' ELSE '99' END, lpad(cast((l_orderkey * 31 + l_linenumber * 7 + l_partkey) % 1000000000 as string), 9, '0'))"
_CHECK = "(11 - (" + " + ".join(f"cast(substr(r, {i + 1}, 1) as int) * {w}" for i, w in enumerate(I.WEIGHTS)) + ") % 11) % 10 = cast(substr(r, 11, 1) as int)"
_VALID = f"(substr(r, 1, 2) IN ('10','15','16','17','20') AND {_CHECK})"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, r AS ruc, {_VALID} AS valido FROM (SELECT *, {_RUC} AS r FROM lineitem)")
def ruc_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{_RUC} AS ruc")
    return rows.withColumn("valido", I.ruc_is_valid(F.col("ruc")))


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, concat(cast(l_linenumber as string), {_RUC}, '3') AS d FROM lineitem),
w AS (SELECT *, unnest(range(1, length(d) - 9)) AS i FROM x), v AS (SELECT *, substr(d, i, 11) AS r FROM w)
SELECT x.l_orderkey, x.l_linenumber, x.l_partkey, x.d AS digitos, (SELECT arg_min(r, i) FROM v WHERE v.d = x.d AND {_VALID}) AS hallado FROM x""")
def ruc_find(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"concat(cast(l_linenumber as string), {_RUC}, '3') AS digitos")
    return rows.withColumn("hallado", I.ruc_find(F.concat(F.lit("RUC: "), F.col("digitos"))))


_MONEY_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN concat('S/ ', cast(o_orderkey as string), ',', lpad(cast(o_custkey % 1000 as string), 3, '0'), '.', lpad(cast(o_custkey % 100 as string), 2, '0'))
WHEN 1 THEN concat('US$ ', cast(o_orderkey as string), '.', lpad(cast(o_custkey % 1000 as string), 3, '0'), ',', lpad(cast(o_custkey % 100 as string), 2, '0'))
WHEN 2 THEN concat(cast(o_orderkey as string), '.', lpad(cast(o_custkey % 1000 as string), 3, '0')) WHEN 3 THEN concat(cast(o_orderkey as string), ',', lpad(cast(o_custkey % 100 as string), 2, '0'), ' dolares')
WHEN 4 THEN concat('1,', lpad(cast(o_orderkey % 1000 as string), 3, '0'), ',', lpad(cast(o_custkey % 1000 as string), 3, '0')) ELSE 'sin importe' END"""


@query(f"""SELECT o_orderkey, o_custkey, t AS texto, CASE o_orderkey % 6
WHEN 0 THEN (o_orderkey * 1000 + o_custkey % 1000) + (o_custkey % 100) / 100.0 WHEN 1 THEN (o_orderkey * 1000 + o_custkey % 1000) + (o_custkey % 100) / 100.0
WHEN 2 THEN o_orderkey * 1000 + o_custkey % 1000 WHEN 3 THEN o_orderkey + (o_custkey % 100) / 100.0
WHEN 4 THEN 1000000 + (o_orderkey % 1000) * 1000 + o_custkey % 1000 END AS cantidad,
CASE o_orderkey % 6 WHEN 0 THEN 'PEN' WHEN 1 THEN 'USD' WHEN 2 THEN 'PEN' WHEN 3 THEN 'USD' WHEN 4 THEN 'PEN' END AS moneda
FROM (SELECT *, {_MONEY_TEXT} AS t FROM orders)""")
def parse_money(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", f"{_MONEY_TEXT} AS texto")
    return shown(rows.withColumn("m", I.parse_money(F.col("texto"))).select("o_orderkey", "o_custkey", "texto", "m.*"))


_PERIOD_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN concat('Setiembre de ', cast(year(o_orderdate) as string)) WHEN 1 THEN concat('x ', cast(year(o_orderdate) * 100 + month(o_orderdate) as string), ' y')
WHEN 2 THEN concat(cast(month(o_orderdate) as string), ' / ', cast(year(o_orderdate) as string)) WHEN 3 THEN concat(cast(year(o_orderdate) as string), '-', lpad(cast(month(o_orderdate) as string), 2, '0'))
WHEN 4 THEN concat(lpad(cast(month(o_orderdate) as string), 2, '0'), cast(year(o_orderdate) as string)) ELSE 'junio' END"""


@query(f"""SELECT o_orderkey, t AS texto, CASE WHEN year(o_orderdate) < 1993 THEN NULL WHEN o_orderkey % 6 = 0 THEN cast(year(o_orderdate) as varchar) || '09' WHEN o_orderkey % 6 = 5 THEN NULL
ELSE cast(year(o_orderdate) * 100 + month(o_orderdate) as varchar) END AS periodo FROM (SELECT *, {_PERIOD_TEXT} AS t FROM orders)""")
def parse_period(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_PERIOD_TEXT} AS texto")
    return rows.withColumn("periodo", I.parse_period(F.col("texto")))


_DATE_TEXT = "concat('el ', cast(o_custkey % 35 as string), '-', cast(o_orderkey % 14 as string), '.', CASE WHEN o_orderkey % 2 = 0 THEN '24' ELSE '2023' END)"


@query(f"""SELECT o_orderkey, cast(try_cast(CASE WHEN o_orderkey % 2 = 0 THEN '2024' ELSE '2023' END || '-' || lpad(cast(o_orderkey % 14 as varchar), 2, '0') || '-' || lpad(cast(o_custkey % 35 as varchar), 2, '0') as date) as varchar) AS fecha FROM orders""")
def parse_payment_date(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_DATE_TEXT} AS texto")
    return rows.select("o_orderkey", I.parse_payment_date(F.col("texto")).cast("string").alias("fecha"))


_RENT = f"(SELECT * FROM ({D.DOCS_SQL}) WHERE doc_id % 12 = 11)"


def rent_docs(spark: SparkSession, sf: str) -> DataFrame:
    return D.rendered(spark, sf).filter(R.recognise_profile(F.col("texto")))


@query(f"""SELECT doc_id, regexp_extract(texto, 'Monto de alquiler: (S/ [0-9.]+)', 1) AS monto_alquiler, regexp_extract(texto, 'Importe pagado: (S/ [0-9.]+)', 1) AS importe_pagado,
regexp_extract(texto, 'Periodo tributario: ([0-9/]+)', 1) AS periodo, regexp_extract(texto, 'Fecha de pago: ([0-9/]+)', 1) AS fecha_de_pago,
regexp_extract(texto, 'Nro operacion: ([0-9]+)', 1) AS numero_de_operacion, regexp_extract(texto, 'RUC del arrendador: ([0-9]+)', 1) AS ruc_contribuyente FROM {_RENT}""")
def profile_fields(spark: SparkSession, sf: str) -> DataFrame:
    names = ["monto_alquiler", "importe_pagado", "periodo", "fecha_de_pago", "numero_de_operacion", "ruc_contribuyente"]
    fields = R.extract_profile_fields(rent_docs(spark, sf))
    return fields.groupBy("doc_id").agg(*[F.max(F.when(F.col("campo") == n, F.col("valor"))).alias(n) for n in names])


# Readings of three strategies for every document row, from its id and length.
_FIELDS = R.ESSENTIAL + ["nombre_contribuyente", "numero_de_operacion"]
_CANDIDATES = " UNION ALL ".join(
    f"SELECT doc_id, '{field}' AS campo, concat('v', cast(n_chars % 89 as string), '{s}') AS valor, ((doc_id * {7 + i} + n_chars * {3 + j}) % {p}) / cast(100 as double) + 0.3 AS confianza,"
    f" '{strategy}' AS estrategia, {R.STRATEGY_COST[strategy]} AS costo FROM documents"
    for i, field in enumerate(_FIELDS) for j, (strategy, s, p) in enumerate([("native_pdf_text", "n", 70), ("local_ocr", "o", 68), ("vision_ai", "a", 66)]))
_BEST = f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, campo ORDER BY confianza DESC, costo, valor DESC) AS rn FROM ({_CANDIDATES})) WHERE rn = 1)"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Five fields read by three strategies, for every document."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = [
        F.struct(F.lit(field).alias("campo"), F.concat(F.lit("v"), (F.col("n_chars") % 89).cast("string"), F.lit(s)).alias("valor"),
                 (((F.col("doc_id") * (7 + i) + F.col("n_chars") * (3 + j)) % p) / F.lit(100.0) + 0.3).alias("confianza"),
                 F.lit(strategy).alias("estrategia"), F.lit(R.STRATEGY_COST[strategy]).alias("costo"))
        for i, field in enumerate(_FIELDS)
        for j, (strategy, s, p) in enumerate([("native_pdf_text", "n", 70), ("local_ocr", "o", 68), ("vision_ai", "a", 66)])]
    return docs.select("doc_id", F.explode(F.array(*rows)).alias("c")).select("doc_id", "c.*")


@query(f"WITH {_BEST} SELECT doc_id, campo, valor, round(confianza, 4) AS confianza, estrategia FROM best")
def best_field(spark: SparkSession, sf: str) -> DataFrame:
    return R.best_field(candidates(spark, sf)).select("doc_id", "campo", "valor", F.round("confianza", 4).alias("confianza"), "estrategia")


_ESSENTIAL = "(" + ", ".join(f"'{f}'" for f in R.ESSENTIAL) + ")"


@query(f"""WITH {_BEST}, q AS (SELECT doc_id, count(*) FILTER (WHERE campo IN {_ESSENTIAL} AND confianza >= 0.8) AS fiables,
count(*) FILTER (WHERE campo NOT IN {_ESSENTIAL} AND confianza < 0.8) AS dudosos, round(sum(confianza * CASE WHEN campo IN {_ESSENTIAL} THEN 3 ELSE 1 END) / 11, 4) AS confianza_global,
count(*) FILTER (WHERE estrategia = 'native_pdf_text') AS n1, count(*) FILTER (WHERE estrategia = 'local_ocr') AS n2, count(*) FILTER (WHERE estrategia = 'vision_ai') AS n3 FROM best GROUP BY doc_id)
SELECT doc_id, CASE WHEN fiables = 3 THEN 'complete' ELSE 'partial' END AS completitud, CASE WHEN fiables = 3 AND dudosos = 0 THEN 'not_required' ELSE 'pending' END AS estado_de_revision,
confianza_global, CASE WHEN n1 >= n2 AND n1 >= n3 THEN 'native_pdf_text' WHEN n2 >= n3 THEN 'local_ocr' ELSE 'vision_ai' END AS estrategia_usada, fiables = 3 AS suficiente FROM q""")
def review_states(spark: SparkSession, sf: str) -> DataFrame:
    return R.quality(R.best_field(candidates(spark, sf))).withColumn("confianza_global", F.round("confianza_global", 4))


def rent_records(spark: SparkSession, sf: str) -> DataFrame:
    """Typed records of all rendered rent payments."""
    built = R.build_record(R.best_field(R.extract_profile_fields(rent_docs(spark, sf))))
    return built.select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("job_id"), F.expr("timestamp_seconds(doc_id * 60)").alias("created_at"), *built.columns[1:])


_RECORDS = f"""r AS (SELECT doc_id AS id, o_custkey, o_orderdate, {_VALID.replace('(r, ', '(ru, ')} AND {_VALID.replace('(r, ', '(rq, ')} AND year(o_orderdate) >= 1993 AS listo, {_VALID.replace('(r, ', '(ru, ')} AS ok, ru, t, x, lpad(cast(doc_id as varchar), 8, '0') AS op FROM
(SELECT o_orderkey AS doc_id, o_custkey, o_orderdate, concat('20', lpad(cast(o_custkey as varchar), 9, '0')) AS ru, concat('10', lpad(cast(o_orderkey as varchar), 9, '0')) AS rq, cast(o_totalprice as decimal(18,2)) AS t,
cast(cast(o_totalprice as decimal(18,2)) * cast(0.18 as decimal(3,2)) as decimal(18,2)) AS x FROM orders WHERE o_orderkey % 12 = 11))"""


@query(f"""WITH {_RECORDS} SELECT CASE WHEN ok THEN ru ELSE '' END AS ruc_contribuyente, CASE WHEN year(o_orderdate) >= 1993 THEN strftime(o_orderdate, '%Y%m') ELSE '' END AS periodo,
cast(t as varchar) AS monto_alquiler, cast(x as varchar) AS importe_pagado, '' AS intereses_moratorios, 'PEN' AS moneda, strftime(o_orderdate, '%d/%m/%Y') AS fecha_de_pago, op AS numero_de_operacion,
'PEREZ ' || o_custkey AS nombre_contribuyente FROM r""")
def records_report(spark: SparkSession, sf: str) -> DataFrame:
    report = R.records_report(rent_records(spark, sf), cap=None)
    return report.select("ruc_contribuyente", "periodo", "monto_alquiler", "importe_pagado", "intereses_moratorios", "moneda", "fecha_de_pago", "numero_de_operacion", "nombre_contribuyente")


@query(f"""WITH {_RECORDS} SELECT id, cast(x as double) AS importe_pagado FROM r WHERE strftime(o_orderdate, '%Y%m') BETWEEN '199501' AND '199712' AND o_orderdate <= date '1997-06-30'
ORDER BY id DESC""")
def list_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.list_records(rent_records(spark, sf), periodo_desde="199501", periodo_hasta="199712", fecha_hasta="1997-06-30")
    return shown(rows.select("id", "importe_pagado"))


@query(f"""WITH {_RECORDS} SELECT count(*) AS total, count(*) FILTER (WHERE NOT listo) AS pendientes FROM r""")
def review_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.review_counts(rent_records(spark, sf))


@query(f"""WITH {_RECORDS} SELECT id, CASE WHEN id % 5 = 0 THEN '202401' WHEN year(o_orderdate) >= 1993 THEN strftime(o_orderdate, '%Y%m') END AS periodo,
CASE WHEN id % 5 = 0 THEN 'approved' WHEN listo THEN 'not_required' ELSE 'pending' END AS estado_de_revision, CASE WHEN id % 5 = 0 THEN 1.0 ELSE 0.96 END AS confianza_periodo FROM r
""".replace("ELSE 0.96 END", "WHEN year(o_orderdate) >= 1993 THEN 0.96 ELSE 0.432 END"))
def apply_corrections(spark: SparkSession, sf: str) -> DataFrame:
    records = rent_records(spark, sf).withColumnRenamed("id", "record_id")
    fixes = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.lit("periodo").alias("campo"),
        F.when(F.col("o_orderkey") % 5 == 0, "enero 2024").when(F.col("o_orderkey") % 5 == 1, "no es un periodo").alias("valor")).filter("valor is not null")
    fixed, _ = R.apply_corrections(records, fixes)
    return fixed.select(F.col("record_id").alias("id"), "periodo", "estado_de_revision", F.element_at("confianza_por_campo", "periodo").alias("confianza_periodo"))


@query("""SELECT cast(user_id % 7 as bigint) AS job_id, count(*) AS mensajes_revisados, count(*) FILTER (WHERE value > 10) AS mensajes_con_adjuntos,
count(*) FILTER (WHERE event_type = 'click') AS adjuntos_descargados, count(*) FILTER (WHERE event_type = 'error') AS adjuntos_rechazados,
count(*) FILTER (WHERE event_type NOT IN ('click', 'error')) AS adjuntos_duplicados, count(*) FILTER (WHERE event_id % 2 = 0) AS errores,
count(*) FILTER (WHERE event_id % 3 <> 0) AS registros_extraidos, count(*) FILTER (WHERE event_id % 3 = 1) AS registros_en_revision, count(*) FILTER (WHERE event_id % 3 = 0) AS adjuntos_sin_datos,
count(*) FILTER (WHERE value > 50) AS llamadas_ia, count(*) FILTER (WHERE event_id % 2 = 1) AS errores_extraccion FROM events GROUP BY user_id % 7""")
def scan_counters(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").withColumn("job_id", F.col("user_id") % 7)
    kind = F.col("event_type")
    files = log.select("job_id", F.when(kind == "click", "descargado").when(kind == "error", "rechazado").otherwise("duplicado").alias("resultado"))
    errors = log.select("job_id", F.when(F.col("event_id") % 2 == 1, "extracting").otherwise("downloading").alias("etapa"))
    third = F.col("event_id") % 3
    done = log.select("job_id", (third != 0).alias("reconocido"), F.when(third == 1, "pending").otherwise("not_required").alias("estado_de_revision"), (F.col("value") > 50).alias("uso_ia"))
    return R.scan_counters(log.select("job_id", F.when(F.col("value") > 10, 1).otherwise(0).alias("adjuntos")), files, errors, done)


_KIND = "CASE l_linenumber % 5 WHEN 0 THEN 'Factura electronica' WHEN 1 THEN '07' WHEN 2 THEN 'NOTA DE CRÉDITO' WHEN 3 THEN '99' ELSE 'Boleta' END"


@query(f"""SELECT 'F' || (l_suppkey % 10) || '-' || l_orderkey AS id, '20' || l_partkey AS ruc, 'F' || (l_suppkey % 10) AS serie, cast(l_orderkey as double) AS numero,
CASE l_linenumber % 5 WHEN 0 THEN 1 WHEN 4 THEN 3 ELSE 7 END AS tipo_num FROM lineitem WHERE l_linenumber % 5 <> 3""")
def voucher_list(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "lineitem").selectExpr(
        "concat('20-', cast(l_partkey as string)) AS ruc", f"{_KIND} AS tipo", "concat(' f', cast(l_suppkey % 10 as string)) AS serie", "concat('N° 00', cast(l_orderkey as string)) AS numero")
    return shown(V.read_voucher_list(raw, "ruc", "tipo", "serie", "numero").drop("tipo_texto"))


@query("""SELECT o_orderkey % 3 = 0 AS descargar_pdf, o_orderkey % 2 = 0 AS descargar_xml, cast(o_orderkey as varchar) AS id FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def retry_missing(spark: SparkSession, sf: str) -> DataFrame:
    results = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "Error").when(F.col("o_orderstatus") == "P", "Parcial").otherwise("OK").alias("estado"),
        F.lit(True).alias("pide_pdf"), F.lit(None).cast("boolean").alias("pide_xml"), (F.col("o_orderkey") % 3 != 0).alias("pdf"), (F.col("o_orderkey") % 2 != 0).alias("xml"))
    return V.retry_missing(results)


@query("""SELECT cast(o_orderkey as varchar) AS id, CASE WHEN x.k IS NULL THEN 'viejo' ELSE 'Emisor ' || x.c END AS emisor, CASE WHEN x.k IS NULL THEN 'Sin XML — descripción no disponible' ELSE 'doc ' || x.k END AS descripcion
FROM orders LEFT JOIN (SELECT l_orderkey AS k, max(l_partkey) AS c FROM lineitem GROUP BY l_orderkey) x ON x.k = o_orderkey""")
def enrich_results(spark: SparkSession, sf: str) -> DataFrame:
    results = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("viejo").alias("emisor"))
    items = table(spark, sf, "lineitem")
    invoices = items.select(F.concat(F.lit(" "), F.col("l_orderkey").cast("string")).alias("id"), F.concat(F.lit("Emisor "), F.col("l_partkey").cast("string")).alias("emisor"),
                            F.concat(F.lit("doc "), F.col("l_orderkey").cast("string")).alias("descripcion"), F.col("l_partkey").alias("archivo"))
    return V.enrich_results(results, invoices).select("id", "emisor", "descripcion")


_PREFIX = "CASE doc_id % 4 WHEN 0 THEN '%PDF-1.4 ' WHEN 1 THEN 'RIFF0000WEBP' WHEN 2 THEN 'GIF89a' ELSE '%PDF-1.4 /JavaScript ' END"
_NAME = "CASE doc_id % 3 WHEN 0 THEN 'recibo (1).pdf' WHEN 1 THEN 'foto.webp' ELSE 'a/b.pdf' END"
_CHECKED = f"""SELECT doc_id, doc_id % 5 AS company_id, strlen(c) AS bytes, sha256(c) AS sha256, n, CASE WHEN strlen(c) < 64 THEN 'archivo_vacio_o_truncado' WHEN strlen(c) > 20000 THEN 'tamano_excedido'
WHEN n LIKE '%/%' THEN 'nombre_invalido' WHEN doc_id % 4 = 2 THEN 'tipo_no_reconocido' WHEN doc_id % 4 = 1 AND n NOT LIKE '%.webp' OR doc_id % 4 IN (0, 3) AND n NOT LIKE '%.pdf' THEN 'extension_no_coincide_con_contenido'
WHEN doc_id % 4 IN (0, 3) AND (strlen(c) - strlen(replace(c, ' obj', ''))) / 4.0 / greatest(1, strlen(c) // 1024) > 40 THEN 'pdf_sospechoso_de_bomba' WHEN doc_id % 4 = 3 THEN 'pdf_con_contenido_activo' END AS motivo
FROM (SELECT doc_id, {_PREFIX} || text AS c, {_NAME} AS n FROM documents)"""


def checked_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as the bytes of a file, validated."""
    from ledgerlab.operators.attachments import validate_attachment

    files = table(spark, sf, "documents").selectExpr(
        "doc_id", "doc_id % 5 AS company_id", f"cast(concat({_PREFIX}, text) as binary) AS content", f"{_NAME} AS nombre", "lpad(cast(doc_id as string), 20, '0') AS path")
    return validate_attachment(files, 20_000)


@query(f"SELECT doc_id, sha256, motivo IS NULL AS ok, coalesce(motivo, '') AS motivo FROM ({_CHECKED})")
def validate_attachments(spark: SparkSession, sf: str) -> DataFrame:
    return checked_files(spark, sf).select("doc_id", "sha256", "ok", F.coalesce("motivo", F.lit("")).alias("motivo"))


@query(f"""WITH v AS ({_CHECKED}) SELECT company_id, sha256, min(doc_id) AS doc_id FROM v WHERE motivo IS NULL
AND (company_id, sha256) NOT IN (SELECT (company_id, sha256) FROM v WHERE n = 'foto.webp') GROUP BY company_id, sha256""")
def new_attachments(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerlab.operators import attachments as T

    checked = checked_files(spark, sf)
    stored = checked.filter("nombre = 'foto.webp'").select("company_id", "sha256")
    return T.new_attachments(checked, stored).select("company_id", "sha256", "doc_id")
