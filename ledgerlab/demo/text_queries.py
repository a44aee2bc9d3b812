"""Document classification, field extraction and attendance queries, with their SQL checks.

The checks spell the same rules in the other engine's regex dialect; rules with look-around have
unit tests instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlab.demo import documents as D
from ledgerlab.demo.ledgers import table
from ledgerlab.functions import text as X
from ledgerlab.operators import attendance as A
from ledgerlab.operators import classify as C
from ledgerlab.operators import documents as O

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function
    return add


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _score_sql() -> str:
    points = [(kind, weight, " + ".join(f"regexp_matches(u, {_quote(p)})::int" for p in patterns)) for kind, weight, patterns in C.RULES]
    columns = ", ".join(f"({hits}) * {weight} AS {kind}" for kind, weight, hits in points)
    best = "greatest(" + ", ".join(kind for kind, *_ in points) + ")"
    total = " + ".join(kind for kind, *_ in points)
    named = " ".join(f"WHEN {kind} = {best} THEN '{kind}'" for kind, *_ in points)
    return f"""WITH p AS (SELECT doc_id, {columns} FROM (SELECT doc_id, upper(texto) AS u FROM ({D.ALL_TEXTS_SQL})))
SELECT doc_id, CASE WHEN {best} = 0 THEN 'desconocido' {named} END AS tipo,
CASE WHEN {best} = 0 THEN 0.0 ELSE round_even({best}::double / ({total}), 2) END AS confianza FROM p"""


@query(_score_sql())
def classify_documents(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_type(D.all_texts(spark, sf)).select("doc_id", "tipo", "confianza")


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(u, 'NOTA\\s+DE\\s+CR[EÉ]DITO') THEN 'nota_credito' WHEN regexp_matches(u, 'NOTA\\s+DE\\s+D[EÉ]BITO') THEN 'nota_debito'
WHEN regexp_matches(u, 'RECIBO\\s+POR\\s+HONORARIOS|HONORARIOS\\s+PROFESIONALES') THEN 'recibo_honorarios'
WHEN regexp_matches(u, 'BOLETA\\s+DE\\s+VENTA|\\bB\\d{{3}}\\s*[-–]') THEN 'boleta_venta' ELSE 'factura_electronica' END AS subtipo
FROM (SELECT doc_id, upper(texto) AS u FROM ({D.DOCS_SQL}))""")
def invoice_subtype(spark: SparkSession, sf: str) -> DataFrame:
    return D.rendered(spark, sf).select("doc_id", C.invoice_subtype(F.col("texto")).alias("subtipo"))


@query("""SELECT doc_id, length(trim(regexp_replace(regexp_replace(text, '[^\\S\\n]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))) AS largo,
length(text) - length(replace(text, ' ', '')) AS espacios_antes FROM documents""")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    spaces = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    return docs.select("doc_id", F.length(X.clean_text(F.col("text"))).alias("largo"), spaces.alias("espacios_antes"))


def _ex(pattern: str, group: int = 1, options: str = "i") -> str:
    return f"nullif(regexp_extract(texto, {_quote(pattern)}, {group}, '{options}'), '')"


_ISO = r"regexp_replace({0}, '(\d+)/(\d+)/(\d+)', '\3-\2-\1')"
_RUCS = r"regexp_extract_all(texto, '\b(?:10|15|17|20)\d{9}\b')"
_AMOUNT = r"try_cast(replace({0}, ',', '') as double)"


def _money(*labels: str) -> str:
    forms = []
    for label in labels:
        name = label.replace(".", r"\.")
        forms.append(_AMOUNT.format(_ex(rf"\b{name}\b[^\n]{{0,25}}?S/\s*([\d,]+\.\d{{1,2}})")))
        forms.append(_AMOUNT.format(_ex(rf"\b{name}\b\s*[:\.]?\s*([\d,]+\.\d{{1,2}})")))
    return f"coalesce({', '.join(forms)})"


_ANY_DATE = _ISO.format(f"coalesce({_ex(r'(?:Emisi[oó]n|Emitid[ao]|Fecha[:\s]+)\s*[:\s]*(\d{2}/\d{2}/\d{4})')}, {_ex(r'(\d{2}/\d{2}/\d{4})')})")


def _docs_of(remainder: int) -> str:
    return f"(SELECT * FROM ({D.DOCS_SQL}) WHERE doc_id % 12 = {remainder})"


def _typed(spark: SparkSession, sf: str, kind: str, *names: str) -> DataFrame:
    return O.extract_fields(C.with_type(D.rendered(spark, sf)), kind, only=list(names)).drop("tipo", "confianza")


@query(f"""SELECT doc_id, {_RUCS}[1] AS ruc_proveedor, {_ex(r'(?m)^((?:COMERCIAL NORTE|FERRETERIA SUR) S\.A\.C\.) RUC')} AS razon_social_prov, {_ex(r'Av\.[^\n]{5,80}', 0)} AS direccion_prov,
{_RUCS}[2] AS ruc_cliente, {_ex(r'SEÑORES: (CLIENTE \d+) RUC')} AS razon_social_cli, {_ISO.format(_ex(r'FACTURA ELECTR[OÓ]NICA(?:.|\n){0,300}?(\d{2}/\d{2}/\d{4})'))} AS fecha_emision,
{_ISO.format(_ex(r'Fecha de Vencimiento: (\d{2}/\d{2}/\d{4})'))} AS fecha_vencimiento, {_ex(r'Forma de Pago: ([^\n]{2,30})')} AS condicion_pago,
{_ex(r'\b([A-Z]\d{3})-(\d{5,9})\b', 1, 'c')} AS serie, {_ex(r'\b([A-Z]\d{3})-(\d{5,9})\b', 2, 'c')} AS numero_doc, 'PEN' AS moneda,
{_ex(r'UNIDAD (Servicio logistico \d+x)')} AS descripcion, {_money('OP. GRAVADA')} AS subtotal, {_money('DESCUENTO')} AS descuentos, {_money('IGV')} AS igv,
{_money('IMPORTE TOTAL')} AS total FROM {_docs_of(0)}""")
def invoice_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf, "factura_electronica", *[n for n in O.document_fields("factura_electronica") if n not in ("direccion_cli", "otros_cargos")])


@query(f"""SELECT doc_id, {_RUCS}[1] AS ruc_proveedor, {_ex(r'Cliente: (JUAN PEREZ) DNI')} AS nombre_cliente, {_ANY_DATE} AS fecha_emision, 'B002' AS serie,
{_ex(r'B002-(\d+)')} AS numero_doc, 'venta al contado' AS descripcion, {_money('SUBTOTAL')} AS subtotal, {_money('IGV')} AS igv FROM {_docs_of(1)}""")
def receipt_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf, "boleta_venta", "ruc_proveedor", "nombre_cliente", "fecha_emision", "serie", "numero_doc", "descripcion", "subtotal", "igv")


@query(f"""SELECT doc_id, {_RUCS}[1] AS ruc_emisor, {_ex(r'Señor: (ESTUDIO LIMA)')} AS nombre_cliente, '20100070970' AS ruc_cliente, {_ANY_DATE} AS fecha_emision, 'USD' AS moneda,
'asesoria contable' AS descripcion_servicio, h AS monto_honorarios, 4.0 AS retencion_pct, cast(round(cast(h as decimal(18,2)) * 0.04, 2) as double) AS retencion_monto,
cast(cast(h as decimal(18,2)) - round(cast(h as decimal(18,2)) * 0.04, 2) as double) AS neto_pagar FROM (SELECT *, {_money('HONORARIOS')} AS h FROM {_docs_of(2)})""")
def fee_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf, "recibo_honorarios", "ruc_emisor", "nombre_cliente", "ruc_cliente", "fecha_emision", "moneda", "descripcion_servicio",
                  "monto_honorarios", "retencion_pct", "retencion_monto", "neto_pagar")


@query(f"""SELECT doc_id, {_RUCS}[1] AS ruc_proveedor, {_RUCS}[2] AS ruc_cliente, {_ANY_DATE} AS fecha_emision, 'FACTURA' AS doc_ref_tipo, 'F001' AS doc_ref_serie,
{_ex(r'Doc\. Ref\. F001-(\d{5,9})')} AS doc_ref_numero, 'anulacion de la operacion' AS motivo, {_money('OP. GRAVADA')} AS monto_afectado,
{_money('IMPORTE TOTAL')} AS total FROM {_docs_of(3)}""")
def note_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf, "nota_credito", "ruc_proveedor", "ruc_cliente", "fecha_emision", "doc_ref_tipo", "doc_ref_serie", "doc_ref_numero", "motivo",
                  "monto_afectado", "total")


_BILL_SQL = f"{_ex(r'Periodo: ([A-Z]+\s*\d{4})')} AS periodo, {_ANY_DATE} AS fecha_emision, {_ISO.format(_ex(r'VENCIMIENTO: (\d{2}/\d{2}/\d{4})'))} AS fecha_vencimiento, " \
            f"{_money('CARGO FIJO')} AS @cargo, {_money('SUBTOTAL')} AS subtotal, {_money('TOTAL A PAGAR')} AS total_pagar"
_BILL = ["periodo", "fecha_emision", "fecha_vencimiento"]


@query(f"""SELECT doc_id, 'LUZ DEL SUR' AS empresa, {_RUCS}[1] AS ruc_empresa, 'QUISPE FLORES TEODOSIO' AS nombre_cliente, {_ex(r'SUMINISTRO: (\d{5,10})')} AS numero_suministro,
'BT5B' AS tarifa, try_cast({_ex(r'LECTURA ANTERIOR: (\d+)')} as double) AS lectura_anterior, try_cast({_ex(r'LECTURA ACTUAL: (\d+)')} as double) AS lectura_actual,
{_ISO.format(_ex(r'LECTURA ACTUAL[^\n]*?(\d{2}/\d{2}/\d{4})'))} AS fecha_lectura_actual, 148.0 AS consumo_kwh, 7.1 AS alumbrado_publico, {_BILL_SQL.replace('@cargo', 'cargo_fijo')} FROM {_docs_of(5)}""")
def power_bill_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf, "recibo_luz", "empresa", "ruc_empresa", "nombre_cliente", "numero_suministro", "tarifa", "lectura_anterior", "lectura_actual",
                  "fecha_lectura_actual", "consumo_kwh", "alumbrado_publico", *_BILL, "cargo_fijo", "subtotal", "total_pagar")


@query(f"""SELECT doc_id, 'SEDAPAL' AS empresa, {_ex(r'CUENTA: (\d{5,12})')} AS numero_cuenta, 'Domestico' AS categoria, try_cast({_ex(r'CONSUMO: (\d+) m3')} as double) AS consumo_m3,
{_BILL_SQL.replace('@cargo', 'cargo_fijo')} FROM {_docs_of(6)}""")
def water_bill_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf, "recibo_agua", "empresa", "numero_cuenta", "categoria", "consumo_m3", *_BILL, "cargo_fijo", "subtotal", "total_pagar")


@query(f"""SELECT doc_id, 'CALIDDA' AS empresa, {_ex(r'CONTRATO: (\d{5,12})')} AS numero_contrato, 'AB-1234' AS numero_medidor, try_cast({_ex(r'CONSUMO: (\d+) m3')} as double) AS consumo_m3,
1.0025 AS factor_conversion, {_BILL_SQL.replace('@cargo', 'cargo_fijo')} FROM {_docs_of(7)}""")
def gas_bill_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf, "recibo_gas", "empresa", "numero_contrato", "numero_medidor", "consumo_m3", "factor_conversion", *_BILL, "cargo_fijo", "subtotal", "total_pagar")


@query(f"""SELECT doc_id, 'MOVISTAR' AS empresa, {_ex(r'CUENTA: (\d{5,14})')} AS numero_cuenta, '987654321' AS numero_linea, 'TARIFARIO ILIMITADO 50' AS plan, 'Telefonía Móvil' AS tipo_servicio,
12.0 AS roaming, {_BILL_SQL.replace('@cargo', 'cargos_fijos')} FROM {_docs_of(8)}""")
def phone_bill_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf, "recibo_telefonia", "empresa", "numero_cuenta", "numero_linea", "plan", "tipo_servicio", "roaming", *_BILL, "cargos_fijos", "subtotal", "total_pagar")


@query(f"""SELECT doc_id, 'MINERA ANDES S.A.' AS empresa, {_RUCS}[1] AS ruc_empresa, {_ex(r'MES: ([A-Z]+-\d{4})')} AS periodo, 'ROJAS DIAZ ANA' AS trabajador, {_ex(r'DNI: (\d{8})')} AS dni,
'ANALISTA' AS cargo, 'AFP INTEGRA' AS asegurado_afp, 120.5 AS total_descuento, n AS neto_pagar, cast(cast(n as decimal(18,2)) + 120.50 as double) AS total_ingresos
FROM (SELECT *, {_AMOUNT.format(_ex(r'NETO S/\. ([\d.,]+\.\d{2})'))} AS n FROM {_docs_of(10)})""")
def payslip_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf, "boleta_pago", "empresa", "ruc_empresa", "periodo", "trabajador", "dni", "cargo", "asegurado_afp", "total_descuento", "neto_pagar", "total_ingresos")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(texto, chr(10))) AS texto FROM {_docs_of(9)}),
r AS (SELECT doc_id, {_ex(r'\b(\d{8})\b')} AS dni, {_ex(r'^([A-ZÁÉÍÓÚÑ][a-záéíóúñA-ZÁÉÍÓÚÑ]+(?:\s[A-ZÁÉÍÓÚÑ][a-záéíóúñA-ZÁÉÍÓÚÑ]+){1,3})', 1, 'c')} AS trabajador, {_ANY_DATE} AS fecha,
regexp_extract_all(texto, '\\b\\d{{1,2}}:\\d{{2}}\\b') AS h FROM l)
SELECT doc_id, trabajador, dni, fecha, h[1] AS hora_entrada, h[2] AS hora_salida, true AS firma_presente,
CASE WHEN h[1] = '19:00' THEN 'Noche' ELSE 'Mañana' END AS turno FROM r WHERE dni IS NOT NULL AND trabajador IS NOT NULL""")
def attendance_lines(spark: SparkSession, sf: str) -> DataFrame:
    sheets = C.with_type(D.rendered(spark, sf)).filter("tipo = 'asistencia'")
    out = A.extract_attendance(sheets).drop("orden")
    return out.withColumn("turno", A.detect_shift(F.col("hora_entrada"), F.col("hora_salida")))


_CELL = ("CASE {d} % 6 WHEN 0 THEN 'X' WHEN 1 THEN '08:00-17:00' WHEN 2 THEN '8.5' WHEN 3 THEN 'turno tarde' WHEN 4 THEN '' ELSE 'falta' END")


def _day_cells() -> str:
    return ", ".join(f"{_CELL.format(d=f'(o_custkey + {d})')} AS d{d}" for d in range(1, 13))


@query(f"""WITH c AS (UNPIVOT (SELECT concat('Persona ', cast(o_orderkey as string)) AS trabajador, {_day_cells()} FROM orders) ON COLUMNS('d\\d+') INTO NAME dia VALUE celda)
SELECT trabajador, cast(substr(dia, 2) as int) AS dia, '2024-03-' || lpad(substr(dia, 2), 2, '0') AS fecha,
CASE WHEN celda LIKE '%-%' THEN '08:00:00' END AS hora_entrada, CASE WHEN celda LIKE '%-%' THEN '17:00:00' END AS hora_salida,
CASE WHEN celda LIKE 'turno%' THEN 'Tarde' END AS turno, CASE WHEN celda = '8.5' THEN '8.5' END AS horas FROM c WHERE celda NOT IN ('', 'falta')""")
def attendance_wide(spark: SparkSession, sf: str) -> DataFrame:
    sheet = table(spark, sf, "orders").selectExpr(
        "concat('Persona ', cast(o_orderkey as string)) AS trabajador", *[f"{_CELL.format(d=f'(o_custkey + {d})')} AS `{d}`" for d in range(1, 13)])
    out = A.attendance_wide_to_long(sheet, "trabajador", None, 2024, 3)
    return out.withColumn("horas", F.col("horas_normales").cast("string")).drop("dni", "horas_normales", "firma_presente")
