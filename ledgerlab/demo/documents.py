"""Document texts rendered from `orders`, one per row, in SQL both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlab.demo.ledgers import spread, table


def _pad(expression: str, size: int) -> str:
    return f"lpad(cast({expression} as string), {size}, '0')"


_DAY = f"concat({_pad('day(o_orderdate)', 2)}, '/', {_pad('month(o_orderdate)', 2)}, '/', cast(year(o_orderdate) as string))"
_TOTAL = "cast(cast(o_totalprice as decimal(18,2)) as string)"
_TAX = "cast(cast(cast(o_totalprice as decimal(18,2)) * cast(0.18 as decimal(3,2)) as decimal(18,2)) as string)"
_RUC1, _RUC2 = f"concat('20', {_pad('o_custkey', 9)})", f"concat('10', {_pad('o_orderkey', 9)})"
_NUM = _pad("o_orderkey", 8)
_MONTH = ("CASE month(o_orderdate) WHEN 1 THEN 'ENERO' WHEN 2 THEN 'FEBRERO' WHEN 3 THEN 'MARZO' WHEN 4 THEN 'ABRIL' WHEN 5 THEN 'MAYO'"
          " WHEN 6 THEN 'JUNIO' WHEN 7 THEN 'JULIO' WHEN 8 THEN 'AGOSTO' WHEN 9 THEN 'SEPTIEMBRE' WHEN 10 THEN 'OCTUBRE'"
          " WHEN 11 THEN 'NOVIEMBRE' ELSE 'DICIEMBRE' END")


def _text(*lines) -> str:
    """Lines of quoted text; a line may be a list of SQL pieces."""
    parts = [f"concat({', '.join(line)})" if isinstance(line, list) else f"'{line}'" for line in lines]
    return f"concat_ws(chr(10), {', '.join(parts)})"


_SUPPLIER = ["CASE WHEN o_custkey % 2 = 0 THEN 'COMERCIAL NORTE' ELSE 'FERRETERIA SUR' END, ' S.A.C. RUC: '", _RUC1]
_CLIENT = ["'SEÑORES: CLIENTE ', cast(o_custkey as string), ' RUC: '", _RUC2]
_SUMS = (["'OP. GRAVADA S/ '", _TOTAL], ["'IGV 18% S/ '", _TAX], ["'IMPORTE TOTAL S/ '", _TOTAL])
_BILL = (["'Periodo: '", _MONTH, "' ', cast(year(o_orderdate) as string)"], ["'Fecha de Emisión: '", _DAY], ["'VENCIMIENTO: '", _DAY],
         ["'CARGO FIJO S/ 3.45'"], ["'SUBTOTAL '", _TOTAL], ["'I.G.V. S/ '", _TAX], ["'TOTAL A PAGAR S/ '", _TOTAL])

TEMPLATES = [
    _text(_SUPPLIER, "Av. Los Olivos 123 - Lima", "FACTURA ELECTRÓNICA", ["'F001-'", _NUM], ["'Fecha de Emisión: '", _DAY],
          ["'Fecha de Vencimiento: '", _DAY], _CLIENT, "Forma de Pago: Credito 30 dias", "CANTIDAD UNIDAD DESCRIPCION VALOR",
          ["'2.00 UNIDAD Servicio logistico ', cast(o_orderkey % 13 as string), 'x '", _TOTAL], "DESCUENTO 5.00", *_SUMS),
    _text(_SUPPLIER, "BOLETA DE VENTA ELECTRONICA", ["'B002-'", _NUM], ["'Fecha: '", _DAY], ["'Cliente: JUAN PEREZ DNI 4'", _pad("o_custkey % 9999999", 7)],
          "Concepto: venta al contado", ["'SUBTOTAL '", _TOTAL], ["'IGV '", _TAX], ["'TOTAL: '", _TOTAL]),
    _text(_SUPPLIER, "RECIBO POR HONORARIOS ELECTRONICO", ["'E001-'", _NUM], ["'Emitido '", _DAY], "Señor: ESTUDIO LIMA RUC 20100070970",
          "Por concepto de: asesoria contable", ["'HONORARIOS S/ '", _TOTAL], "Moneda: DOLARES"),
    _text(_SUPPLIER, "NOTA DE CRÉDITO ELECTRÓNICA", ["'FC01-'", _NUM], ["'Fecha: '", _DAY], _CLIENT, ["'Doc. Ref. F001-'", _NUM],
          "Documento que modifica: FACTURA", "Motivo: anulacion de la operacion", *_SUMS),
    _text(_SUPPLIER, "NOTA DE DÉBITO ELECTRÓNICA", ["'FD01-'", _NUM], ["'Fecha: '", _DAY], _CLIENT, "Sustento: intereses por mora", *_SUMS),
    _text("LUZ DEL SUR S.A.A.", ["'RUC '", _RUC1], ["'N° DE SUMINISTRO: '", _pad("o_orderkey % 9999999", 7)], "Titular: QUISPE FLORES TEODOSIO",
          "Tarifa: BT5B", ["'LECTURA ANTERIOR: ', cast(o_custkey as string)"], ["'LECTURA ACTUAL: ', cast(o_custkey + 148 as string), ' ('", _DAY, "')'"],
          "CONSUMO DE ENERGIA 148 kWh", "ALUMBRADO PUBLICO S/ 7.10", *_BILL),
    _text("SEDAPAL", ["'RUC '", _RUC1], ["'N° DE CUENTA: '", _pad("o_orderkey % 9999999", 7)], "AGUA POTABLE Y ALCANTARILLADO", "Categoria: Domestico",
          ["'CONSUMO: ', cast(o_custkey % 60 as string), ' m3'"], *_BILL),
    _text("CALIDDA GAS NATURAL", ["'RUC '", _RUC1], ["'N° DE CONTRATO: '", _pad("o_orderkey % 9999999", 7)], "MEDIDOR N° AB-1234",
          ["'CONSUMO: ', cast(o_custkey % 60 as string), ' m3'"], "FACTOR DE CONVERSION: 1.0025", *_BILL),
    _text("MOVISTAR TELEFONIA MOVIL", ["'RUC '", _RUC1], ["'N° DE CUENTA: '", _pad("o_orderkey % 9999999", 9)], "N° DE LINEA: 987 654 321",
          "PLAN TARIFARIO ILIMITADO 50", "ROAMING S/ 12.00", *_BILL),
    _text("PLANILLA DE ASISTENCIA", ["'Quispe Mamani 4'", _pad("o_custkey % 9999999", 7), "' '", _DAY, "' 08:05 17:10 Presente'"],
          ["'Rojas Diaz Ana 4'", _pad("o_orderkey % 9999999", 7), "' '", _DAY, "' 19:00 06:00 X'"], "FIRMA DEL TRABAJADOR"),
    _text("MINERA ANDES S.A.", "BOLETA DE PAGO", ["'RUC: '", _RUC1], ["'MES: '", _MONTH, "'-', cast(year(o_orderdate) as string)"],
          "Nombre: ROJAS DIAZ ANA", ["'N° DNI: 4'", _pad("o_custkey % 9999999", 7)], "Cargo: ANALISTA", "Asegurado en AFP INTEGRA",
          "TOTAL DESCUENTO S/. 120.50", ["'NETO S/. '", _TOTAL], "APORTACION DEL EMPLEADOR ESSALUD"),
    _text("CONSTANCIA DE PAGO - ARRENDAMIENTO 1683", ["'RUC del arrendador: '", _RUC1], ["'Nombre: PEREZ ', cast(o_custkey as string), '   RUC'"],
          ["'RUC del inquilino: '", _RUC2], ["'Periodo tributario: '", _pad("month(o_orderdate)", 2), "'/', cast(year(o_orderdate) as string)"],
          ["'Fecha de pago: '", _DAY], ["'Nro operacion: '", _NUM], ["'Monto de alquiler: S/ '", _TOTAL], ["'Importe pagado: S/ '", _TAX]),
]
TEXT = "CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(TEMPLATES)) + " END"
DOCS_SQL = f"SELECT o_orderkey AS doc_id, {TEXT} AS texto FROM orders"


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A generator renders each text once, as a stored text column would give it.
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")).selectExpr("o_orderkey AS doc_id", f"explode(array({TEXT})) AS texto")


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered documents and the whole prose of `documents`."""
    prose = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).selectExpr("-1 - doc_id AS doc_id", "text AS texto")
    return rendered(spark, sf_dir).unionByName(prose)


ALL_TEXTS_SQL = f"{DOCS_SQL} UNION ALL SELECT -1 - doc_id, text FROM documents"
