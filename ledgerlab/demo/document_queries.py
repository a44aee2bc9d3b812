"""Every field of every document type, over two layouts a type, with the values that the layouts were rendered from.

Each order becomes a document in a full layout or in a sparse one with other wordings. A layout is its lines, in SQL that both
engines read, and the value of every field that it holds; fields that a layout leaves out are NULL. The checks take
the values from the table, not from the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerlab.demo import ledgers as L
from ledgerlab.demo.documents import _MONTH, _NUM, _RUC1, _RUC2, _TAX, _TOTAL, _pad
from ledgerlab.operators import documents as O

QUERIES, SQL = {}, {}

_YEAR = "cast(year(o_orderdate) + 28 as string)"
_D, _M = _pad("day(o_orderdate)", 2), _pad("month(o_orderdate)", 2)
_DAY = f"concat({_D}, '/', {_M}, '/', {_YEAR})"
_ISO = f"concat({_YEAR}, '-', {_M}, '-', {_D})"
_LATER = f"concat({_YEAR}, '-12-28')"
_ID = f"concat('4', {_pad('o_custkey % 9999999', 7)})"
_ACCOUNT = f"concat('9', {_pad('o_orderkey % 99999', 5)})"
_SHORT_MONTH = f"substr({_MONTH}, 1, 3)"
_CENT = "cast(cast(o_custkey % 90 + 1 as decimal(18,2)) + cast(0.25 as decimal(18,2)) as string)"


@dataclass(frozen=True)
class Layout:
    """Lines, quoted text or lists of SQL pieces, and the SQL value of each field."""

    lines: list
    values: dict[str, str]


def _text(layout: Layout) -> str:
    parts = [f"concat({', '.join(line)})" if isinstance(line, list) else "'" + line + "'" for line in layout.lines]
    return f"concat_ws(chr(10), {', '.join(parts)})"


def _number(sql: str) -> str:
    return f"cast({sql} as double)"


_T, _X, _C = _number(_TOTAL), _number(_TAX), _number(_CENT)
_SELLER, _SHOP = ["'COMERCIAL NORTE S.A.C. RUC: '", _RUC1], ["'FERRETERIA SUR S.R.L.'"]
_CLIENT = ["'SEÑORES: CLIENTE ', cast(o_custkey as string), ' RUC: '", _RUC2]
_CLIENT_NAME = "concat('CLIENTE ', cast(o_custkey as string))"
_SHORT_DAY = f"concat({_D}, '/', {_M}, '/', substr({_YEAR}, 3, 2))"

_INVOICES = (
    Layout([_SELLER, "Av. Los Olivos 123 - Lima", "FACTURA ELECTRONICA", ["'F001-'", _NUM], ["'Fecha de Emisión: '", _DAY], ["'Fecha de Vencimiento: 28/12/'", _YEAR], _CLIENT,
            "Domicilio Fiscal: Calle Los Pinos 45", "Forma de Pago: Credito 30 dias", "CANTIDAD UNIDAD DESCRIPCION VALOR", ["'2.00 UNIDAD Servicio logistico tipo B '", _TOTAL],
            ["'DESCUENTO '", _CENT], "OTROS CARGOS S/ 2.50", ["'OP. GRAVADA S/ '", _TOTAL], ["'IGV 18% S/ '", _TAX], ["'IMPORTE TOTAL S/ '", _TOTAL]],
           {"ruc_proveedor": _RUC1, "razon_social_prov": "'COMERCIAL NORTE S.A.C.'", "direccion_prov": "'Av. Los Olivos 123 - Lima'", "ruc_cliente": _RUC2, "razon_social_cli": _CLIENT_NAME,
            "direccion_cli": "'Calle Los Pinos 45'", "fecha_emision": _ISO, "fecha_vencimiento": _LATER, "condicion_pago": "'Credito 30 dias'", "serie": "'F001'", "numero_doc": _NUM, "moneda": "'PEN'",
            "descripcion": "'Servicio logistico tipo B'", "subtotal": _T, "descuentos": _C, "igv": _X, "otros_cargos": "2.5", "total": _T}),
    Layout([_SHOP, ["'RUC: '", _RUC1], "FACTURA ELECTRÓNICA", ["'F002-'", _NUM], ["'Emitida el '", _DAY], "Cliente: ACME PERU", "Moneda: USD",
            "Descripción: Cemento gris", ["'Sub Total '", _TOTAL], ["'I.G.V. S/ '", _TAX], ["'TOTAL: '", _CENT]],
           {"ruc_proveedor": _RUC1, "razon_social_prov": "'FERRETERIA SUR S.R.L.'", "razon_social_cli": "'ACME PERU'", "fecha_emision": _ISO, "serie": "'F002'", "numero_doc": _NUM, "moneda": "'USD'",
            "descripcion": "'Cemento gris'", "subtotal": _T, "igv": _X, "total": _C}))

_RECEIPTS = (
    Layout([_SELLER, "BOLETA DE VENTA ELECTRONICA", ["'B002-'", _NUM], ["'Fecha: '", _DAY], ["'Cliente: JUAN PEREZ RUC: '", _RUC2], "Concepto: venta al contado", ["'OP. GRAVADA S/ '", _TOTAL],
            ["'IGV S/ '", _TAX], ["'TOTAL S/ '", _CENT]],
           {"ruc_proveedor": _RUC1, "razon_social_prov": "'COMERCIAL NORTE S.A.C.'", "nombre_cliente": "'JUAN PEREZ'", "ruc_cliente": _RUC2, "fecha_emision": _ISO, "serie": "'B002'", "numero_doc": _NUM,
            "moneda": "'PEN'", "descripcion": "'venta al contado'", "subtotal": _T, "igv": _X, "total": _C}),
    Layout([["'RUC '", _RUC1], "BOLETA DE VENTA", ["'BV-'", _ACCOUNT], ["'Fecha: '", _SHORT_DAY], "Moneda: EUROS", ["'SUBTOTAL '", _TOTAL], ["'Total: '", _CENT]],
           {"ruc_proveedor": _RUC1, "fecha_emision": _ISO, "serie": "'BV'", "numero_doc": _ACCOUNT, "moneda": "'EUR'", "subtotal": _T, "total": _C}))

_FEES_SQL = f"round(cast({_TOTAL} as decimal(18,2)) * 0.04, 2)"
_FEES = (
    Layout([["'ESTUDIO ANDINO S.R.L. RUC: '", _RUC1], ["'DNI: '", _ID], "RECIBO POR HONORARIOS ELECTRONICO", ["'E001-'", _NUM], ["'Emitido '", _DAY], ["'Señor: ESTUDIO LIMA RUC '", _RUC2],
            "Periodo de Servicio: enero a marzo", "Por concepto de: asesoria contable", ["'HONORARIOS S/ '", _TOTAL], ["'RETENCIÓN S/ '", _CENT], ["'NETO A PAGAR S/ '", _TAX]],
           {"ruc_emisor": _RUC1, "nombre_emisor": "'ESTUDIO ANDINO S.R.L.'", "dni_emisor": _ID, "nombre_cliente": "'ESTUDIO LIMA'", "ruc_cliente": _RUC2, "fecha_emision": _ISO,
            "periodo_servicio": "'enero a marzo'", "serie": "'E001'", "numero_doc": _NUM, "moneda": "'PEN'", "descripcion_servicio": "'asesoria contable'", "monto_honorarios": _T, "retencion_pct": "4.0",
            "retencion_monto": _C, "neto_pagar": _X}),
    Layout([["'RUC '", _RUC1], "RECIBO POR HONORARIOS", ["'E002-'", _ACCOUNT], ["'Emitida '", _DAY], "Moneda: DOLARES", ["'MONTO S/ '", _TOTAL]],
           {"ruc_emisor": _RUC1, "fecha_emision": _ISO, "serie": "'E002'", "numero_doc": _ACCOUNT, "moneda": "'USD'", "monto_honorarios": _T, "retencion_pct": "4.0",
            "retencion_monto": _number(_FEES_SQL), "neto_pagar": _number(f"cast({_TOTAL} as decimal(18,2)) - {_FEES_SQL}")}))


def _notes(title: str, series: str, reason: str, reference: str, kind: str) -> tuple[Layout, Layout]:
    return (
        Layout([_SELLER, f"NOTA DE {title} ELECTRÓNICA", [f"'{series}-'", _NUM], ["'Fecha: '", _DAY], _CLIENT, f"{kind}: FACTURA", [f"'{reference} F001-'", _ACCOUNT], f"{reason}: ajuste de la operacion",
                "Detalle del item: Cemento gris", ["'OP. GRAVADA S/ '", _TOTAL], ["'IGV 18% S/ '", _TAX], ["'IMPORTE TOTAL S/ '", _CENT]],
               {"ruc_proveedor": _RUC1, "razon_social_prov": "'COMERCIAL NORTE S.A.C.'", "ruc_cliente": _RUC2, "razon_social_cli": _CLIENT_NAME, "fecha_emision": _ISO, "serie": f"'{series}'",
                "numero_doc": _NUM, "moneda": "'PEN'", "descripcion": "'Cemento gris'", "doc_ref_tipo": "'FACTURA'", "doc_ref_serie": "'F001'", "doc_ref_numero": _ACCOUNT,
                "motivo": "'ajuste de la operacion'", "monto_afectado": _T, "igv": _X, "total": _C}),
        Layout([_SHOP, ["'RUC: '", _RUC1], f"NOTA DE {title}", [f"'{series}-'", _NUM], ["'Emitida: '", _DAY], "Razon Social: ACME PERU", "Moneda: USD", ["'Sub Total '", _TOTAL], ["'TOTAL '", _CENT]],
               {"ruc_proveedor": _RUC1, "razon_social_prov": "'FERRETERIA SUR S.R.L.'", "razon_social_cli": "'ACME PERU'", "fecha_emision": _ISO, "serie": f"'{series}'", "numero_doc": _NUM,
                "moneda": "'USD'", "monto_afectado": _T, "total": _C}))


# What the four bills share: period, dates, sums.
_BILL = [["'Periodo: '", _MONTH, "' '", _YEAR], ["'Fecha de Emisión: '", _DAY], ["'VENCIMIENTO: 28/12/'", _YEAR]]
_BILL_VALUES = {"periodo": f"concat({_MONTH}, ' ', {_YEAR})", "mes": "month(o_orderdate)", "anio": "year(o_orderdate) + 28", "fecha_emision": _ISO, "fecha_vencimiento": _LATER}
_SUMS = [["'SUBTOTAL '", _TOTAL], ["'I.G.V. S/ '", _TAX], "DEUDA ANTERIOR S/ 11.30", ["'TOTAL A PAGAR S/ '", _CENT]]
_SUM_VALUES = {"subtotal": _T, "igv": _X, "deuda_anterior": "11.3", "total_pagar": _C}
_PERSON = ["Titular: QUISPE FLORES TEODOSIO", ["'RUC cliente '", _RUC2]]
_PERSON_VALUES = {"nombre_cliente": "'QUISPE FLORES TEODOSIO'", "ruc_cliente": _RUC2}
# A sparse bill: the due date with a month's short name, no period.
_BARE = [["'VENCE: '", _D, "'/'", _SHORT_MONTH, "'/'", _YEAR], ["'Total a Pagar: '", _CENT]]
_BARE_VALUES = {"fecha_vencimiento": _ISO, "total_pagar": _C, "anio": "year(o_orderdate) + 28", "mes": "month(o_orderdate)"}

_POWER = (
    Layout(["LUZ DEL SUR S.A.A.", ["'RUC '", _RUC1], ["'N° DE SUMINISTRO: '", _ACCOUNT], *_PERSON, "Direccion del Suministro: Jr. Puno 456", "Tarifa: BT5B", *_BILL,
            ["'LECTURA ANTERIOR: ', cast(o_custkey as string), ' ('", _DAY, "')'"], ["'LECTURA ACTUAL: ', cast(o_custkey + 148 as string), ' (28/12/'", _YEAR, "')'"], "CONSUMO DE ENERGIA 148 kWh",
            "CARGO FIJO S/ 3.45", "ENERGÍA ACTIVA S/ 70.10", "ALUMBRADO PUBLICO S/ 7.10", "MANTENIMIENTO S/ 1.20", "REAJUSTE S/ 0.15", "REDONDEO S/ 0.05", *_SUMS],
           {"empresa": "'LUZ DEL SUR'", "ruc_empresa": _RUC1, **_PERSON_VALUES, "numero_suministro": _ACCOUNT, "direccion_suministro": "'Jr. Puno 456'", "tarifa": "'BT5B'", **_BILL_VALUES,
            "lectura_anterior": _number("o_custkey"), "fecha_lectura_anterior": _ISO, "lectura_actual": _number("o_custkey + 148"), "fecha_lectura_actual": _LATER, "consumo_kwh": "148.0",
            "cargo_fijo": "3.45", "energia_activa": "70.1", "alumbrado_publico": "7.1", "mantenimiento_redes": "1.2", "reajuste": "0.15", "redondeo": "0.05", **_SUM_VALUES,
            "serie": _ACCOUNT, "numero_doc": _ACCOUNT}),
    Layout(["ENEL", ["'Suministro: '", _ACCOUNT], "QUISPE FLORES ANA", *_BARE, "120 kWh"],
           {"empresa": "'ENEL'", "nombre_cliente": "'QUISPE FLORES ANA'", "numero_suministro": _ACCOUNT, **_BARE_VALUES, "consumo_kwh": "120.0", "serie": _ACCOUNT, "numero_doc": _ACCOUNT}))

_WATER = (
    Layout(["SEDAPAL", ["'RUC '", _RUC1], ["'N° DE CUENTA: '", _ACCOUNT], *_PERSON, "Direccion: Jr. Puno 456", "Categoria: Domestico", *_BILL, ["'CONSUMO: ', cast(o_custkey % 60 as string), ' m3'"],
            "Rango: 0 - 20 m3", "CARGO FIJO S/ 3.45", "AGUA POTABLE S/ 22.00", "ALCANTARILLADO S/ 9.90", "TRATAMIENTO S/ 1.10", *_SUMS],
           {"empresa": "'SEDAPAL'", "ruc_empresa": _RUC1, **_PERSON_VALUES, "numero_cuenta": _ACCOUNT, "direccion": "'Jr. Puno 456'", "categoria": "'Domestico'", **_BILL_VALUES,
            "consumo_m3": _number("o_custkey % 60"), "rango_consumo": "'0 - 20 m3'", "cargo_fijo": "3.45", "agua_potable": "22.0", "alcantarillado": "9.9", "tratamiento_aguas": "1.1", **_SUM_VALUES,
            "serie": _ACCOUNT, "numero_doc": _ACCOUNT, "total": _C}),
    Layout(["EPS GRAU", *_BARE, "17 m3"],
           {"empresa": "'EPS GRAU'", **_BARE_VALUES, "consumo_m3": "17.0", "total": _C}))

_GAS = (
    Layout(["CALIDDA GAS NATURAL", ["'RUC '", _RUC1], ["'N° DE CONTRATO: '", _ACCOUNT], *_PERSON, "MEDIDOR N° AB-1234", "Direccion: Jr. Puno 456", "Uso: Residencial", *_BILL,
            ["'LECTURA ANTERIOR: ', cast(o_custkey as string)"], ["'LECTURA ACTUAL: ', cast(o_custkey + 12 as string)"], ["'CONSUMO: ', cast(o_custkey % 60 as string), ' m3'"],
            "FACTOR DE CONVERSION: 1.0025", "kWh: 130.5", "CARGO FIJO S/ 3.45", "CARGO VARIABLE S/ 8.80", "COMERCIALIZACION S/ 0.75", *_SUMS],
           {"empresa": "'CALIDDA'", "ruc_empresa": _RUC1, **_PERSON_VALUES, "numero_contrato": _ACCOUNT, "numero_medidor": "'AB-1234'", "direccion": "'Jr. Puno 456'", "uso": "'Residencial'", **_BILL_VALUES,
            "lectura_anterior": _number("o_custkey"), "lectura_actual": _number("o_custkey + 12"), "consumo_m3": _number("o_custkey % 60"), "factor_conversion": "1.0025", "consumo_kwh": "130.5",
            "cargo_fijo": "3.45", "cargo_variable": "8.8", "cargo_comercializacion": "0.75", **_SUM_VALUES, "serie": _ACCOUNT, "numero_doc": _ACCOUNT, "total": _C}),
    Layout(["CONTUGAS", ["'CLIENTE '", _ACCOUNT], *_BARE], {"empresa": "'CONTUGAS'", **_BARE_VALUES, "total": _C}))

_PHONE = (
    Layout(["MOVISTAR TELEFONIA MOVIL", ["'RUC '", _RUC1], ["'N° DE CUENTA: '", _ACCOUNT], *_PERSON, "N° DE LINEA: 987 654 321", "PLAN ILIMITADO 50", "INTERNET", *_BILL, "CARGO FIJO S/ 3.45",
            "CARGOS VARIABLES S/ 4.20", "DATOS ADICIONALES S/ 2.10", "ROAMING S/ 12.00", "DESCUENTO S/ 1.00", *_SUMS],
           {"empresa": "'MOVISTAR'", "ruc_empresa": _RUC1, **_PERSON_VALUES, "numero_cuenta": _ACCOUNT, "numero_linea": "'987654321'", "plan": "'ILIMITADO 50'", "tipo_servicio": "'Telefonía Móvil + Internet'",
            **_BILL_VALUES, "cargos_fijos": "3.45", "cargos_variables": "4.2", "datos_adicionales": "2.1", "roaming": "12.0", "descuentos": "1.0", **_SUM_VALUES, "serie": _ACCOUNT, "numero_doc": _ACCOUNT,
            "total": _C}),
    Layout(["ENTEL", "912345678", *_BARE], {"empresa": "'ENTEL'", "numero_linea": "'912345678'", **_BARE_VALUES, "total": _C}))

_PAYSLIPS = (
    Layout(["MINERA ANDES S.A.", "BOLETA DE PAGO", ["'RUC: '", _RUC1], ["'MES: '", _MONTH, "'-'", _YEAR], "Nombre: ROJAS DIAZ ANA", ["'N° DNI: '", _ID], "Cargo: ANALISTA", "Codigo: AB12",
            ["'Fecha Ingreso: '", _DAY], "Dias Efectivos Trabajados: 30", "Asegurado en AFP INTEGRA", ["'Basico Mes: '", _TOTAL], ["'TOTAL INGRESOS S/. '", _TOTAL], "TOTAL DESCUENTO S/. 120.50",
            "TOTAL APORTE S/. 90.10", ["'NETO S/. '", _CENT]],
           {"empresa": "'MINERA ANDES S.A.'", "ruc_empresa": _RUC1, "periodo": f"concat({_MONTH}, '-', {_YEAR})", "trabajador": "'ROJAS DIAZ ANA'", "dni": _ID, "cargo": "'ANALISTA'", "codigo": "'AB12'",
            "fecha_ingreso": _DAY, "dias_trabajados": "'30'", "asegurado_afp": "'AFP INTEGRA'", "basico": _T, "total_ingresos": _T, "total_descuento": "120.5", "total_aporte": "90.1", "neto_pagar": _C}),
    Layout(["PESQUERA SUR", "Nombre: LUZ VEGA", "TOTAL DESCUENTO S/. 10.50", ["'NETO S/. '", _TOTAL]],
           {"empresa": "'PESQUERA SUR'", "trabajador": "'LUZ VEGA'", "total_descuento": "10.5", "neto_pagar": _T,
            "total_ingresos": _number(f"cast({_TOTAL} as decimal(18,2)) + 10.50")}))

LAYOUTS = {
    "factura_electronica": ("all_invoice_fields", _INVOICES), "boleta_venta": ("all_receipt_fields", _RECEIPTS), "recibo_honorarios": ("all_fee_fields", _FEES),
    "nota_credito": ("all_credit_note_fields", _notes("CRÉDITO", "C001", "Motivo", "Doc. Ref.", "Documento que modifica")),
    "nota_debito": ("all_debit_note_fields", _notes("DÉBITO", "D001", "Sustento", "Referencia:", "Comprobante que afecta")),
    "recibo_luz": ("all_power_bill_fields", _POWER), "recibo_agua": ("all_water_bill_fields", _WATER), "recibo_gas": ("all_gas_bill_fields", _GAS),
    "recibo_telefonia": ("all_phone_bill_fields", _PHONE), "boleta_pago": ("all_payslip_fields", _PAYSLIPS),
}


def _add(kind: str, name: str, layouts: tuple[Layout, Layout]) -> None:
    full, sparse = layouts
    text = f"CASE WHEN o_orderkey % 2 = 0 THEN {_text(full)} ELSE {_text(sparse)} END"
    fields = O.document_fields(kind)
    unknown = (set(full.values) | set(sparse.values)) - set(fields)
    if unknown:
        raise ValueError(f"{kind} has no fields {unknown}")
    value = lambda field: f"CASE WHEN o_orderkey % 2 = 0 THEN {full.values.get(field, 'NULL')} ELSE {sparse.values.get(field, 'NULL')} END AS {field}"

    def query(spark: SparkSession, sf: str) -> DataFrame:
        # A generator renders each text once, as a stored text column would give it.
        docs = L.spread(L.table(spark, sf, "orders")).selectExpr("o_orderkey AS doc_id", f"explode(array({text})) AS texto")
        return O.extract_fields(docs, kind)

    query.__name__, query.__doc__ = name, f"Every field of {kind}, by a full layout and a sparse one."
    QUERIES[name], SQL[name] = query, f"SELECT o_orderkey AS doc_id, {', '.join(map(value, fields))} FROM orders"


for _kind, (_name, _layouts) in LAYOUTS.items():
    _add(_kind, _name, _layouts)
