"""Typed fields of each document type, as one projection over the text column.

A type is a table of `field -> rule`; a rule turns the text Column into a value Column. Nothing
here runs per row in Python: `extract_fields` is a filter and a select.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlab.errors import InvalidSpec
from ledgerlab.functions import text as X
from ledgerlab.functions.values import let

Rule = Callable[..., Column]
_UPPER = "_mayusculas"
_UP = "A-ZÁÉÍÓÚÑ"

# --- rule constructors -----------------------------------------------------------------------


def with_upper(rule: Rule) -> Rule:
    """A rule that takes the text in upper case too, to pass over what a text does not hold."""
    rule.with_upper = True
    return rule


def money(*labels: str) -> Rule:
    return with_upper(lambda t, upper=None: X.amount(t, list(labels), upper))


def captured(*patterns: str, group: int = 1) -> Rule:
    """First pattern that matches, stripped."""
    return lambda t: F.coalesce(*[X.grab(t, p, group) for p in patterns])


def measured(*patterns: str) -> Rule:
    """First pattern that matches, as a number."""
    return lambda t: F.coalesce(*[X.hit(t, p).try_cast("double") for p in patterns])


def ruc(position: int) -> Rule:
    return lambda t: X.ruc_at(t, position)


def dated(pattern: str) -> Rule:
    return lambda t: X.labelled_date(t, pattern)


def company(names: list[str], *fallbacks: tuple[str, str | None]) -> Rule:
    """First listed name in the upper-cased text, else a pattern's fixed name (None: its match)."""
    def rule(t: Column) -> Column:
        def first(upper: Column) -> Column:
            listed = [F.when(upper.contains(n), n) for n in names]
            other = [F.when(X.found(upper, p, ""), name) if name else X.grab(upper, p, 0, "") for p, name in fallbacks]
            return F.coalesce(*listed, *other)
        return let(F.upper(t), first)
    return rule


def series(t: Column) -> Column:
    return X.voucher(t)[0]


def voucher_no(t: Column) -> Column:
    return X.voucher(t)[1]


# --- fixed values: patterns -------------------------------------------------------------------
_SUPPLIER_RUC = rf"([{_UP}][^\n]+)\s+RUC[:\s]+(\d{{11}})"
_SUPPLIER_NAME_LINE = (rf"^([{_UP}][{_UP}A-Za-záéíóúñ\s\.\-&,]+(?:S\.A\.C\.?|S\.R\.L\.?|E\.I\.R\.L\.?|SAC|SRL|EIRL|S\.A\.))\s+RUC")
_SUPPLIER_NAME_ALONE = rf"^([{_UP}][A-Z\s\.&]+(?:S\.A\.C?\.?|S\.R\.L\.?|E\.I\.R\.L\.?|SAC|SRL|EIRL))\s*$"
_COMPANY_FORM = r"S\.A\.|S\.R\.L|E\.I\.R\.L|SAC|SRL|EIRL"
_CLIENT_RUC_BLOCK = r"SE.OR[^:\n]*:\s*.{3,80}?RUC[:\s]+(\d{11})"
_CLIENT_RUC = r"(?:CLIENTE|RUC\s+(?:del)?\s*(?:cliente|comprador))[:\s]+(\d{11})"
_CLIENT_NAME_BLOCK = rf"SE.OR[^:\n]*:\s*([{_UP}][^\n]{{3,80}}?)\s+RUC"
_CLIENT_NAME = rf"(?:Se[ñn]or(?:es)?|Señores|Cliente|Raz[oó]n\s+Social)\s*:\s*([{_UP}][^\n]{{3,60}})"
_BUYER_NAME = rf"(?:Se[ñn]or(?:es)?|Cliente|Comprador|Adquirente)\s*[:\-]?\s*([{_UP}][^\n]{{3,60}})"
_SUPPLIER_ADDRESS = r"(?:Direcci[oó]n|Domicilio|Av\.|Jr\.|Cal\.|Urb\.)[^\n]{5,80}"
_CLIENT_ADDRESS = r"(?:Direcci[oó]n\s+(?:del)?\s*(?:cliente|comprador)|Domicilio\s+Fiscal)[:\s]+([^\n]{5,80})"
_INVOICE_DATE = r"FACTURA\s+ELECTR[OÓ]NICA.{0,300}?(\d{2}[/\-]\d{2}[/\-]\d{4})"
_INVOICE_DUE = r"(?:Fecha\s+(?:de\s+)?Vencimiento|Vence|Vto\.?)\s*[:\-]?\s*(\d{2}[/\-]\d{2}[/\-]\d{4})"
_TERMS = r"(?:Condici[oó]n\s+(?:de\s+)?Pago|Forma\s+de\s+Pago)\s*[:\-]?\s*([^\n]{2,30})"
_DOLLARS, _EUROS = r"\bUSD\b|\bD[OÓ]LARES?\b|\$\s*\d", r"\bEUR\b|\bEUROS?\b"
_DNI = r"\b(\d{8})\b"
_SERVICE_PERIOD = r"(?:Periodo|Per[íi]odo)\s+(?:de\s+)?(?:Servicio|Trabajo)[:\s]*([^\n]{3,30})"
_REF_KIND = r"(?:Comprobante|Documento)\s+que\s+(?:modifica|afecta)\s*[:\-]?\s*([^\n]{3,30})"
_REF_SERIES = r"(?:Doc\.?\s+Ref\.?|Referencia|Afecta\s+a?)\s*[:\-]?\s*([A-Z]\d{3})\s*[-–]"
_REF_NUMBER = r"(?:Doc\.?\s+Ref\.?|Referencia|Afecta\s+a?)\s*[:\-]?\s*[A-Z]\d{3}\s*[-–]\s*(\d{5,9})"
_REASON = r"(?:Motivo|Sustento|Glosa|Descripci[oó]n)\s*[:\-]?\s*([^\n]{5,120})"
_BILL_PERIOD = r"(?:Periodo|Per[íi]odo)\s*[:\-]?\s*([A-Z]+\s*\d{4})"
_ITEM_HEAD = r"descripci[oó]n|concepto|detalle"
_ITEM_SAME_LINE = r"(?:descripci[oó]n|concepto|detalle)[^:\n]{0,25}:\s*(.{4,120})"
_ITEM_NUMBER = r"(?:s/\.?|[\d.,/%()$-]+)"
_LETTER = "[A-Za-zÁÉÍÓÚÑáéíóúñ]"
_ITEM_ROWS, _ITEM_LENGTH = 15, 120
_UNITS = ["unidad", "unidades", "und", "unid", "niu", "zz", "kg", "kgm", "grm", "ltr", "gln", "mtr", "m2", "m3", "pza",
          "cja", "box", "bls", "doc", "par", "gr", "lt", "mt"]
_ITEM_SKIPPED = ["cantidad", "unidad medida", "unidad de medida", "valor unitario", "precio unitario", "precio",
                 "valor venta", "importe", "importe total", "icbper", "isc", "igv", "descuento", "descuentos", "sub total",
                 "subtotal", "total", "codigo", "código", "cod", "item", "monto", "afecto", "num", "nro"]
_ITEM_SKIPPED_STARTS = r"^(?:valor |precio |importe|sub total|otros |mto)"
POWER_COMPANIES = ["ENEL", "LUZ DEL SUR", "ELECTRO ORIENTE", "SEAL", "ELSE", "ELECTRO SUR ESTE", "HIDRANDINA", "ENOSA",
                   "ELECTRONOROESTE", "ELECTROCENTRO", "ELECTRO PUNO", "PLUZ", "PLUZ ENERGIA", "EDELNOR",
                   "ELECTRO UCAYALI", "ADINELSA", "ELECTRO NORTE"]
POWER_MISREAD = [(r"PI\.U\b|NUZ\s*ENER", "PLUZ ENERGIA PERU S.A.A."), (r"LUZ\s+DEL\s+S", "LUZ DEL SUR S.A.A."),
                 (r"ENEL\s+DISTRIB", "ENEL DISTRIBUCION PERU S.A.A."), (r"HIDRANDINA", "HIDRANDINA S.A."),
                 (r"ELECTROCENTRO", "ELECTROCENTRO S.A."), (r"ELECTRO\s+SUR\s+ESTE", "ELECTRO SUR ESTE S.A.A."),
                 (r"SEAL\b", "SEAL S.A.")]
WATER_COMPANIES = ["SEDAPAL", "SEDACHIMBOTE", "SEDA CUSCO", "SEDACUSCO", "SEDALIB", "SEDAPAR", "EMFAPATUMBES",
                   "AGUAS DE LIMA", "EPS GRAU", "EPS ILO", "EPS TACNA", "EMAPA HUACHO", "EMAPA PASCO",
                   "EMAPA HUANCAVELICA", "EMSAP", "SEMAPACH"]
GAS_COMPANIES = ["CALIDDA", "CÁLIDDA", "GASES DEL PACIFICO", "GASES DEL PACÍFICO", "QUAVII", "CONTUGAS", "GNC PERU", "GNC PERÚ"]
PHONE_COMPANIES = ["CLARO", "MOVISTAR", "ENTEL", "BITEL", "WOM", "VIRGIN MOBILE", "AMERICA MOVIL", "TELEFONICA", "TELEFONÍCA"]
PHONE_SERVICES = [(r"CELULAR|M[OÓ]VIL|SMARTPHONE", "Telefonía Móvil"),
                  (r"TELEFON[IÍ]A\s+FIJA|L[IÍ]NEA\s+FIJA", "Telefonía Fija"),
                  (r"INTERNET|BANDA\s+ANCHA|FIBRA\s+[OÓ]PTICA|FIBRA\s+OPTICA", "Internet"),
                  (r"CABLE|TV\s+CABLE|TELEVISION", "TV Cable")]
_NAME_LINE = rf"^[{_UP}]{{3,}}(?:\s+[{_UP}]{{2,}}){{1,4}}$"
_NAME_LINE_NOT = ["DATOS", "LECTURA", "CONSUMO", "PERIODO", "PLIEGO", "SISTEMA", "ENERG", "VENCIM"]
_READING_DAY = r"[^\n]*?[\(\[]?(\d{2}/\d{2}/\d{4}|\d{2}/[A-Z]{3}/\d{4})[\)\]]?"
FEE_RETENTION = 0.04

# --- rules with more than one step -------------------------------------------------------------


def supplier_ruc(t: Column) -> Column:
    """The number after a name and RUC on one line, else the first number of the text."""
    labelled = X.guarded(t, r"RUC[:\s]+\d{11}", X.hit(t, _SUPPLIER_RUC, 2))
    return F.coalesce(labelled, X.ruc_at(t, 0))


def supplier_name(t: Column) -> Column:
    return X.guarded(t, _COMPANY_FORM, F.coalesce(
        X.grab(t, _SUPPLIER_NAME_LINE, 1, "im"), X.grab(t, _SUPPLIER_NAME_ALONE, 1, "m")))


def client_ruc(t: Column) -> Column:
    return F.coalesce(X.hit(t, _CLIENT_RUC_BLOCK, 1, "is"), X.hit(t, _CLIENT_RUC), X.ruc_at(t, 1))


def buyer_name(t: Column) -> Column:
    """A name, cut where the next label starts."""
    name = X.grab(t, _BUYER_NAME)
    return X.strip(F.get(F.split(name, X.rx(r"\s+(?:RUC|DNI|Doc)\b", "i"), 2), F.lit(0)))


def invoice_date(t: Column) -> Column:
    return F.coalesce(let(X.hit(t, _INVOICE_DATE, 1, "is"), X.any_date), X.any_date(t))


@with_upper
def currency(t: Column, upper: Column | None = None) -> Column:
    dollars, euros = X.found(t, _DOLLARS), X.found(t, _EUROS)
    if upper is not None:
        dollars, euros = (upper.contains("USD") | upper.contains("LAR") | upper.contains("$")) & dollars, upper.contains("EUR") & euros
    return F.when(dollars, "USD").when(euros, "EUR").otherwise("PEN")


def _row_item(line: Column) -> Column:
    """Item name of a table row: leading quantities and units and trailing amounts removed."""
    spaced = F.regexp_replace(line, X.rx(r"\s+"), " ")
    head = rf"^(?:(?:{_ITEM_NUMBER}|{'|'.join(_UNITS)})(?: |$))+"
    no_head = F.regexp_replace(spaced, X.rx(head, "i"), "")
    item = X.strip(F.regexp_replace(no_head, X.rx(rf"(?:(?:^| ){_ITEM_NUMBER})+$", "i"), ""))
    return let(item, lambda name: F.when(name.rlike(_LETTER), name))


def item_description(t: Column) -> Column:
    """Text after the description label, else the first data row below that heading."""
    return X.guarded(t, _ITEM_HEAD, let(X.lines_of(t), _item_of_lines))


def _item_of_lines(lines: Column) -> Column:
    # Lines behind the first heading, and rows behind the first one with a name, are not looked at.
    step = lambda state, line: F.struct((state["n"] + 1).alias("n"), F.when(
        state["at"].isNotNull(), state["at"]).when(X.found(line, _ITEM_HEAD), state["n"]).alias("at"))
    first = F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("at")), step, lambda state: state["at"])
    return let(first, lambda at: F.substring(F.coalesce(
        let(X.grab(F.get(lines, at), _ITEM_SAME_LINE), lambda same: F.when(same.rlike("[A-Za-zÁÉÍÓÚÑ]"), same)),
        _first_row(F.slice(lines, at + 2, F.lit(_ITEM_ROWS)))), 1, _ITEM_LENGTH))


def _first_row(below: Column) -> Column:
    number_line = X.rx(rf"^{_ITEM_NUMBER}$", "i")

    def is_row(line: Column) -> Column:
        low = F.regexp_replace(F.lower(line), "[.:]+$", "")
        return ~(line.rlike(number_line) | low.isin(_ITEM_SKIPPED + _UNITS) | (F.length(line) < 4) | low.rlike(_ITEM_SKIPPED_STARTS))

    return F.aggregate(below, F.lit(None).cast("string"), lambda item, line: F.when(item.isNotNull(), item).when(is_row(line), _row_item(line)))


def _upper_name_line(t: Column) -> Column:
    def is_name(line: Column) -> Column:
        clean = line.rlike(X.rx(_NAME_LINE))
        for word in _NAME_LINE_NOT:
            clean = clean & ~line.contains(word)
        return clean
    return X.first_of(F.filter(X.lines_of(t), is_name))


def _power_client(t: Column) -> Column:
    label = rf"(?:Cliente|Titular|Propietario|Suministrado\s+a|Nombre)\s*[:\-]?\s*([{_UP}][^\n]{{3,60}})"
    return F.coalesce(X.grab(t, label), _upper_name_line(t))


def _supply_number(t: Column) -> Column:
    alone = F.transform(X.lines_of(t), lambda line: F.trim(line, F.lit("| ")))
    return F.coalesce(
        X.hit(t, r"N[°º\.ro]*\s*(?:DE\s+)?SUMINISTRO\s*[:\-]?\s*(\d{5,10})"), X.hit(t, r"\bSuministro\b[:\s]+(\d{5,10})"),
        X.hit(t, r"\b(\d{7})\b"), X.first_of(F.filter(alone, lambda line: line.rlike(r"^\d{6,9}$"))))


def _phone_line(t: Column) -> Column:
    labelled = X.hit(t, r"N[°º\.ro]*\s*(?:DE\s+)?(?:L[IÍ]NEA|TEL[EÉ]FONO|CELULAR|NÚMERO)\s*[:\-]?\s*(\d[\d\s\-]{6,12}\d)")
    return F.coalesce(F.regexp_replace(labelled, X.rx(r"[\s\-]"), ""), X.hit(t, r"\b(9\d{8})\b"))


def _phone_services(t: Column) -> Column:
    return F.nullif(let(F.upper(t), lambda upper: F.concat_ws(
        " + ", *[F.when(X.found(upper, p, ""), name) for p, name in PHONE_SERVICES])), F.lit(""))


def _fee_amount(t: Column) -> Column:
    return X.amount(t, ["HONORARIOS", "IMPORTE", "MONTO"])


def _fee_retention(t: Column) -> Column:
    read = F.nullif(X.amount(t, ["RETENCIÓN", "RETENCION", "RETENC"]), F.lit(0.0))
    return F.coalesce(read, let(_fee_amount(t), lambda fees: F.when(fees != 0, F.round(fees * FEE_RETENTION, 2))))


def _fee_net(t: Column) -> Column:
    read = F.nullif(X.amount(t, ["NETO A PAGAR", "NETO", "IMPORTE NETO"]), F.lit(0.0))
    return F.coalesce(read, let(_fee_amount(t), lambda fees: F.when(
        fees != 0, F.round(fees - F.coalesce(_fee_retention(t), F.lit(0.0)), 2))))


_PAY_MONEY = r"([\d.,]+\.\d{2})"


def _pay_value(label: str, value: str = rf"([{_UP}0-9][^\n]+)") -> Rule:
    return lambda t: X.grab(t, rf"{label}\s*:?\s*{value}")


def _pay_money(label: str) -> Rule:
    return lambda t: X.number(X.hit(t, rf"{label}\s*{_PAY_MONEY}"))


_pay_deductions, _pay_net = _pay_money(r"TOTAL\s+DESCUENTO\s+S/\."), _pay_money(r"NETO\s+S/\.")


def _pay_income(t: Column) -> Column:
    before = X.number(X.hit(t, rf"{_PAY_MONEY}\s*\n\s*TOTAL\s+DESCUENTO"))
    return F.coalesce(_pay_money(r"TOTAL\s+INGRESOS\s+S/\.")(t), before, F.round(_pay_net(t) + _pay_deductions(t), 2))


# --- fields per type ---------------------------------------------------------------------------
_VOUCHER = {"serie": series, "numero_doc": voucher_no, "moneda": currency}
_IGV3 = ("IGV", "I.G.V", "I.G.V.")
_AFFECTED = ("OP. AFECTA", "OP. GRAVADA", "SUBTOTAL", "Sub Total")

_INVOICE = {
    "ruc_proveedor": supplier_ruc, "razon_social_prov": supplier_name,
    "direccion_prov": captured(_SUPPLIER_ADDRESS, group=0), "ruc_cliente": client_ruc,
    "razon_social_cli": captured(_CLIENT_NAME_BLOCK, _CLIENT_NAME), "direccion_cli": captured(_CLIENT_ADDRESS),
    "fecha_emision": invoice_date, "fecha_vencimiento": lambda t: let(X.hit(t, _INVOICE_DUE), X.any_date),
    "condicion_pago": captured(_TERMS), **_VOUCHER, "descripcion": item_description,
    "subtotal": money("OP. AFECTA", "OP. GRAVADA", "OP. INAFECTA", "OP. EXONERADA", "SUBTOTAL", "Sub Total"),
    "descuentos": money("DESCUENTO", "DSCTO", "REBAJA"), "igv": money(*_IGV3, "IGV 18%"),
    "otros_cargos": money("OTROS CARGOS", "PERCEPCION", "DETRACCION"),
    "total": money("IMPORTE TOTAL", "TOTAL A PAGAR", "TOTAL", "Importe Total"),
}
_RECEIPT = {
    "ruc_proveedor": supplier_ruc, "razon_social_prov": supplier_name, "nombre_cliente": buyer_name, "ruc_cliente": ruc(1),
    "fecha_emision": X.any_date, **_VOUCHER, "descripcion": item_description, "subtotal": money(*_AFFECTED),
    "igv": money(*_IGV3, "IGV 18%"), "total": money("TOTAL", "IMPORTE TOTAL", "Total"),
}
_FEES = {
    "ruc_emisor": supplier_ruc, "nombre_emisor": supplier_name, "dni_emisor": captured(_DNI), "nombre_cliente": buyer_name,
    "ruc_cliente": ruc(1), "fecha_emision": X.any_date, "periodo_servicio": captured(_SERVICE_PERIOD), **_VOUCHER,
    "descripcion_servicio": item_description, "monto_honorarios": _fee_amount, "retencion_pct": lambda t: F.lit(4.0),
    "retencion_monto": _fee_retention, "neto_pagar": _fee_net,
}
_NOTE = {
    "ruc_proveedor": supplier_ruc, "razon_social_prov": supplier_name, "ruc_cliente": client_ruc,
    "razon_social_cli": captured(_CLIENT_NAME_BLOCK, _CLIENT_NAME), "fecha_emision": invoice_date, **_VOUCHER,
    "descripcion": item_description, "doc_ref_tipo": captured(_REF_KIND), "doc_ref_serie": captured(_REF_SERIES),
    "doc_ref_numero": captured(_REF_NUMBER), "motivo": captured(_REASON), "monto_afectado": money(*_AFFECTED),
    "igv": money(*_IGV3), "total": money("IMPORTE TOTAL", "TOTAL", "Total"),
}
_BILL_DATES = {"periodo": captured(_BILL_PERIOD), "mes": X.month_named, "anio": X.year_in, "fecha_emision": X.any_date,
               "fecha_vencimiento": X.due_date}
_BILL_TOTAL = money("TOTAL A PAGAR", "IMPORTE TOTAL", "TOTAL")
_POWER = {
    "empresa": company(POWER_COMPANIES, *POWER_MISREAD), "ruc_empresa": ruc(0), "nombre_cliente": _power_client,
    "ruc_cliente": ruc(1), "numero_suministro": _supply_number,
    "direccion_suministro": captured(r"(?:Direcci[oó]n|Domicilio|Predio|Inmueble)\s*(?:del?\s+Suministro)?[:\-]?\s*([^\n]{5,80})"),
    "tarifa": captured(r"(?:Tarifa|Tipo\s+de\s+Tarifa|Pliego\s+Tarifario)\s*[:\-]?\s*([^\n]{2,20})"), **_BILL_DATES,
    "lectura_anterior": measured(r"LECTURA\s+ANTERIOR\s*[:\-]?\s*(\d+)"), "fecha_lectura_anterior": dated(r"LECTURA\s+ANTERIOR" + _READING_DAY),
    "lectura_actual": measured(r"LECTURA\s+ACTUAL\s*[:\-]?\s*(\d+)"), "fecha_lectura_actual": dated(r"LECTURA\s+ACTUAL" + _READING_DAY),
    "consumo_kwh": measured(r"(?:CONSUMO|ENERGIA\s+ACTIVA)[^\n]{0,30}?(\d+(?:\.\d+)?)\s*kWh", r"(\d+)\s*kWh\b"),
    "cargo_fijo": money("CARGO FIJO", "Cargo Fijo"),
    "energia_activa": money("ENERGÍA ACTIVA", "ENERGIA ACTIVA", "CARGO POR ENERGÍA", "CARGO POR ENERGIA"),
    "alumbrado_publico": money("ALUMBRADO PÚBLICO", "ALUMBRADO PUBLICO", "APORTE ALUMBRADO"),
    "mantenimiento_redes": money("MANTENIMIENTO", "MANTENIMIENTO DE REDES"), "reajuste": money("REAJUSTE", "FACTOR DE REAJUSTE"),
    "subtotal": money("SUBTOTAL", "Sub Total", "TOTAL DEL MES", "Total del Mes"), "igv": money(*_IGV3),
    "deuda_anterior": money("DEUDA ANTERIOR", "SALDO ANTERIOR", "DEUDA VENCIDA"), "redondeo": money("REDONDEO", "REDONDEADO", "AJUSTE"),
    "total_pagar": money("TOTAL A PAGAR", "Total a Pagar", "IMPORTE A PAGAR", "MONTO A PAGAR"),
    "serie": _supply_number, "numero_doc": _supply_number,
}
_water_account = captured(
    r"N[°º\.ro]*\s*(?:DE\s+)?(?:CUENTA|CODIGO\s+CLIENTE|COD\.?\s*CLIENTE)\s*[:\-]?\s*(\d{5,12})", r"\b(\d{10})\b")
_WATER = {
    "empresa": company(WATER_COMPANIES, (r"\bEPS\s+([A-Z\s]+)\b", None)), "ruc_empresa": ruc(0),
    "nombre_cliente": captured(rf"(?:Cliente|Titular|Propietario|Beneficiario|Nombre)\s*[:\-]?\s*([{_UP}][^\n]{{3,60}})"),
    "ruc_cliente": ruc(1), "numero_cuenta": _water_account,
    "direccion": captured(r"(?:Direcci[oó]n|Domicilio|Predio|Inmueble|Ubicaci[oó]n)\s*[:\-]?\s*([^\n]{5,80})"),
    "categoria": captured(r"(?:Categor[íi]a|Uso|Tipo\s+de\s+Uso)\s*[:\-]?\s*([^\n]{2,30})"), **_BILL_DATES,
    "consumo_m3": measured(r"(?:CONSUMO|VOLUMEN)\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*m[3³]", r"(\d+)\s*m[3³]\b"),
    "rango_consumo": captured(r"(?:Rango|Bloque)\s*[:\-]?\s*(\d+\s*[-–a]\s*\d+\s*m[3³]?)"),
    "cargo_fijo": money("CARGO FIJO", "Cargo Fijo", "CUOTA FIJA"), "agua_potable": money("AGUA POTABLE", "Agua Potable", "CARGO POR AGUA"),
    "alcantarillado": money("ALCANTARILLADO", "Alcantarillado", "DESAGÜE", "DESAGUE"),
    "tratamiento_aguas": money("TRATAMIENTO", "PLANTA DE TRATAMIENTO"), "subtotal": money("SUBTOTAL", "Sub Total"), "igv": money(*_IGV3),
    "deuda_anterior": money("DEUDA ANTERIOR", "SALDO ANTERIOR", "DEUDA VENCIDA", "ADEUDO ANTERIOR"),
    "total_pagar": money("TOTAL A PAGAR", "Total a Pagar", "IMPORTE TOTAL", "MONTO A PAGAR"),
    "serie": _water_account, "numero_doc": _water_account, "total": _BILL_TOTAL,
}
_gas_contract = captured(r"N[°º\.ro]*\s*(?:DE\s+)?(?:CONTRATO|CLIENTE|CUENTA|SUMINISTRO)\s*[:\-]?\s*(\d{5,12})")
_GAS = {
    "empresa": company(GAS_COMPANIES), "ruc_empresa": ruc(0),
    "nombre_cliente": captured(rf"(?:Cliente|Titular|Nombre)\s*[:\-]?\s*([{_UP}][^\n]{{3,60}})"), "ruc_cliente": ruc(1),
    "numero_contrato": _gas_contract,
    "numero_medidor": captured(r"(?:N[°º]?\s*(?:DE\s+)?MEDIDOR|MEDIDOR\s*N[°º]?)\s*[:\-]?\s*([A-Z0-9\-]{4,15})"),
    "direccion": captured(r"(?:Direcci[oó]n|Domicilio)\s*[:\-]?\s*([^\n]{5,80})"),
    "uso": captured(r"(?:Uso|Tipo\s+de\s+Uso|Categor[íi]a)\s*[:\-]?\s*([^\n]{2,30})"), **_BILL_DATES,
    "lectura_anterior": measured(r"LECTURA\s+ANTERIOR\s*[:\-]?\s*(\d+(?:\.\d+)?)"),
    "lectura_actual": measured(r"LECTURA\s+ACTUAL\s*[:\-]?\s*(\d+(?:\.\d+)?)"),
    "consumo_m3": measured(r"(?:CONSUMO|VOLUMEN)\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*m[3³]"),
    "factor_conversion": measured(r"(?:FACTOR\s+(?:DE\s+)?CONVERSI[OÓ]N|FC)\s*[:\-]?\s*(\d+\.\d+)"),
    "consumo_kwh": measured(r"(?:ENERGIA\s+CONSUMIDA|kWh)\s*[:\-]?\s*(\d+(?:\.\d+)?)"),
    "cargo_fijo": money("CARGO FIJO", "Cargo Fijo", "CARGO DE CONEXION"),
    "cargo_variable": money("CARGO VARIABLE", "CARGO POR CONSUMO", "ENERGIA CONSUMIDA"),
    "cargo_comercializacion": money("CARGO DE COMERCIALIZACION", "COMERCIALIZACION"), "subtotal": money("SUBTOTAL", "Sub Total"),
    "igv": money(*_IGV3), "deuda_anterior": money("DEUDA ANTERIOR", "SALDO ANTERIOR"),
    "total_pagar": money("TOTAL A PAGAR", "Total a Pagar", "IMPORTE TOTAL", "TOTAL"),
    "serie": _gas_contract, "numero_doc": _gas_contract, "total": _BILL_TOTAL,
}
_phone_account = captured(r"N[°º\.ro]*\s*(?:DE\s+)?(?:CUENTA|CLIENTE|CONTRATO|SUSCRIPTOR)\s*[:\-]?\s*(\d{5,14})")
_PHONE = {
    "empresa": company(PHONE_COMPANIES), "ruc_empresa": ruc(0),
    "nombre_cliente": captured(rf"(?:Cliente|Titular|Nombre|Suscriptor)\s*[:\-]?\s*([{_UP}][^\n]{{3,60}})"), "ruc_cliente": ruc(1),
    "numero_cuenta": _phone_account, "numero_linea": _phone_line,
    "plan": captured(r"(?:PLAN|PLAN TARIFARIO|TARIFA|PAQUETE)\s*[:\-]?\s*([^\n]{3,50})"), "tipo_servicio": _phone_services, **_BILL_DATES,
    "cargos_fijos": money("CARGO FIJO", "RENTA BÁSICA", "RENTA BASICA", "CARGOS FIJOS"),
    "cargos_variables": money("CARGOS VARIABLES", "CARGOS ADICIONALES", "LLAMADAS", "SMS"),
    "datos_adicionales": money("DATOS ADICIONALES", "MB ADICIONALES", "GB ADICIONALES"), "roaming": money("ROAMING", "ITINERANCIA"),
    "descuentos": money("DESCUENTO", "DESCUENTOS", "BONIF", "BONIFICACION", "PROMO"), "subtotal": money("SUBTOTAL", "Sub Total"),
    "igv": money(*_IGV3), "deuda_anterior": money("DEUDA ANTERIOR", "SALDO ANTERIOR", "SALDO PENDIENTE"),
    "total_pagar": money("TOTAL A PAGAR", "Total a Pagar", "IMPORTE TOTAL", "TOTAL DEL MES"),
    "serie": _phone_account, "numero_doc": _phone_account, "total": _BILL_TOTAL,
}
_PAYSLIP = {
    "empresa": lambda t: X.first_of(X.lines_of(t)), "ruc_empresa": _pay_value(r"RUC\.?", r"(\d{11})"),
    "periodo": _pay_value("MES", r"([A-ZÑÁÉÍÓÚ]+[-\s]\d{4})"), "trabajador": _pay_value("Nombre"),
    "dni": _pay_value(r"N[°º]?\s*DNI", r"(\d{8})"), "cargo": _pay_value("Cargo"), "codigo": _pay_value("C[oó]digo", r"([A-Z0-9]{2,})"),
    "fecha_ingreso": _pay_value(r"Fecha\s+Ingreso", r"(\d{2}/\d{2}/\d{4})"),
    "dias_trabajados": _pay_value(r"D[ií]as\s+Efectivos\s+Trabajados", r"(\d{1,3})"),
    "asegurado_afp": _pay_value(r"Asegurado\s+en", r"([A-ZÑ][A-ZÑ ]+)"), "basico": _pay_money(r"B[aá]sico\s+Mes\s*:?"),
    "total_ingresos": _pay_income, "total_descuento": _pay_deductions, "total_aporte": _pay_money(r"TOTAL\s+APORTE\s+S/\."),
    "neto_pagar": _pay_net,
}
FIELDS: dict[str, dict[str, Rule]] = {
    "factura_electronica": _INVOICE, "boleta_venta": _RECEIPT, "recibo_honorarios": _FEES, "nota_credito": _NOTE,
    "nota_debito": _NOTE, "recibo_luz": _POWER, "recibo_agua": _WATER, "recibo_gas": _GAS, "recibo_telefonia": _PHONE,
    "boleta_pago": _PAYSLIP,
}


def document_fields(kind: str) -> list[str]:
    """Field names of a document type, in report order."""
    if kind not in FIELDS:
        raise InvalidSpec(f"unknown document type: {kind!r}")
    return list(FIELDS[kind])


def extract_fields(docs: DataFrame, kind: str, text: str = "texto", only: list[str] | None = None) -> DataFrame:
    """Documents of one type with its typed fields, other columns kept (the text dropped).

    `docs` with a `tipo` column is filtered on it first; a table stored per type reads one folder.
    """
    names = document_fields(kind) if only is None else only
    if "tipo" in docs.columns:
        docs = docs.filter(F.col("tipo") == kind)
    kept = [c for c in docs.columns if c != text]
    rules, given = {n: FIELDS[kind][n] for n in names}, [F.col(text)]
    if any(hasattr(rule, "with_upper") for rule in rules.values()):
        # A generator makes it once, however many rules look into it.
        docs, given = docs.select("*", F.explode(F.array(F.upper(text))).alias(_UPPER)), [*given, F.col(_UPPER)]
    out = docs.select(*kept, *[rule(*given[:2 if hasattr(rule, "with_upper") else 1]).alias(n) for n, rule in rules.items()])
    # Payslip pages without a worker or an id hold no record.
    return out.filter("trabajador is not null or dni is not null") if kind == "boleta_pago" and only is None else out


def fields_as_map(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace field columns by one `campos` MAP<STRING,STRING> without missing values."""
    entries = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("k"), F.col(n).cast("string").alias("v"))) for n in names]))
    return df.select(*[c for c in df.columns if c not in names], F.map_from_entries(entries).alias("campos"))


def merge_corrections(fields: Column, corrections: Column) -> Column:
    """A field map with a reader's corrections on top."""
    kept = F.map_filter(fields, lambda k, v: ~F.array_contains(F.map_keys(corrections), k))
    return F.when(corrections.isNull(), fields).otherwise(F.map_concat(kept, corrections))
