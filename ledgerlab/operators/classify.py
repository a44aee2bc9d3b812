"""Rule-scored document types."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlab.functions.text import found
from ledgerlab.functions.values import let, total_of

UNKNOWN = "desconocido"

# Labels of the document types.
TYPE_LABELS = {
    "factura_electronica": "Factura Electrónica", "boleta_venta": "Boleta de Venta",
    "recibo_honorarios": "Recibo por Honorarios", "nota_credito": "Nota de Crédito", "nota_debito": "Nota de Débito",
    "recibo_luz": "Recibo de Luz", "recibo_agua": "Recibo de Agua", "recibo_gas": "Recibo de Gas",
    "recibo_telefonia": "Recibo de Telefonía / Internet", "asistencia": "Planilla de Asistencia",
    "boleta_pago": "Boleta de Pago", UNKNOWN: "Documento desconocido",
}
# Fixed values: (type, weight of each hit, patterns over the upper-cased text), in tie order.
RULES = [
    ("boleta_pago", 12, [
        r"BOLETA\s+DE\s+PAGO", r"APORTACI[OÓ]N\s+DEL\s+EMPLEADOR", r"DESCUENTO\s+DEL\s+TRABAJADOR", r"TOTAL\s+APORTE",
        r"REMUNERACI[OÓ]N\s+MENSUAL", r"\bESSALUD\b", r"\bAFP\b|\bO\.?N\.?P\.?\b"]),
    ("factura_electronica", 12, [
        r"FACTURA\s+ELECTR[OÓ]NICA", r"\bF\d{3}\s*[-–]\s*\d{5,}", r"FACTURA\s+N[°º]?\s*F\d{3}"]),
    ("boleta_venta", 12, [r"BOLETA\s+DE\s+VENTA", r"\bB\d{3}\s*[-–]\s*\d{5,}"]),
    ("recibo_honorarios", 10, [
        r"RECIBO\s+POR\s+HONORARIOS", r"HONORARIOS\s+PROFESIONALES", r"\bE\d{3}\s*[-–]\s*\d{5,}",
        r"RETENCI[OÓ]N\s+(?:DEL?\s+)?4\s*%", r"NETO\s+A\s+PAGAR"]),
    ("nota_credito", 12, [
        r"NOTA\s+DE\s+CR[EÉ]DITO\s+ELECTR[OÓ]NICA", r"NOTA\s+DE\s+CR[EÉ]DITO", r"\bNC\d{2}\s*[-–]\s*\d{5,}"]),
    ("nota_debito", 12, [
        r"NOTA\s+DE\s+D[EÉ]BITO\s+ELECTR[OÓ]NICA", r"NOTA\s+DE\s+D[EÉ]BITO", r"\bND\d{2}\s*[-–]\s*\d{5,}"]),
    ("recibo_luz", 8, [
        r"\bkWh\b", r"N[°º]?\s*(?:DE\s+)?SUMINISTRO", r"LECTURA\s+(?:ACTUAL|ANTERIOR)", r"CONSUMO\s+(?:DE\s+)?ENERG[IÍ]A",
        r"ALUMBRADO\s+P[UÚ]BLICO",
        r"LUZ\s+DEL\s+SUR|ENEL\b|HIDRANDINA|ELECTROCENTRO|ELECTRO\s+NORTE|SEAL\b|ELSE\b|PLUZ\b|ENOSA\b"
        r"|ELECTRO\s+ORIENTE|ELECTRO\s+SUR\s+ESTE|ELECTRO\s+PUNO|ELECTRO\s+UCAYALI|ADINELSA|EDELNOR"]),
    ("recibo_agua", 8, [
        r"SEDAPAL|SEDACHIMBOTE|SEDA\s+CUSCO|SEDALIB|SEDAPAR|SEDACUSCO|EMFAPATUMBES|AGUAS\s+DE\s+(?:LIMA|AREQUIPA|TUMBES)",
        r"AGUA\s+POTABLE", r"CONSUMO\s+DE\s+AGUA", r"ALCANTARILLADO", r"M[3³]\s*(?:AGUA|CONSUMO)|CONSUMO.*M[3³]",
        r"N[°º]?\s*(?:DE\s+)?CUENTA.*AGUA|CUENTA\s+DE\s+AGUA"]),
    ("recibo_gas", 8, [
        r"C[AÁ]LIDDA|GASES\s+DEL\s+PAC[IÍ]FICO|QUAVII|CONTUGAS|GNC\s+PERU", r"GAS\s+NATURAL", r"CONSUMO\s+DE\s+GAS",
        r"PRESI[OÓ]N\s+(?:DE\s+)?(?:SERVICIO|GAS)", r"M[3³]\s*(?:GAS|CONSUMO\s+GAS)|GAS.*M[3³]",
        r"N[°º]?\s*(?:DE\s+)?CONTRATO.*GAS"]),
    ("recibo_telefonia", 8, [
        r"\bCLARO\b|\bMOVISTAR\b|\bENTEL\b|\bBITEL\b|\bWOM\b|\bVIRGIN\s+MOBILE\b", r"N[°º]?\s*(?:DE\s+)?L[IÍ]NEA",
        r"PLAN\s+(?:TARIF|M[OÓ]VIL|FIJ|DATOS|ILIMITADO)", r"DATOS\s+M[OÓ]VILES|MB\s+CONSUMIDO|GB\s+CONSUMIDO", r"ROAMING",
        r"TELEFON[IÍ]A\s+(?:M[OÓ]VIL|FIJA)|INTERNET\s+(?:M[OÓ]VIL|FIJO)"]),
    ("asistencia", 8, [
        r"PLANILLA\s+(?:DE\s+)?ASISTENCIA", r"CONTROL\s+(?:DE\s+)?ASISTENCIA", r"REGISTRO\s+(?:DE\s+)?ASISTENCIA",
        r"HORA\s+(?:DE\s+)?(?:ENTRADA|INGRESO).*HORA\s+(?:DE\s+)?SALIDA", r"(?:ENTRADA|INGRESO)\s+(?:SALIDA|EGRESO).*DNI",
        r"FIRMA\s+(?:DEL?\s+)?TRABAJADOR"]),
]


def _needles(pattern: str) -> list[str]:
    """A word every match of each alternative must hold; [] when some alternative has none."""
    words = []
    for alternative in re.sub(r"\((?:[^()]|\([^()]*\))*\)[?*]?", "~", pattern).split("|"):
        plain = re.sub(r"\[[^\]]*\][?*+]?|\\.(?:\{[^}]*\})?[?*+]?|.[?*]", "~", alternative)
        found_words = re.findall(r"[A-ZÁÉÍÓÚÑ]{2,}", plain)
        if not found_words:
            return []
        words.append(max(found_words, key=len))
    return words


def _signs(alternative: str) -> list[str]:
    """Like a needle, for an alternative without a capital word: a word of other letters, or a letter and each of a few signs."""
    word = re.search(r"(?:^|\\b)([A-Za-z]{2,})(?:\\b|$)", alternative)
    letter = re.match(r"([A-Z])\[([^\]\\^-]+)\](?![?*+{])", alternative)
    return [word[1]] if word else [letter[1] + sign for sign in letter[2]] if letter else []


def _letter_first(pattern: str) -> str:
    """The pattern with the letter behind each word start looked for before the start: fewer places of a text are tried."""
    return re.sub(r"\\b([A-Z])(?![?*+{])", r"\1(?<=\\b\1)", pattern)


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern that are in no group."""
    depth, parts = 0, [""]
    for piece in re.findall(r"\\.|\[[^\]]*\]|.", pattern):
        depth += (piece == "(") - (piece == ")")
        if piece == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += piece
    return parts


def _matches(upper: Column, pattern: str) -> Column:
    """Whether any alternative matches, each tried only on texts that hold one of its words."""
    tries = []
    for alternative in _alternatives(pattern):
        words, look = _needles(alternative) or _signs(alternative), found(upper, _letter_first(alternative), "")
        held = [upper.contains(w) for w in words]
        tries.append(held[0] if words == [alternative] else reduce(lambda a, b: a | b, held) & look if held else look)
    return reduce(lambda a, b: a | b, tries)


def type_scores(text: Column) -> Column:
    """ARRAY<STRUCT<puntos, orden, tipo>>: points of every type; the earlier rule has the higher order."""
    def scored(upper: Column) -> Column:
        points = [(kind, total_of([_matches(upper, p) for p in patterns]) * weight) for kind, weight, patterns in RULES]
        return F.array(*[F.struct(score.alias("puntos"), F.lit(-rank).alias("orden"), F.lit(kind).alias("tipo"))
                         for rank, (kind, score) in enumerate(points)])
    return let(F.upper(text), scored)


def with_type(df: DataFrame, text: str = "texto") -> DataFrame:
    """Append `tipo` and `confianza`.

    The scores come out of a generator, so they are computed once per row: a filter on `tipo`
    cannot pull the patterns into itself.
    """
    scored = df.select("*", F.explode(F.array(type_scores(F.col(text)))).alias("_puntos"))
    total = F.aggregate("_puntos", F.lit(0), lambda acc, x: acc + x["puntos"])
    best = F.array_max("_puntos")
    known = best["puntos"] > 0
    share = F.bround((best["puntos"] / F.nullif(total, F.lit(0))).cast("double"), 2)
    return scored.withColumns({
        "tipo": F.when(known, best["tipo"]).otherwise(UNKNOWN),
        "confianza": F.when(known, share).otherwise(0.0),
    }).drop("_puntos")


def type_label(kind: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(named, kind), kind)


def invoice_subtype(text: Column) -> Column:
    """Which of the invoice family a text is."""
    upper = F.upper(text)
    return (
        F.when(found(upper, r"NOTA\s+DE\s+CR[EÉ]DITO", ""), "nota_credito")
        .when(found(upper, r"NOTA\s+DE\s+D[EÉ]BITO", ""), "nota_debito")
        .when(found(upper, r"RECIBO\s+POR\s+HONORARIOS|HONORARIOS\s+PROFESIONALES", ""), "recibo_honorarios")
        .when(found(upper, r"BOLETA\s+DE\s+VENTA|\bB\d{3}\s*[-–]", ""), "boleta_venta")
        .otherwise("factura_electronica"))
