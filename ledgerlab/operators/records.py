"""Records extracted from mail attachments: profile fields, best reading, review, listing, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlab.functions import identity as I
from ledgerlab.functions.text import found, grab, strip
from ledgerlab.functions.values import let, total_of

# Letters a scanner confuses.
CONFUSED = {"a": "aá4@", "b": "b8", "e": "eé3", "g": "g9", "i": "ií1l|", "l": "l1i|", "n": "nñ", "o": "oó0",
            "s": "s5$", "t": "t7", "u": "uú", "z": "z2"}


_READ_AS = str.maketrans({" ": r"\s*", **{letter: f"[{forms}]" for letter, forms in CONFUSED.items()}})


def tolerant(word: str) -> str:
    """A pattern for a label whose letters may be misread and whose spaces may be lost or added."""
    return word.translate(_READ_AS)


# Fragments and, per field, (pattern, confidence) in the order they are tried. What may stand before a label
# and is not part of the value is left out.
_T = tolerant
_SEP = r"\s*[:.\-]?\s*"
_LANDLORD = f"(?:{_T('arrendador')}|{_T('contribuyente')}|{_T('declarante')})"
_TENANT = f"(?:{_T('arrendatario')}|{_T('inquilino')})"
_OF = rf"(?:\s*{_T('de')}[l1i]?\s*)?"
_NAME1 = f"(?:{_T('nombres')}?|{_T('apellidos y nombres')}|{_T('razon social')}|{_T('razon socia')}[l1i])"
_NAME = rf"{_NAME1}(?:\s*[/y]\s*{_NAME1})?"
_RUC = r"(\d[\d\s\-]{9,16})"
_DAY = r"(\d{1,2}\s*[/\-.]\s*\d{1,2}\s*[/\-.]\s*\d{2,4})"
_MONEY = r"((?:s\s*/\.?|us\$|\$)?[\s*]*\d[\d.,]{0,17})"
_REST = r"([^\n]{4,120})"
_CAPITAL_REST = r"([A-ZÁÉÍÓÚÑ][^\n]{3,120})"
_OPERATION = r"([0-9][0-9\-]{3,29})"
PATTERNS: dict[str, list[tuple[str, float]]] = {
    "ruc_contribuyente": [
        (rf"{_T('ruc')}{_OF}{_LANDLORD}{_SEP}{_RUC}", 0.98), (rf"{_LANDLORD}{_SEP}[^\n]{{0,40}}?(\d{{11}})", 0.90),
        (rf"\b{_T('ruc')}{_SEP}{_RUC}", 0.85)],
    "nombre_contribuyente": [
        (rf"{_NAME}{_OF}{_LANDLORD}{_SEP}{_REST}", 0.94), (rf"{_NAME}\s*[:]\s*{_REST}", 0.90),
        (rf"{_NAME}\s{{2,}}{_CAPITAL_REST}", 0.84)],
    "ruc_inquilino": [
        (rf"(?:{_T('ruc')}|{_T('doc')}){_OF}{_TENANT}{_SEP}{_RUC}", 0.96), (rf"{_TENANT}{_SEP}[^\n]{{0,40}}?(\d{{11}})", 0.88)],
    "nombre_inquilino": [
        (rf"{_NAME}{_OF}{_TENANT}{_SEP}{_REST}", 0.94),
        (rf"{_TENANT}[ \t]*:[ \t]*(?!(?:r\.?u\.?c|dni|c\.?e|pasaporte|\d)){_CAPITAL_REST}", 0.84)],
    "periodo": [
        (rf"{_T('periodo')}(?:\s*{_T('tributario')})?{_SEP}"
         r"([0-9]{4}\s*[-/]?\s*[0-9]{2}|[0-9]{2}\s*[-/]?\s*[0-9]{4}|[a-zñáéíóú]+\s+(?:de\s+)?[0-9]{4})", 0.96),
        (rf"{_T('mes')}(?:\s*[yY]?\s*{_T('ano')})?{_SEP}([0-9]{{2}}\s*[-/]\s*[0-9]{{4}})", 0.88)],
    "fecha_de_pago": [
        (rf"{_T('fecha')}{_OF}{_T('pago')}{_SEP}{_DAY}", 0.96),
        (rf"{_T('fecha')}{_OF}(?:{_T('presentacion')}|{_T('emision')}){_SEP}{_DAY}", 0.86)],
    "numero_de_operacion": [
        (rf"{_T('operacion')}(?:\s*[a-z]+)?{_SEP}{_OPERATION}", 0.95),
        (rf"{_T('orden')}{_SEP}{_OPERATION}", 0.82)],
    "monto_alquiler": [(rf"{_T('monto')}{_OF}{_T('alquiler')}{_SEP}{_MONEY}", 0.95)],
    "tributo_resultante": [(rf"{_T('tributo')}\s*{_T('resultante')}{_SEP}{_MONEY}", 0.95)],
    "importe_pagado": [
        (rf"{_T('importe')}\s*(?:{_T('pagado')}|{_T('total')}){_SEP}{_MONEY}", 0.95), (rf"\b{_T('importe')}{_SEP}{_MONEY}", 0.80)],
    "intereses_moratorios": [(rf"{_T('interes')}[a-z]*\s*{_T('moratorio')}[a-z]*{_SEP}{_MONEY}", 0.9)],
    "tipo_de_bien": [(rf"{_T('tipo')}\s*{_OF}{_T('bien')}{_SEP}([A-Za-z]{{3,20}})", 0.9)],
    "tipo_doc_inquilino": [
        (rf"{_T('inquilino')}{_SEP}(?:\d{{2}}\s*[-/]?\s*)?(r\.?\s*u\.?\s*c\.?|dni|c\.?\s*e\.?|pasaporte)", 0.88)],
}
SIGNALS = [_T("arrendamiento"), r"\b1683\b", r"\b3011\b", _T("impuesto a la renta"), _T("constancia de pago"),
           _T("primera categoria"), r"1ra\s*\.?\s*categor", _T("recibo por arrendamiento"), _T("renta de primera")]
MIN_SIGNALS = 2
UNVALIDATED = 0.45
TRUSTED = 0.80
ESSENTIAL = ["ruc_contribuyente", "periodo", "importe_pagado"]
DESIRABLE = ["nombre_contribuyente", "ruc_inquilino", "nombre_inquilino", "tipo_doc_inquilino", "tipo_de_bien",
             "fecha_de_pago", "numero_de_operacion", "monto_alquiler", "tributo_resultante", "intereses_moratorios"]
MONEY_FIELDS = ["monto_alquiler", "tributo_resultante", "importe_pagado", "intereses_moratorios"]
FREE_TEXT = ["nombre_contribuyente", "nombre_inquilino", "tipo_doc_inquilino", "tipo_de_bien"]
# Reading strategies by growing cost.
STRATEGY_COST = {"native_pdf_text": 1, "pdf_tables": 2, "local_ocr": 3, "vision_ai": 4}
EMPTY, PARTIAL, COMPLETE = "empty", "partial", "complete"
NOT_REQUIRED, PENDING, APPROVED, REJECTED = "not_required", "pending", "approved", "rejected"

# What makes a value of a field real.
PARSERS = {
    "ruc_contribuyente": I.ruc_find, "ruc_inquilino": I.ruc_find, "periodo": I.parse_period,
    "fecha_de_pago": I.parse_payment_date, "numero_de_operacion": I.parse_operation_number,
    **{name: I.money_amount for name in MONEY_FIELDS},
}


def recognise_profile(text: Column) -> Column:
    """At least two rent-payment signals in the accent-free text."""
    plain = F.regexp_replace(I.without_accents(F.lower(text)), r"\s+", " ")
    return let(plain, lambda p: total_of([found(p, signal) for signal in SIGNALS])) >= MIN_SIGNALS


def extract_profile_fields(docs: DataFrame, key: str = "doc_id", text: str = "texto", strategy: str = "native_pdf_text") -> DataFrame:
    """Long table (doc, campo, valor, confianza, estrategia, costo) of the profile's fields.

    The first pattern whose value validates wins; else the first value found, at reduced confidence.
    """
    fields = F.array_compact(F.array(*[_field(F.col(text), name) for name in PATTERNS]))
    return docs.select(key, F.explode(fields).alias("f")).select(
        key, "f.*", F.lit(strategy).alias("estrategia"), F.lit(STRATEGY_COST[strategy]).alias("costo"))


def _field(text: Column, name: str) -> Column:
    """A field's reading. A pattern is tried only where no earlier one found a value that validates."""
    def read(value: Column, confidence: float) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("campo"), value.alias("valor"), F.lit(confidence).alias("confianza")))

    def tried(patterns: list[tuple[str, float]], reduced: Column) -> Column:
        if not patterns:
            return reduced
        (pattern, confidence), later = patterns[0], patterns[1:]

        def judged(value: Column) -> Column:
            real = value.isNotNull() & PARSERS[name](value).isNotNull() if name in PARSERS else value.isNotNull()
            return F.when(real, read(value, confidence)).otherwise(
                tried(later, F.coalesce(reduced, read(value, round(confidence * UNVALIDATED, 3)))))

        return let(F.nullif(grab(text, pattern, 1, "im"), F.lit("")), judged)

    return tried(PATTERNS[name], F.lit(None))


def best_field(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document and field the reading with the highest confidence, the cheaper one on a tie.

    Readings are reduced within their tasks first, so a document with very many sends one row per field and task.
    """
    usable = candidates.filter("error is null").drop("error") if "error" in candidates.columns else candidates
    best = usable.groupBy(key, "campo").agg(F.max_by(
        F.struct("valor", "confianza", "estrategia", "costo"), F.struct("confianza", -F.col("costo"), "valor")).alias("x"))
    return best.select(key, "campo", "x.*")


def quality(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: completeness, review state, overall confidence, main strategy and
    whether the essentials are good enough to stop trying costlier strategies.

    A document has at most one row per field, so its strategy list is short.
    """
    return fields.groupBy(key).agg(*_quality_parts()).select(key, *_quality())


def _quality_parts() -> list[Column]:
    """Aggregates over the fields of a document that its quality follows from."""
    essential, trusted = F.col("campo").isin(ESSENTIAL), F.col("confianza") >= TRUSTED
    filled = F.trim("valor") != ""
    weight = F.when(essential, 3.0).otherwise(1.0)
    return [
        F.count_if(filled).alias("presentes"), F.count_if(essential & filled).alias("esenciales"),
        F.count_if(essential & trusted).alias("fiables"), F.count_if(essential & filled & trusted).alias("esenciales_fiables"),
        F.count_if(F.col("campo").isin(DESIRABLE) & ~trusted).alias("dudosos"),
        (F.sum(F.col("confianza") * weight) / F.sum(weight)).alias("confianza_global"),
        *[F.count_if(F.col("estrategia") == s).alias(f"_{s}") for s in STRATEGY_COST]]


def _quality() -> list[Column]:
    """Quality columns over those aggregates."""
    need = len(ESSENTIAL)
    level = (F.when(F.col("presentes") == 0, EMPTY).when(
        (F.col("esenciales") < need) | (F.col("esenciales_fiables") < need), PARTIAL).otherwise(COMPLETE))
    state = (F.when(level == EMPTY, NOT_REQUIRED).when(
        (level == PARTIAL) | (F.col("dudosos") > 0), PENDING).otherwise(NOT_REQUIRED))
    most = F.greatest(*[F.col(f"_{s}") for s in STRATEGY_COST])
    dominant = F.coalesce(*[F.when((F.col(f"_{s}") == most) & (most > 0), s) for s in STRATEGY_COST])
    return [level.alias("completitud"), state.alias("estado_de_revision"), F.col("confianza_global"),
            dominant.alias("estrategia_usada"), (F.col("fiables") == need).alias("suficiente")]


def build_record(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """One typed record per document from its best fields, with raw values, confidences and quality: one aggregation."""
    maps = fields.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("campo", "valor"))).alias("campos_crudos"),
        F.map_from_entries(F.collect_list(F.struct("campo", F.bround("confianza", 3)))).alias("confianza_por_campo"), *_quality_parts())

    def raw(name: str) -> Column:
        return F.try_element_at("campos_crudos", F.lit(name))

    columns = {
        **{n: PARSERS[n](raw(n)) for n in PARSERS},
        "nombre_contribuyente": I.clean_name(raw("nombre_contribuyente")), "nombre_inquilino": I.clean_name(raw("nombre_inquilino")),
        "tipo_doc_inquilino": I.normalize_code(raw("tipo_doc_inquilino")), "tipo_de_bien": I.normalize_code(raw("tipo_de_bien")),
        "moneda": F.coalesce(I.parse_money(raw("importe_pagado"))["moneda"], I.parse_money(raw("monto_alquiler"))["moneda"], F.lit("PEN")),
    }
    return maps.select(key, *[c.alias(n) for n, c in columns.items()], "campos_crudos", "confianza_por_campo", *_quality())


def _as_text(name: str, value: Column) -> Column:
    return F.substring(strip(F.coalesce(value, F.lit(""))), 1, 120) if name in FREE_TEXT else PARSERS[name](value).cast("string")


def apply_corrections(records: DataFrame, corrections: DataFrame, key: str = "record_id", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(corrected records, rejected corrections). `corrections` is (key, campo, valor).

    Of several corrections of one field the one with the greatest `order` column counts (the greatest value, without one).

    Every value passes the field's own parser. A record with a field that may not be corrected
    or a value that does not parse keeps its old values, and its bad rows are returned.
    """
    known = FREE_TEXT + list(PARSERS)
    value = F.coalesce(*[F.when(F.col("campo") == n, _as_text(n, F.col("valor"))) for n in known])
    parsed = corrections.withColumn("leido", value)
    rejected = parsed.filter("leido is null").select(
        key, "campo", "valor", F.when(F.col("campo").isin(known), "valor_no_valido").otherwise("campo_no_corregible").alias("motivo"))
    # One row per record: at most one value per known field.
    wide = parsed.groupBy(key).agg(
        F.count_if(F.col("leido").isNull()).alias("_malas"),
        *[F.max_by("leido", F.when(F.col("campo") == n, F.struct(*([order] if order else []), "leido"))).alias(f"_{n}") for n in known])
    joined = records.join(wide.filter("_malas = 0").drop("_malas").withColumn("_hay", F.lit(True)), key, "left")
    entries = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNotNull(), F.struct(F.lit(n).alias("k"), F.col(f"_{n}").alias("v"))) for n in known]))
    new_raw = F.map_from_entries(entries)
    new_trust = F.transform_values(new_raw, lambda k, v: F.lit(1.0))

    def merged(old: str, new: Column) -> Column:
        kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
        return F.when(F.col("_hay"), F.map_concat(kept, new)).otherwise(F.col(old))

    types = {f.name: f.dataType for f in records.schema}
    out = []
    for name in records.columns:
        if name in known:
            out.append(F.coalesce(F.col(f"_{name}").cast(types[name]), F.col(name)).alias(name))
        elif name == "campos_crudos":
            out.append(merged(name, new_raw).alias(name))
        elif name == "confianza_por_campo":
            out.append(merged(name, new_trust).alias(name))
        elif name == "estado_de_revision":
            out.append(F.when(F.col("_hay"), APPROVED).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return joined.select(out), rejected


def list_records(records: DataFrame, limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
    """Records that meet every given filter, newest first.

    Filters: job_id, ruc, ruc_inquilino, periodo, periodo_desde, periodo_hasta, fecha_desde,
    fecha_hasta, solo_aprobados, solo_pendientes, ids.
    """
    conditions = {
        "job_id": lambda v: F.col("job_id") == v, "ruc": lambda v: F.col("ruc_contribuyente") == v,
        "ruc_inquilino": lambda v: F.col("ruc_inquilino") == v, "periodo": lambda v: F.col("periodo") == v,
        "periodo_desde": lambda v: F.col("periodo") >= v, "periodo_hasta": lambda v: F.col("periodo") <= v,
        "fecha_desde": lambda v: F.col("fecha_de_pago") >= F.lit(v).cast("date"),
        "fecha_hasta": lambda v: F.col("fecha_de_pago") <= F.lit(v).cast("date"),
        "solo_aprobados": lambda v: F.col("estado_de_revision").isin(APPROVED, NOT_REQUIRED),
        "solo_pendientes": lambda v: F.col("estado_de_revision") == PENDING, "ids": lambda v: F.col("id").isin(list(v)),
    }
    out = records
    for name, value in filters.items():
        if value or (name == "job_id" and value is not None):
            out = out.filter(conditions[name](value))
    out = out.orderBy(F.desc("created_at"), F.desc("id"))
    return out.offset(offset).limit(limit) if limit else out


def review_counts(records: DataFrame) -> DataFrame:
    """One row: records and how many await review."""
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("estado_de_revision") == PENDING).alias("pendientes"))


def pending_extraction(attachments: DataFrame, messages: DataFrame, records: DataFrame, job_id=None) -> DataFrame:
    """Attachments (of a job) that produced no record yet."""
    jobs = messages.select(F.col("id").alias("message_id"), "job_id")
    jobs = jobs if job_id is None else jobs.filter(F.col("job_id") == job_id)
    done = records.select(F.col("attachment_id").alias("id"), "company_id")
    return attachments.join(jobs, "message_id").join(done, ["id", "company_id"], "left_anti")


def origin_lookup(records: DataFrame, attachments: DataFrame, messages: DataFrame) -> DataFrame:
    """Records with the file and message they came from. Sides shuffle by id; none is assumed small."""
    files = attachments.select(F.col("id").alias("attachment_id"), "message_id", F.col("original_name").alias("nombre_adjunto"))
    mails = messages.select(F.col("id").alias("message_id"), F.col("sender").alias("remitente"), F.col("subject").alias("asunto"),
                            F.col("received_at").alias("recibido_en"))
    return records.join(files.join(mails, "message_id"), "attachment_id", "left").drop("message_id")


# Report labels of completeness and review state, and the report's columns.
COMPLETENESS_LABELS = {COMPLETE: "Completo", PARTIAL: "Parcial", EMPTY: "Vacío"}
REVIEW_LABELS = {NOT_REQUIRED: "No requiere", PENDING: "Pendiente", APPROVED: "Aprobado", REJECTED: "Rechazado"}
REPORT_COLUMNS = {
    "ruc_contribuyente": "RUC Arrendador", "nombre_contribuyente": "Nombre / Razón Social", "tipo_doc_inquilino": "Tipo Doc. Inquilino",
    "ruc_inquilino": "RUC Arrendatario", "nombre_inquilino": "Inquilino", "tipo_de_bien": "Tipo de Bien", "periodo": "Periodo",
    "monto_alquiler": "Monto Alquiler", "tributo_resultante": "Tributo Resultante", "importe_pagado": "Importe Pagado",
    "intereses_moratorios": "Intereses Moratorios", "moneda": "Moneda", "fecha_de_pago": "Fecha de Pago",
    "numero_de_operacion": "N° Operación", "estado": "Estado de Extracción", "revision": "Revisión", "archivo_origen": "Archivo",
}


def _named(column: str, labels: dict[str, str]) -> Column:
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.col(column)), F.col(column), F.lit(""))


def records_report(records: DataFrame, cap: int | None = None) -> DataFrame:
    """Report rows as text; `cap` keeps the newest records only."""
    rows = list_records(records, cap) if cap else records
    texts = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in REPORT_COLUMNS if n not in ("estado", "revision", "archivo_origen")}
    texts.update({n: F.coalesce(F.col(n).cast("decimal(14,2)").cast("string"), F.lit("")) for n in MONEY_FIELDS})
    texts["fecha_de_pago"] = F.coalesce(F.date_format("fecha_de_pago", "dd/MM/yyyy"), F.lit(""))
    texts["estado"], texts["revision"] = _named("completitud", COMPLETENESS_LABELS), _named("estado_de_revision", REVIEW_LABELS)
    texts["archivo_origen"] = F.coalesce(F.col("nombre_adjunto"), F.lit("")) if "nombre_adjunto" in records.columns else F.lit("")
    return rows.select([texts[n].alias(n) for n in REPORT_COLUMNS])


COUNTERS = ["mensajes_revisados", "mensajes_con_adjuntos", "adjuntos_descargados", "adjuntos_rechazados", "adjuntos_duplicados",
            "errores", "registros_extraidos", "registros_en_revision", "adjuntos_sin_datos", "llamadas_ia", "errores_extraccion"]


def scan_counters(messages: DataFrame, attachments: DataFrame, errors: DataFrame, extractions: DataFrame) -> DataFrame:
    """The eleven counters per job, from four logs: messages (job_id, adjuntos), attachments
    (job_id, resultado: descargado|rechazado|duplicado), errors (job_id, etapa: listing|downloading|
    extracting) and extractions (job_id, reconocido, estado_de_revision, uso_ia).

    Each log is counted per job first; the joins that follow see one row per job.
    """
    recognised, outcome, stage = F.col("reconocido"), F.col("resultado"), F.col("etapa")
    parts = [
        messages.groupBy("job_id").agg(F.count(F.lit(1)).alias(COUNTERS[0]), F.count_if(F.col("adjuntos") > 0).alias(COUNTERS[1])),
        attachments.groupBy("job_id").agg(*[
            F.count_if(outcome == o).alias(n) for o, n in zip(("descargado", "rechazado", "duplicado"), COUNTERS[2:5])]),
        errors.groupBy("job_id").agg(F.count_if(stage != "extracting").alias("errores"), F.count_if(stage == "extracting").alias("errores_extraccion")),
        extractions.groupBy("job_id").agg(
            F.count_if(recognised).alias("registros_extraidos"),
            F.count_if(recognised & (F.col("estado_de_revision") == PENDING)).alias("registros_en_revision"),
            F.count_if(~recognised).alias("adjuntos_sin_datos"), F.count_if(F.col("uso_ia")).alias("llamadas_ia")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "job_id", "full_outer")
    return out.select("job_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in COUNTERS])
