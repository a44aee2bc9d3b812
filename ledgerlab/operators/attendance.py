"""Attendance sheets: text lines, one column per day, or one row per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlab.functions import text as X

# Words a heading may contain for each field, in order of preference.
ALIASES = {
    "trabajador": ["trabajador", "nombre", "apellidos y nombres", "apellidos"],
    "dni": ["dni", "documento", "doc"],
    "cargo": ["cargo", "puesto", "funcion"],
    "departamento": ["departamento", "area", "seccion", "unidad"],
    "fecha": ["fecha", "date", "dia"],
    "hora_entrada": ["entrada", "ingreso", "hora entrada", "hora_entrada"],
    "hora_salida": ["salida", "hora salida", "hora_salida"],
    "turno": ["turno", "jornada"],
    "horas_normales": ["horas normales", "horas_normales", "horas trabajadas"],
    "horas_extras": ["horas extras", "horas_extras", "sobretiempo"],
    "firma": ["firma", "asistencia", "presente", "asistio"],
}
PRESENT = ["si", "s", "x", "p", "presente", "1", "true", "asistio"]
_ID = r"\b(\d{8})\b"
_LINE_NAME = r"^([A-ZÁÉÍÓÚÑ][a-záéíóúñA-ZÁÉÍÓÚÑ]+(?:\s[A-ZÁÉÍÓÚÑ][a-záéíóúñA-ZÁÉÍÓÚÑ]+){1,3})"
_HEADER_NAME = r"(?:APELLIDOS?\s+Y?\s*NOMBRES?|TRABAJADOR)[:\s]*\n?\s*([A-ZÁÉÍÓÚÑ][^\n\d]{5,60})"
_SIGNED = r"\b(Si|X|P|Presente)\b"
_SHIFT = r"(Ma[ñn]ana|Tarde|Noche|Diurno|Nocturno)"
_SPAN = r"^(\d{1,2}:\d{2})\s*[-/]\s*(\d{1,2}:\d{2})"
CARRIED = ["trabajador", "dni", "empresa", "anio"]
MIN_DAY_COLUMNS = 10


def extract_attendance(docs: DataFrame, key: str = "doc_id", text: str = "texto") -> DataFrame:
    """One record per line with an 8-digit id and a name; a text without such lines gives one
    record from its heading."""
    whole = F.col(text)
    lines = F.split(whole, "\r\n|[\n\r]")
    by_line = F.filter(F.transform(lines, _line_record), lambda r: r["dni"].isNotNull() & r["trabajador"].isNotNull())
    heading = F.array(_record(
        X.grab(whole, _HEADER_NAME), X.hit(whole, _ID, 1, ""), F.lit(None), F.lit(None), F.lit(None), F.lit(False)))
    with_name = F.filter(heading, lambda r: r["dni"].isNotNull() & r["trabajador"].isNotNull())
    found = docs.select(key, by_line.alias("por_linea"), with_name.alias("cabecera"))
    chosen = F.when(F.size("por_linea") > 0, F.col("por_linea")).otherwise(F.col("cabecera"))
    return found.select(key, F.posexplode(chosen).alias("orden", "r")).select(key, "orden", "r.*")


def _record(name: Column, worker_id: Column, day: Column, entry: Column, leave: Column, signed: Column) -> Column:
    return F.struct(
        name.alias("trabajador"), worker_id.alias("dni"), day.cast("string").alias("fecha"),
        entry.cast("string").alias("hora_entrada"), leave.cast("string").alias("hora_salida"), signed.alias("firma_presente"))


def _line_record(line: Column) -> Column:
    times = F.regexp_extract_all(line, F.lit(X.rx(r"(\b\d{1,2}:\d{2}(?::\d{2})?\b)")), F.lit(1))
    return _record(X.grab(line, _LINE_NAME, 1, ""), X.hit(line, _ID, 1, ""), X.any_date(line),
                   F.get(times, F.lit(0)), F.get(times, F.lit(1)), X.found(line, _SIGNED))


def is_wide(columns: list[str]) -> bool:
    """Whether a sheet has a column per day of the month."""
    return sum(c.strip().isdigit() and len(c.strip()) <= 2 for c in columns) >= MIN_DAY_COLUMNS


def attendance_wide_to_long(sheet: DataFrame, name: str, worker_id: str | None, year: int | None, month: int | None) -> DataFrame:
    """Day columns 1..31 to one row per worker and day with something in the cell."""
    days = [c for c in sheet.columns if c.strip().isdigit() and 1 <= int(c) <= 31]
    kept = sheet.select(
        X.strip(F.col(name).cast("string")).alias("trabajador"),
        (X.strip(F.col(worker_id).cast("string")) if worker_id else F.lit(None).cast("string")).alias("dni"),
        *[X.strip(F.col(f"`{d}`").cast("string")).alias(d) for d in days])
    kept = kept.filter("trabajador is not null and trabajador <> '' and lower(trabajador) <> 'none'")
    pairs = F.array(*[F.struct(F.lit(int(d)).alias("dia"), F.col(f"`{d}`").alias("celda")) for d in days])
    cells = kept.select("trabajador", "dni", F.inline(pairs)).filter("celda is not null and celda not in ('', 'None')")
    cell = F.col("celda")
    day = F.lpad(F.col("dia").cast("string"), 2, "0")
    date = F.concat(F.lit(f"{year}-{month:02d}-"), day) if year and month else F.lit(None).cast("string")
    mark = cell.rlike("^[XxPpSs1]$")
    start, end = X.hit(cell, _SPAN, 1, ""), X.hit(cell, _SPAN, 2, "")
    hours = F.when(~mark, X.hit(cell, r"^(\d{1,2}(?:\.\d{1,2})?)$", 1, "").try_cast("double"))
    shift = F.when(~mark & start.isNull() & hours.isNull(), F.initcap(X.hit(cell, _SHIFT)))
    out = cells.select(
        "trabajador", "dni", "dia", date.alias("fecha"),
        F.concat(start, F.lit(":00")).alias("hora_entrada"), F.concat(end, F.lit(":00")).alias("hora_salida"),
        shift.alias("turno"), hours.alias("horas_normales"),
        (mark | start.isNotNull() | hours.isNotNull() | shift.isNotNull()).alias("firma_presente"))
    return out.filter("firma_presente")


def attendance_vertical(sheet: DataFrame) -> DataFrame:
    """One row per day: headings matched by alias, dates and hours normalised, presence flag."""
    def pick(field: str) -> Column:
        for alias in ALIASES[field]:
            for heading in sheet.columns:
                if alias in heading.strip().lower():
                    return X.strip(F.col(f"`{heading}`").cast("string"))
        return F.lit(None).cast("string")

    present = F.coalesce(F.lower(pick("firma")).isin(PRESENT), F.lit(False))
    texts = [pick(f).alias(f) for f in ("trabajador", "dni", "cargo", "departamento", "turno")]
    return sheet.select(
        *texts, X.any_date(pick("fecha")).alias("fecha"), X.time_of_day(pick("hora_entrada")).alias("hora_entrada"),
        X.time_of_day(pick("hora_salida")).alias("hora_salida"), pick("horas_normales").try_cast("double").alias("horas_normales"),
        pick("horas_extras").try_cast("double").alias("horas_extras"), present.alias("firma_presente"),
    ).filter("trabajador is not null and trabajador <> ''")


def detect_shift(entry: Column, leave: Column) -> Column:
    """'Noche', 'Mañana' or 'Tarde' from the hours of entry and leave."""
    start, end = (X.hit(c, r"^(\d{1,2})", 1, "").cast("int") for c in (entry, leave))
    both = start.isNotNull() & end.isNotNull()
    return (
        F.when(both & start.between(18, 23) & end.between(4, 10), "Noche")
        .when(both & start.between(6, 10), "Mañana").when(both & start.between(14, 17), "Tarde"))


def carry_headers(pages: DataFrame, file: str = "archivo", page: str = "pagina") -> DataFrame:
    """Fill worker, id, company and year of later pages from the first page of the file that has
    each. The fill value is one row per file, joined back, so a long file is never sorted."""
    names = [c for c in CARRIED if c in pages.columns]
    first = [F.min_by(F.struct(F.col(page), F.col(c)), F.when(F.col(c).isNotNull(), F.col(page))).alias(f"_{c}") for c in names]
    heads = pages.groupBy(file).agg(*first)
    out = pages.join(heads, file, "left")
    filled = [
        F.coalesce(F.col(c), F.when(F.col(f"_{c}")[page] < F.col(page), F.col(f"_{c}")[c])).alias(c) if c in names else F.col(c)
        for c in pages.columns]
    return out.select(filled)
