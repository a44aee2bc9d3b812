"""Readers of company ledgers, authority proposals and sales lines, by field position or heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlab.errors import InvalidSpec
from ledgerlab.functions import normalize as N
from ledgerlab.sources.lines import after_first, decoded, field, fields_of, first_lines, line_position, text_lines

# Field positions (from 0) of the standard books and of the proposals.
PURCHASE_BOOK = {
    "fecha_emision": 3, "tipo_cdp": 5, "serie": 6, "numero": 8, "ruc_proveedor": 11, "razon_social": 12, "base_imponible": 13,
    "igv": 14, "bi_dgng": 15, "igv_dgng": 16, "bi_dng": 17, "igv_dng": 18, "valor_adq_ng": 19, "isc": 20, "icbper": 21,
    "otros": 22, "importe_total": 23, "moneda": 24, "tipo_cambio": 25,
}
SALES_BOOK = {
    "fecha_emision": 3, "tipo_cdp": 5, "serie": 6, "numero": 7, "numero_final": 8, "exportacion": 12, "bi": 13, "dscto_bi": 14,
    "igv_bruto": 15, "dscto_igv": 16, "mto_exonerado": 17, "mto_inafecto": 18, "isc": 19, "bi_ivap": 20, "ivap": 21,
    "icbper": 22, "otros": 23, "importe_total": 24, "moneda": 25, "tipo_cambio": 26,
}
SALES_LINE = {
    "periodo": 0, "cuo": 1, "fecha_emi": 3, "tipo": 5, "serie": 6, "numero": 7, "numero_final": 8, "razon_social": 11,
    "base_imponible": 13, "igv": 15, "total": 24, "moneda": 25, "tc": 26, "fecha_doc_mod": 27,
}
PROPOSAL_SALES = {
    "fecha_emision": 4, "tipo_cdp": 6, "serie": 7, "numero": 8, "base_imponible": 14, "descuento_base": 15, "igv": 16,
    "descuento_igv": 17, "mto_exonerado": 18, "mto_inafecto": 19, "importe_total": 25, "tipo_cambio": 27,
}
PROPOSAL_PURCHASES = {
    "fecha_emision": 4, "tipo_cdp": 6, "serie": 7, "numero": 9, "ruc_proveedor": 12, "razon_social": 13, "base_imponible": 14,
    "igv": 15, "bi_dgng": 16, "igv_dgng": 17, "bi_dng": 18, "igv_dng": 19, "valor_adq_ng": 20, "importe_total": 24,
    "moneda": 25, "tipo_cambio": 26,
}
# Headings of the platform's file, least numbers of fields, and the gate of a book: in each file this
# share of all lines adds up within the tolerance.
PLATFORM_HEADINGS = ["type description", "number", "issued date", "amount net", "amount tax", "amount total"]
MIN_LINE_FIELDS, MIN_PURCHASE_FIELDS, MIN_SALES_FIELDS = 36, 26, 27
GATE_SHARE, GATE_TOLERANCE = 0.9, "0.02"
PERIOD_FIELD, DATE_FIELD = r"^\s*[0-9]{6}00\s*$", r"^\s*[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\s*$"
_TEXT = ["tipo_cdp", "serie", "numero", "numero_final", "ruc_proveedor", "razon_social", "moneda"]
# Amounts that add up to the total.
PURCHASE_PARTS = ["base_imponible", "igv", "bi_dgng", "igv_dgng", "bi_dng", "igv_dng", "valor_adq_ng", "isc", "icbper", "otros"]
SALES_PARTS = ["exportacion", "bi", "dscto_bi", "igv_bruto", "dscto_igv", "mto_exonerado", "mto_inafecto", "isc", "bi_ivap", "ivap", "icbper", "otros"]


def _positional(rows: DataFrame, positions: dict[str, int], amount) -> DataFrame:
    columns = {}
    for name, at in positions.items():
        if name in _TEXT:
            columns[name] = field(at)
        elif name == "fecha_emision":
            columns[name] = N.parse_date(field(at))
        elif name == "tipo_cambio":
            columns[name] = N.rate_or_one(amount(field(at), "decimal(9,3)"))
        else:
            columns[name] = amount(field(at))
    return rows.select("archivo", "line_no", *[c.alias(n) for n, c in columns.items()])


def read_ple_sales(spark: SparkSession, path: str) -> DataFrame:
    """Sales-book lines with the fields the period checks use; lines under 36 fields are left out."""
    rows = fields_of(text_lines(spark, path), "|").filter(F.size("c") >= MIN_LINE_FIELDS)
    special = {
        "fecha_emi": N.book_date, "fecha_doc_mod": N.book_date, "serie": F.upper, "moneda": F.upper,
        "base_imponible": N.strict_amount, "igv": N.strict_amount, "total": N.strict_amount,
        "tc": lambda c: c.try_cast("decimal(9,3)"),
    }
    return rows.select("archivo", "line_no", *[special.get(n, lambda c: c)(field(i)).alias(n) for n, i in SALES_LINE.items()])


def _book(spark: SparkSession, path: str, positions: dict[str, int], parts: list[str], least: int, check: bool) -> DataFrame:
    lines = fields_of(text_lines(spark, path), "|").filter(F.size("c") >= least)
    if check:
        shares = lines.groupBy("archivo").agg(F.avg(F.when(adds_up(positions, parts), 1.0).otherwise(0.0)).alias("proporcion"))
        # One row from one pass over the lines: how many files there are, and the first that does not add up.
        judged = shares.agg(F.count(F.lit(1)).alias("archivos"), F.min(F.when(F.col("proporcion") < GATE_SHARE, F.col("archivo"))).alias("malo")).first()
        if judged.malo is not None or not judged.archivos:
            raise InvalidSpec(f"amounts do not add up: the fields are not where the standard puts them ({judged.malo or path})")
    return _positional(lines, positions, N.plain_amount).filter("numero <> ''")


def read_ledger_purchases(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Standard purchases book (8.1), by position."""
    rows = _book(spark, path, PURCHASE_BOOK, PURCHASE_PARTS, MIN_PURCHASE_FIELDS, check)
    return rows.drop("isc", "icbper", "otros")


def read_ledger_sales(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Standard sales book (14.1), by position; discounts are folded into base and IGV."""
    rows = _book(spark, path, SALES_BOOK, SALES_PARTS, MIN_SALES_FIELDS, check)
    folded = rows.withColumns({
        "base_imponible": (F.col("bi") + F.col("dscto_bi")).cast(N.MONEY), "igv": (F.col("igv_bruto") + F.col("dscto_igv")).cast(N.MONEY)})
    return folded.drop("bi", "dscto_bi", "igv_bruto", "dscto_igv", "exportacion", "isc", "bi_ivap", "ivap", "icbper", "otros")


def read_ledger_platform(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Sales export with named headings; `Number` is 'series-number'."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    names = {c.lower().strip(): c for c in raw.columns}
    missing = [h for h in PLATFORM_HEADINGS if h not in names]
    if missing:
        raise InvalidSpec(f"headings not found: {', '.join(missing)}")

    def col(heading: str) -> Column:
        return decoded(F.col(f"`{names[heading]}`")) if heading in names else F.lit("")

    series, number = N.split_number(F.trim(col("number")))
    rows = raw.select(
        F.col("_metadata.file_path").alias("archivo"), line_position().alias("line_no"),
        N.normalize_doc_type(col("type description")).alias("tipo_cdp"), series.alias("serie"), number.alias("numero"),
        N.parse_date(col("issued date")).alias("fecha_emision"),
        *[N.parse_amount(col(f"amount {k}")).alias(n) for k, n in (
            ("net", "base_imponible"), ("tax", "igv"), ("total", "importe_total"), ("exo", "mto_exonerado"), ("ina", "mto_inafecto"))],
        F.trim(F.coalesce(col("status description"), F.lit(""))).alias("status_description"))
    return rows.filter("numero is not null and numero not in ('', 'nan', 'None')")


MAPPED_TEXT = ["ruc_proveedor", "razon_social", "moneda", "status_description"]
MAPPED_AMOUNTS = ["base_imponible", "igv", "importe_total", "mto_exonerado", "mto_inafecto", "bi_dgng", "igv_dgng", "bi_dng", "igv_dng", "valor_adq_ng"]


def read_ledger_mapped(
    spark: SparkSession, path: str, columns: dict[str, int], sep: str = "|", skip_rows: int = 0, header: bool = False, combined: bool = False,
) -> DataFrame:
    """A ledger with a confirmed `field -> position` map. Rows whose number has no digit are page
    headings, totals or labels and are dropped."""
    rows = fields_of(after_first(text_lines(spark, path), skip_rows + int(header)), sep)

    def text(name: str) -> Column:
        return field(columns[name]) if name in columns else F.lit("")

    if combined:
        series, number = N.split_number(text("numero"))
    else:
        series, number = F.upper(text("serie")), text("numero")
    rate = N.parse_amount(text("tipo_cambio"), "decimal(9,3)") if "tipo_cambio" in columns else F.lit(1).cast("decimal(9,3)")
    out = rows.select(
        "archivo", "line_no", N.normalize_doc_type(text("tipo_cdp")).alias("tipo_cdp"), series.alias("serie"), number.alias("numero"),
        N.parse_date(text("fecha_emision")).alias("fecha_emision"), *[N.parse_amount(text(n)).alias(n) for n in MAPPED_AMOUNTS],
        *[text(n).alias(n) for n in MAPPED_TEXT], N.rate_or_one(rate).alias("tipo_cambio"))
    return valid_rows(out)


def read_ledger_minimal(spark: SparkSession, path: str, columns: dict[str, int], sep: str = "|", skip_rows: int = 0, header: bool = False) -> DataFrame:
    """Type, series, number and amount only; a series is split out of 'F001-123'."""
    rows = fields_of(after_first(text_lines(spark, path), skip_rows + int(header)), sep)

    def text(name: str, missing: str = "") -> Column:
        return field(columns[name]) if columns.get(name) is not None else F.lit(missing)

    pattern = r"(?i)^([A-Z][A-Z0-9]{2,3})-([0-9]+)$"
    number = text("numero")
    joined = F.lower(text("serie")).isin("", "nan", "none") & number.rlike(pattern)
    return rows.filter(~number.isin("", "nan", "None")).select(
        "archivo", "line_no", N.normalize_doc_type(text("tipo_cdp", "00")).alias("tipo_cdp"),
        F.when(joined, F.upper(F.regexp_extract(number, pattern, 1))).otherwise(text("serie")).alias("serie"),
        F.when(joined, F.regexp_extract(number, pattern, 2)).otherwise(number).alias("numero"),
        N.parse_amount(text("importe_total", "0")).alias("importe_total"))


def valid_rows(ledger: DataFrame) -> DataFrame:
    """Rows whose number has a digit."""
    return ledger.filter(F.col("numero").rlike("[0-9]"))


def read_authority_proposal(spark: SparkSession, path: str, book: str) -> DataFrame:
    """The authority's pipe text with a heading, by position; rows without type, series and number
    are dropped. Each file's first line is its heading."""
    positions = {"ventas": PROPOSAL_SALES, "compras": PROPOSAL_PURCHASES}.get(book)
    if positions is None:
        raise InvalidSpec(f"unknown book: {book!r}")
    rows = _positional(fields_of(after_first(text_lines(spark, path), 1), "|"), positions, N.dot_amount)
    if book == "ventas":
        rows = rows.withColumns({
            "base_imponible": (F.col("base_imponible") + F.col("descuento_base")).cast(N.MONEY),
            "igv": (F.col("igv") + F.col("descuento_igv")).cast(N.MONEY)}).drop("descuento_base", "descuento_igv")
    return rows.filter("not (tipo_cdp = '' and serie = '' and numero = '')")


def adds_up(positions: dict[str, int], parts: list[str]) -> Column:
    """Whether the parts of a line of fields add up to its total.

    The parts are one array with one rule for all: spelled out for each part, the generated code is too long to be compiled.
    """
    amounts = F.transform(F.array(*[field(positions[p]) for p in parts]), lambda x: N.plain_amount(x))
    added = F.aggregate(amounts, F.lit(0).cast("decimal(30,2)"), lambda sum_, x: (sum_ + x).cast("decimal(30,2)"))
    return F.abs(added - N.plain_amount(field(positions["importe_total"]))) <= F.lit(GATE_TOLERANCE).cast(N.MONEY)


def detect_ledger_format(spark: SparkSession, path: str, book: str = "ventas") -> DataFrame:
    """One row per file: its format by the first line, and why it does not fit the book."""
    head = fields_of(first_lines(text_lines(spark, path), 1), "|")
    is_book = (F.size("c") >= MIN_PURCHASE_FIELDS) & field(0).rlike(PERIOD_FIELD) & field(3).rlike(DATE_FIELD)
    lowered = F.lower("value")
    platform = F.lit(True)
    for heading in PLATFORM_HEADINGS:
        platform = platform & lowered.contains(heading)
    sales = is_book & (F.size("c") >= MIN_SALES_FIELDS) & adds_up(SALES_BOOK, SALES_PARTS)
    purchases = is_book & adds_up(PURCHASE_BOOK, PURCHASE_PARTS)
    books = {"ple_ventas": sales, "ple_compras": purchases}
    first, second = ("ple_compras", "ple_ventas") if book == "compras" else ("ple_ventas", "ple_compras")
    kind = (F.when(platform, "plataforma").when(books[first], first).when(books[second], second)
            .when(is_book, "ple_no_cuadra").otherwise("desconocido"))
    wrong = F.when((F.lit(book) == "compras") & (F.col("formato") == "plataforma"), "formato del sistema de ventas: para compras se espera el registro 8.1")
    wrong = wrong.when((F.lit(book) == "compras") & (F.col("formato") == "ple_ventas"), "parece un registro de ventas (14.1)")
    wrong = wrong.when((F.lit(book) == "ventas") & (F.col("formato") == "ple_compras"), "parece un registro de compras (8.1)")
    wrong = wrong.when(F.col("formato") == "ple_no_cuadra", "parece un registro electrónico pero el total no es la suma de sus componentes")
    return head.select("archivo", kind.alias("formato")).withColumn("aviso", F.coalesce(wrong, F.lit("")))
