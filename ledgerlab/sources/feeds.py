"""Exchange-rate feeds, invoice XML and attachment files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlab.functions.text import strip
from ledgerlab.operators.vouchers import XML_TYPES
from ledgerlab.sources.files import content_of, dealt, list_files

RATE = "decimal(7,3)"
# Month abbreviations of the rate feed.
FEED_MONTHS = {"ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "set": 9, "sep": 9, "oct": 10, "nov": 11, "dic": 12}
QUOTES_SCHEMA = "config STRUCT<series: ARRAY<STRUCT<name: STRING>>>, periods ARRAY<STRUCT<name: STRING, `values`: ARRAY<STRING>>>"
INVOICE_SCHEMA = """ID STRING, InvoiceTypeCode STRING, IssueDate STRING,
AccountingSupplierParty STRUCT<Party: STRUCT<PartyIdentification: STRUCT<ID: STRING>, PartyName: STRUCT<Name: STRING>, PartyLegalEntity: STRUCT<RegistrationName: STRING>>>,
LegalMonetaryTotal STRUCT<PayableAmount: STRUCT<_VALUE: STRING, _currencyID: STRING>>,
InvoiceLine ARRAY<STRUCT<Item: STRUCT<Description: ARRAY<STRING>>>>, CreditNoteLine ARRAY<STRUCT<Item: STRUCT<Description: ARRAY<STRING>>>>,
DebitNoteLine ARRAY<STRUCT<Item: STRUCT<Description: ARRAY<STRING>>>>"""


def read_fx_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Business-day quotes from the JSON feed; buy and sell are found by name, days without data skipped."""
    feed = spark.read.schema(QUOTES_SCHEMA).option("multiLine", True).json(path)
    names = F.transform("config.series", lambda s: F.lower(s["name"]))

    def place(word: str) -> Column:
        return F.array_position(F.transform(names, lambda n: n.contains(word)), F.lit(True)).cast("int") - 1

    rows = feed.select(place("compra").alias("ic"), place("venta").alias("iv"), F.explode("periods").alias("p"))
    months = F.create_map(*[F.lit(x) for pair in FEED_MONTHS.items() for x in pair])
    parts = F.split(F.lower("p.name"), r"\.")
    day = F.make_date(F.get(parts, F.lit(2)).try_cast("int") + 2000, F.try_element_at(months, F.trim(F.get(parts, F.lit(1)))), F.get(parts, F.lit(0)).try_cast("int"))
    quotes = rows.filter("ic >= 0 and iv >= 0").select(
        day.alias("fecha"), F.get(F.col("p.values"), F.col("ic")).try_cast(RATE).alias("compra"), F.get(F.col("p.values"), F.col("iv")).try_cast(RATE).alias("venta"))
    return quotes.filter("compra is not null and venta is not null")


def fx_daily_rows(lines: DataFrame) -> DataFrame:
    """`dd/mm/yyyy|buy|sell|` lines to quotes; other lines are skipped. Works on streams too."""
    parts = F.split("value", r"\|")
    quotes = lines.select(
        F.try_to_timestamp(F.trim(F.get(parts, F.lit(0))), F.lit("dd/MM/yyyy")).cast("date").alias("fecha"),
        F.trim(F.get(parts, F.lit(1))).try_cast(RATE).alias("compra"), F.trim(F.get(parts, F.lit(2))).try_cast(RATE).alias("venta"))
    return quotes.filter("fecha is not null and compra is not null and venta is not null")


def read_fx_daily(spark: SparkSession, path: str) -> DataFrame:
    return fx_daily_rows(spark.read.text(path))


def parse_invoices(files: DataFrame, content: str = "content", descriptions: int | None = None) -> DataFrame:
    """UBL Invoice, CreditNote and DebitNote documents (one per row of bytes) to voucher rows.

    `concepto` joins the descriptions of all items, or of the first `descriptions` with an ellipsis for the rest. Documents
    that are not such XML are dropped.
    """
    declared = F.regexp_extract(F.decode(F.substring(content, 1, 200), "ISO-8859-1"), r"(?i)encoding=[\"']([\w-]+)", 1)
    text = F.when(F.lower(declared).isin("iso-8859-1", "windows-1252", "latin-1"), F.decode(content, "ISO-8859-1")).otherwise(F.decode(content, "UTF-8"))
    root = F.regexp_extract("xml", r"<(?:\w+:)?(Invoice|CreditNote|DebitNote)[\s>]", 1)
    kept = [c for c in files.columns if c != content]
    # Generators keep the filters from pulling the document and its parsing into themselves: each is made once a file.
    once = lambda name, column: F.inline(F.array(F.struct(column.alias(name))))
    docs = files.select(*kept, once("xml", text)).withColumn("raiz", root).filter("raiz <> ''")
    read = docs.select(*kept, "raiz", once("d", F.from_xml("xml", INVOICE_SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})))

    def value(path: str) -> Column:
        return strip(F.coalesce(F.col(f"d.{path}"), F.lit("")))

    party = "AccountingSupplierParty.Party"
    issuer = F.coalesce(F.nullif(value(f"{party}.PartyLegalEntity.RegistrationName"), F.lit("")), value(f"{party}.PartyName.Name"))
    kind = F.when(F.col("raiz") == "CreditNote", "07").when(F.col("raiz") == "DebitNote", "08").otherwise(
        F.coalesce(F.nullif(value("InvoiceTypeCode"), F.lit("")), F.lit("01")))
    lines = F.concat(*[F.coalesce(f"d.{n}", F.array().cast("array<struct<Item:struct<Description:array<string>>>>"))
                       for n in ("InvoiceLine", "CreditNoteLine", "DebitNoteLine")])
    items = F.filter(F.flatten(F.transform(lines, lambda x: F.coalesce(x["Item"]["Description"], F.array().cast("array<string>")))), lambda t: strip(t) != "")
    shown = items if descriptions is None else F.slice(items, 1, descriptions)
    first = F.array_join(F.transform(shown, strip), "; ")
    concept = first if descriptions is None else F.when(F.size(items) > descriptions, F.concat(first, F.lit("…"))).otherwise(first)
    out = read.select(
        *kept, value("ID").alias("id"), issuer.alias("emisor"), value(f"{party}.PartyIdentification.ID").alias("ruc"), kind.alias("tipo"),
        value("LegalMonetaryTotal.PayableAmount._VALUE").alias("monto"), F.coalesce("d.LegalMonetaryTotal.PayableAmount._currencyID", F.lit("")).alias("moneda"),
        value("IssueDate").alias("fecha"), concept.alias("concepto")).filter("id <> ''")
    named = F.create_map(*[F.lit(x) for pair in XML_TYPES.items() for x in pair])
    label = F.coalesce(F.try_element_at(named, F.col("tipo")), F.concat(F.lit("Comprobante "), F.col("tipo")))
    head = F.when(F.col("emisor") != "", F.concat(label, F.lit(" de "), F.col("emisor"))).otherwise(label)
    money = F.when(F.col("monto") != "", F.trim(F.concat_ws(" ", "moneda", "monto")))
    return out.withColumn("descripcion", F.concat_ws(" — ", head, F.nullif(F.col("concepto"), F.lit("")), money))


# Fixed value: item descriptions that a voucher shows.
SHOWN_ITEMS = 2


def read_invoices_xml(spark: SparkSession, path: str, descriptions: int | None = SHOWN_ITEMS) -> DataFrame:
    """Invoice files of a folder (recursive), one voucher per file; None shows the descriptions of all items."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path)
    return parse_invoices(files.select(F.col("path").alias("archivo"), "content"), descriptions=descriptions)


def named_files(files: DataFrame, name: Column | None = None) -> DataFrame:
    """path, nombre, length, content of binary files; `name` where a path does not end in the file's name."""
    shown = F.element_at(F.split("path", "/"), -1) if name is None else name
    return files.select("path", shown.alias("nombre"), "length", "content")


def read_attachments(
    spark: SparkSession, path: str, lengths: tuple[int, int] | None = None, changed: tuple[str, str] | None = None, name: Column | None = None,
) -> DataFrame:
    """Files as bytes: path, nombre, length, content.

    Bounds on the length and the time of the last change reach the source: other files are listed and never opened.
    Contents are read only where they are asked for. Tasks list and read the files where all machines see them.
    """
    listed = list_files(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path) if listed is None else listed
    if lengths is not None:
        files = files.filter(F.col("length").between(*lengths))
    if changed is not None:
        files = files.filter((F.col("modificationTime") >= changed[0]) & (F.col("modificationTime") < changed[1]))
    if listed is not None:
        files = dealt(files, listed.count()).withColumn("content", content_of(F.col("path")))
    return named_files(files, name)
