"""Ledger text -> amounts, dates, voucher types and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlab.functions.text import strip
from ledgerlab.functions.values import let

MONEY = "decimal(18,2)"

# Names of voucher types with their codes; exact first, then as a prefix, in order.
TYPE_NAMES = {
    "BOLETA": "03", "BOLETA DE VENTA": "03", "FACTURA": "01", "FACTURA ELECTRONICA": "01", "FACTURA ELECTRÓNICA": "01",
    "NOTA DE CREDITO": "07", "NOTA DE CRÉDITO": "07", "NOTA DE DEBITO": "08", "NOTA DE DÉBITO": "08", "TICKET": "03",
    "LIQUIDACION DE COMPRA": "04", "LIQUIDACIÓN DE COMPRA": "04", "GUIA DE REMISION": "09", "GUÍA DE REMISIÓN": "09",
}


def _rightmost(text: Column, sign: str) -> Column:
    """Position of the last occurrence, 0 when absent."""
    return F.when(F.instr(text, sign) > 0, F.length(text) - F.instr(F.reverse(text), sign) + 1).otherwise(0)


# All signs that a number's text may consist of.
_NUMERIC = r"^[\x00-\x20+\-.eE\p{Nd}]+$"
# Plain amounts, which need no separators told apart, and texts that hold a sign of no number at all.
_PLAIN, _NO_NUMBER = r"^-?[0-9]{1,16}(\.[0-9]{1,6})?$", r"[/:A-DF-Za-df-z]"


def _decimal_or_zero(text: Column, dtype: str) -> Column:
    """The text as a decimal, junk is 0. Empty text and what cannot be a number are not read: a failed reading costs far more than the look."""
    read = F.when(text.rlike(_NUMERIC), text.try_cast("decimal(38,6)").try_cast(dtype))
    return F.coalesce(read, F.lit(0).cast(dtype))


def parse_amount(value: Column, dtype: str = MONEY) -> Column:
    """Number text to a decimal; the separator that comes last is the decimal one, junk is 0."""
    def read(text: Column) -> Column:
        european = F.translate(text, ",.", ".")
        english = F.replace(text, F.lit(","), F.lit(""))
        plain = F.when(_rightmost(text, ",") > _rightmost(text, "."), european).otherwise(english)
        return _decimal_or_zero(plain, dtype)
    # Nearly all values are plain or no number, which two patterns tell; the rest is read in steps.
    text, zero = value.cast("string"), F.lit(0).cast(dtype)
    return F.when(text.rlike(_PLAIN), F.coalesce(text.try_cast(dtype), zero)).when(text.isNull() | text.rlike(_NO_NUMBER), zero).otherwise(let(strip(text), read))


def dot_amount(value: Column, dtype: str = MONEY) -> Column:
    """Authority notation: a comma is a decimal point, junk is 0."""
    plain = F.replace(strip(F.coalesce(value, F.lit(""))), F.lit(","), F.lit("."))
    return _decimal_or_zero(plain, dtype)


def plain_amount(value: Column, dtype: str = MONEY) -> Column:
    """Book notation: commas group thousands, junk is 0."""
    bare = F.replace(strip(F.coalesce(value, F.lit(""))), F.lit(","), F.lit(""))
    return _decimal_or_zero(bare, dtype)


def strict_amount(value: Column, dtype: str = MONEY) -> Column:
    """Plain decimal text, 0 when it is anything else."""
    return _decimal_or_zero(strip(value), dtype)


def rate_or_one(rate: Column) -> Column:
    """An exchange rate of 0 stands for none: 1."""
    return F.when(rate == 0, F.lit(1).cast("decimal(9,3)")).otherwise(rate)


def parse_date_text(value: Column) -> Column:
    """'5/1/2024' -> '2024-01-05'; any other text unchanged."""
    def read(text: Column) -> Column:
        parts = F.split(text, "/")
        iso = F.concat(F.get(parts, F.lit(2)), F.lit("-"), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lit("-"), F.lpad(F.get(parts, F.lit(0)), 2, "0"))
        return F.when(text.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), iso).otherwise(text)
    return let(strip(F.coalesce(value.cast("string"), F.lit(""))), read)


def parse_date(value: Column) -> Column:
    """Date of a ledger text, NULL when it is none."""
    return let(parse_date_text(value), lambda t: F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t.try_cast("date")))


def book_date(value: Column) -> Column:
    """Strict d/m/yyyy date from 1900 on; '01/01/0001' is the book's empty date."""
    return let(parse_date(value), lambda d: F.when(F.year(d) >= 1900, d))


def normalize_doc_type(value: Column) -> Column:
    """'PE03' -> '03', a Spanish name -> its code, '3' -> '03', anything else unchanged."""
    def read(text: Column) -> Column:
        out = F.when(text.rlike(r"^\p{L}{2}[0-9]{2}$"), F.substring(text, 3, 2))
        for name, code in TYPE_NAMES.items():
            out = out.when(text == name, code)
        for name, code in TYPE_NAMES.items():
            out = out.when(text.startswith(name), code)
        return out.when(text.rlike("^[1-9]$"), F.concat(F.lit("0"), text)).otherwise(text)
    return let(F.upper(strip(F.coalesce(value, F.lit("")))), read)


def split_number(value: Column) -> tuple[Column, Column]:
    """'F001-123' -> ('F001', '123'); a number without a dash has no series."""
    parts = F.split(value, "-", 2)
    paired = F.size(parts) > 1
    return F.when(paired, F.upper(F.get(parts, F.lit(0)))).otherwise(""), F.when(paired, F.get(parts, F.lit(1))).otherwise(value)
