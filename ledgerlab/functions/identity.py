"""Validated values read from dirty text: taxpayer number, period, money, date, operation number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlab.functions.text import hit, rx, strip
from ledgerlab.functions.values import let

# Check-digit weights and valid prefixes of a taxpayer number.
WEIGHTS = [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]
PREFIXES = ["10", "15", "16", "17", "20"]
# Month names of a tax period, without accents.
PERIOD_MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8,
    "setiembre": 9, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}
FIRST_YEAR, LAST_YEAR = 1993, 2100
# Currency signs, tried in this order.
CURRENCIES = [("s/", "PEN"), ("s/.", "PEN"), ("soles", "PEN"), ("pen", "PEN"),
              ("$", "USD"), ("us$", "USD"), ("usd", "USD"), ("dolares", "USD")]
MAX_AMOUNT = "999999999.99"

_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def without_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{Mn}", "")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, rx(r"\D"), "")


def ruc_is_valid(text: Column) -> Column:
    """Eleven digits, a known prefix and a matching modulus-11 check digit."""
    total = sum((F.substring(text, i + 1, 1).try_cast("int") * w for i, w in enumerate(WEIGHTS[1:], 1)),
                F.substring(text, 1, 1).try_cast("int") * WEIGHTS[0])
    check = (F.lit(11) - total % 11) % 10
    shape = text.rlike("^[0-9]{11}$") & F.substring(text, 1, 2).isin(PREFIXES)
    return F.coalesce(shape & (check == F.substring(text, 11, 1).try_cast("int")), F.lit(False))


def ruc_find(text: Column) -> Column:
    """The first valid number among all 11-digit windows of the text's digits, else NULL."""
    def search(digits: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(digits) - 10, F.lit(1)))
        windows = F.transform(starts, lambda i: F.substring(digits, i, F.lit(11)))
        return F.get(F.filter(windows, ruc_is_valid), F.lit(0))

    return let(digits_of(text), search)


def is_natural_person(ruc: Column) -> Column:
    return ruc.startswith("10")


def parse_period(text: Column) -> Column:
    """'marzo 2026', '202603', '03/2026', '2026-03' or '032026' -> 'YYYYMM', years 1993-2100."""
    return let(without_accents(F.lower(strip(text))), _period_of)


def _period_of(plain: Column) -> Column:
    year, month, loose = r"(?:19|20)\d{2}", "(0[1-9]|1[0-2])", "(0?[1-9]|1[0-2])"

    def both(pattern: str, y: int, m: int) -> Column:
        return F.concat(hit(plain, pattern, y, ""), F.lpad(hit(plain, pattern, m, ""), 2, "0"))

    def named(year_read: Column) -> Column:
        return F.coalesce(*[F.when(plain.contains(name), F.concat(year_read, F.lit(f"{month_no:02d}")))
                            for name, month_no in PERIOD_MONTHS.items()])

    value = F.coalesce(
        let(hit(plain, f"({year})", 1, ""), named),
        both(rf"\b({year}){month}\b", 1, 2),
        both(rf"\b{loose}\s*[/\-.]\s*({year})\b", 2, 1),
        both(rf"\b({year})\s*[/\-.]\s*{loose}\b", 1, 2),
        both(rf"\b{month}({year})\b", 2, 1))
    return let(value, lambda v: F.when(F.substring(v, 1, 4).cast("int").between(FIRST_YEAR, LAST_YEAR), v))


def period_label(period: Column) -> Column:
    """'202603' -> '03/2026'."""
    return F.concat(F.substring(period, 5, 2), F.lit("/"), F.substring(period, 1, 4))


def _decimal(raw: Column) -> Column:
    """Peruvian or English notation: with both separators the last one is the decimal; a single
    separator before exactly three digits, or a repeated one, groups thousands."""
    return let(F.replace(raw, F.lit(" "), F.lit("")), _plain_decimal)


def _plain_decimal(text: Column) -> Column:
    comma, dot = text.contains(","), text.contains(".")
    last_comma = F.length(text) - F.instr(F.reverse(text), ",")
    last_dot = F.length(text) - F.instr(F.reverse(text), ".")
    no_dot, no_comma = F.replace(text, F.lit("."), F.lit("")), F.replace(text, F.lit(","), F.lit(""))

    def single(sep: str) -> Column:
        tail = F.substring_index(text, sep, -1)
        bare = F.replace(text, F.lit(sep), F.lit(""))
        many = F.length(text) - F.length(bare) > 1
        return F.when(many | (F.length(tail) == 3), bare).otherwise(F.replace(text, F.lit(sep), F.lit(".")))

    plain = (
        F.when(comma & dot & (last_comma > last_dot), F.replace(no_dot, F.lit(","), F.lit(".")))
        .when(comma & dot, no_comma).when(comma, single(",")).when(dot, single(".")).otherwise(text))
    return F.bround(plain.try_cast("decimal(38,6)"), 2)


def parse_money(text: Column) -> Column:
    """STRUCT<cantidad DECIMAL(14,2), moneda>, NULL without a number or beyond the maximum."""
    return let(F.lower(strip(text)), _money_of)


def _money_of(lowered: Column) -> Column:
    currency = F.coalesce(*[F.when(lowered.contains(sign), code) for sign, code in CURRENCIES], F.lit("PEN"))
    limit = F.lit(MAX_AMOUNT).cast("decimal(14,2)")
    return let(_decimal(hit(lowered, r"(\d[\d\s.,]*\d|\d)", 1, "")), lambda value: F.when(
        value <= limit, F.struct(value.try_cast("decimal(14,2)").alias("cantidad"), currency.alias("moneda"))))


def money_amount(text: Column) -> Column:
    return parse_money(text).getField("cantidad")


def parse_payment_date(text: Column) -> Column:
    """Day-first date, or ISO; two-digit years are 20xx, impossible dates NULL."""
    day_first = r"\b(\d{1,2})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{2,4})\b"
    iso = r"\b((?:19|20)\d{2})-(\d{1,2})-(\d{1,2})\b"

    def century(year: Column) -> Column:
        return F.when(year.cast("int") < 100, (year.cast("int") + 2000).cast("string")).otherwise(year)

    def built(pattern: str, y: int, m: int, d: int) -> Column:
        year = let(hit(text, pattern, y, ""), century)
        parts = [F.lpad(x, n, "0") for x, n in ((year, 4), (hit(text, pattern, m, ""), 2), (hit(text, pattern, d, ""), 2))]
        return F.concat_ws("-", *parts).try_cast("date")

    return F.when(text.rlike(rx(day_first)), built(day_first, 3, 2, 1)).when(text.rlike(rx(iso)), built(iso, 1, 2, 3))


def parse_operation_number(text: Column) -> Column:
    """Letters, digits and dashes, 4 to 40 of them."""
    bare = F.regexp_replace(text, r"[^A-Za-z0-9\-]", "")
    return let(bare, lambda b: F.when(F.length(b).between(4, 40), b))


def clean_name(text: Column) -> Column:
    """Cut a name where the next label starts and drop trailing signs; at most 120 characters."""
    cut = F.get(F.split(text, rx(r"\s{3,}|\s+(?:ruc|periodo|fecha|importe|monto|operacion)\b", "i"), 2), F.lit(0))
    return F.substring(F.coalesce(F.regexp_replace(strip(cut), rx(r"[\s:;,.\-]+$"), ""), F.lit("")), 1, 120)


def normalize_code(text: Column) -> Column:
    """'R.U.C' -> 'RUC', at most 40 characters."""
    return F.substring(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), rx(r"[.\s]+"), "")), 1, 40)
