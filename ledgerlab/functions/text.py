"""Regex extraction over text columns, JVM-side.

Patterns run with Unicode classes and `\\n` as the only line end; a missing match is NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlab.functions.values import let

BLANKS = " \t\n\r\x0b\x0c\xa0"

# Spanish month names and abbreviations.
MONTHS = {
    "ENERO": 1, "FEBRERO": 2, "MARZO": 3, "ABRIL": 4, "MAYO": 5, "JUNIO": 6, "JULIO": 7, "AGOSTO": 8,
    "SEPTIEMBRE": 9, "OCTUBRE": 10, "NOVIEMBRE": 11, "DICIEMBRE": 12, "ENE": 1, "FEB": 2, "MAR": 3, "ABR": 4,
    "MAY": 5, "JUN": 6, "JUL": 7, "AGO": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DIC": 12,
}
# A taxpayer number anywhere in a text, an hour, a voucher, a due date.
RUC = r"\b(?:10|15|17|20)\d{9}\b"
DAY = r"\d{2}[/\-]\d{2}[/\-]\d{4}"
DUE = (r"(?:VENCIMIENTO|VENCE|FECHA\s+VENC\.?|PAGAR\s+ANTES\s+DEL?)\s*[:\-]?\s*"
       r"(\d{2}[/\-]\d{2}[/\-]\d{4}|\d{2}/[A-Z]{3}/\d{4})")
DATE_CONTEXTS = [
    r"(?:Emisi[oó]n|Emitid[ao]|Fecha[:\s]+)\s*[:\s]*(\d{2}[/\-]\d{2}[/\-]\d{2,4})",
    r"(\d{2}[/\-]\d{2}[/\-]\d{4})",
    r"(\d{4}[/\-]\d{2}[/\-]\d{2})",
    r"(\d{2}[/\-]\d{2}[/\-]\d{2})",
]
VOUCHER_STRICT = r"\b([A-Z]\d{3})\s*[-–]\s*(\d{5,9})\b"
VOUCHER_LOOSE = r"\b([A-Z]{1,3}\d*[-–]\d+)\b"
VOUCHER_LABELLED = r"[Ss]erie[:\s]+([A-Z0-9]+).*?[Nn][uúu]m(?:ero)?[:\s]+(\d+)"
AMOUNT = r"([\d,]+\.\d{1,2})"


def rx(pattern: str, flags: str = "") -> str:
    """A pattern with the library's flags; add `i`, `s` or `m` as needed."""
    return f"(?Ud{flags}){pattern}"


def hit(text: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    """A group of the first match, NULL without one. The match is bound: a bare comparison would look for it twice."""
    return let(F.regexp_extract(text, rx(pattern, flags), group), lambda match: F.when(match != "", match))


def found(text: Column, pattern: str, flags: str = "i") -> Column:
    return text.rlike(rx(pattern, flags))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def grab(text: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    """`hit`, stripped."""
    return strip(hit(text, pattern, group, flags))


def guarded(text: Column, needle: str, value: Column) -> Column:
    """Evaluate a costly pattern only on texts that hold its cheap part."""
    return F.when(found(text, needle), value)


def quoted(label: str) -> str:
    """A label as a literal pattern."""
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in label)


def number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def clean_text(text: Column) -> Column:
    """Collapse blanks within lines and runs of three or more newlines."""
    flat = F.regexp_replace(text, rx(r"[^\S\n]+"), " ")
    return strip(F.regexp_replace(flat, rx(r"\n{3,}"), "\n\n"))


def first_ruc(text: Column) -> Column:
    return hit(text, RUC, 0, "")


def all_rucs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rx(f"({RUC})")), F.lit(1))


def ruc_at(text: Column, position: int) -> Column:
    """The n-th taxpayer number (from 0)."""
    return F.get(all_rucs(text), F.lit(position))


# What a pattern takes for these letters, whatever their case, though it stays itself in upper case.
_ALSO = {"I": "\u0130", "K": "\u212a"}


def holds(upper: Column, word: str) -> Column:
    """Whether a text in upper case holds a word, or a sign that patterns take for one of its letters: cheap, and no match of the word goes without."""
    signs = [word.upper(), *[sign for letter, sign in _ALSO.items() if letter in word.upper()]]
    return reduce(lambda a, b: a | b, [upper.contains(sign) for sign in signs])


def word_first(name: str) -> str:
    """A literal pattern at the start of a word. The letter is looked for before the start: fewer places of a text are tried."""
    return rf"{name[0]}(?<=\b{name[0]}){name[1:]}" if name[0].isalpha() else rf"\b{name}"


def amount(text: Column, labels: list[str], upper: Column | None = None) -> Column:
    """Amount after the first label that has one: the `S/` form first, then the bare form.

    A bare TOTAL does not count when it is part of "Sub Total". With the text in upper case, a label is only looked for in texts that hold it.
    """
    forms = []
    for label in labels:
        name = quoted(label)
        start, bare = word_first(name), word_first(name)
        if label.upper() in ("TOTAL", "TOTAL:"):
            bare = rf"(?<!Sub\s)(?<!sub\s)(?<!SUB\s)\b{name}"
        found_forms = [number(hit(text, rf"{start}\b[^\n]{{0,25}}?S/\s*{AMOUNT}")), number(hit(text, rf"{bare}\b\s*[:\.]?\s*{AMOUNT}"))]
        forms += found_forms if upper is None else [F.when(holds(upper, label), F.coalesce(*found_forms))]
    return F.coalesce(*forms)


def iso_date(raw: Column) -> Column:
    """'05/01/2024' or '2024-01-05' -> ISO text; two-digit years are 20xx."""
    def joined(parts: Column) -> Column:
        first, middle, last = (F.get(parts, F.lit(i)) for i in range(3))
        year = F.when(F.length(last) == 4, last).otherwise(F.concat(F.lit("20"), last))
        return F.when(F.length(first) == 4, F.concat(first, F.lit("-"), middle, F.lit("-"), last)).otherwise(
            F.concat(year, F.lit("-"), middle, F.lit("-"), first))

    return let(F.split(raw, r"[/\-]"), joined)


def any_date(text: Column) -> Column:
    """First date: next to an issue label, then d/m/yyyy, y/m/d, d/m/yy."""
    return iso_date(F.coalesce(*[hit(text, p) for p in DATE_CONTEXTS]))


def month_number(name: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(named, name)


def short_month_date(text: Column) -> Column:
    """'05/ENE/2024' -> '2024-01-05'."""
    def joined(upper: Column) -> Column:
        month = F.lpad(month_number(hit(upper, r"^\d{2}/([A-Z]{3})/\d{4}", 1, "")).cast("string"), 2, "0")
        return F.concat(hit(upper, r"^\d{2}/[A-Z]{3}/(\d{4})", 1, ""), F.lit("-"), month, F.lit("-"), F.substring(upper, 1, 2))

    return let(F.upper(text), joined)


def labelled_date(text: Column, pattern: str) -> Column:
    """The date a labelled pattern captures, with a numeric or abbreviated month."""
    return let(hit(text, pattern), lambda raw: F.coalesce(short_month_date(raw), any_date(raw)))


def due_date(text: Column) -> Column:
    return labelled_date(text, DUE)


def time_of_day(text: Column) -> Column:
    """First h:mm[:ss] as HH:mm:ss."""
    pattern = r"\b(\d{1,2}):(\d{2})(?::(\d{2}))?\b"
    return F.concat(F.lpad(hit(text, pattern, 1, ""), 2, "0"), F.lit(":"), hit(text, pattern, 2, ""), F.lit(":"),
                    F.coalesce(hit(text, pattern, 3, ""), F.lit("00")))


def month_named(text: Column) -> Column:
    return month_number(hit(F.upper(text), rf"\b({'|'.join(MONTHS)})\b", 1, ""))


def year_in(text: Column) -> Column:
    return hit(text, r"\b(20\d{2})\b", 1, "").cast("int")


def voucher(text: Column) -> tuple[Column, Column]:
    """(series, number) of the first voucher: F001-00001, then looser forms, then labelled ones."""
    strict = hit(text, VOUCHER_STRICT, 1, "")
    loose = hit(text, VOUCHER_LOOSE, 1, "")
    parts = F.split(loose, "[-–]", 2)
    # The labelled form spans lines: look for it only where both labels are.
    both = found(text, r"[Ss]erie[:\s]", "") & found(text, r"[Nn][uúu]m(?:ero)?[:\s]", "")
    labelled = [F.when(both, hit(text, VOUCHER_LABELLED, g, "s")) for g in (1, 2)]
    return tuple(
        F.when(strict.isNotNull(), hit(text, VOUCHER_STRICT, g, ""))
        .when(loose.isNotNull(), F.nullif(F.get(parts, F.lit(g - 1)), F.lit("")))
        .otherwise(labelled[g - 1]) for g in (1, 2))


def lines_of(text: Column) -> Column:
    """Non-blank stripped lines, in order."""
    lines = F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip)
    return F.filter(lines, lambda line: line != "")


def first_of(array: Column) -> Column:
    return F.get(array, F.lit(0))
