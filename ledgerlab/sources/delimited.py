"""Delimited files to DataFrames and to Parquet datasets."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlab.errors import EmptyDataset, InvalidSpec
from ledgerlab.operators.tables import schema_of
from ledgerlab.session import path_exists
from ledgerlab.sources.lines import WINDOWS, after_first, fields_of, first_lines, line_position, text_lines, windows_text

# How badly formed a file may be, from strict to everything as text without quotes.
LADDER = ["normal", "padded", "raw"]
CORRUPT = "_corrupt_record"
# Columns of lines read as text.
RAW_COLUMNS = 1000


def encodings_of(spark: SparkSession, path: str) -> list[tuple[str, str | None, list[str]]]:
    """(encoding, line separator, files) of each encoding found; a file has one of its own.

    UTF-16 by the mark its first line begins with, UTF-8 when all its lines are valid, else Windows-1252 when
    it has that page's extra letters, else Latin-1. The separator is given for UTF-16 only, where lines end in
    two-byte characters.
    """
    raw, line = F.hex(F.col("value").cast("binary")), F.col("value").cast("binary")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("archivo"), line_position().alias("line_no"), F.is_valid_utf8("value").alias("utf8"),
        F.substring(raw, 1, 4).alias("mark"), raw.endswith("0D00").alias("crlf"),
        F.decode(line, "ISO-8859-1").rlike("[\\x{80}-\\x{9f}]").alias("extra"))
    files = lines.groupBy("archivo").agg(
        F.min_by("mark", "line_no").alias("mark"), F.bool_and("utf8").alias("utf8"), F.bool_or("crlf").alias("crlf"),
        F.bool_or("extra").alias("extra"))
    name = (F.when(F.col("mark") == "FFFE", "UTF-16LE").when(F.col("mark") == "FEFF", "UTF-16BE").when(F.col("utf8"), "UTF-8")
            .when(F.col("extra"), "windows-1252").otherwise("ISO-8859-1"))
    wide = name.startswith("UTF-16")
    end = F.when(wide & F.col("crlf"), "\r\n").when(wide, "\n")
    named = files.select(name.alias("encoding"), end.alias("fin"), "archivo")
    groups = named.groupBy("encoding", "fin").count().orderBy(F.desc("count"), "encoding", "fin").collect()  # six at most
    if len(groups) <= 1:  # the folder as it is: no names are gathered
        return [(g.encoding, g.fin, [path]) for g in groups] or [("UTF-8", None, [path])]
    # A reader of some files of a folder is given their names, as many as its own list of files holds.
    same = lambda g: (F.col("encoding") == g.encoding) & F.col("fin").eqNullSafe(g.fin)
    return [(g.encoding, g.fin, [row.archivo for row in named.filter(same(g)).orderBy("archivo").toLocalIterator()]) for g in groups]


def _reader(spark: SparkSession, sep: str, encoding: str, line_end: str | None, header: bool):
    reader = (spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
              .option("preferDate", True).option("multiLine", False))
    return reader.option("lineSep", line_end) if line_end else reader


def _parsed(spark: SparkSession, files: list[str], sep: str, encoding: str, line_end: str | None, header: bool, mode: str) -> DataFrame:
    if encoding.lower() not in ("windows-1252", "cp1252"):
        return _read(spark, files, sep, encoding, line_end, header, mode)
    # Spark's reader has no such charset: read as Latin-1, then put its letters right.
    df = _read(spark, files, sep, "ISO-8859-1", line_end, header, mode)
    texts = [field.name for field in df.schema if field.dataType.simpleString() == "string"]
    df = df.withColumns({name: windows_text(F.col(f"`{name}`")) for name in texts})
    return df.toDF(*[name.translate(str.maketrans(WINDOWS)) for name in df.columns])


def _read(spark: SparkSession, files: list[str], sep: str, encoding: str, line_end: str | None, header: bool, mode: str) -> DataFrame:
    """Files of one encoding with inferred types; `padded` has the lines that were no whole rows in a column of their own."""
    reader = _reader(spark, sep, encoding, line_end, header)
    if mode == "normal":
        df = reader.option("mode", "FAILFAST").option("inferSchema", True).option("enforceSchema", not header).csv(files)
        return df.toDF(*[c.lstrip("﻿") for c in df.columns])
    schema = reader.option("inferSchema", True).option("mode", "PERMISSIVE").csv(files).schema
    names = [c.lstrip("﻿") for c in schema.names]
    df = reader.schema(schema.add(CORRUPT, "string")).option("columnNameOfCorruptRecord", CORRUPT).csv(files)
    return df.toDF(*names, CORRUPT)


def _as_text_lines(spark: SparkSession, files: list[str], encoding: str, line_end: str | None) -> DataFrame:
    """Lines (archivo, line_no, value) of files of one encoding."""
    if not encoding.startswith("UTF-16"):
        return text_lines(spark, files)
    # A separator no text holds leaves each line whole.
    lines = _reader(spark, "\u0001", encoding, line_end, False).option("quote", "").schema("value string").csv(files)
    return lines.select(F.col("_metadata.file_path").alias("archivo"), line_position().alias("line_no"),
                        F.regexp_replace("value", "^﻿", "").alias("value")).filter(F.trim("value") != "")


def _raw(spark: SparkSession, files: list[str], sep: str, encoding: str, line_end: str | None, header: bool) -> DataFrame:
    """Everything as text without quoting; the longest line decides how many columns there are, so none is lost.

    A table holds only so many columns: what a line has beyond them stays, unsplit, in the last one.
    """
    lines = _as_text_lines(spark, files, encoding, line_end)
    head = fields_of(first_lines(lines, 1), sep, RAW_COLUMNS).orderBy("archivo").first() if header else None
    rows = fields_of(after_first(lines, 1) if header else lines, sep, RAW_COLUMNS)
    width = max(rows.agg(F.max(F.size("c"))).first()[0] or 0, len(head.c) if head else 0)
    names, seen = [], set()
    for k in range(width):
        name = head.c[k].strip() if head and k < len(head.c) and head.c[k].strip() else f"_c{k}"
        names.append(f"{name}_{k}" if name.lower() in seen else name)
        seen.add(names[-1].lower())
    return rows.select(*[F.nullif(F.get("c", F.lit(k)), F.lit("")).alias(name) for k, name in enumerate(names)])


def _stacked(parts: list[DataFrame]) -> DataFrame:
    """Parts by column name; a column whose types differ becomes text."""
    kinds: dict[str, set] = {}
    for part in parts:
        for field in part.schema:
            kinds.setdefault(field.name, set()).add(field.dataType.simpleString())
    mixed = [name for name, held in kinds.items() if len(held) > 1]
    parts = [part.withColumns({name: F.col(f"`{name}`").cast("string") for name in mixed if name in part.columns}) for part in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, header: bool = True, mode: str = "normal",
) -> DataFrame:
    """A CSV/TXT file or folder with inferred types; files of a folder may differ in their encoding.

    `normal` fails on a line that is no whole row, `padded` keeps short rows (NULL-padded) and has such lines whole in
    `_corrupt_record`, `raw` reads everything as text without quoting and gives longer lines further columns.
    """
    if mode not in LADDER:
        raise InvalidSpec(f"unknown mode: {mode!r}")
    if sep is None:
        from ledgerlab.operators.profile import delimiter_of

        sep = delimiter_of(spark, path)
    groups = [(encoding, None, [path])] if encoding else encodings_of(spark, path)
    read = _raw if mode == "raw" else lambda *given: _parsed(*given, mode)
    return _stacked([read(spark, files, sep, found, line_end, header) for found, line_end, files in groups])


def _malformed(failed: Exception) -> bool:
    """Whether a failure is about what a file holds; all others (a lost disk, no access) are raised."""
    return "MALFORMED" in str(failed) or "CSV header does not conform" in str(failed)


def field_count(line: Column, sep: str) -> Column:
    """How many fields a line has, separators within quotes aside.

    A scan with two states, as a fold over the pieces between quotes: every quote turns from outside to inside and back
    (a doubled quote does so twice), and only pieces outside count. Linear in the line, however long a quoted field is.
    What follows a quote that is never closed counts as outside, so no field is overlooked.
    """
    pieces = F.split(line, '"')
    separators = lambda piece: ((F.length(piece) - F.length(F.replace(piece, F.lit(sep), F.lit("")))) / len(sep)).cast("int")

    def step(state: Column, piece: Column) -> Column:
        here = separators(piece)
        return F.struct((~state["inside"]).alias("inside"), F.when(state["inside"], state["n"]).otherwise(state["n"] + here).alias("n"),
                        F.when(state["inside"], here).otherwise(F.lit(0)).alias("unclosed"))

    start = F.struct(F.lit(False).alias("inside"), F.lit(1).alias("n"), F.lit(0).alias("unclosed"))
    # The last piece lies inside quotes where their number is odd: then the quote was never closed.
    return F.aggregate(pieces, start, step, lambda state: state["n"] + state["unclosed"])


def _has_surplus(stored: DataFrame, sep: str) -> bool:
    """Whether a padded line held more fields than there are columns: those would be lost."""
    fields = field_count(F.col(CORRUPT), sep)
    return not stored.filter(fields > len(stored.columns) - 1).isEmpty()


def ingest(spark: SparkSession, path: str, dest: str, sep: str | None = None, **options) -> tuple[list[dict], int]:
    """Convert a file to a Parquet dataset at `dest`; returns its schema and row count.

    Badly formed files fall back through the ladder, and no rung loses a field; a file without rows is an
    error and leaves nothing behind. The rung is the name of the dataset's last folder.
    """
    if path_exists(spark, dest):
        raise InvalidSpec(f"a dataset already exists at {dest}")
    if sep is None:
        from ledgerlab.operators.profile import delimiter_of

        sep = delimiter_of(spark, path)
    for step in LADDER:
        target = f"{dest.rstrip('/')}/{step}"
        try:
            df = read_delimited(spark, path, sep=sep, mode=step, **options)
            if df.isEmpty():
                raise EmptyDataset(f"{path} holds no rows")
            df.write.mode("errorifexists").parquet(target)
        except (PySparkException, Py4JJavaError) as failed:
            if step == LADDER[-1] or not _malformed(failed):
                raise
            continue
        stored = spark.read.parquet(target)
        if step == "padded" and _has_surplus(stored, sep):
            continue
        stored = open_dataset(spark, dest)
        return schema_of(stored), stored.count()


def rung(spark: SparkSession, dest: str) -> str:
    """The step of the ladder that wrote a dataset."""
    return next(step for step in reversed(LADDER) if path_exists(spark, f"{dest.rstrip('/')}/{step}/_SUCCESS"))


def open_dataset(spark: SparkSession, dest: str) -> DataFrame:
    """The dataset `ingest` stored."""
    return spark.read.parquet(f"{dest.rstrip('/')}/{rung(spark, dest)}").drop(CORRUPT)
